"""Files of the warehouse through Hadoop's file system, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import BackupTargetExists, StorageError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def list(self, name: str) -> list[str]:
        p = self._path(name)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Writes a file whole under another name, then gives it its own; fails if that is taken, which makes commits atomic."""
        new, to = self._path(f"{name}.new-{id(self)}"), self._path(name)
        stream = self.fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(to) or not self.fs.rename(new, to):
            self.fs.delete(new, False)
            raise StorageError(f"{name} was written by another")

    def move(self, name: str, to: str) -> bool:
        """Gives a file or folder another name; false if another has moved it already."""
        self.fs.mkdirs(self._path(to).getParent())
        return self.fs.exists(self._path(name)) and not self.exists(to) and self.fs.rename(self._path(name), self._path(to))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def copy_all(self, target: str) -> None:
        to = self.jvm.org.apache.hadoop.fs.Path(target)
        there = to.getFileSystem(self.conf)
        if there.exists(to):
            raise BackupTargetExists(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(""), there, to, False, self.conf)
