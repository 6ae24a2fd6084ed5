"""What all parts need of a cluster: this package on Python workers, and a folder that driver and executors share."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's code to the executors, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for d, _, names in os.walk(top):
            for x in sorted(names):
                if x.endswith(".py"):
                    z.write(p := os.path.join(d, x), os.path.relpath(p, os.path.dirname(top)))
    path = os.path.join(tempfile.mkdtemp(prefix="heronlake"), "heronlake_code.zip")  # the driver's own copy, which Spark serves to executors
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="heronlake-checkpoints"))
    return named or sc.getCheckpointDir()
