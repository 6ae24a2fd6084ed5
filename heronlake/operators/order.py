"""Places of rows in a global order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_dir

#: monotonically_increasing_id has the row's place in its partition in so many bits.
_ROW_BITS = 33


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, and still there when executors are lost."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/heronlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(ordered: DataFrame, to: str = "place") -> DataFrame:
    """An ordered frame's rows with their place from 1, without a task that sees them all; in no order itself.

    Rows get the number of their sorted partition and their place in it, as a table, since another run might divide them
    otherwise; then the count of the partitions before is added, one row for each partition.
    """
    at = F.monotonically_increasing_id()
    rows = kept(ordered.select("*", F.shiftright(at, _ROW_BITS).alias("_part"), at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_at")))
    before, counts = 0, []
    for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():  # one row for each partition
        counts.append((r[0], before))
        before += r.n
    starts = ordered.sparkSession.createDataFrame(counts, "_part long, _before long")
    return rows.join(F.broadcast(starts), "_part").withColumn(to, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")
