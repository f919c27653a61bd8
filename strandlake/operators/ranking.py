"""Numbers over a whole sorted table without passing it through one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def use_checkpoints(spark: SparkSession) -> None:
    """The checkpoint folder of the session; where it names none, a temporary one in local mode, and an error on a cluster."""
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(found)


def numbered(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 by ``order``, which should leave no ties.

    The rows are sorted by ranges and stored in the checkpoint folder; the sizes of the sorted parts, a row each, give the
    number at which each part begins.
    """
    use_checkpoints(rows.sparkSession)
    at = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True)
    at = at.withColumn("_part", F.shiftrightunsigned("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("_part", before.alias("_before"))
    return at.join(F.broadcast(begins), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_at", "_part", "_place", "_before")
