"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with over this many rows, and over a thousandth of all, is split.
HOT, PARTS = 100_000, 1_000


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], hot: int = HOT) -> DataFrame:
    """Inner join on ``keys``; keys of which ``many`` has very many rows are dealt over slots, and their rows of ``few`` go to each slot.

    ``many`` is read three times: store it before. There are fewer than ``PARTS`` hot keys, whatever the size.
    """
    total = many.count()
    least = max(hot, total // PARTS)
    sizes = many.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > least)
    slots = F.broadcast(sizes.select(*keys, F.ceil(F.col("_n") / least).cast("int").alias("_slots")))
    n = F.coalesce("_slots", F.lit(1))
    left = many.join(slots, keys, "left").withColumn("_slot", F.pmod(F.xxhash64(*many.columns), n).cast("int")).drop("_slots")
    right = few.join(slots, keys, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), n - 1))).drop("_slots")
    return left.join(right, [*keys, "_slot"]).drop("_slot")
