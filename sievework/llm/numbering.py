"""Dense global row numbers without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import store

_PLACE_BITS = 33


def ordered(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` with ``row_number`` (from 0) in the given order, in files of the shared folder.

    Rows are dealt by ranges and sorted inside them; a row's number is its place in its range plus the
    rows of the ranges before, one number a range. Numbers follow from the rows and the order alone, not
    from files or partitions; rows that the order doesn't tell apart take theirs in any order, and are
    split over ranges by their place in the scan.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = [*order, F.col("_nth")]
    dealt = df.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(parts, *full).sortWithinPartitions(*full).drop("_nth")
    placed = store.written(dealt.withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", _PLACE_BITS)
    sums = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.broadcast(sums.select("_part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("_before")))
    place = F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return placed.withColumn("_part", part).join(before, "_part").withColumn("row_number", F.col("_before") + place).drop("_part", "_before", "_at")
