"""As-of joins: for each row the latest row of another table at or before its time, of the same key.

Both tables are united and a window carries the last right row forward, so nothing is paired. A key that holds a third of all
rows is cut into ranges of time: a window runs inside a range, and what a range inherits is the last right row of the
ranges before, found among one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, span: str = "month", tie: str | None = None) -> DataFrame:
    """``left``'s rows, each with ``right_at`` and ``matched``, a struct of right's other columns, of the latest right row whose
    time isn't after its own; nulls where there is none.

    Of right rows of one key and time the largest by ``tie``, or by all their columns, stands. Rows of left with a null key or time match
    nothing, and such right rows are never matched; repeated left rows are all kept. ``span``: the ranges, by ``date_trunc``.
    """
    others = [c for c in right.columns if c not in (key, at)]
    mine = [c for c in left.columns]
    values = F.struct(*[F.col(c) for c in ([tie] if tie else []) + [c for c in others if c != tie]])
    from_right = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(at).alias("_at")).agg(F.max(values).alias("_value"))
    from_left = left.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.struct(*[F.col(c) for c in mine]).alias("_row"))
    both = from_left.withColumn("_value", F.lit(None).cast(from_right.schema["_value"].dataType)).unionByName(from_right.withColumn("_row", F.lit(None).cast(from_left.schema["_row"].dataType)))
    both = both.withColumn("_range", F.date_trunc(span, F.col("_at").cast("timestamp")))
    entry = F.when(F.col("_value").isNotNull(), F.struct("_at", "_value"))
    # A right row comes before left rows of its time.
    inside = Window.partitionBy("_key", "_range").orderBy("_at", F.col("_value").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_own", F.last(entry, ignorenulls=True).over(inside))
    ranges = both.groupBy("_key", "_range").agg(F.max(entry).alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ranges.select("_key", "_range", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    rows = carried.where(F.col("_row").isNotNull()).join(inherited, ["_key", "_range"], "left")
    known = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    match = F.when(known, F.coalesce("_own", "_before"))
    return rows.select("_row", match.alias("_match")).select(*[F.col("_row")[c].alias(c) for c in mine], F.col("_match._at").alias("right_at"), F.col("_match._value").alias("matched"))


def correction_rates(reviewed: DataFrame, predicted: Column, corrected: Column, by: list[str]) -> DataFrame:
    """Reviews, those with a valid prediction, and the share of these that a reviewer changed."""
    judged = predicted.isNotNull() & corrected.isNotNull()
    changed = judged & (predicted != corrected)
    return reviewed.groupBy(*by).agg(F.count("*").alias("reviews"), F.count_if(judged).alias("judged"), F.count_if(changed).alias("corrected"), F.try_divide(F.count_if(changed).cast("double"), F.count_if(judged)).alias("correction_rate"))
