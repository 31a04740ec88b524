"""Duplicate isolation and the temporal split, with their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework import schemas as S
from sievework.functions import stats


def classify(rows: DataFrame, fingerprint: Column, label: Column, order: list[Column], day: Column | None = None, *, start: str = S.WINDOW_START, validation: str = S.VALIDATION_START, test: str = S.TEST_START, end: str = S.WINDOW_END) -> DataFrame:
    """Adds fingerprint, disposition, exclusion_reason and, with a day, split_assignment.

    A fingerprint of two labels excludes all its rows; otherwise the first row by ``order`` stays. Both
    need the fingerprint's extremes only: aggregates that combine before the shuffle, and a join whose
    large side can be split, so a text that a third of all rows share is not gathered in one task.
    """
    keyed = rows.withColumn("fingerprint", fingerprint).withColumn("_label", label).withColumn("_order", F.struct(*order))
    groups = keyed.groupBy("fingerprint").agg(F.min("_label").alias("_least"), F.max("_label").alias("_most"), F.min("_order").alias("_first"))
    joined = keyed.join(groups, "fingerprint")
    disposition = F.when(F.col("_least") != F.col("_most"), S.DISPOSITIONS[2]).when(F.col("_order") != F.col("_first"), S.DISPOSITIONS[1]).otherwise(S.DISPOSITIONS[0])
    out = joined.withColumn("disposition", disposition).withColumn("exclusion_reason", F.when(F.col("disposition") != S.DISPOSITIONS[0], F.col("disposition")))
    if day is not None:
        assigned = stats.temporal_assignment(day, validation, test, start, end)
        out = out.withColumn("split_assignment", F.when(F.col("disposition") == S.DISPOSITIONS[0], assigned))
    return out.drop("_label", "_order", "_least", "_most", "_first")


def ranked_duplicates(rows: DataFrame, fingerprint: Column, order: list[Column], cells: int = 64) -> DataFrame:
    """Rows with their rank among equal fingerprints.

    Ranks are counted inside ``cells`` ranges of the order and shifted by the counts of the ranges before, so
    a very common fingerprint is cut into as many parts. The ranges' bounds are a few rows, the least by a hash.
    """
    keyed = rows.withColumn("_print", fingerprint).withColumn("_order", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    few = keyed.select("_order").distinct().orderBy(F.xxhash64("_order")).limit(cells - 1).select(F.sort_array(F.collect_list("_order").over(Window.partitionBy())).alias("_bounds")).limit(1)
    bounds = F.broadcast(rows.sparkSession.range(1).join(few, how="left").select(F.coalesce("_bounds", F.array()).alias("_bounds")))  # one row
    dealt = keyed.join(bounds).withColumn("_cell", F.size(F.filter("_bounds", lambda b: b <= F.col("_order")))).drop("_bounds")
    sizes = dealt.groupBy("_print", "_cell").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_print").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("_print").alias("_p"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    local = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_print", "_cell").orderBy("_order")))
    ranked = local.join(before, F.col("_print").eqNullSafe(F.col("_p")) & (F.col("_cell") == F.col("_c")))
    return ranked.select(*rows.columns, (F.col("_before") + F.col("_rn")).cast("int").alias("rank"))


def split_counts(split: DataFrame) -> DataFrame:
    """Seven filtered counts of a split in one pass."""
    kept = lambda name: F.count_if(F.col("split_assignment") == name)
    of = lambda name: F.count_if(F.col("disposition") == name)
    return split.agg(
        F.count("*").alias("input_record_count"),
        of("included").alias("included_record_count"),
        of("duplicate_same_label").alias("same_label_duplicate_count"),
        of("duplicate_label_conflict").alias("label_conflict_count"),
        kept("train").alias("train_record_count"),
        kept("validation").alias("validation_record_count"),
        kept("test").alias("test_record_count"),
    )


def leaking_fingerprints(split: DataFrame) -> DataFrame:
    """Fingerprints that are in more than one split; none in a sound one."""
    return split.where("split_assignment IS NOT NULL").groupBy("fingerprint").agg(F.min("split_assignment").alias("a"), F.max("split_assignment").alias("b")).where("a != b").select("fingerprint")


def label_conflicts(rows: DataFrame, key: str, label: str) -> DataFrame:
    """Whether rows of a key have more than one label, and how many rows they are."""
    return rows.groupBy(key).agg(F.coalesce(F.min(label) != F.max(label), F.lit(False)).alias("conflict"), F.count("*").alias("n"))


def misdated(day: Column, start: str, validation: str, test: str, end: str) -> Column:
    """Whether an assigned row's date is outside its split's window."""
    name = F.col("split_assignment")
    windows = {"train": (start, validation), "validation": (validation, test), "test": (test, end)}
    own = F.lit(False)
    for k, (lo, hi) in windows.items():
        own = own | ((name == k) & stats.half_open(day, lo, hi))
    return name.isNotNull() & ~F.coalesce(own, F.lit(False))


def misdated_rows(split: DataFrame, day: str, *, start: str, validation: str, test: str, end: str) -> DataFrame:
    """How many assigned rows have a date outside their split's window."""
    return split.agg(F.count_if(misdated(F.col(day), start, validation, test, end)).alias("mismatched"))


def split_checks(split: DataFrame, day: str, *, start: str, validation: str, test: str, end: str) -> DataFrame:
    """Named boolean checks of a split in one row, from one pass that counts by fingerprint first."""
    col = F.col
    flags = {
        "input_record_count": F.lit(True),
        "included_record_count": col("disposition") == "included",
        "same_label_duplicate_count": col("disposition") == "duplicate_same_label",
        "label_conflict_count": col("disposition") == "duplicate_label_conflict",
        **{f"{k}_record_count": col("split_assignment") == k for k in ("train", "validation", "test")},
        "date_mismatch_count": misdated(col(day), start, validation, test, end),
    }
    own = split.groupBy("fingerprint").agg(*[F.count_if(v).alias(k) for k, v in flags.items()], (F.min("split_assignment") != F.max("split_assignment")).alias("leaks"))
    row = own.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in flags], F.count_if("leaks").alias("leaking"))
    return row.select(
        (col("included_record_count") + col("same_label_duplicate_count") + col("label_conflict_count") == col("input_record_count")).alias("dispositions_reconcile"),
        (col("train_record_count") + col("validation_record_count") + col("test_record_count") == col("included_record_count")).alias("assignments_reconcile"),
        (col("date_mismatch_count") == 0).alias("dates_inside_splits"),
        (col("leaking") == 0).alias("no_fingerprint_in_two_splits"),
        (col("train_record_count") > 0).alias("train_has_rows"),
        (col("validation_record_count") > 0).alias("validation_has_rows"),
        (col("test_record_count") > 0).alias("test_has_rows"),
    )


def eligible_rows(population: DataFrame, staged: DataFrame) -> DataFrame:
    """Eligible rows of a population with their staged texts and dates."""
    keys = ["raw_batch_id", "source_row_ordinal", "staging_transformation_version"]
    pop = population.where("eligibility_status = 'eligible'").select(*keys, "population_version", "target_product")
    texts = staged.select(*keys[:2], F.col("transformation_version").alias(keys[2]), "narrative", "date_received")
    return pop.join(texts, keys)


def split_rows(split: DataFrame, population: DataFrame, staged: DataFrame, name: str, *, lo: str | None = None, hi: str | None = None, allow_test: bool = False) -> DataFrame:
    """Texts and labels of one split: split rows joined with population and staged rows."""
    if name == "test" and not allow_test:
        raise ValueError("test_split_is_closed")
    keys = ["raw_batch_id", "source_row_ordinal", "population_version"]
    own = split.where(F.col("split_assignment") == name).select(*keys, "narrative_fingerprint_sha256")
    out = own.join(eligible_rows(population, staged), keys)
    if lo:
        out = out.where(F.col("date_received") >= F.lit(lo).cast("date"))
    return out.where(F.col("date_received") < F.lit(hi).cast("date")) if hi else out
