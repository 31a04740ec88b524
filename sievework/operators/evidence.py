"""Evidence of model reports: custody by hashes, unique selections, quality gates and benchmark pairs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.metrics import universe
from sievework.operators.rules import gates


def custody(documents: DataFrame, links: DataFrame) -> DataFrame:
    """Whether each document that another cites is the one at hand, by its hash.

    documents: document, sha256; links: document, cites, cited_sha256.
    """
    found = documents.select(F.col("document").alias("cites"), F.col("sha256").alias("actual_sha256"))
    both = links.join(found, "cites", "left")
    return both.select("document", "cites", F.col("actual_sha256").isNotNull().alias("present"), F.coalesce(F.col("cited_sha256") == F.col("actual_sha256"), F.lit(False)).alias("unbroken"))


def the_selected(candidates: DataFrame, key: str, selected: Column) -> DataFrame:
    """The one candidate that a report selects; an error unless it is there once and converged."""
    own = candidates.where(F.col(key) == selected)
    one = own.agg(F.count("*").alias("_n"), F.first(F.struct(*candidates.columns)).alias("row"))
    sound = (F.col("_n") == 1) & F.coalesce(F.col("row.converged"), F.lit(False))
    return one.select(F.when(sound, F.col("row")).otherwise(F.raise_error(F.lit("selection_not_unique"))).alias("row")).select("row.*")


def same_calibrator(stored: DataFrame, reported: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Whether a stored calibrator is the reported one: temperature, class count and model hash, in one row."""
    a, b = stored.limit(2).alias("a"), reported.limit(2).alias("b")  # one row each; a second would show below
    both = a.join(b)
    no = F.lit(False)
    equal = lambda c: F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), no)
    close = F.coalesce(F.abs(F.col("a.temperature") - F.col("b.temperature")) <= tolerance, no)
    return both.agg((F.count("*") == 1).alias("one_of_each"), F.bool_and(close).alias("temperature_agrees"), F.bool_and(equal("classes")).alias("classes_agree"), F.bool_and(equal("model_sha256")).alias("model_agrees"))


#: Floors of a model's quality, and what its calibration must not exceed, by name; fixed values.
QUALITY = {"macro_f1": "candidate_macro_f1 >= baseline_macro_f1", "worst_recall": "candidate_worst_recall >= baseline_worst_recall"}
CALIBRATION = {"ece": "calibrated_ece <= uncalibrated_ece", "nll": "calibrated_nll <= uncalibrated_nll"}


def evaluated(rows: DataFrame, quality: Mapping[str, str] = QUALITY, calibration: Mapping[str, str] = CALIBRATION) -> DataFrame:
    """Adds the failed quality and calibration rules and whether all hold; a null fails."""
    judged = gates(rows, {**{f"quality_{k}": v for k, v in quality.items()}, **{f"calibration_{k}": v for k, v in calibration.items()}})
    return judged


def benchmark_pairs(ours: DataFrame, theirs: DataFrame, workload: list[str], measures: list[str]) -> DataFrame:
    """Ratios of measures of two benchmarks; an error unless both ran one workload on one host.

    Both: the workload's columns, and the measures, a row for each model.
    """
    a, b = ours.alias("a"), theirs.alias("b")
    both = a.join(b)  # a row each
    same = F.lit(True)
    for c in workload:
        same = same & F.coalesce(F.col(f"a.{c}") == F.col(f"b.{c}"), F.lit(False))
    ratios = [F.round(F.try_divide(F.col(f"b.{m}"), F.col(f"a.{m}")), 6).alias(f"{m}_ratio") for m in measures]
    checked = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("benchmarks_not_comparable")).cast("boolean"))
    return both.select(checked.alias("comparable"), *ratios)


def partition_evidence(rows: DataFrame, partition: str, label: str, partitions: list[str], labels: list[str]) -> DataFrame:
    """Rows of each label in each partition, zeros included."""
    counted = rows.groupBy(F.col(partition).alias("part"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    every = F.broadcast(universe(rows, partitions, "part")).join(F.broadcast(universe(rows, labels, "label")))
    return every.join(counted, ["part", "label"], "left").select("part", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def findings(rows: DataFrame, categories: str, resolved: Column) -> DataFrame:
    """Rows by category of finding; an error at the first row with an unresolved one."""
    checked = F.when(F.coalesce(resolved, F.lit(False)) | (F.size(categories) == 0), F.col(categories)).otherwise(F.raise_error(F.lit("finding_unresolved")).cast("array<string>"))
    return rows.select(F.explode(checked).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
