"""Coverage and risk of predicting only above a confidence threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import stats
from sievework.operators.metrics import universe

#: The reference threshold and the candidates; fixed values.
THRESHOLDS = (0.0, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
#: Gates by name; fixed values.
GATES = {
    "candidate_threshold": "threshold > 0",
    "selective_accuracy_at_least_0p93": "coalesce(selective_accuracy >= 0.93, false)",
    "coverage_at_least_0p60": "coverage >= 0.60",
    "false_suggestion_rate_at_most_0p05": "false_suggestion_rate <= 0.05",
    "every_actual_class_coverage_at_least_0p10": "worst_actual_coverage >= 0.10",
    "every_predicted_class_has_at_least_20_suggestions": "least_suggestions >= 20",
    "every_predicted_class_precision_at_least_0p50": "worst_precision >= 0.50",
}


def grid(like: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    return F.broadcast(universe(like, list(thresholds), "threshold", "double"))


def cells(rows: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Rows of (actual, predicted, passed thresholds) with their counts: all that the sweep needs.

    rows: actual, predicted, confidence. Rows are never multiplied by thresholds.
    """
    passed = sum((F.col("confidence") >= F.lit(t)).cast("int") for t in thresholds)  # thresholds rise
    return rows.groupBy("actual", "predicted", passed.alias("passed")).agg(F.count("*").alias("n"))


def actual_classes(counted: DataFrame, labels: list, thresholds: tuple[float, ...] = THRESHOLDS, kind: str = "int") -> DataFrame:
    """Coverage and accuracy among suggested, for each threshold and actual label."""
    return _classes(counted, labels, thresholds, kind, "actual")


def predicted_classes(counted: DataFrame, labels: list, thresholds: tuple[float, ...] = THRESHOLDS, kind: str = "int") -> DataFrame:
    """Suggestions and precision, for each threshold and predicted label; zeros are kept."""
    return _classes(counted, labels, thresholds, kind, "predicted")


def _steps(counted: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    steps = F.broadcast(universe(counted, list(enumerate(thresholds, 1)), "x", "struct<step:int,threshold:double>").select("x.*"))
    return counted.join(steps)


def _classes(counted: DataFrame, labels: list, thresholds: tuple[float, ...], kind: str, side: str) -> DataFrame:
    on = F.col("passed") >= F.col("step")
    hit = on & (F.col("actual") == F.col("predicted"))
    found = _steps(counted, thresholds).groupBy("threshold", F.col(side).alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(on, F.col("n")).otherwise(0)).alias("suggested"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("correct"))
    every = grid(counted, thresholds).join(F.broadcast(universe(counted, labels, "label", kind)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = every.join(found, ["threshold", "label"], "left").select("threshold", "label", zero("support"), zero("suggested"), zero("correct"))
    return out.withColumn("coverage", F.try_divide("suggested", "support")).withColumn("precision", F.try_divide("correct", "suggested"))


def sweep(rows: DataFrame, labels: list, thresholds: tuple[float, ...] = THRESHOLDS, kind: str = "int") -> DataFrame:
    """One row for each threshold: counts, rates, Wilson bounds, class minima and gates."""
    counted = cells(rows, thresholds)
    on = F.col("passed") >= F.col("step")
    hit = on & (F.col("actual") == F.col("predicted"))
    base = _steps(counted, thresholds).groupBy("threshold").agg(F.sum("n").alias("total"), F.sum(F.when(on, F.col("n")).otherwise(0)).alias("suggested"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("correct"))
    actual = actual_classes(counted, labels, thresholds, kind).groupBy("threshold").agg(F.avg("coverage").alias("macro_actual_coverage"), F.min(F.coalesce("coverage", F.lit(0.0))).alias("worst_actual_coverage"))
    predicted = predicted_classes(counted, labels, thresholds, kind).groupBy("threshold").agg(F.min("suggested").alias("least_suggestions"), F.min(F.coalesce("precision", F.lit(0.0))).alias("worst_precision"))
    s, c, n = F.col("suggested"), F.col("correct"), F.col("total")
    out = base.join(actual, "threshold").join(predicted, "threshold").select(
        "threshold", "total", "suggested", "correct", (n - s).alias("review"), (s - c).alias("false_suggestions"),
        (s / n).alias("coverage"), (1 - s / n).alias("review_rate"), F.try_divide(c, s).alias("selective_accuracy"), (1 - F.try_divide(c, s)).alias("selective_risk"),
        stats.wilson(c, s, "lower").alias("accuracy_lower"), stats.wilson(c, s, "upper").alias("accuracy_upper"),
        ((s - c) / n).alias("false_suggestion_rate"), (c / n).alias("correct_suggestion_rate"),
        "macro_actual_coverage", "worst_actual_coverage", "least_suggestions", "worst_precision",
    )
    failed = F.array_compact(F.array(*[F.when(~F.expr(rule), F.lit(name)) for name, rule in GATES.items()]))
    return out.withColumn("failed_gates", failed).withColumn("eligible", F.size("failed_gates") == 0)


def select_threshold(swept: DataFrame) -> DataFrame:
    """The best eligible threshold by coverage, accuracy, false rate and size, or manual review only."""
    key = F.struct((-F.col("coverage")).alias("a"), (-F.col("selective_accuracy")).alias("b"), F.col("false_suggestion_rate").alias("c"), F.col("threshold").alias("d"))
    best = swept.agg(F.min(F.when(F.col("eligible"), key)).alias("best"), F.count_if("eligible").alias("eligible_candidates"))
    status = F.when(F.col("best").isNull(), "manual_review_only").otherwise("threshold_proposed")
    return best.select(status.alias("status"), F.col("best.d").alias("proposed_threshold"), "eligible_candidates")


def blocking(swept: DataFrame) -> DataFrame:
    """Each candidate's failed gates as one text."""
    return swept.where("threshold > 0").select("threshold", F.concat_ws("; ", "failed_gates").alias("blocking"))


def decisions(rows: DataFrame, threshold: float) -> DataFrame:
    """suggest or abstain for each row of probabilities, with ranked alternatives."""
    ranked = F.reverse(F.array_sort(F.transform("probabilities", lambda v, i: F.struct(v.alias("p"), (-i).alias("i")))))
    alternatives = F.transform(F.slice(ranked, 1, 3), lambda x: F.struct((-x["i"]).alias("label_id"), x["p"].alias("probability")))
    return rows.withColumn("decision", F.when(F.col("confidence") >= threshold, "suggest").otherwise("abstain")).withColumn("alternatives", alternatives)


def reproduced(stored: DataFrame, computed: DataFrame, key: str, columns: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Whether stored and computed metrics agree, and by how much they differ."""
    both = stored.alias("a").join(computed.alias("b"), key, "full_outer")
    gap = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in columns]) if len(columns) > 1 else F.abs(F.col(f"a.{columns[0]}") - F.col(f"b.{columns[0]}"))
    return both.select(key, gap.alias("gap"), F.coalesce(gap <= tolerance, F.lit(False)).alias("agrees"))
