"""Calibration of class scores: loss, reliability, expected calibration error, temperature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import stats
from sievework.operators.metrics import universe

BINS = 15
#: Cells of confidence in which rows are ranked.
CELLS = 1 << 14
#: Cells of the tie-breaker within a cell of one confidence.
TIES = 1 << 10
LOWEST, HIGHEST = 0.05, 20.0


def scored(rows: DataFrame, scores: Column, label: Column, temperature: float = 1.0) -> DataFrame:
    """Adds probabilities, predicted, confidence, correct, nll and brier."""
    p = F.col("probabilities")
    return (
        rows.withColumn("_scores", scores.cast("array<double>"))
        .withColumn("_label", label.cast("int"))
        .withColumn("probabilities", stats.softmax(F.col("_scores"), temperature))
        .withColumn("predicted", stats.first_of_top(p))
        .withColumn("confidence", F.array_max(p))
        .withColumn("correct", F.col("predicted") == F.col("_label"))
        .withColumn("nll", stats.log_loss(F.col("_scores"), F.col("_label"), temperature))
        .withColumn("brier", stats.brier(p, F.col("_label")))
    )


def metrics(rows: DataFrame) -> DataFrame:
    """Means over scored rows."""
    return rows.agg(
        F.count("*").alias("record_count"),
        F.avg("nll").alias("nll"),
        F.avg("brier").alias("brier"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("confidence").alias("mean_confidence"),
        (F.avg("confidence") - F.avg(F.col("correct").cast("double"))).alias("confidence_minus_accuracy"),
    )


def equal_width(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Reliability bins of equal width; empty ones have a count of 0 and null means."""
    index = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    counted = rows.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), F.avg("confidence").alias("mean_confidence"))
    all_ = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = F.broadcast(all_).join(counted, "bin", "left")
    accuracy = F.col("n_correct") / F.col("n")
    return out.select("bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("n_correct", F.lit(0)).cast("long").alias("n_correct"), "mean_confidence", accuracy.alias("accuracy"), F.abs(F.col("mean_confidence") - accuracy).alias("gap"))


def expected_error(bins: DataFrame) -> DataFrame:
    return bins.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("gap")), F.sum("n")), F.lit(0.0)).alias("ece"))


def equal_mass(rows: DataFrame, order: list[str], bins: int = BINS) -> DataFrame:
    """Reliability bins of equal counts, the larger ones first; ``order`` breaks ties and begins with a number.

    Ranks are global without a single-task window over rows: they are counted inside ``CELLS`` cells of
    confidence and shifted by the counts of the cells before, one number a cell. A cell whose confidences are
    all equal, such as one that most rows share, is cut again by the first tie-breaker into ``TIES`` cells.
    """
    first = F.col(order[0])
    cell = F.floor(F.col("confidence") * CELLS).cast("int").alias("_cell")
    dealt = rows.select("confidence", F.col("correct").cast("int").alias("hit"), *order, cell)
    tied = F.min("confidence") == F.max("confidence")
    ends = dealt.groupBy("_cell").agg(F.when(tied, F.min(first).cast("double")).alias("_lo"), F.when(tied, F.max(first).cast("double")).alias("_hi"))
    place = F.floor((first.cast("double") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * TIES)
    dealt = dealt.join(F.broadcast(ends), "_cell").withColumn("_tie", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(0).cast("int"))  # CELLS + 1 rows at most
    sizes = dealt.groupBy("_cell", "_tie").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_cell", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_cell", "_tie", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    local = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_cell", "_tie").orderBy("confidence", *order)))
    ranked = local.join(before, ["_cell", "_tie"]).withColumn("_rank", F.col("_before") + F.col("_rn") - 1)
    size, extra = F.floor(F.col("_total") / bins), F.col("_total") % bins
    head = extra * (size + 1)
    tile = F.when(F.col("_rank") < head, F.floor(F.col("_rank") / (size + 1))).otherwise(extra + F.floor(F.try_divide(F.col("_rank") - head, size)))
    return ranked.groupBy(tile.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("hit").alias("accuracy")).withColumn("gap", F.abs(F.col("mean_confidence") - F.col("accuracy")))


def per_class(rows: DataFrame, classes: int) -> DataFrame:
    """Prevalence, mean probability, their gap, and one-versus-rest Brier loss of each class."""
    long = rows.select("_label", F.posexplode("probabilities").alias("label_id", "p"))
    own = (F.col("_label") == F.col("label_id")).cast("double")
    found = long.groupBy("label_id").agg(F.sum(own).cast("long").alias("support"), F.avg(own).alias("prevalence"), F.avg("p").alias("mean_probability"), F.avg(F.pow(F.col("p") - own, F.lit(2.0))).alias("brier"))
    ids = universe(rows, list(range(classes)), "label_id", "int")
    return F.broadcast(ids).join(found, "label_id", "left").select("label_id", F.coalesce("support", F.lit(0)).cast("long").alias("support"), "prevalence", "mean_probability", F.abs(F.col("mean_probability") - F.col("prevalence")).alias("prevalence_gap"), "brier")


def checks(rows: DataFrame, classes: int, tolerance: float = 1e-12) -> DataFrame:
    """Whether all probability arrays are whole, finite, in [0, 1] and sum to 1."""
    p = F.col("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return rows.agg(
        F.bool_and(F.size(p) == classes).alias("whole"),
        F.bool_and(F.forall(p, lambda x: ~F.isnan(x) & (x >= 0) & (x <= 1))).alias("in_range"),
        F.coalesce(F.max(F.abs(total - 1)) <= tolerance, F.lit(True)).alias("sums_to_one"),
        F.bool_and((F.col("_label") >= 0) & (F.col("_label") < classes)).alias("labels_in_range"),
    )


def invariant(rows: DataFrame, scores: Column, temperature: float) -> DataFrame:
    """Whether a temperature leaves the first and the two largest classes as they are."""
    a, b = stats.softmax(scores.cast("array<double>")), stats.softmax(scores.cast("array<double>"), temperature)
    rank = lambda p: F.slice(F.reverse(F.array_sort(F.transform(p, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))), 1, 2)["i"]
    return rows.agg(F.bool_and(stats.first_of_top(a) == stats.first_of_top(b)).alias("argmax_unchanged"), F.bool_and(rank(a) == rank(b)).alias("top_two_unchanged"))


def fit_temperature(rows: DataFrame, scores: Column, label: Column, tolerance: float = 1e-8, rounds: int = 100) -> dict[str, float]:
    """The temperature of least mean loss within bounds, its logarithm to ``tolerance``; an error where that is a bound.

    The loss is convex in the inverse temperature a: its slope is the mean of E[s] - s_label and the slope's that of Var[s], the class
    probabilities at a being the weights. Each round is one aggregation of both; a Newton step that leaves the
    bracket is replaced by its middle.
    """
    base = rows.select(scores.cast("array<double>").alias("_s"), label.cast("int").alias("_l"))
    zero = F.lit(0.0)

    def at(x: float) -> tuple[float, float, float]:
        weighed = F.zip_with(stats.softmax(F.col("_s"), math.exp(x)), "_s", lambda p, s: F.struct(p.alias("p"), s.alias("s")))
        mean = F.aggregate(weighed, zero, lambda t, w: t + w["p"] * w["s"])
        square = F.aggregate(weighed, zero, lambda t, w: t + w["p"] * w["s"] * w["s"])
        each = base.select(mean.alias("m"), square.alias("q"), F.get(F.col("_s"), F.col("_l")).alias("own"), stats.log_loss(F.col("_s"), F.col("_l"), math.exp(x)).alias("nll"))
        found = tuple(each.agg(F.avg(F.col("m") - F.col("own")), F.avg(F.col("q") - F.col("m") * F.col("m")), F.avg("nll")).first())
        if any(v is None or not math.isfinite(v) for v in found):
            raise ValueError("calibration_scores_invalid")
        return found

    lo, hi = math.log(LOWEST), math.log(HIGHEST)
    x = min(max(0.0, lo), hi)
    for _ in range(rounds):
        slope, curve, nll = at(x)
        if slope > 0:  # too sure of themselves: a hotter temperature
            lo = x
        else:
            hi = x
        a = math.exp(-x)
        step = a - slope / curve if curve > 0 else 0.0
        ahead = -math.log(step) if step > 0 else math.inf
        after = ahead if lo < ahead < hi else (lo + hi) / 2
        if (slope == 0 and curve > 0) or abs(after - x) <= tolerance or hi - lo <= tolerance:
            break
        x = after
    if min(x - math.log(LOWEST), math.log(HIGHEST) - x) <= 1e-6:
        raise ValueError("calibration_temperature_at_bound")
    return {"temperature": math.exp(x), "nll": nll}
