"""Classification metrics from confusion counts over a fixed set of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def universe(like: DataFrame, labels: list, name: str, kind: str = "string") -> DataFrame:
    """One row for each label."""
    return like.sparkSession.createDataFrame([(x,) for x in labels], f"{name} {kind}")


def confusion(rows: DataFrame, actual: str, predicted: str, labels: list, by: list[str] | None = None, kind: str = "string") -> DataFrame:
    """Counts for every pair of labels, zeros included: [by,] actual, predicted, n.

    Rows are counted before anything is joined; the grid is of the labels' square.
    """
    by = by or []
    counted = rows.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    grid = F.broadcast(universe(rows, labels, "actual", kind)).join(F.broadcast(universe(rows, labels, "predicted", kind)))
    if by:
        grid = counted.select(*by).distinct().join(grid)
    return grid.join(counted, [*by, "actual", "predicted"], "left").select(*by, "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(matrix: DataFrame, by: list[str] | None = None) -> DataFrame:
    """precision, recall, f1 and support of each label; 0 where undefined."""
    by = by or []
    hit = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = matrix.groupBy(*by, F.col("actual").alias("label")).agg(hit.alias("hits"), F.sum("n").alias("support"))
    columns = matrix.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    both = rows.join(columns, [*by, "label"]).withColumn("precision", ratio(F.col("hits"), F.col("predicted"))).withColumn("recall", ratio(F.col("hits"), F.col("support")))
    f1 = ratio(2 * F.col("hits"), F.col("support") + F.col("predicted"))
    return both.select(*by, "label", "hits", "predicted", "support", "precision", "recall", f1.alias("f1"))


def summary(classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy, macro and weighted averages and the worst recall."""
    total = F.sum("support")
    return classes.groupBy(*(by or [])).agg(
        total.alias("record_count"),
        F.coalesce(F.try_divide(F.sum("hits"), total), F.lit(0.0)).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), total), F.lit(0.0)).alias("weighted_f1"),
        F.min("recall").alias("worst_recall"),
    )


def complete(slices: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Slices of exactly the expected values; an error where one is missing or another is there."""
    marked = slices.withColumn("_there", F.lit(True))
    both = F.broadcast(universe(slices, expected, column).withColumn("_wanted", F.lit(True))).join(marked, column, "full_outer")
    sound = F.col("_wanted").isNotNull() & F.col("_there").isNotNull()
    checked = F.when(sound, F.col(column)).otherwise(F.raise_error(F.lit(f"{column}_slices_incomplete")).cast("string"))
    return both.select(checked.alias(column), *[c for c in slices.columns if c != column])


def long_table(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A report table with a row for each metric: keys, metric, value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_x")
    return rows.select(*keys, pairs).select(*keys, "_x.metric", "_x.value")


def majority(counts: DataFrame, label: str, n: str) -> DataFrame:
    """The one most frequent label; an error on a tie."""
    ranked = counts.withColumn("_rank", F.rank().over(Window.orderBy(F.desc(n))))  # a row for each label
    best = ranked.where("_rank = 1").agg(F.min(label).alias(label), F.max(n).alias(n), F.count("*").alias("_ties"))
    return best.select(F.when(F.col("_ties") > 1, F.raise_error(F.lit("majority_tie")).cast("string")).otherwise(F.col(label).cast("string")).alias(label), n)


def constant_confusion(counts: DataFrame, predicted: Column, by: list[str]) -> DataFrame:
    """The confusion counts of always predicting one label, from [by,] label, n."""
    return counts.select(*by, F.col("label").alias("actual"), predicted.alias("predicted"), "n")


def top_confusions(matrix: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent errors with their shares of all errors and of the actual label's."""
    errors = matrix.where("actual != predicted AND n > 0")
    all_ = F.sum("n").over(Window.partitionBy())
    own = F.sum("n").over(Window.partitionBy("actual"))
    shared = errors.select("actual", "predicted", "n", (F.col("n") / all_).alias("share_of_errors"), (F.col("n") / own).alias("share_of_actual_errors"))
    return shared.orderBy(F.desc("n"), "actual", "predicted").limit(limit)


def rarity_groups(classes: DataFrame, training: DataFrame, share: float = 0.01) -> DataFrame:
    """Macro averages of labels whose training share is below ``share`` and of the others."""
    total = F.sum("n").over(Window.partitionBy())
    kinds = training.select("label", F.when(F.col("n") / total < share, "rare").otherwise("common").alias("rarity"))
    return classes.join(kinds, "label").groupBy("rarity").agg(F.count("*").alias("labels"), F.sum("support").alias("support"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))


def weakest(classes: DataFrame, metric: str = "recall") -> DataFrame:
    """The label of the least metric, the first by name on ties."""
    return classes.agg(F.min(F.struct(metric, "label")).alias("w")).select("w.label", f"w.{metric}")


def metric_range(rows: DataFrame, metric: str) -> DataFrame:
    return rows.agg(F.min(metric).alias("least"), F.max(metric).alias("most"), (F.max(metric) - F.min(metric)).alias("range"))


def compared(ours: DataFrame, theirs: DataFrame, metric: str) -> DataFrame:
    """Two models' metric by label, over the same labels and supports; an error where they differ."""
    a, b = ours.select("label", F.col(metric).alias("baseline"), F.col("support").alias("_a")), theirs.select("label", F.col(metric).alias("candidate"), F.col("support").alias("_b"))
    both = a.join(b, "label", "full_outer")
    sound = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    delta = F.col("candidate") - F.col("baseline")
    name = F.when(~sound, F.raise_error(F.lit("supports_differ")).cast("string")).when(delta < 0, "baseline").when(delta > 0, "candidate").otherwise("tie")
    return both.select("label", "baseline", "candidate", delta.alias("delta"), name.alias("winner"))


def win_counts(comparison: DataFrame) -> DataFrame:
    """How often each side wins, zeros included."""
    return F.broadcast(universe(comparison, ["baseline", "candidate", "tie"], "winner")).join(comparison.groupBy("winner").agg(F.count("*").alias("n")), "winner", "left").select("winner", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def first_by(rows: DataFrame, *order: Column) -> DataFrame:
    """The one first row by an ordered rule: models, epochs and thresholds are selected so."""
    return rows.orderBy(*order).limit(1)


def select_candidate(rows: DataFrame) -> DataFrame:
    """Of converged candidates, the best macro F1, then worst recall, weighted F1, least C, and id."""
    return first_by(rows.where("converged"), F.desc("macro_f1"), F.desc("worst_recall"), F.desc("weighted_f1"), F.col("c"), F.col("candidate_id"))


def select_epoch(rows: DataFrame) -> DataFrame:
    return first_by(rows, F.desc("macro_f1"), F.desc("worst_recall"), F.desc("weighted_f1"), F.col("epoch"))


def early_stopping(scores: Column, least_gain: float = 0.001, patience: int = 1) -> Column:
    """Fold of an array of scores in epoch order: (best, epochs without gain, stopped)."""
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("flat"), F.lit(False).alias("stop"))

    def step(acc: Column, x: Column) -> Column:
        gain = acc["best"].isNull() | (x >= acc["best"] + least_gain)
        flat = F.when(gain, 0).otherwise(acc["flat"] + 1)
        moved = F.struct(F.when(gain, x).otherwise(acc["best"]).alias("best"), flat.alias("flat"), (flat > patience).alias("stop"))
        return F.when(acc["stop"], acc).otherwise(moved)

    return F.aggregate(scores, start, step)
