"""Length profiles, label and month profiles, schema profiles, and batch shapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import stats
from sievework.functions import text as X

SHARES = (0.5, 0.75, 0.9, 0.95, 0.99)
LIMITS = (128, 256, 384, 512)


def histogram(rows: DataFrame, length: str, label: str | None = None) -> DataFrame:
    """Counts by length, of all rows (label null) and of each label, in one pass."""
    own = F.lit(None).cast("string") if label is None else F.col(label)
    counted = rows.select(own.alias("label"), F.col(length).alias("length")).groupBy("label", "length").agg(F.count("*").alias("n"))
    if label is None:
        return counted
    sets = counted.groupingSets([["label", "length"], ["length"]], "label", "length").agg(F.sum("n").alias("n"), F.grouping("label").alias("_all"))
    return sets.select(F.when(F.col("_all") == 0, F.col("label")).alias("label"), "length", "n")


def group_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by some keys."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def counts_differ(hist: DataFrame, expected: DataFrame) -> DataFrame:
    """Labels (null: all rows) whose records by length don't add up to what is expected: label, n, expected."""
    own = hist.groupBy("label").agg(F.sum("n").alias("n"))
    both = own.join(expected.select(F.col("label").alias("_label"), "expected"), F.col("label").eqNullSafe(F.col("_label")), "full_outer")
    return both.where(~F.col("n").eqNullSafe(F.col("expected"))).select(F.coalesce("label", "_label").alias("label"), "n", "expected")


def length_profile(hist: DataFrame) -> DataFrame:
    """Records, tokens, least, most, mean and nearest-rank quantiles, from counts by length.

    The running sums are over distinct lengths, not rows.
    """
    w = Window.partitionBy("label").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    run = hist.withColumn("_cum", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(Window.partitionBy("label")))
    ranks = [F.min(F.when(F.col("_cum") >= F.ceil(F.col("_all") * F.lit(p)), F.col("length"))).cast("long").alias(f"p{round(p * 100)}") for p in SHARES]
    return run.groupBy("label").agg(
        F.sum("n").alias("record_count"), F.sum(F.col("n") * F.col("length")).alias("token_count"), F.min("length").cast("long").alias("least"), F.max("length").cast("long").alias("most"), (F.sum(F.col("n") * F.col("length")) / F.sum("n")).alias("mean"), *ranks
    )


def truncation(hist: DataFrame, limits: tuple[int, ...] = LIMITS) -> DataFrame:
    """For each limit: how many records exceed it, their share, and the share of tokens it retains."""
    points = F.explode(F.array(*[F.lit(x) for x in limits])).alias("max_length")
    rows = hist.select("label", "length", "n", points)
    over = F.sum(F.when(F.col("length") > F.col("max_length"), F.col("n")).otherwise(0))
    kept = F.sum(F.least("length", "max_length") * F.col("n"))
    return rows.groupBy("label", "max_length").agg(over.alias("exceeding"), (over / F.sum("n")).alias("exceeding_share"), (kept / F.sum(F.col("n") * F.col("length"))).alias("retained_share"))


def label_months(rows: DataFrame, label: str, day: str, first: str, last: str) -> DataFrame:
    """Counts of each label and month of [first, last], zeros included."""
    month = F.trunc(F.col(day).cast("date"), "month")
    counted = rows.groupBy(F.col(label).alias("label"), month.alias("month")).agg(F.count("*").alias("n"))
    months = rows.sparkSession.range(1).select(F.explode(F.expr(f"sequence(DATE'{first}', DATE'{last}', INTERVAL 1 MONTH)")).alias("month"))
    every = counted.select("label").distinct().join(F.broadcast(months))
    return every.join(counted, ["label", "month"], "left").select("label", F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def label_month_totals(rows: DataFrame, label: str, day: str) -> DataFrame:
    """Counts by label and month with subtotals of labels and of everything."""
    month = F.date_format(F.col(day).cast("date"), "yyyy-MM")
    counted = rows.groupBy(F.col(label).alias("label"), month.alias("month")).agg(F.count("*").alias("n"))
    return counted.rollup("label", "month").agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level"))


def reconciled(table: DataFrame, total: int, labels: tuple[str, ...]) -> DataFrame:
    """Checks of label x month counts against a stated total and label set."""
    names = F.array(*[F.lit(x) for x in labels])
    own = table.agg(F.sum("n").alias("sum"), F.collect_set("label").alias("found"), F.count_distinct("month").alias("months"), F.count("*").alias("cells"))
    return own.select(
        (F.col("sum") == total).alias("total_matches"),
        (F.size(F.array_except(names, "found")) == 0).alias("no_missing_labels"),
        (F.size(F.array_except("found", names)) == 0).alias("no_unknown_labels"),
        (F.col("cells") == F.size("found") * F.col("months")).alias("months_complete"),
    )


def schema_profile(rows: DataFrame, payload: str) -> DataFrame:
    """For each key of JSON objects: rows, nulls, and the types seen."""
    parsed = rows.select(F.try_parse_json(payload).alias("_v"))
    entries = parsed.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key IS NOT NULL")
    kind = F.coalesce(X.json_type(F.col("value")), F.lit("null"))
    return entries.select("key", kind.alias("kind")).groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "null").alias("n_null"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with a reproducible order: a hash of the key and the seed."""
    return rows.withColumn("shuffle_rank", stats.spread(F.col(key), seed))


def epoch_order(rows: DataFrame, key: str, seed: int, epoch: int, cell_rows: int = 1 << 20) -> DataFrame:
    """Rows with ``position``, a dense shuffled order from 0 that follows from keys, seed and epoch alone, not from
    partitions; rows of equal keys take neighbouring positions.

    The order is that of a keyed hash. Rows are dealt to cells of hash ranges, a position being the rows of
    the cells before, one number a cell, and the rank inside the cell, so no task orders all rows.
    """
    cells = max(1, -(-rows.count() // cell_rows))
    drawn = rows.withColumn("_draw", stats.spread(F.concat_ws("/", F.col(key), F.lit(epoch)), seed))
    width = -(-(1 << 60) // cells)
    drawn = drawn.withColumn("_cell", F.call_function("div", F.col("_draw"), F.lit(width)))
    earlier = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = drawn.groupBy("_cell").agg(F.count("*").alias("_n")).select("_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_draw", key)) - 1
    return drawn.withColumn("_place", place).join(F.broadcast(before), "_cell").withColumn("position", F.col("_before") + F.col("_place")).drop("_draw", "_cell", "_place", "_before")


def length_groups(rows: DataFrame, key: str, length: str, *, batch: int = 32, pool: int = 1024, seed: int = 42) -> DataFrame:
    """pool_id, batch_id and place of each row: pools of about ``pool`` rows, batches of similar lengths.

    Rows are dealt to pools by a hash, so no order over all rows is needed; a pool's rows are sorted by
    length and cut into batches, and ``batch_rank`` orders batches reproducibly.
    """
    n = rows.count()
    pools = max(1, -(-n // pool))
    dealt = rows.withColumn("pool_id", F.pmod(stats.spread(F.col(key), seed), F.lit(pools)))
    rank = F.row_number().over(Window.partitionBy("pool_id").orderBy(length, key)) - 1
    out = dealt.withColumn("_rank", rank).withColumn("batch_id", F.floor(F.col("_rank") / batch)).withColumn("place", F.col("_rank") % batch).drop("_rank")
    return out.withColumn("batch_rank", stats.spread(F.concat_ws("/", "pool_id", "batch_id"), seed))


def padded(length: Column, multiple: int = 8) -> Column:
    return (F.ceil(length / multiple) * multiple).cast("long")


def collation(groups: DataFrame, length: str, limit: int = 384) -> DataFrame:
    """Shapes of padded batches: batches, longest, real tokens, slots and the padding's share."""
    cut = F.least(F.col(length), F.lit(limit))
    shapes = groups.groupBy("pool_id", "batch_id").agg(F.count("*").alias("rows"), F.sum(cut).alias("real"), padded(F.max(cut)).alias("width"))
    slots = F.col("rows") * F.col("width")
    return shapes.agg(F.count("*").alias("batches"), F.sum("rows").alias("records"), F.min("width").alias("least_width"), F.max("width").alias("most_width"), F.sum("real").alias("real_tokens"), F.sum(slots).alias("slots"), (1 - F.sum("real") / F.sum(slots)).alias("padding_share"))


def collated(groups: DataFrame, ids: str, limit: int = 384, pad: int = 0) -> DataFrame:
    """Padded id arrays and attention masks of each batch."""
    cut = groups.withColumn("_ids", F.slice(ids, 1, limit))
    batches = cut.groupBy("pool_id", "batch_id", "batch_rank").agg(F.sort_array(F.collect_list(F.struct("place", "_ids"))).alias("_rows"))
    width = padded(F.array_max(F.transform("_rows", lambda r: F.size(r["_ids"])))).cast("int")
    fill = lambda value, n: F.array_repeat(F.lit(value), n)
    out = batches.withColumn("_width", width)
    return out.select(
        "pool_id", "batch_id", "batch_rank",
        F.transform("_rows", lambda r: F.concat(r["_ids"], fill(pad, F.col("_width") - F.size(r["_ids"])))).alias("input_ids"),
        F.transform("_rows", lambda r: F.concat(fill(1, F.size(r["_ids"])), fill(0, F.col("_width") - F.size(r["_ids"])))).alias("attention_mask"),
    )


def buffer_shuffled(rows: DataFrame, buffer: int = 8192, seed: int = 42) -> DataFrame:
    """Rows in another order, none lost: within each partition rows wait in a buffer, and when it holds twice ``buffer`` a random half
    of them leaves, so memory is bounded. The order depends on the partitions and the seed alone; ``epoch_order`` doesn't depend on partitions."""

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        dice = np.random.default_rng([seed, TaskContext.get().partitionId()])
        held: pa.Table | None = None
        for batch in batches:
            come = pa.Table.from_batches([batch])
            held = come if held is None else pa.concat_tables([held, come])
            if len(held) >= 2 * buffer:
                held = held.take(dice.permutation(len(held)))
                yield from held.slice(buffer).combine_chunks().to_batches()
                held = held.slice(0, buffer).combine_chunks()
        if held is not None and len(held):
            yield from held.take(dice.permutation(len(held))).combine_chunks().to_batches()

    return rows.mapInArrow(mixed, rows.schema)


def log_heights(counts: DataFrame, n: str) -> DataFrame:
    """Adds height, in [0, 1]: log10(n + 1) over that of the largest n. A row for each bar."""
    return counts.withColumn("height", F.log10(F.col(n) + 1) / F.log10(F.max(n).over(Window.partitionBy()) + 1))


def pixels(value: Column, least: Column, most: Column, start: float, end: float) -> Column:
    """A value's place on an axis from ``start`` to ``end``."""
    return F.lit(start) + F.coalesce(F.try_divide(value - least, most - least), F.lit(0.0)) * (end - start)


def drift(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Population stability index between two tables' distributions of a key, by value and in total."""
    share = lambda df, name: df.groupBy(key).agg(F.count("*").alias("_n")).withColumn(name, F.col("_n") / F.sum("_n").over(Window.partitionBy())).drop("_n")
    both = share(before, "p").join(share(after, "q"), key, "full_outer").select(key, F.coalesce("p", F.lit(1e-6)).alias("p"), F.coalesce("q", F.lit(1e-6)).alias("q"))
    return both.withColumn("psi", (F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))
