"""Large JSON arrays of objects, read by many tasks.

An array has no line ends to split at, so Spark's text source reads it with ``}`` as the line separator: any
split of a file gives whole fragments, each with the split that it lies in. Two prefix sums, over a few rows for
splits and then inside each split, say what a fragment begins in: the number of quotes before it, whether
inside a string; the brackets outside strings before it, at what depth. A fragment that comes back to the depth of the
array ends an element, and the number of ends before it is its element's ordinal. Elements that lie inside one
split are put together there; those that cross splits, two a split at most, by one more small shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """path, split, at, text: what lies between closing braces, in order of (split, at)."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))


def fragments_of(documents: DataFrame, every: int) -> DataFrame:
    """The same of documents (path, document) at hand, as if a split held ``every`` fragments."""
    parts = documents.select("path", F.posexplode(F.split("document", r"\}")).alias("at", "text"))
    return parts.select("path", F.call_function("div", F.col("at"), F.lit(every)).alias("split"), F.col("at").cast("long").alias("at"), "text")


def _bare(text: Column) -> Column:
    """A fragment without escapes; no brace follows a backslash in valid JSON, so none is cut apart."""
    return F.regexp_replace(text, r"(?s)\\.", "")


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier fragments of the file; a row a split is broadcast."""
    sums = rows.groupBy("path", "split").agg(F.sum(value).alias("_sum"))
    of_file = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    of_split = Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select("path", "split", F.coalesce(F.sum("_sum").over(of_file), F.lit(0)).alias("_earlier"))
    inside = rows.withColumn("_inside", F.coalesce(F.sum(value).over(of_split), F.lit(0)))
    return inside.join(F.broadcast(earlier), ["path", "split"]).withColumn(name, F.col("_earlier") + F.col("_inside")).drop("_earlier", "_inside")


def elements(parts: DataFrame) -> DataFrame:
    """path, ordinal, element of each object of the arrays that the fragments make up.

    A file that isn't one array of objects raises an error, and so does what follows the array.
    """
    last = parts.groupBy("path").agg(F.max(F.struct("split", "at")).alias("_last"))
    rows = parts.join(F.broadcast(last), "path").withColumn("is_last", F.struct("split", "at") == F.col("_last")).drop("_last")
    rows = _before(rows.withColumn("quotes", _count(_bare(F.col("text")), '"')), "quotes", "quotes_before")
    quoted, closed = F.col("quotes_before") % 2 == 1, (F.col("quotes_before") + F.col("quotes")) % 2 == 0
    outside = F.regexp_replace(F.concat(F.when(quoted, '"').otherwise(""), _bare(F.col("text"))), '"[^"]*("|$)', "")
    brace = closed & ~F.col("is_last")
    delta = _count(outside, "[{") - _count(outside, "]}") - F.when(brace, 1).otherwise(0)
    rows = _before(rows.withColumn("delta", delta), "delta", "depth")
    rows = rows.withColumn("ends", (brace & (F.col("depth") + F.col("delta") == 1)).cast("int"))
    rows = _before(rows, "ends", "ordinal")
    fresh = ~quoted & (F.col("depth") <= 1)
    first, last = F.col("depth") == 0, F.col("is_last")
    begun = F.when(last, F.when(first, r"^\s*\[\s*\]\s*$").otherwise(r"^\s*\]\s*$")).when(first, r"^\s*\[\s*\{").otherwise(r"^\s*,\s*\{")
    sound = F.when(last, fresh).otherwise(F.lit(True)) & F.when(fresh, F.regexp_like("text", begun)).otherwise(F.lit(True))
    text = F.when(fresh, F.regexp_replace("text", r"^\s*[\[,]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", F.when(sound, F.when(~last, F.concat(text, F.lit("}")))).otherwise(F.raise_error(F.lit("malformed_array")).cast("string"))).where(F.col("text").isNotNull())
    pieces = rows.groupBy("path", "split", "ordinal").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda r: r["text"]), "").alias("piece"), F.max(fresh.cast("int")).alias("begins"), F.max("ends").alias("ends"))
    whole = (F.col("begins") == 1) & (F.col("ends") == 1)
    crossing = pieces.where(~whole).groupBy("path", "ordinal").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "piece"))), lambda r: r["piece"]), "").alias("element"))
    return pieces.where(whole).select("path", "ordinal", F.col("piece").alias("element")).unionByName(crossing)


def source_rows(found: DataFrame) -> DataFrame:
    """path, source_row_ordinal, payload of the elements' ``_source``."""
    return found.select("path", F.col("ordinal").cast("int").alias("source_row_ordinal"), F.to_json(F.variant_get(F.parse_json("element"), "$._source", "variant")).alias("payload"))


def read_split_exports(spark: SparkSession, path: str) -> DataFrame:
    """path, source_row_ordinal, payload of export arrays ``[{_source}]``, each file read by as many tasks as it has splits."""
    return source_rows(elements(fragments(spark, path)))
