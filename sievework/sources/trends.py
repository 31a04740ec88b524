"""Aggregate responses: counts by label and month, with shape guards and no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as X

#: Bytes of an aggregate response at most; fixed value.
TREND_BYTES = 3_000_000
#: Parameters of requests for rows, which a request for aggregates must not have; fixed values.
ROW_PARAMETERS = {"format", "frm", "no_aggs", "search_term", "size"}


def required(value: Column, kind: str, place: str) -> Column:
    """The variant itself, with an error that names the place only where its JSON type is another."""
    found = X.json_type(value)
    return F.when(F.coalesce(found == kind, F.lit(False)), value).otherwise(F.raise_error(F.lit(f"{place}_is_not_{kind}")))


def required_count(value: Column, place: str) -> Column:
    """A whole number of 0 or more."""
    n = F.try_variant_get(required(value, "integer", place), "$", "bigint")
    return F.when(n >= 0, n).otherwise(F.raise_error(F.lit(f"{place}_is_negative")).cast("long"))


def required_month(value: Column, place: str) -> Column:
    """YYYY-MM of a text that begins with a date on the first of a month."""
    text = F.try_variant_get(required(value, "string", place), "$", "string")
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    fits = day.isNotNull() & (F.dayofmonth(day) == 1)
    return F.when(fits, F.substring(text, 1, 7)).otherwise(F.raise_error(F.lit(f"{place}_is_no_month")))


def without_rows(document: Column) -> Column:
    """The parsed document, with an error if it holds rows."""
    rows = F.try_variant_get(document, "$.hits.hits", "array<variant>")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, document).otherwise(F.raise_error(F.lit("rows_in_aggregate_response")))


def _buckets(parent: Column, path: str, place: str) -> Column:
    return F.try_variant_get(required(F.try_variant_get(parent, path, "variant"), "array", place), "$", "array<variant>")


def trend_months(documents: DataFrame) -> DataFrame:
    """label, label_count, month and n of each label's months. documents: document (JSON text)."""
    parsed = without_rows(F.parse_json("document"))
    labels = documents.select(F.explode(_buckets(parsed, "$.aggregations.product.product.buckets", "labels")).alias("b"))
    field = lambda name: F.try_variant_get("b", f"$.{name}", "variant")
    rows = labels.select(
        F.try_variant_get(required(field("key"), "string", "label"), "$", "string").alias("label"),
        required_count(field("doc_count"), "label_count").alias("label_count"),
        F.explode_outer(_buckets(F.col("b"), "$.trend_period.buckets", "months")).alias("m"),
    )
    part = lambda name: F.try_variant_get("m", f"$.{name}", "variant")
    return rows.select("label", "label_count", F.when(F.col("m").isNotNull(), required_month(F.coalesce(part("key_as_string"), part("key")), "month")).alias("month"), F.when(F.col("m").isNotNull(), required_count(part("doc_count"), "month_count")).alias("n"))


def trend_totals(documents: DataFrame) -> DataFrame:
    """The response's own totals: all rows, and rows of labels that it left out."""
    parsed = without_rows(F.parse_json("document"))
    at = lambda path: F.try_variant_get(parsed, path, "variant")
    return documents.select(required_count(at("$.aggregations.product.doc_count"), "total").alias("total"), required_count(at("$.aggregations.product.product.sum_other_doc_count"), "left_out").alias("left_out"))


def trend_checks(months: DataFrame, totals: DataFrame, start: str, end: str, labels: tuple[str, ...], legacy: tuple[str, ...]) -> DataFrame:
    """One row of checks of label and month counts over months in [start, end), as YYYY-MM."""
    own = months.groupBy("label").agg(F.max("label_count").alias("stated"), F.coalesce(F.sum("n"), F.lit(0)).alias("summed"), F.coalesce(F.bool_or((F.col("month") >= start) & (F.col("month") < end)), F.lit(False)).alias("inside"))
    inside = F.col("inside")
    known = F.col("label").isin(*labels)
    sums = own.agg(
        F.sum("stated").alias("stated"), F.bool_and(F.col("stated") == F.col("summed")).alias("label_months_reconcile"),
        (F.count_if(inside & F.col("label").isin(*legacy)) == 0).alias("no_legacy_labels"), (F.count_if(inside & ~known & ~F.col("label").isin(*legacy)) == 0).alias("no_unknown_labels"),
        (F.count_if(inside & known) == len(labels)).alias("all_labels_observed"),
    )
    wanted = f"sequence(DATE'{start}-01', add_months(DATE'{end}-01', -1), INTERVAL 1 MONTH)"
    seen = months.where((F.col("month") >= start) & (F.col("month") < end)).agg((F.count_distinct("month") == F.expr(f"size({wanted})")).alias("months_complete"))
    row = totals.agg(F.sum("total").alias("total"), F.sum("left_out").alias("left_out")).join(sums).join(seen)  # one row each
    return row.select((F.col("left_out") == 0).alias("complete_labels"), (F.col("stated") == F.col("total")).alias("counts_reconcile"), "label_months_reconcile", "months_complete", "no_legacy_labels", "no_unknown_labels", "all_labels_observed")
