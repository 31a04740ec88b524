"""Sources of raw batches: JSON envelopes and arrays, manifests, artifacts, settings."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import contracts
from sievework.functions import text as X


class SourceError(Exception):
    """A failed check; it carries a code and safe details, never source values."""

    def __init__(self, code: str, **details: str | int | bool | None):
        super().__init__(code)
        self.code, self.details = code, details

    def report(self) -> dict:
        return {"status": "error", "error": {"code": self.code, **self.details}, "privacy": {"source_values_logged": False}}


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """path, source_row_ordinal, payload of each ``hits.hits[]._source`` of search responses."""
    return envelope_rows(_whole_files(spark, path))


def envelope_rows(documents: DataFrame) -> DataFrame:
    """The same of documents (path, document) at hand."""
    hits = documents.select("path", F.expr("posexplode(cast(variant_get(parse_json(document), '$.hits.hits') AS array<variant>))").alias("source_row_ordinal", "hit"))
    return hits.select("path", "source_row_ordinal", F.to_json(F.variant_get("hit", "$._source", "variant")).alias("payload"))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """The same of export arrays ``[{_source}]``."""
    return export_rows(_whole_files(spark, path))


def export_rows(documents: DataFrame) -> DataFrame:
    """The same of documents (path, document) at hand."""
    items = documents.select("path", F.expr("posexplode(cast(parse_json(document) AS array<variant>))").alias("source_row_ordinal", "item"))
    return items.select("path", "source_row_ordinal", F.to_json(F.variant_get("item", "$._source", "variant")).alias("payload"))


def read_large_exports(spark: SparkSession, path: str) -> DataFrame:
    """The same of arrays of any size: the JSON source streams an array's items, so a task holds one at a time.

    Files don't split, so a row's place is its running number less that of its file's first row.
    """
    rows = spark.read.schema("_source variant").option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("_at"), "_source")
    first = rows.groupBy("path").agg(F.min("_at").alias("_first"))
    return rows.join(first, "path").select("path", (F.col("_at") - F.col("_first")).cast("int").alias("source_row_ordinal"), F.to_json("_source").alias("payload"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with a JSON object a line, which split; ordinals are places in the file.

    Whole arrays of many GB are better rewritten as lines first: an array is one task's work.
    """
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def inspection(rows: DataFrame, lo: str, hi: str) -> DataFrame:
    """One row of counts and checks over payloads: unique ids, narratives, dates within [lo, hi)."""
    p = F.col("payload")
    day = X.strict_date(X.string_field(p, "date_received"))
    seen = rows.select(X.identifier_field(p, "complaint_id").alias("id"), day.alias("day"), X.stripped(X.string_field(p, "complaint_what_happened")).isNotNull().alias("narrated"), X.stripped(X.string_field(p, "product")).isNotNull().alias("labelled"))
    # Ids are counted in two steps, so no distinct set is gathered.
    ids = seen.groupBy("id").agg(F.count("*").alias("n"), F.count_if("narrated").alias("narrated"), F.count_if("labelled").alias("labelled"), F.min("day").alias("first"), F.max("day").alias("last"), F.count_if(~F.coalesce((F.col("day") >= F.lit(lo).cast("date")) & (F.col("day") < F.lit(hi).cast("date")), F.lit(False))).alias("outside"))
    known = F.col("id").isNotNull()
    return ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"), F.count_if(known).alias("unique_ids"), F.coalesce(F.sum(F.when(known, F.col("n") - 1)), F.lit(0)).alias("duplicate_ids"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_ids"),
        F.coalesce(F.sum("narrated"), F.lit(0)).alias("narratives"), F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.min("first").alias("first_date"), F.max("last").alias("last_date"), F.coalesce(F.sum("outside"), F.lit(0)).alias("outside_bounds"),
    )


def artifact_path(sha256: Column, root: str = "data/raw/sha256") -> Column:
    """Where an artifact lies by its content."""
    return F.concat(F.lit(f"{root}/"), F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit(".json"))


def verified_artifacts(spark: SparkSession, files: str, manifest: DataFrame) -> DataFrame:
    """Each stated artifact with whether its bytes, hash and name agree.

    manifest: relative_path, byte_count, sha256.
    """
    return verified(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(files).select("path", "content"), manifest)


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """The same of files (path, content) at hand."""
    found = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.length("content").alias("found_bytes"), F.sha2("content", 256).alias("found_sha256"))
    stated = manifest.withColumn("name", F.regexp_extract("relative_path", "([^/]+)$", 1))
    both = stated.join(found, "name", "left")
    no = F.lit(False)
    return both.select("relative_path", F.col("found_sha256").isNotNull().alias("exists"), F.coalesce(F.col("found_bytes") == F.col("byte_count"), no).alias("bytes_agree"), F.coalesce(F.col("found_sha256") == F.col("sha256"), no).alias("hash_agrees"), F.coalesce(F.concat("sha256", F.lit(".json")) == F.col("name"), no).alias("named_by_content"))


def synthetic(payload: Column, index: Column) -> Column:
    """Whether a row carries all marks of synthetic data."""
    return X.identifier_field(payload, "complaint_id").startswith("SYN-") & X.string_field(payload, "complaint_what_happened").startswith("SYNTHETIC") & F.lower(index).contains("synthetic")


def read_document(path: str, root: str, required: Mapping[str, object]) -> dict:
    """A JSON document under a trusted root whose fields have the required values."""
    place = trusted(path, root)
    try:
        document = json.loads(place.read_text("utf-8"), parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))
    except (OSError, ValueError) as error:
        raise SourceError("document_unreadable") from error
    if not isinstance(document, dict):
        raise SourceError("document_is_not_an_object")
    for name, value in required.items():
        if document.get(name) != value:
            raise SourceError("document_field_differs", field=name)
    return document


#: Fields of a batch manifest: type, and a pattern for texts; fixed values.
MANIFEST: dict[str, tuple[type, str]] = {
    "batch_id": (str, r"[A-Za-z0-9][A-Za-z0-9._-]*"),
    "manifest_version": (str, r"\d+\.\d+\.\d+"),
    "is_synthetic": (bool, ""),
    "request.request_fingerprint_sha256": (str, r"[0-9a-f]{64}"),
    "request.parameters": (dict, ""),
    "artifact.relative_path": (str, r"[^/].*"),
    "artifact.byte_count": (int, ""),
    "artifact.sha256": (str, r"[0-9a-f]{64}"),
    "records.returned": (int, ""),
    "records.min_date": (str, r"\d{4}-\d{2}-\d{2}"),
    "records.max_date": (str, r"\d{4}-\d{2}-\d{2}"),
}


def contract_problems(documents: DataFrame, schema: Mapping, column: str = "document") -> DataFrame:
    """The rows with ``problems`` (each ``place: keyword``) and ``first_problem`` of a JSON text under a schema."""
    parsed = documents.withColumn("_parsed", F.try_parse_json(column))
    found = parsed.withColumn("problems", contracts.problems(F.col("_parsed"), schema)).drop("_parsed")
    return found.withColumn("first_problem", F.get("problems", F.lit(0)))


def read_contracted(spark: SparkSession, path: str, root: str, schema: Mapping) -> dict:
    """A JSON document under a trusted root that keeps to a schema, or an error that names the first problem."""
    document = read_document(path, root, {})
    row = contract_problems(spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "document string"), schema).first()
    if row["first_problem"] is not None:
        raise SourceError("manifest_invalid", fields=row["first_problem"])
    return document


def field_problems(document: Mapping, fields: Mapping[str, tuple[type, str]]) -> list[str]:
    """The places of a document whose value is missing, of another type, negative, or not of the pattern."""
    out = []
    for place, (kind, pattern) in fields.items():
        value: object = document
        for part in place.split("."):
            value = value.get(part) if isinstance(value, Mapping) else None
        # A boolean is no whole number here.
        if not isinstance(value, kind) or (kind is int and (isinstance(value, bool) or value < 0)) or (kind is str and not re.fullmatch(pattern, value)):
            out.append(place)
    return out


def read_manifest(path: str, root: str) -> dict:
    """A batch manifest whose fields are all there and sound."""
    document = read_document(path, root, {})
    if problems := field_problems(document, MANIFEST):
        raise SourceError("manifest_invalid", fields=",".join(problems))
    return document


def trusted(path: str, root: str) -> Path:
    """A path inside ``root`` that neither climbs out of it nor passes a symbolic link."""
    base = Path(root).resolve()
    if os.path.isabs(path) or ".." in Path(path).parts:
        raise SourceError("path_outside_root")
    place = base
    for part in Path(path).parts:
        place /= part
        if place.is_symlink():
            raise SourceError("path_is_a_link")
    return place


def settings(names: tuple[str, ...], env_file: str | None = None, environ: Mapping[str, str] | None = None) -> dict[str, str]:
    """Settings from the environment, then from a file of NAME=value lines; all must be there."""
    found: dict[str, str] = {}
    if env_file and os.path.exists(env_file):
        for line in Path(env_file).read_text("utf-8").splitlines():
            if m := re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*", line):
                found[m[1]] = m[2].strip("\"'")
    found |= {k: v for k, v in (os.environ if environ is None else environ).items() if k in names}
    if missing := [n for n in names if not found.get(n)]:
        raise SourceError("setting_missing", names=",".join(missing))
    return {n: found[n] for n in names}


def monthly_shards(spark: SparkSession, start: str, end: str) -> DataFrame:
    """month, the half-open bounds, and the inclusive ones that a request takes."""
    months = spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{start}', add_months(DATE'{end}', -1), INTERVAL 1 MONTH)")).alias("lo"))
    return months.select(F.date_format("lo", "yyyy-MM").alias("month"), "lo", F.add_months("lo", 1).alias("hi"), F.col("lo").alias("request_min"), F.last_day("lo").alias("request_max"))


def preflight(shards: DataFrame, counts: DataFrame, limit: int | None = 100_000) -> DataFrame:
    """Each month's count and what is wrong with it: missing, below 1, at the export's limit (None: it has none), or unexpected."""
    both = shards.select("month", F.lit(True).alias("_wanted")).join(counts.select("month", "n"), "month", "full_outer")
    problem = F.when(F.col("_wanted").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") < 1, "count_invalid")
    problem = problem if limit is None else problem.when(F.col("n") >= limit, "export_limit_reached")
    return both.select("month", "n", problem.alias("problem"))


def retention(expires: Column, now: Column, due_days: int = 30) -> Column:
    """scheduled, due_soon or overdue, and whole days left, rounded up: a microsecond more than a day is two days."""
    left = F.unix_micros(expires.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    day = F.lit(86_400_000_000)
    days = F.call_function("div", left + F.pmod(-left, day), day)
    return F.struct(F.when(left < 0, "overdue").when(days <= due_days, "due_soon").otherwise("scheduled").alias("status"), F.greatest(days, F.lit(0)).alias("days_left"))


def report_rows(documents: DataFrame, schema: str, required: Mapping[str, str]) -> DataFrame:
    """Typed fields of JSON reports (path, document), with an error at the first that isn't JSON of the schema
    or lacks a required value."""
    typed = documents.select("path", F.from_json("document", schema, {"mode": "FAILFAST"}).alias("r"))
    sound = F.lit(True)
    for name, value in required.items():
        sound = sound & F.coalesce(F.col(f"r.{name}").cast("string") == value, F.lit(False))
    return typed.select("path", F.when(sound, F.col("r")).otherwise(F.raise_error(F.lit("document_field_differs"))).alias("r")).select("path", "r.*")


def run_manifest_checks(shards: DataFrame, expected: DataFrame) -> DataFrame:
    """Checks of a run's shards (month, batch_id, artifact_sha256, returned, unique_ids) in one row."""
    both = expected.select("month", F.lit(True).alias("_wanted")).join(shards, "month", "full_outer")
    return both.agg(
        F.bool_and(F.col("_wanted").isNotNull() & F.col("batch_id").isNotNull()).alias("months_complete"),
        (F.count("batch_id") == F.count_distinct("batch_id")).alias("batches_unique"),
        (F.count("artifact_sha256") == F.count_distinct("artifact_sha256")).alias("artifacts_unique"),
        F.bool_and(F.coalesce(F.col("returned") == F.col("unique_ids"), F.lit(False))).alias("counts_equal"),
        F.sum("returned").alias("returned"),
    )


def cleanup_inventory(spark: SparkSession, files: str, manifest: DataFrame) -> DataFrame:
    """What a cleanup of a run would remove: each stated artifact, and whether it is there. Nothing is deleted."""
    return verified_artifacts(spark, files, manifest).select("relative_path", "exists", F.when(F.col("exists") & F.col("hash_agrees"), "would_delete").when(F.col("exists"), "differs").otherwise("absent").alias("action"))
