"""Table constraints and cross-layer reconciliation as violation counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework import schemas as S


def _closed(column: str, values: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"size(array_except({column}, array({listed}))) = 0"


_SHA = "rlike '^[0-9a-f]{64}$'"
#: Conditions that every row of a stored table meets, by name; null counts as a violation.
CONSTRAINTS: dict[str, dict[str, str]] = {
    "raw.ingestion_batches": {"bytes_positive": "artifact_byte_count > 0", "returned_positive": "returned_record_count > 0", "inserted_is_returned": "inserted_record_count = returned_record_count"},
    "raw.complaints": {"ordinal_not_negative": "source_row_ordinal >= 0", "payload_is_object": "coalesce(schema_of_variant(try_parse_json(payload)) LIKE 'OBJECT%', false)"},
    "staging.transformation_batches": {"counts_not_negative": "input_record_count >= 0 AND accepted_record_count >= 0 AND quarantined_record_count >= 0", "output_is_input": "output_record_count = input_record_count", "statuses_add_up": "accepted_record_count + quarantined_record_count = output_record_count"},
    "staging.complaint_outcomes": {
        "ordinal_not_negative": "source_row_ordinal >= 0",
        "status_known": "outcome_status IN ('accepted', 'quarantined')",
        "accepted_has_no_reasons": "(outcome_status = 'accepted') = (size(quarantine_reasons) = 0)",
        "reasons_known": _closed("quarantine_reasons", S.QUARANTINE_REASONS),
        "accepted_is_whole": "outcome_status = 'quarantined' OR (complaint_id IS NOT NULL AND date_received IS NOT NULL AND narrative IS NOT NULL AND narrative_sha256 IS NOT NULL AND product_raw IS NOT NULL)",
    },
    "analytical.population_runs": {"window_ordered": "window_start < window_end_exclusive", "output_is_input": "output_record_count = input_record_count", "statuses_add_up": "eligible_record_count + excluded_record_count = output_record_count"},
    "analytical.population_outcomes": {
        "status_known": "eligibility_status IN ('eligible', 'excluded')",
        "eligible_has_no_reasons": "(eligibility_status = 'eligible') = (size(exclusion_reasons) = 0)",
        "reasons_known": _closed("exclusion_reasons", S.EXCLUSION_REASONS),
        "eligible_is_whole": "eligibility_status = 'excluded' OR (target_product IS NOT NULL AND narrative_char_count > 0)",
        "eligible_is_english": "eligibility_status = 'excluded' OR coalesce(detected_language = 'en', false)",
        "undetermined_has_no_language": "NOT array_contains(exclusion_reasons, 'language_undetermined') OR detected_language IS NULL",
    },
    "analytical.split_runs": {
        "boundaries_ordered": "window_start < train_end_exclusive AND train_end_exclusive < validation_end_exclusive AND validation_end_exclusive < window_end_exclusive",
        "dispositions_add_up": "included_record_count + duplicate_same_label_count + duplicate_label_conflict_count = input_eligible_count",
        "assignments_add_up": "train_record_count + validation_record_count + test_record_count = included_record_count",
        "commit_is_hex": "implementation_commit_sha rlike '^[0-9a-f]{40}$'",
        "manifest_is_sha256": f"source_run_manifest_sha256 {_SHA}",
    },
    "analytical.split_outcomes": {
        "disposition_known": "disposition IN ('included', 'duplicate_same_label', 'duplicate_label_conflict')",
        "included_is_assigned": "(disposition = 'included') = (split_assignment IS NOT NULL AND exclusion_reason IS NULL)",
        "fingerprint_is_sha256": f"narrative_fingerprint_sha256 {_SHA}",
    },
}
#: Primary keys of the stored tables.
KEYS: dict[str, list[str]] = {
    "raw.ingestion_batches": ["batch_id"],
    "raw.complaints": ["batch_id", "source_row_ordinal"],
    "staging.transformation_batches": ["raw_batch_id", "transformation_version"],
    "staging.complaint_outcomes": ["raw_batch_id", "source_row_ordinal", "transformation_version"],
    "analytical.population_runs": ["raw_batch_id", "staging_transformation_version", "population_version"],
    "analytical.population_outcomes": ["raw_batch_id", "source_row_ordinal", "staging_transformation_version", "population_version"],
    "analytical.split_runs": ["run_id", "population_version", "split_version"],
    "analytical.split_outcomes": ["run_id", "raw_batch_id", "source_row_ordinal", "population_version", "split_version"],
}


def violations(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """rule and the number of rows that break it, from one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in rules]), F.array(*[F.col(f"`{n}`") for n in rules]))).alias("rule", "n_violations"))


def table_violations(df: DataFrame, table: str) -> DataFrame:
    """Constraint violations of a stored table, duplicate keys included."""
    doubled = df.groupBy(*KEYS[table]).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n_violations"))
    return violations(df, CONSTRAINTS[table]).union(doubled.select(F.lit("primary_key_unique").alias("rule"), "n_violations"))


def require(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """The rows themselves, with an error, naming the rule only, at the first row that breaks one."""
    out = df
    for name, condition in rules.items():
        out = out.where(F.when(F.coalesce(F.expr(condition), F.lit(False)), True).otherwise(F.raise_error(F.lit(name)).cast("boolean")))
    return out


def count_reconciliation(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose counts n differ between two tables, or are in one alone; none where they reconcile."""
    both = left.select(*keys, F.col("n").alias("left_n")).join(right.select(*keys, F.col("n").alias("right_n")), keys, "full_outer")
    return both.where(~F.col("left_n").eqNullSafe(F.col("right_n")))


def array_checks(rows: DataFrame, values: str, size: int, label: str, labels: int, by: list[str] | None = None) -> DataFrame:
    """Whether arrays have a size and finite values, and labels lie in [0, labels); in one row, or by keys."""
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = (F.col(label) >= 0) & (F.col(label) < labels)
    return rows.groupBy(*(by or [])).agg(F.bool_and(F.size(values) == size).alias("whole"), F.bool_and(finite).alias("finite"), F.bool_and(known).alias("labels_in_range"), F.count("*").alias("n"))


def child_counts(parents: DataFrame, children: DataFrame, key: str, stated: str) -> DataFrame:
    """Each parent's stated and actual number of children."""
    actual = children.groupBy(key).agg(F.count("*").alias("actual"))
    return parents.join(actual, key, "left").select(key, stated, F.coalesce("actual", F.lit(0)).alias("actual"), (F.col(stated) == F.coalesce("actual", F.lit(0))).alias("agrees"))


def present(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Parents of which a child is there."""
    return parents.join(children, keys, "left_semi")


def absent(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Parents of which no child is there."""
    return parents.join(children, keys, "left_anti")


def totals(rows: DataFrame, key: str, value: str, at: str, by: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Rows, distinct keys (all, and of those that meet a condition), the sum of a value, and the latest time."""
    more = [] if where is None else [F.count_distinct(F.when(where, F.col(key))).alias("keys_where")]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), *more, F.coalesce(F.sum(value), F.lit(0)).alias("total"), F.max(at).alias("latest"))


def label_coverage(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Labels missing from a table, and values of it outside the labels."""
    own = rows.select(F.col(column).alias("label")).distinct()
    known = labels.select("label").distinct()
    return known.exceptAll(own).withColumn("problem", F.lit("missing")).union(own.exceptAll(known).withColumn("problem", F.lit("unknown")))


def layer_report(raw: DataFrame, staged: DataFrame, population: DataFrame) -> DataFrame:
    """Counts of three layers and whether they reconcile, in one row.

    raw: batch_id; staged: raw_batch_id, outcome_status; population: raw_batch_id, eligibility_status.
    """
    r = raw.agg(F.count("*").alias("raw_records"), F.count_distinct("batch_id").alias("raw_batches"))
    s = staged.agg(F.count("*").alias("staged_records"), F.count_if(F.col("outcome_status") == "accepted").alias("accepted"), F.count_if(F.col("outcome_status") == "quarantined").alias("quarantined"), F.count_distinct("raw_batch_id").alias("staged_batches"))
    p = population.agg(F.count("*").alias("population_records"), F.count_if(F.col("eligibility_status") == "eligible").alias("eligible"), F.count_if(F.col("eligibility_status") == "excluded").alias("excluded"), F.count_distinct("raw_batch_id").alias("population_batches"))
    row = r.join(s).join(p)  # one row each
    c = F.col
    return row.select(
        *row.columns,
        (c("raw_records") == c("staged_records")).alias("raw_is_staged"),
        (c("accepted") + c("quarantined") == c("staged_records")).alias("staged_adds_up"),
        (c("staged_records") == c("population_records")).alias("staged_is_population"),
        (c("eligible") + c("excluded") == c("population_records")).alias("population_adds_up"),
        ((c("raw_batches") == c("staged_batches")) & (c("staged_batches") == c("population_batches"))).alias("batches_agree"),
        (c("quarantined") <= c("excluded")).alias("quarantined_are_excluded"),
    )


def funnel(report: DataFrame, split_counts: DataFrame) -> DataFrame:
    """Stages of a cohort and their records, in order."""
    row = report.join(split_counts)
    stages = ("staged_records", "eligible", "included_record_count", "train_record_count", "validation_record_count", "test_record_count")
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("stage"), F.col(s).cast("long").alias("n")) for i, s in enumerate(stages)])).alias("x")).select("x.*")


def share_of_total(rows: DataFrame, key: str) -> DataFrame:
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Square-root balanced weights."""
    counted = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy()
    return counted.withColumn("weight", F.sqrt(F.sum("n").over(all_) / (F.count("*").over(all_) * F.col("n"))))


def gates(metrics: DataFrame, limits: Mapping[str, str]) -> DataFrame:
    """Adds failed_gates and passed; a metric that is null fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in limits.items()]))
    return metrics.withColumn("failed_gates", failed).withColumn("passed", F.size("failed_gates") == 0)


#: Limits of an operational model; fixed values.
CPU_GATES = {"p95_ms": "p95_ms <= 750", "max_ms": "max_ms <= 1500", "load_seconds": "load_seconds <= 30", "working_set_bytes": "working_set_bytes <= 2147483648", "artifact_bytes": "artifact_bytes <= 268435456"}


def latency_summary(rows: DataFrame, by: str, column: str) -> DataFrame:
    """Count, mean, nearest-rank p50 and p95, and maximum of latencies."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(column).alias("mean_ms"), rank(0.5).alias("p50_ms"), rank(0.95).alias("p95_ms"), F.max(column).alias("max_ms"))


def operational_choice(candidates: DataFrame, limits: Mapping[str, str] = CPU_GATES) -> DataFrame:
    """The preferred model (least preference) of those that pass all gates, else the fallback (largest)."""
    judged = gates(candidates, limits)
    best = judged.agg(F.min(F.when(F.col("passed"), F.struct("preference", "model"))).alias("best"), F.max(F.struct("preference", "model")).alias("last"))
    return best.select(F.coalesce("best.model", "last.model").alias("model"), F.col("best").isNotNull().alias("passed_all_gates"))
