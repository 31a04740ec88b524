"""Table schemas, closed vocabularies and version constants."""

from __future__ import annotations

from pyspark.sql import types as T

# Versions, windows, labels and reason codes that stored rows carry.
TRANSFORMATION_VERSION = "1.1.0"
POPULATION_VERSION = "1.0.0"
SPLIT_VERSION = "1.0.0"
FINGERPRINT_VERSION = "nfc-casefold-whitespace-sha256-v1"
WINDOW_START, WINDOW_END = "2023-09-01", "2025-01-01"
VALIDATION_START, TEST_START = "2024-09-01", "2024-11-01"
LABELS = (
    "Checking or savings account",
    "Credit card",
    "Credit reporting or other personal consumer reports",
    "Debt collection",
    "Debt or credit management",
    "Money transfer, virtual currency, or money service",
    "Mortgage",
    "Payday loan, title loan, personal loan, or advance loan",
    "Prepaid card",
    "Student loan",
    "Vehicle loan or lease",
)
# Labels of an earlier taxonomy; fixed values.
LEGACY_LABELS = (
    "Credit card or prepaid card",
    "Credit reporting, credit repair services, or other personal consumer reports",
    "Payday loan, title loan, or personal loan",
)
QUARANTINE_REASONS = (
    "source_record_checksum_mismatch",
    "complaint_id_missing_or_invalid",
    "raw_complaint_id_mismatch",
    "duplicate_complaint_id_within_batch",
    "date_received_invalid",
    "narrative_missing_or_invalid",
    "product_missing_or_invalid",
    "has_narrative_not_true",
)
EXCLUSION_REASONS = (
    "staging_quarantined",
    "date_before_window",
    "date_at_or_after_window_end",
    "product_outside_taxonomy",
    "language_not_english",
    "language_undetermined",
)
DISPOSITIONS = ("included", "duplicate_same_label", "duplicate_label_conflict")


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType())}


def struct(text: str) -> T.StructType:
    """A schema of ``name type`` items, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (item.split() for item in text.split(", "))])


#: The eight stored tables by schema and name; column names and types are fixed values.
TABLES: dict[str, T.StructType] = {
    "raw.ingestion_batches": struct("batch_id string, manifest_version string, is_synthetic boolean, request_fingerprint_sha256 string, artifact_sha256 string, artifact_relative_path string, artifact_byte_count long, retrieved_at timestamp, returned_record_count int, inserted_record_count int, retention_policy_id string, manifest string, inserted_at timestamp"),
    "raw.complaints": struct("batch_id string, source_row_ordinal int, complaint_id string, source_record_sha256 string, payload string, inserted_at timestamp"),
    "staging.transformation_batches": struct("raw_batch_id string, transformation_version string, input_record_count int, accepted_record_count int, quarantined_record_count int, output_record_count int, transformed_at timestamp"),
    "staging.complaint_outcomes": struct("raw_batch_id string, source_row_ordinal int, transformation_version string, source_record_sha256 string, outcome_status string, quarantine_reasons array<string>, complaint_id string, date_received date, narrative string, narrative_sha256 string, product_raw string, sub_product_raw string, issue_raw string, sub_issue_raw string, submitted_via_raw string, transformed_at timestamp"),
    "analytical.population_runs": struct("raw_batch_id string, staging_transformation_version string, population_version string, taxonomy_version string, window_start date, window_end_exclusive date, language_detector string, input_record_count int, eligible_record_count int, excluded_record_count int, output_record_count int, reported_at timestamp"),
    "analytical.population_outcomes": struct("raw_batch_id string, source_row_ordinal int, staging_transformation_version string, population_version string, eligibility_status string, exclusion_reasons array<string>, target_product string, detected_language string, narrative_char_count int, reported_at timestamp"),
    "analytical.split_runs": struct("run_id string, staging_transformation_version string, population_version string, split_version string, fingerprint_version string, taxonomy_version string, window_start date, train_end_exclusive date, validation_end_exclusive date, window_end_exclusive date, implementation_commit_sha string, source_run_manifest_sha256 string, input_eligible_count int, included_record_count int, duplicate_same_label_count int, duplicate_label_conflict_count int, train_record_count int, validation_record_count int, test_record_count int, created_at timestamp"),
    "analytical.split_outcomes": struct("run_id string, raw_batch_id string, source_row_ordinal int, population_version string, split_version string, staging_transformation_version string, disposition string, split_assignment string, exclusion_reason string, narrative_fingerprint_sha256 string, assigned_at timestamp"),
}
