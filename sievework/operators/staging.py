"""Cleansing: raw rows to accepted or quarantined outcomes, and accepted ones to a population."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework import schemas as S
from sievework.functions import text as X


def reasons(*rules: tuple[Column, str]) -> Column:
    """The names of the conditions that hold, in order; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in rules]))


def with_copies(rows: DataFrame, keys: list[str], name: str, least: int = 1) -> DataFrame:
    """Adds how many rows have the same keys, null where a key is null or they are fewer than ``least``."""
    known = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(name))
    return rows.join(known.where(F.col(name) >= least) if least > 1 else known, keys, "left")


def stage(raw: DataFrame, guaranteed: Column | None = None) -> DataFrame:
    """Normalised fields, ordered quarantine reasons and a status for each raw row.

    raw: batch_id, source_row_ordinal, complaint_id, source_record_sha256, payload (JSON text).
    guaranteed: whether the batch's request already selects rows with a narrative.
    Ids are counted within a batch before the shuffle; those that repeat come back by a join, so rows without
    an id, or of a very common one, aren't gathered.
    """
    payload = F.col("payload")
    rows = raw.select(
        F.col("batch_id").alias("raw_batch_id"),
        "source_row_ordinal",
        "source_record_sha256",
        F.col("complaint_id").alias("_raw_id"),
        X.identifier_field(payload, "complaint_id").alias("complaint_id"),
        X.strict_date(X.string_field(payload, "date_received")).alias("date_received"),
        X.required_text(X.string_field(payload, "complaint_what_happened")).alias("narrative"),
        *[X.required_text(X.string_field(payload, f)).alias(f"{f}_raw") for f in ("product", "sub_product", "issue", "sub_issue", "submitted_via")],
        (~F.coalesce(X.canonical_json_sha256(payload) == F.col("source_record_sha256"), F.lit(False))).alias("_changed"),
        ((F.get_json_object(payload, "$.has_narrative") == "true") & (X.json_field_type(payload, "has_narrative") == "boolean")).alias("_narrated"),
        (F.lit(False) if guaranteed is None else F.coalesce(guaranteed, F.lit(False))).alias("_guaranteed"),
    )
    found = reasons(
        (F.col("_changed"), S.QUARANTINE_REASONS[0]),
        (F.col("complaint_id").isNull(), S.QUARANTINE_REASONS[1]),
        (F.col("complaint_id") != F.col("_raw_id"), S.QUARANTINE_REASONS[2]),
        (F.col("_copies") > 1, S.QUARANTINE_REASONS[3]),
        (F.col("date_received").isNull(), S.QUARANTINE_REASONS[4]),
        (F.col("narrative").isNull(), S.QUARANTINE_REASONS[5]),
        (F.col("product_raw").isNull(), S.QUARANTINE_REASONS[6]),
        (~F.coalesce("_narrated", F.lit(False)) & ~F.col("_guaranteed"), S.QUARANTINE_REASONS[7]),
    )
    judged = with_copies(rows, ["raw_batch_id", "complaint_id"], "_copies", 2).withColumn("quarantine_reasons", found)
    return judged.select(
        "raw_batch_id", "source_row_ordinal", F.lit(S.TRANSFORMATION_VERSION).alias("transformation_version"), "source_record_sha256",
        F.when(F.size("quarantine_reasons") > 0, "quarantined").otherwise("accepted").alias("outcome_status"), "quarantine_reasons",
        "complaint_id", "date_received", "narrative", F.sha2("narrative", 256).alias("narrative_sha256"),
        "product_raw", "sub_product_raw", "issue_raw", "sub_issue_raw", "submitted_via_raw",
    )


def stage_header(outcomes: DataFrame) -> DataFrame:
    """Counts of each staged batch; they reconcile by construction and are checked by ``rules``."""
    return outcomes.groupBy("raw_batch_id", "transformation_version").agg(
        F.count("*").cast("int").alias("input_record_count"),
        F.count_if(F.col("outcome_status") == "accepted").cast("int").alias("accepted_record_count"),
        F.count_if(F.col("outcome_status") == "quarantined").cast("int").alias("quarantined_record_count"),
        F.count("*").cast("int").alias("output_record_count"),
    )


def guaranteed_batches(batches: DataFrame) -> DataFrame:
    """batch_id and whether its request asked for JSON rows with a narrative."""
    flag = lambda name: F.get_json_object("manifest", f"$.request.parameters.{name}")
    return batches.select("batch_id", F.coalesce((flag("format") == "json") & (flag("has_narrative") == "true"), F.lit(False)).alias("guaranteed"))


Identifier = Callable[[Column], Column]


def stop_word_language(text: Column) -> Column:
    """A plain identifier by counts of common words; null without a winner."""
    words = {"en": ("the", "and", "of", "to"), "de": ("der", "und", "die", "das"), "fr": ("le", "les", "des", "et"), "es": ("el", "los", "que", "y")}  # fixed values
    tokens = F.split(F.lower(text), "[^\\p{L}]+")

    def hits(common: tuple[str, ...]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*common)))

    counts = F.array(*[F.struct(hits(common).alias("n"), F.lit(lang).alias("lang")) for lang, common in words.items()])
    best = F.element_at(F.array_sort(counts, lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).otherwise(0)), 1)
    rivals = F.size(F.filter(counts, lambda c: c["n"] == best["n"]))
    return F.when((best["n"] > 0) & (rivals == 1), best["lang"])


def assess(staged: DataFrame, identify: Identifier = stop_word_language, *, labels: tuple[str, ...] = S.LABELS, start: str = S.WINDOW_START, end: str = S.WINDOW_END, wanted: str = "en") -> DataFrame:
    """Eligibility and ordered exclusion reasons of staged rows.

    The identifier, the one costly rule, sees null for rows that the cheap rules exclude.
    """
    accepted = F.col("outcome_status") == "accepted"
    day = F.col("date_received")
    structural = reasons(
        (F.col("outcome_status") == "quarantined", S.EXCLUSION_REASONS[0]),
        (accepted & (day < F.lit(start).cast("date")), S.EXCLUSION_REASONS[1]),
        (accepted & (day >= F.lit(end).cast("date")), S.EXCLUSION_REASONS[2]),
        (accepted & ~F.col("product_raw").isin(*labels), S.EXCLUSION_REASONS[3]),
    )
    broken = ~F.col("outcome_status").isin("accepted", "quarantined") | (accepted & (day.isNull() | F.col("narrative").isNull() | F.col("product_raw").isNull()))
    checked = F.when(broken, F.raise_error(F.lit("staging_contract_violation")).cast("array<string>")).otherwise(structural)
    rows = staged.withColumn("_reasons", checked)
    rows = rows.withColumn("_asked", F.when(F.size("_reasons") == 0, F.col("narrative"))).withColumn("detected_language", identify(F.col("_asked")))
    asked = F.col("_asked").isNotNull()
    found = F.concat("_reasons", reasons((asked & (F.col("detected_language") != wanted), S.EXCLUSION_REASONS[4]), (asked & F.col("detected_language").isNull(), S.EXCLUSION_REASONS[5])))
    rows = rows.withColumn("exclusion_reasons", found).withColumn("_eligible", F.size("exclusion_reasons") == 0)
    return rows.select(
        "raw_batch_id", "source_row_ordinal", F.col("transformation_version").alias("staging_transformation_version"), F.lit(S.POPULATION_VERSION).alias("population_version"),
        F.when(F.col("_eligible"), "eligible").otherwise("excluded").alias("eligibility_status"), "exclusion_reasons",
        F.when(F.col("_eligible"), F.col("product_raw")).alias("target_product"), "detected_language",
        F.when(accepted, F.length("narrative")).alias("narrative_char_count"),
    )


def reason_counts(outcomes: DataFrame, column: str) -> DataFrame:
    """Rows for each reason; a row with two reasons counts twice, one without none."""
    return outcomes.select(F.explode(column).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def population_header(outcomes: DataFrame) -> DataFrame:
    """Counts and lengths of each assessed batch."""
    eligible = F.col("eligibility_status") == "eligible"
    return outcomes.groupBy("raw_batch_id", "population_version").agg(
        F.count("*").alias("input_record_count"),
        F.count_if(eligible).alias("eligible_record_count"),
        F.count_if(~eligible).alias("excluded_record_count"),
        F.min(F.when(eligible, F.col("narrative_char_count"))).alias("min_chars"),
        F.max(F.when(eligible, F.col("narrative_char_count"))).alias("max_chars"),
        F.round(F.avg(F.when(eligible, F.col("narrative_char_count"))), 3).alias("mean_chars"),
    )
