"""Commands as plain functions: read stored layers, compute, check, store once, and return a report.

A report holds counts and metrics only. A command that has run for an identity returns the stored
result; one that would differ raises ``IdentityConflict``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import wraps
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import schemas as S
from sievework.functions import text as X
from sievework.operators import abstention, calibration, evidence, features, metrics, profile, rules, split, staging
from sievework.sources import acquisition, figures, http, migrations, tables, trends
from sievework.sources import documents as sources
from sievework.sources.tables import Store


def reported(*fields: str) -> Callable[[Callable[..., dict]], Callable[..., dict]]:
    """A command whose report has exactly these fields; an error where it hasn't."""

    def wrap(f: Callable[..., dict]) -> Callable[..., dict]:
        @wraps(f)
        def run(*args: object, **kwargs: object) -> dict:
            return tables.closed(f(*args, **kwargs), set(fields))

        return run

    return wrap


def row_report(df: DataFrame) -> dict:
    """A one-row table as a report."""
    first = df.first()
    return {} if first is None else first.asDict(recursive=True)


def table_report(df: DataFrame, limit: int = 1000) -> list[dict]:
    """A small table as a list; reports stay small."""
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


def ingest(store: Store, manifest: dict, files: str) -> dict:
    """Raw rows of an export whose manifest, bytes and hash agree, as ``raw`` tables."""
    spark = store.spark
    artifact = spark.createDataFrame([(manifest["artifact"]["relative_path"], int(manifest["artifact"]["byte_count"]), manifest["artifact"]["sha256"])], "relative_path string, byte_count long, sha256 string")
    verified = row_report(sources.verified_artifacts(spark, files, artifact))
    if not all(v for k, v in verified.items() if k != "relative_path"):
        raise sources.SourceError("artifact_differs", **{k: v for k, v in verified.items() if k != "relative_path"})
    read = sources.read_large_exports if manifest["request"]["parameters"].get("format") == "json" else sources.read_envelopes
    rows = read(spark, files)
    lo, hi = manifest["records"]["min_date"], manifest["records"]["max_date"]
    seen = row_report(sources.inspection(rows, lo, "9999-12-31"))
    if seen["record_count"] != manifest["records"]["returned"] or str(seen["first_date"]) < lo or str(seen["last_date"]) > hi:
        raise sources.SourceError("records_do_not_reconcile", returned=manifest["records"]["returned"], found=seen["record_count"])
    batch = manifest["batch_id"]
    complaints = rows.select(F.lit(batch).alias("batch_id"), "source_row_ordinal", X.identifier_field(F.col("payload"), "complaint_id").alias("complaint_id"), X.canonical_json_sha256(F.col("payload")).alias("source_record_sha256"), "payload", F.current_timestamp().alias("inserted_at"))
    n = int(seen["record_count"])
    from sievework.sources.tables import canonical

    header = spark.createDataFrame(
        [(batch, manifest["manifest_version"], bool(manifest.get("is_synthetic")), manifest["request"]["request_fingerprint_sha256"], manifest["artifact"]["sha256"], manifest["artifact"]["relative_path"], int(manifest["artifact"]["byte_count"]), n, n, canonical(manifest))],
        "batch_id string, manifest_version string, is_synthetic boolean, request_fingerprint_sha256 string, artifact_sha256 string, artifact_relative_path string, artifact_byte_count long, returned_record_count int, inserted_record_count int, manifest string",
    )
    written = store.append("raw.complaints", complaints, "raw.ingestion_batches", header, batch)
    return {"batch_id": batch, "written": written, **{k: str(v) if k.endswith("date") else v for k, v in seen.items()}}


@reported("batch_id", "written", "counts", "reasons")
def stage_batch(store: Store, batch: str) -> dict:
    raw = store.read("raw.complaints", batch)
    flag = staging.guaranteed_batches(store.read("raw.ingestion_batches", batch)).first()
    outcomes = staging.stage(raw, F.lit(bool(flag and flag["guaranteed"])))
    header = staging.stage_header(outcomes)
    written = store.append("staging.complaint_outcomes", outcomes, "staging.transformation_batches", header, batch)
    stored = store.read("staging.complaint_outcomes", batch)
    return {"batch_id": batch, "written": written, "counts": row_report(staging.stage_header(stored)), "reasons": table_report(staging.reason_counts(stored, "quarantine_reasons").orderBy("reason"))}


@reported("batch_id", "written", "counts", "reasons", "languages")
def report_population(store: Store, batch: str, identify: staging.Identifier = staging.stop_word_language, detector: str = "stop-words") -> dict:
    outcomes = staging.assess(store.read("staging.complaint_outcomes", batch), identify)
    counts = staging.population_header(outcomes)
    fixed = {"raw_batch_id": batch, "staging_transformation_version": S.TRANSFORMATION_VERSION, "language_detector": detector}
    header = counts.select(*[F.lit(v).alias(k) for k, v in fixed.items()], "population_version", F.lit(S.WINDOW_START).cast("date").alias("window_start"), F.lit(S.WINDOW_END).cast("date").alias("window_end_exclusive"), "input_record_count", "eligible_record_count", "excluded_record_count", F.col("input_record_count").alias("output_record_count"))
    written = store.append("analytical.population_outcomes", outcomes, "analytical.population_runs", header, batch)
    stored = store.read("analytical.population_outcomes", batch)
    return {"batch_id": batch, "written": written, "counts": row_report(staging.population_header(stored)), "reasons": table_report(staging.reason_counts(stored, "exclusion_reasons").orderBy("reason")), "languages": table_report(stored.where("detected_language IS NOT NULL").groupBy("detected_language").count().orderBy("detected_language"))}


def report_layers(store: Store) -> dict:
    return row_report(rules.layer_report(store.read("raw.complaints"), store.read("staging.complaint_outcomes"), store.read("analytical.population_outcomes")))


@reported("run_id", "written", "counts", "checks", "constraints")
def build_split(store: Store, run: str, commit: str, manifest_sha256: str, fingerprint: Column | None = None) -> dict:
    """The duplicate-isolated temporal split of all eligible rows, stored under a run id."""
    population, staged = store.read("analytical.population_outcomes"), store.read("staging.complaint_outcomes")
    keys = ["raw_batch_id", "source_row_ordinal"]
    eligible = population.where("eligibility_status = 'eligible'").select(*keys, "staging_transformation_version", "population_version", "target_product")
    texts = staged.select(*keys, F.col("transformation_version").alias("staging_transformation_version"), "narrative", "date_received", "complaint_id")
    rows = eligible.join(texts, [*keys, "staging_transformation_version"])
    order = [F.col(c) for c in ("date_received", "complaint_id", "raw_batch_id", "source_row_ordinal")]
    out = split.classify(rows, X.fingerprint(F.col("narrative")) if fingerprint is None else fingerprint, F.col("target_product"), order, F.col("date_received"))
    counts = split.split_counts(out)
    outcomes = out.select(F.lit(run).alias("run_id"), *keys, "population_version", F.lit(S.SPLIT_VERSION).alias("split_version"), "staging_transformation_version", "disposition", "split_assignment", "exclusion_reason", F.col("fingerprint").alias("narrative_fingerprint_sha256"))
    day = lambda x: F.lit(x).cast("date")
    header = counts.select(
        F.lit(run).alias("run_id"), F.lit(S.TRANSFORMATION_VERSION).alias("staging_transformation_version"), F.lit(S.POPULATION_VERSION).alias("population_version"), F.lit(S.SPLIT_VERSION).alias("split_version"), F.lit(S.FINGERPRINT_VERSION).alias("fingerprint_version"),
        day(S.WINDOW_START).alias("window_start"), day(S.VALIDATION_START).alias("train_end_exclusive"), day(S.TEST_START).alias("validation_end_exclusive"), day(S.WINDOW_END).alias("window_end_exclusive"), F.lit(commit).alias("implementation_commit_sha"), F.lit(manifest_sha256).alias("source_run_manifest_sha256"),
        F.col("input_record_count").alias("input_eligible_count"), "included_record_count", F.col("same_label_duplicate_count").alias("duplicate_same_label_count"), F.col("label_conflict_count").alias("duplicate_label_conflict_count"), "train_record_count", "validation_record_count", "test_record_count",
    )
    written = store.append("analytical.split_outcomes", outcomes, "analytical.split_runs", header, run)
    checks = split.split_checks(out, "date_received", start=S.WINDOW_START, validation=S.VALIDATION_START, test=S.TEST_START, end=S.WINDOW_END)
    return {"run_id": run, "written": written, "counts": row_report(split.split_counts(out)), "checks": row_report(checks), "constraints": table_report(rules.table_violations(store.read("analytical.split_outcomes", run), "analytical.split_outcomes").orderBy("rule"))}


def build_split_here(store: Store, run: str, repository: str, manifest: str, fingerprint: Column | None = None) -> dict:
    """``build_split`` under the lineage that is there: the commit that is checked out, which must be clean, and the manifest's hash."""
    commit, clean = acquisition.git_lineage(repository)
    if not clean:
        raise sources.SourceError("lineage_not_clean")
    return build_split(store, run, commit, acquisition.file_sha256(manifest), fingerprint)


@reported("label", "metrics")
def majority_baseline(rows: DataFrame, split_column: str, label: str) -> dict:
    """The training majority label's metrics on every split."""
    counts = rows.groupBy(F.col(split_column).alias("split"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    best = metrics.majority(counts.where("split = 'train'"), "label", "n").first()["label"]
    labels = [r["label"] for r in counts.select("label").distinct().orderBy("label").limit(1000).collect()]
    matrix = metrics.confusion(rows.select(F.col(split_column).alias("split"), F.col(label).alias("label")).withColumn("predicted", F.lit(best)), "label", "predicted", labels, by=["split"])
    return {"label": best, "metrics": table_report(metrics.summary(metrics.per_class(matrix, ["split"]), ["split"]).orderBy("split"))}


@reported("overall", "per_class", "top_confusions", "months", "lengths", "rarity", "weakest")
def error_analysis(rows: DataFrame, labels: list[str], training: DataFrame) -> dict:
    """rows: actual, predicted, received (date), chars; training: label, n."""
    matrix = metrics.confusion(rows, "actual", "predicted", labels)
    classes = metrics.per_class(matrix)

    def sliced(name: str, column: Column) -> list[dict]:
        own = metrics.confusion(rows.withColumn(name, column), "actual", "predicted", labels, by=[name])
        return table_report(metrics.summary(metrics.per_class(own, [name]), [name]).orderBy(name))

    from sievework.functions import stats

    return {
        "overall": row_report(metrics.summary(classes)),
        "per_class": table_report(classes.orderBy("label")),
        "top_confusions": table_report(metrics.top_confusions(matrix)),
        "months": sliced("month", F.date_format("received", "yyyy-MM")),
        "lengths": sliced("band", stats.length_band(F.col("chars"))),
        "rarity": table_report(metrics.rarity_groups(classes, training).orderBy("rarity")),
        "weakest": row_report(metrics.weakest(classes)),
    }


@reported("lengths", "truncation")
def token_profile(rows: DataFrame, length: str, label: str) -> dict:
    hist = profile.histogram(rows, length, label)
    return {"lengths": table_report(profile.length_profile(hist).orderBy("label")), "truncation": table_report(profile.truncation(hist).orderBy("label", "max_length"))}


def dataset_shapes(rows: DataFrame, key: str, length: str) -> dict:
    return row_report(profile.collation(profile.length_groups(rows, key, length), length))


@reported("temperature", "nll", "before", "after", "checks")
def calibrate(rows: DataFrame, scores: Column, label: Column, classes: int, fit_on: Column) -> dict:
    """Fit a temperature on one part of the rows and measure the other before and after."""
    fitted = calibration.fit_temperature(rows.where(fit_on), scores, label)
    rest = rows.where(~fit_on)

    def measured(temperature: float) -> dict:
        out = calibration.scored(rest, scores, label, temperature)
        return row_report(calibration.metrics(out)) | row_report(calibration.expected_error(calibration.equal_width(out)))

    checked = calibration.scored(rest, scores, label, fitted["temperature"])
    return {**fitted, "before": measured(1.0), "after": measured(fitted["temperature"]), "checks": row_report(calibration.checks(checked, classes)) | row_report(calibration.invariant(rest, scores, fitted["temperature"]))}


@reported("temperature", "figures")
def draw_figures(rows: DataFrame, scores: Column, label: Column, labels: list, fit_on: Column, root: str) -> dict:
    """Reliability before and after scaling, and risk by coverage after it, of the rows that the temperature isn't fitted on.
    Each figure is published once."""
    heat = calibration.fit_temperature(rows.where(fit_on), scores, label)["temperature"]
    before, after = (calibration.scored(rows.where(~fit_on), scores, label, t) for t in (1.0, heat))
    swept = abstention.sweep(after.select(F.col("_label").alias("actual"), "predicted", "confidence"), labels)
    drawn = {
        "reliability.svg": figures.reliability_svg({"before scaling": calibration.equal_width(before), "after scaling": calibration.equal_width(after)}),
        "risk-coverage.svg": figures.risk_coverage_svg(swept),
    }
    return {"temperature": heat, "figures": [tables.publish_text(rows.sparkSession, f"{root.rstrip('/')}/{name}", text) for name, text in drawn.items()]}


@reported("from", "to", "steps")
def migrate(store: Store, to: str) -> dict:
    """Bring a store's tables to a revision, up or down."""
    at = migrations.current(store)
    up = all(way == "up" for way, _ in migrations.planned(at, to))
    return {"from": at, "to": to, "steps": migrations.upgrade(store, to) if up else migrations.downgrade(store, to)}


@reported("thresholds", "selection", "blocking")
def analyse_abstention(rows: DataFrame, labels: list) -> dict:
    """rows: actual, predicted, confidence."""
    swept = abstention.sweep(rows, labels)
    return {"thresholds": table_report(swept.orderBy("threshold")), "selection": row_report(abstention.select_threshold(swept)), "blocking": table_report(abstention.blocking(swept).orderBy("threshold"))}


@reported("labels", "wins")
def compare_models(ours: DataFrame, theirs: DataFrame, metric: str = "f1") -> dict:
    comparison = metrics.compared(ours, theirs, metric)
    return {"labels": table_report(comparison.orderBy("label")), "wins": table_report(metrics.win_counts(comparison).orderBy("winner"))}


def fetched_trends(spark: SparkSession, url: str, scheme: str = "https") -> DataFrame:
    """The aggregate response of a URL that asks for no rows, of ``trends.TREND_BYTES`` at most."""
    if set(parse_qs(urlsplit(url).query, keep_blank_values=True)) & trends.ROW_PARAMETERS:
        raise sources.SourceError("url_refused")
    spark.dataSource.register(http.BoundedHttp)
    options = {"urls": json.dumps([url]), "host": urlsplit(url).hostname or "", "scheme": scheme, "maxbytes": str(trends.TREND_BYTES)}
    return spark.read.format("bounded_http").options(**options).load().select("document")


def fetch_taxonomy(spark: SparkSession, url: str, start: str = S.WINDOW_START[:7], end: str = S.WINDOW_END[:7], scheme: str = "https") -> dict:
    """``taxonomy`` of a response over HTTP, asked for once and never written."""
    document = fetched_trends(spark, url, scheme).first()["document"]  # one response, its bytes bounded
    return taxonomy_of(spark.createDataFrame([(document,)], "document string"), start, end)


def taxonomy(spark: SparkSession, path: str, start: str = S.WINDOW_START[:7], end: str = S.WINDOW_END[:7]) -> dict:
    return taxonomy_of(spark.read.text(path, wholetext=True).withColumnRenamed("value", "document"), start, end)


@reported("checks", "labels")
def taxonomy_of(documents: DataFrame, start: str, end: str) -> dict:
    """Labels by month of an aggregate response, and its checks against the taxonomy."""
    months = trends.trend_months(documents)
    checks = trends.trend_checks(months, trends.trend_totals(documents), start, end, S.LABELS, S.LEGACY_LABELS)
    return {"checks": row_report(checks), "labels": table_report(months.groupBy("label").agg(F.sum("n").alias("n"), F.min("month").alias("first"), F.max("month").alias("last")).orderBy("label"))}


def publish_shard(path: str, root: str) -> dict:
    """A downloaded file as an artifact named by its content."""
    return vars(acquisition.stream_artifact(acquisition.file_chunks(path), root))


@reported("run_id", "shards", "records")
def acquire(spark: SparkSession, root: str, run: str, base: str, counts: dict[str, int], *, start: str = S.WINDOW_START, end: str = S.WINDOW_END, scheme: str = "https", pause: float = 35.0) -> dict:
    """Download every month's export, inspect it, and publish the run's manifest; all of it or nothing."""
    months = {r["month"]: r for r in sources.monthly_shards(spark, start, end).orderBy("month").collect()}
    host = urlsplit(base).hostname or ""

    def fetch(month: str) -> Iterator[bytes]:
        m = months[month]
        return http.body(http.export_url(base, str(m["request_min"]), str(m["request_max"]), counts[month]), host, scheme=scheme)

    shards = acquisition.acquire_run(list(months), counts, fetch, root, pause=pause)
    try:
        for shard in shards:
            m = months[str(shard["month"])]
            seen = row_report(sources.inspection(sources.read_large_exports(spark, f"{root}/{shard['artifact_relative_path']}"), str(m["lo"]), str(m["hi"])))
            if seen["outside_bounds"] or seen["duplicate_ids"] or seen["missing_ids"] or seen["narratives"] != seen["record_count"]:
                raise sources.SourceError("export_inspection_failed", month=str(shard["month"]))
            shard |= {"returned_record_count": seen["record_count"], "batch_id": f"{run}-{shard['month']}"}
        acquisition.publish_run(root, f"runs/{run}.json", run, shards, list(months))
    except BaseException:
        acquisition.discard(root, [str(s["artifact_relative_path"]) for s in shards if s["created"]])
        raise
    return {"run_id": run, "shards": len(shards), "records": sum(int(s["returned_record_count"]) for s in shards)}  # type: ignore[call-overload]


@reported("status", "days_left", "cleanup_required")
def retention_checkpoint(spark: SparkSession, deadline: str, now: str) -> dict:
    at = lambda x: F.lit(x).cast("timestamp")
    found = row_report(spark.range(1).select(sources.retention(at(deadline), at(now)).alias("r")).select("r.*"))
    return {**found, "cleanup_required": found["status"] == "overdue"}


@reported("run_id", "executed", "artifacts")
def cleanup_run(root: str, manifest: dict, execute: bool = False, confirmation: str | None = None) -> dict:
    """What a run's artifacts are; with ``execute`` and the run's id, their removal."""
    shards = [{"relative_path": s["artifact_relative_path"], "sha256": s["artifact_sha256"]} for s in manifest["shards"]]
    return {"run_id": manifest["run_id"], "executed": execute, "artifacts": acquisition.cleanup(root, manifest["run_id"], shards, execute=execute, confirmation=confirmation)}


@reported("model", "selected", "candidates")
def train(rows: DataFrame, text: str, label: str, labels: list[str], path: str, *, candidates: dict | None = None, max_iter: int = 200, min_df: int = 5) -> dict:
    """Search the candidates on the train and validation rows (split_assignment) and save the best model once."""
    of = lambda name: rows.where(F.col("split_assignment") == name)
    model, found = features.search(of("train"), of("validation"), text, label, labels, candidates=candidates or features.CANDIDATES, max_iter=max_iter, min_df=min_df)
    model.write().save(path)  # fails where a model is
    return {"model": path, "selected": metrics.select_candidate(found).first()["candidate_id"], "candidates": table_report(found.orderBy("candidate_id"))}


def smoke(spark: SparkSession, path: str) -> dict:
    """The whole training on a few made-up rows."""
    words = {"a": "alpha beta gamma", "b": "delta epsilon zeta"}
    rows = [(f"{words[k]} {k}{i % 3}", k, "validation" if i % 4 == 0 else "train") for i in range(24) for k in words]
    table = spark.createDataFrame(rows, "text string, label string, split_assignment string")
    return train(table, "text", "label", ["a", "b"], path, candidates={"c1.0-none": (1.0, False)}, max_iter=50, min_df=1)


@reported("choice", "candidates")
def select_model(candidates: DataFrame, limits: dict[str, str] | None = None) -> dict:
    """The operational model: candidates with evidence of quality and calibration, and CPU measures.

    candidates: model, preference (least is wanted most), the metrics of ``evidence.QUALITY`` and
    ``evidence.CALIBRATION``, and the measures of ``rules.CPU_GATES``; the last preference is the fallback.
    """
    judged = evidence.evaluated(candidates).withColumnRenamed("failed_gates", "failed_evidence").withColumnRenamed("passed", "evidence_holds")
    gates = {**(limits or rules.CPU_GATES), "evidence": "evidence_holds"}
    chosen = rules.operational_choice(judged, gates)
    return {"choice": row_report(chosen), "candidates": table_report(rules.gates(judged, gates).select("model", "preference", "failed_evidence", "failed_gates", "passed").orderBy("preference"))}


def profile_fields(spark: SparkSession, path: str) -> dict:
    """The observed schema of a folder of search responses."""
    return {"fields": table_report(profile.schema_profile(sources.read_envelopes(spark, path), "payload").orderBy("key"))}
