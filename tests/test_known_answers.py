"""Operators on small tables with known answers."""

import datetime as dt
import hashlib
import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievework import schemas as S
from sievework.functions import stats
from sievework.functions import text as X
from sievework.operators import abstention, calibration, features, metrics, profile, rules, split, staging


def sha(value) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


GOOD = {"complaint_id": 17, "date_received": "2024-01-02T12:00:00-05:00", "complaint_what_happened": " Café\r\ntext ", "product": "Mortgage", "has_narrative": True, "issue": " "}


def raw(spark, *payloads, ids=None, shas=None):
    rows = [("b", i, ids[i] if ids else str(p.get("complaint_id")), shas[i] if shas else sha(p), json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "batch_id string, source_row_ordinal int, complaint_id string, source_record_sha256 string, payload string")


def test_accepted_row_is_normalised(spark):
    r = staging.stage(raw(spark, GOOD)).first()
    assert (r.outcome_status, r.quarantine_reasons, r.complaint_id, r.date_received) == ("accepted", [], "17", dt.date(2024, 1, 2))
    assert r.narrative == "Café\ntext" and r.issue_raw is None and r.narrative_sha256 == hashlib.sha256(r.narrative.encode()).hexdigest()


def test_reasons_keep_their_order(spark):
    bad = {"complaint_id": None, "date_received": "01/02/2024", "complaint_what_happened": "  ", "product": 42, "has_narrative": False}
    flag = {**GOOD, "complaint_id": True, "has_narrative": "true", "date_received": "2024-1-2"}
    out = {r.source_row_ordinal: r.quarantine_reasons for r in staging.stage(raw(spark, bad, GOOD, GOOD, flag, {**GOOD, "complaint_id": "x"}, ids=["1", "17", "17", "1", "y"], shas=[sha(bad), "0" * 64, sha(GOOD), sha(flag), sha({**GOOD, "complaint_id": "x"})])).collect()}
    assert out[0] == ["complaint_id_missing_or_invalid", "date_received_invalid", "narrative_missing_or_invalid", "product_missing_or_invalid", "has_narrative_not_true"]
    assert out[1] == ["source_record_checksum_mismatch", "duplicate_complaint_id_within_batch"] and out[2] == ["duplicate_complaint_id_within_batch"]
    assert out[3] == ["complaint_id_missing_or_invalid", "date_received_invalid", "has_narrative_not_true"] and out[4] == ["raw_complaint_id_mismatch"]
    guaranteed = staging.stage(raw(spark, {**GOOD, "has_narrative": None}), F.lit(True)).first()
    assert guaranteed.outcome_status == "accepted"


def test_population_of_five(spark):
    rows = [("b", 0, "1.1.0", "accepted", dt.date(2024, 1, 1), "the end of the day", "Mortgage"), ("b", 1, "1.1.0", "accepted", dt.date(2023, 8, 31), "the end", "Mortgage"), ("b", 2, "1.1.0", "accepted", dt.date(2024, 1, 1), "los que el y", "Mortgage"), ("b", 3, "1.1.0", "accepted", dt.date(2024, 1, 1), "the end", "Other"), ("b", 4, "1.1.0", "quarantined", None, None, None)]
    out = staging.assess(spark.createDataFrame(rows, "raw_batch_id string, source_row_ordinal int, transformation_version string, outcome_status string, date_received date, narrative string, product_raw string"))
    got = {r.source_row_ordinal: (r.eligibility_status, r.exclusion_reasons, r.detected_language) for r in out.collect()}
    assert got[0] == ("eligible", [], "en") and got[1][1] == ["date_before_window"] and got[2] == ("excluded", ["language_not_english"], "es")
    assert got[3][1] == ["product_outside_taxonomy"] and got[4] == ("excluded", ["staging_quarantined"], None)
    assert all(r.n_violations == 0 for r in rules.table_violations(out, "analytical.population_outcomes").collect())


def test_fingerprints(spark):
    rows = spark.createDataFrame([("  CAFÉ\taccount\r\nproblem  ",), ("café account problem",), ("10.00",), ("1000",), (" ",), ("Straße",), ("strasse",)], "t string")
    f = [r.f for r in rows.select(X.fingerprint(F.col("t")).alias("f")).collect()]
    assert f[0] == f[1] and f[2] != f[3] and f[4] is None and f[5] == f[6]


def test_split_of_twenty_one(spark):
    rows = [(i, f"text {i}", "A", dt.date(2023, 9, 1) + dt.timedelta(days=30 * i)) for i in range(16)]
    rows += [(16, "TEXT  1", "A", dt.date(2024, 12, 31)), (17, "text 1", "A", dt.date(2024, 12, 1)), (18, "clash", "A", dt.date(2024, 1, 1)), (19, "Clash", "B", dt.date(2024, 1, 2)), (20, "late", "B", dt.date(2024, 12, 31))]
    df = spark.createDataFrame(rows, "id long, text string, label string, day date")
    out = split.classify(df, X.fingerprint(F.col("text")), F.col("label"), [F.col("day"), F.col("id")], F.col("day"))
    counts = split.split_counts(out).first()
    assert (counts.input_record_count, counts.included_record_count, counts.same_label_duplicate_count, counts.label_conflict_count) == (21, 17, 2, 2)
    assert (counts.train_record_count, counts.validation_record_count, counts.test_record_count) == (13, 2, 2)
    assert split.leaking_fingerprints(out).isEmpty()
    assert all(split.split_checks(out, "day", start=S.WINDOW_START, validation=S.VALIDATION_START, test=S.TEST_START, end=S.WINDOW_END).first())
    with pytest.raises(PySparkException):
        split.classify(df.withColumn("day", F.lit("2030-01-01").cast("date")), F.col("text"), F.col("label"), [F.col("id")], F.col("day")).collect()


def test_lengths(spark):
    hist = profile.histogram(spark.createDataFrame([(2,), (4,), (10,), (130,)], "n int"), "n")
    p = profile.length_profile(hist).first()
    assert (p.record_count, p.token_count, p.p50, p.p75, p.p90, p.p95, p.p99) == (4, 146, 4, 10, 130, 130, 130)
    t = profile.truncation(hist).where("max_length = 128").first()
    assert (t.exceeding, t.exceeding_share) == (1, 0.25) and round(t.retained_share, 6) == 0.986301
    s = rules.latency_summary(spark.range(1, 1537).select(F.lit("m").alias("m"), F.col("id").alias("x")), "m", "x").first()
    assert (s.p50_ms, s.p95_ms, s.max_ms) == (768, 1460, 1536)


def test_constant_predictor(spark):
    counts = spark.createDataFrame([("train", "A", 6), ("train", "B", 4), ("val", "A", 2), ("val", "B", 8)], "split string, label string, n long")
    best = metrics.majority(counts.where("split = 'train'").groupBy("label").agg(F.sum("n").alias("n")), "label", "n").first()
    assert best.label == "A"
    grid = metrics.universe(counts, ["A", "B"], "predicted")
    full = counts.join(grid).select("split", F.col("label").alias("actual"), "predicted", F.when(F.col("predicted") == "A", F.col("n")).otherwise(0).alias("n"))
    m = {r.split: r for r in metrics.summary(metrics.per_class(full, ["split"]), ["split"]).collect()}
    assert (m["train"].accuracy, m["train"].macro_precision, m["train"].macro_recall) == (0.6, 0.3, 0.5) and math.isclose(m["train"].macro_f1, 0.375) and math.isclose(m["train"].weighted_f1, 0.45)
    assert m["val"].accuracy == 0.2
    with pytest.raises(PySparkException):
        metrics.majority(spark.createDataFrame([("A", 1), ("B", 1)], "label string, n long"), "label", "n").collect()


def test_reliability_bins(spark):
    rows = spark.createDataFrame([(0.0, False), (0.2, True), (0.5, True), (0.999, False), (1.0, True)], "confidence double, correct boolean")
    bins = {r.bin: r for r in calibration.equal_width(rows).collect()}
    assert len(bins) == 15 and bins[0].n == 1 and bins[14].n == 2 and bins[1].n == 0 and bins[1].gap is None
    assert sum(b.n for b in bins.values()) == 5 and sum(b.n_correct for b in bins.values()) == 3


def test_temperature(spark):
    rows = spark.createDataFrame([([4.0, 0.0], 0), ([4.0, 0.0], 0), ([4.0, 0.0], 0), ([4.0, 0.0], 1)], "s array<double>, y int")
    assert abs(calibration.fit_temperature(rows, F.col("s"), F.col("y"))["temperature"] - 4 / math.log(3)) < 0.05
    assert calibration.invariant(rows, F.col("s"), 2.0).first() == (True, True)
    with pytest.raises(ValueError):
        calibration.fit_temperature(rows.where("y = 0"), F.col("s"), F.col("y"))


def test_thresholds(spark):
    rows = spark.createDataFrame([(0, 0, 0.95), (0, 0, 0.75), (1, 0, 0.75), (1, 1, 0.4)], "actual int, predicted int, confidence double")
    out = {r.threshold: r for r in abstention.sweep(rows, [0, 1]).collect()}
    assert out[0.75].suggested == 3 and out[0.8].suggested == 1 and out[0.0].suggested == 4 and out[0.95].suggested == 1
    assert out[0.75].false_suggestions == 1 and out[0.95].worst_actual_coverage == 0 and "coverage_at_least_0p60" in out[0.8].failed_gates
    assert abstention.select_threshold(abstention.sweep(rows, [0, 1])).first().status == "manual_review_only"
    many = spark.range(400).select((F.col("id") % 2).cast("int").alias("actual"), (F.col("id") % 2).cast("int").alias("predicted"), F.lit(0.97).alias("confidence"))
    assert abstention.select_threshold(abstention.sweep(many, [0, 1])).first().proposed_threshold == 0.5
    w = spark.range(1).select(stats.wilson(F.lit(5), F.lit(10), "lower").alias("a"), stats.wilson(F.lit(0), F.lit(0), "lower").alias("b"), stats.wilson(F.lit(10), F.lit(10), "upper").alias("c")).first()
    assert math.isclose(w.a, 0.236593090512564) and w.b is None and math.isclose(w.c, 1.0)


def test_selection(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.7, 0.1, 0.8, True), ("b", 0.5, 0.7, 0.1, 0.8, True), ("c", 0.5, 0.9, 0.9, 0.9, False)], "candidate_id string, c double, macro_f1 double, worst_recall double, weighted_f1 double, converged boolean")
    assert metrics.select_candidate(rows).first().candidate_id == "b"
    fold = spark.range(1).select(metrics.early_stopping(F.array(F.lit(0.5), F.lit(0.5009), F.lit(0.501))).alias("e"), metrics.early_stopping(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.5), F.lit(0.9))).alias("g")).first()
    assert tuple(fold.e) == (0.501, 0, False) and tuple(fold.g) == (0.5, 2, True)
    models = spark.createDataFrame([(1, "new", 800.0, 1.0, 1.0, 1, 1), (2, "old", 1.0, 1.0, 1.0, 1, 1)], "preference int, model string, p95_ms double, max_ms double, load_seconds double, working_set_bytes long, artifact_bytes long")
    assert rules.operational_choice(models).first() == ("old", True)


def test_batches(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 97 + 1).alias("length"))
    groups = profile.length_groups(rows, "doc_id", "length", batch=32, pool=256)
    assert groups.select("doc_id").distinct().count() == 1000
    assert groups.groupBy("pool_id", "batch_id").count().agg(F.max("count")).first()[0] == 32
    shape = profile.collation(groups, "length").first()
    assert shape.records == 1000 and shape.most_width % 8 == 0 and 0 <= shape.padding_share < 0.2
    ids = groups.withColumn("ids", F.transform(F.sequence(F.lit(1), F.col("length").cast("int")), lambda x: x))
    batch = profile.collated(ids, "ids").first()
    assert len({len(x) for x in batch.input_ids}) == 1 and [sum(m) for m in batch.attention_mask] == [sum(i > 0 for i in x) for x in batch.input_ids]
    assert profile.shuffled(rows, "doc_id", 43).count() == 1000


def test_learning_rate_and_weights(spark):
    steps = spark.range(100).select(stats.warmup_linear(F.col("id"), 100).alias("f")).collect()
    assert steps[0].f == 0 and steps[6].f == 1 and steps[99].f > 0
    w = {r.label: r.weight for r in rules.class_weights(spark.createDataFrame([("a",)] * 3 + [("b",)], "label string"), "label").collect()}
    assert math.isclose(w["a"], math.sqrt(4 / 6)) and math.isclose(w["b"], math.sqrt(2))


def test_tokenised(spark):
    rows = spark.createDataFrame([("a b c",), (None,)], "text string")
    out = features.tokenized(rows, "text", lambda texts: [[len(w) for w in t.split()] for t in texts], limit=2).collect()
    assert [r.input_ids for r in out] == [[1, 1], []]
    assert rows.select(features.whitespace_length("text")).first()[0] == 5


def test_small_text_functions(spark):
    rows = spark.createDataFrame([("a\r\nb", "Mortgage"), ("a\nb", "Other")], "t string, label string")
    got = rows.select(X.content_sha256(F.col("t"), any_line_ends=True).alias("h"), X.content_sha256(F.col("t")).alias("g"), X.short_label(F.col("label"), {"Mortgage": "Mort."}).alias("s"), X.html_escaped(F.lit("<a&'>")).alias("e")).collect()
    assert got[0].h == got[1].h == got[1].g != got[0].g and [r.s for r in got] == ["Mort.", "Other"] and got[0].e == "&lt;a&amp;&#x27;&gt;"
    urls = spark.createDataFrame([("https://h/p/x",), ("http://h/p/x",), ("https://u@h/p/x",), ("https://h/q",), ("https://h:1/p",), (None,)], "u string")
    assert [r[0] for r in urls.select(X.url_accepted(F.col("u"), "h", "/p")).collect()] == [True, False, False, False, False, False]
