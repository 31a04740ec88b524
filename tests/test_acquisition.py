"""Artifacts, manifests, lineage, cleanup, aggregate responses, and the models of the commands."""

import hashlib
import json
import random
import subprocess

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sievework import cli
from sievework.operators import calibration, evidence, features, latency, metrics, profile, rules, split
from sievework.plans import workflows as W
from sievework.sources import acquisition as A
from sievework.sources import documents as D
from sievework.sources import tables, trends
from sievework.sources.tables import IdentityConflict, Store


def test_streamed_artifacts(tmp_path):
    body = [b"a" * 70_000, b"b" * 10]
    sha = hashlib.sha256(b"".join(body)).hexdigest()
    first = A.stream_artifact(body, str(tmp_path))
    assert (first.sha256, first.byte_count, first.created) == (sha, 70_010, True) and first.relative_path.endswith(f"{sha[:2]}/{sha}.json")
    assert not A.stream_artifact(iter(body), str(tmp_path)).created
    for chunks, limit in (([], 10), ([b"123", b"4567"], 5), (["text"], 10)):
        with pytest.raises(D.SourceError):
            A.stream_artifact(chunks, str(tmp_path), limit=limit)

    def broken():
        yield b"x"
        raise OSError

    with pytest.raises(OSError):
        A.stream_artifact(broken(), str(tmp_path))
    (tmp_path / first.relative_path).write_bytes(b"other")
    with pytest.raises(D.SourceError, match="artifact_conflict"):
        A.stream_artifact(body, str(tmp_path))
    assert not list((tmp_path / "data/raw/sha256/.partial").iterdir())


def test_run_manifest_and_cleanup(tmp_path):
    shards = []
    for month in ("2024-01", "2024-02"):
        a = A.stream_artifact([month.encode()], str(tmp_path))
        shards.append({"month": month, "batch_id": f"b-{month}", "artifact_sha256": a.sha256, "artifact_relative_path": a.relative_path, "preflight_count": 2, "returned_record_count": 2})
    months = ["2024-01", "2024-02"]
    assert A.publish_run(str(tmp_path), "runs/r.json", "run-1", shards, months) and not A.publish_run(str(tmp_path), "runs/r.json", "run-1", shards, months)
    for bad in (shards[:1], shards[::-1], [shards[0], {**shards[1], "batch_id": shards[0]["batch_id"]}], [shards[0], {**shards[1], "returned_record_count": 1}]):
        with pytest.raises(D.SourceError):
            A.publish_run(str(tmp_path), "runs/x.json", "run-1", bad, months)
    with pytest.raises(D.SourceError, match="document_conflict"):
        A.publish_run(str(tmp_path), "runs/r.json", "run-2", shards, months)
    manifest = D.read_document("runs/r.json", str(tmp_path), {"run_id": "run-1"})
    assert {a["action"] for a in W.cleanup_run(str(tmp_path), manifest)["artifacts"]} == {"delete"}
    with pytest.raises(D.SourceError, match="cleanup_not_confirmed"):
        W.cleanup_run(str(tmp_path), manifest, True, "run-2")
    W.cleanup_run(str(tmp_path), manifest, True, "run-1")
    assert {a["action"] for a in W.cleanup_run(str(tmp_path), manifest)["artifacts"]} == {"absent"}


def test_acquired_runs(tmp_path):
    months, now, waits = ["2024-01", "2024-02"], [0.0], []

    def sleep(seconds: float) -> None:
        waits.append(seconds)
        now[0] += seconds

    def fetch(month: str):
        now[0] += 5
        yield month.encode()
        if month in broken:
            raise OSError

    broken: set[str] = set()
    ask = lambda counts: A.acquire_run(months, counts, fetch, str(tmp_path), free_bytes=1, sleep=sleep, clock=lambda: now[0])
    with pytest.raises(D.SourceError, match="preflight_failed"):
        ask({"2024-01": 1, "2024-02": 100_000})
    with pytest.raises(D.SourceError, match="disk_too_full"):
        A.acquire_run(months, dict.fromkeys(months, 1), fetch, str(tmp_path), free_bytes=1 << 60)
    broken.add("2024-02")
    with pytest.raises(OSError):
        ask(dict.fromkeys(months, 1))
    assert not list(tmp_path.rglob("*.json"))  # the first month's artifact went with the run
    broken.clear()
    waits.clear()
    shards = ask(dict.fromkeys(months, 1))
    assert waits == [30.0] and [s["month"] for s in shards] == months and len(list(tmp_path.rglob("*.json"))) == 2


def test_buffered_shuffle(spark):
    rows = spark.range(5000).repartition(3).withColumn("t", F.col("id").cast("string"))
    first = [tuple(r) for r in profile.buffer_shuffled(rows, 64, 7).collect()]
    assert sorted(first) == [(i, str(i)) for i in range(5000)] and first != [tuple(r) for r in rows.collect()]
    assert first == [tuple(r) for r in profile.buffer_shuffled(rows, 64, 7).collect()] != [tuple(r) for r in profile.buffer_shuffled(rows, 64, 8).collect()]
    assert profile.buffer_shuffled(rows.where("false")).count() == 0


def test_ranked_duplicates(spark):
    rng = random.Random(3)
    data = [(i, "hot" if i % 3 else f"p{i % 7}", rng.choice(["a", "b", None])) for i in range(600)]
    rows = spark.createDataFrame(data + [(1000, None, "a"), (1001, None, "b")], "id long, print string, source string")
    got = {r.id: r["rank"] for r in split.ranked_duplicates(rows, F.col("print"), [F.col("source"), F.col("id")]).collect()}
    want = {}
    for name in {p for _, p, _ in data} | {None}:
        own = sorted((r for r in [*data, (1000, None, "a"), (1001, None, "b")] if r[1] == name), key=lambda r: (r[2] is not None, r[2] or "", r[0]))
        want |= {r[0]: k + 1 for k, r in enumerate(own)}
    assert got == want
    assert split.ranked_duplicates(rows.where("false"), F.col("print"), [F.col("id")]).count() == 0


def test_equal_confidences(spark):
    """One confidence for all rows: bins follow the tie-breaker."""
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit(0.5).alias("confidence"), (F.col("id") < 100).alias("correct"))
    got = {r.bin: (r.n, round(r.accuracy, 6)) for r in calibration.equal_mass(rows, ["k"], 10).collect()}
    assert got == {i: (100, 1.0 if i == 0 else 0.0) for i in range(10)}


def test_required_slices(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "band string, n int")
    assert {tuple(r) for r in metrics.complete(rows, "band", ["a", "b"]).collect()} == {("a", 1), ("b", 2)}
    for expected in (["a", "b", "c"], ["a"]):
        with pytest.raises(Exception, match="band_slices_incomplete"):
            metrics.complete(rows, "band", expected).collect()


def test_tables_come_and_go(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert len(store.create()) == 8 and store.create() == []
    assert store.read("raw.complaints").count() == 0
    rows = spark.createDataFrame([("b", 1, "1", "0" * 64, "{}")], "batch_id string, source_row_ordinal int, complaint_id string, source_record_sha256 string, payload string")
    store.append("raw.complaints", rows, "raw.ingestion_batches", spark.createDataFrame([("b", "1")], "batch_id string, manifest_version string"), "b")
    with pytest.raises(IdentityConflict):
        store.remove()
    assert store.read("raw.complaints").count() == 1
    empty = Store(spark, f"file://{tmp_path}/e")
    empty.create()
    assert len(empty.remove()) == 8 and not empty.exists("raw.complaints", "none")


def test_latency_and_reports(spark):
    found = latency.timed(len, ["a", "bb"], warmups=2, repeats=3)
    assert len(found["latencies_ms"]) == 6 and found["peak_bytes"] > 0
    run = latency.in_subprocess("from sievework.operators import latency; import json; print(json.dumps(latency.timed(len, ['a'])))")
    assert len(run["latencies_ms"]) == 3 and run["process_seconds"] > 0
    rows = spark.createDataFrame([("m", x) for x in run["latencies_ms"]], "model string, ms double")
    assert rules.latency_summary(rows, "model", "ms").first().n == 3
    with pytest.raises(D.SourceError):
        latency.in_subprocess("raise SystemExit(1)")
    assert tables.closed({"a": 1}, {"a"}) == {"a": 1}
    with pytest.raises(ValueError):
        tables.closed({"a": 1, "b": 2}, {"a"})
    assert tables.bars_svg([("a<b", 0.5)]).count("<rect") == 1 and "a&lt;b" in tables.bars_svg([("a<b", 2.0)])


def test_library_tokenizer(spark):
    names = pytest.importorskip("public_tokenizers")
    path = names.path("word_bpe_49k.json")
    rows = spark.createDataFrame([(1, "hello wide world"), (2, None)], "id long, text string")
    got = {r.id: list(r.input_ids) for r in features.tokenized(rows, "text", features.library_tokenizer(path), 2).collect()}
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    assert got == {1: plain.encode("hello wide world").ids[:2], 2: plain.encode("").ids[:2]}


def test_lineage(tmp_path):
    run = lambda *args: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)
    with pytest.raises(D.SourceError):
        A.git_lineage(str(tmp_path / "none"))
    run("init")
    (tmp_path / "a").write_text("a")
    run("add", "a")
    run("commit", "-m", "a")
    sha, clean = A.git_lineage(str(tmp_path))
    assert len(sha) == 40 and clean
    (tmp_path / "b").write_text("b")
    assert A.git_lineage(str(tmp_path)) == (sha, False)


def test_manifest_fields(tmp_path):
    good = {"batch_id": "b-1", "manifest_version": "2.0.0", "is_synthetic": True, "request": {"request_fingerprint_sha256": "0" * 64, "parameters": {}}, "artifact": {"relative_path": "a/b.json", "byte_count": 3, "sha256": "f" * 64}, "records": {"returned": 1, "min_date": "2024-01-01", "max_date": "2024-01-02"}}
    assert D.field_problems(good, D.MANIFEST) == []
    bad = {**good, "is_synthetic": "yes", "artifact": {"relative_path": "/etc", "byte_count": True, "sha256": "F" * 64}, "records": {"returned": -1}}
    assert D.field_problems(bad, D.MANIFEST) == ["is_synthetic", "artifact.relative_path", "artifact.byte_count", "artifact.sha256", "records.returned", "records.min_date", "records.max_date"]
    (tmp_path / "m.json").write_text(json.dumps(bad))
    with pytest.raises(D.SourceError, match="manifest_invalid"):
        D.read_manifest("m.json", str(tmp_path))


def test_large_exports(spark, tmp_path):
    for name, n in (("a", 50), ("b", 7)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"_source": {"complaint_id": i, "x": {"deep": [1, None, 2.5]}}} for i in range(n)], indent=1))
    got = D.read_large_exports(spark, str(tmp_path)).collect()
    own = D.read_exports(spark, str(tmp_path)).collect()
    key = lambda r: (r.path.rsplit("/", 1)[1], r.source_row_ordinal, r.payload)
    assert sorted(map(key, got)) == sorted(map(key, own)) and len(got) == 57


def response(months=(("2024-01-01T00:00:00.000Z", 2),), **more):
    label = {"key": "Mortgage", "doc_count": 2, "trend_period": {"buckets": [{"key_as_string": m, "doc_count": n} for m, n in months]}}
    return {"aggregations": {"product": {"doc_count": 2, "product": {"sum_other_doc_count": 0, "buckets": [label]}}}, **more}


def test_trend_guards(spark):
    frame = lambda d: spark.createDataFrame([(json.dumps(d),)], "document string")
    assert [tuple(r) for r in trends.trend_months(frame(response())).collect()] == [("Mortgage", 2, "2024-01", 2)]
    checks = lambda d: trends.trend_checks(trends.trend_months(frame(d)), trends.trend_totals(frame(d)), "2024-01", "2024-02", ("Mortgage",), ("Old",)).first()
    assert all(checks(response()))
    assert not checks(response((("2024-01-01", 1),))).label_months_reconcile and not checks(response((("2024-02-01", 2),))).months_complete
    bad = [response(hits={"hits": [{"_source": {}}]}), response((("2024-01-02", 2),)), response((("2024-01-01", -1),)), response((("2024-01-01", "2"),)), {"aggregations": {}}]
    for document in bad:
        with pytest.raises(Exception, match="rows_in_aggregate|is_no_month|is_negative|is_not_"):
            trends.trend_months(frame(document)).collect()


def test_evidence_errors(spark):
    rows = spark.createDataFrame([("a", True, 1.0), ("b", False, 2.0), ("c", True, 3.0), ("c", True, 4.0)], "id string, converged boolean, score double")
    assert evidence.the_selected(rows, "id", F.lit("a")).first().score == 1.0
    for name in ("b", "c", "d"):
        with pytest.raises(Exception, match="selection_not_unique"):
            evidence.the_selected(rows, "id", F.lit(name)).collect()
    one = lambda host: spark.createDataFrame([(host, 2.0)], "host string, ms double")
    assert evidence.benchmark_pairs(one("h"), one("h"), ["host"], ["ms"]).first().ms_ratio == 1.0
    with pytest.raises(Exception, match="benchmarks_not_comparable"):
        evidence.benchmark_pairs(one("h"), one("g"), ["host"], ["ms"]).collect()
    found = spark.createDataFrame([(["x"], False)], "c array<string>, ok boolean")
    with pytest.raises(Exception, match="finding_unresolved"):
        evidence.findings(found, "c", F.col("ok")).collect()
    a = spark.createDataFrame([(1.5, 3, "m")], "temperature double, classes int, model_sha256 string")
    assert all(evidence.same_calibrator(a, a).first()) and not evidence.same_calibrator(a, a.union(a)).first().one_of_each


def test_store_compares_rows(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([("b", i, str(i), "0" * 64, "{}") for i in range(3)], "batch_id string, source_row_ordinal int, complaint_id string, source_record_sha256 string, payload string")
    header = spark.createDataFrame([("b", "1.0.0")], "batch_id string, manifest_version string")
    write = lambda r: store.append("raw.complaints", r, "raw.ingestion_batches", header, "b")
    assert write(rows) and not write(rows.orderBy(F.desc("source_row_ordinal")))
    with pytest.raises(IdentityConflict):
        write(rows.withColumn("complaint_id", F.lit("x")))


def test_models_are_saved(spark, tmp_path):
    report = W.smoke(spark, f"file://{tmp_path}/model")
    assert report["selected"] == "c1.0-none" and report["candidates"][0]["accuracy"] == 1.0
    model = PipelineModel.load(f"file://{tmp_path}/model")
    rows = spark.createDataFrame([("alpha beta a1", "a"), ("zeta delta", "b")], "text string, label string")
    assert [r.predicted for r in features.predictions(model, rows).orderBy("label").collect()] == ["a", "b"]
    with pytest.raises(Exception):
        W.smoke(spark, f"file://{tmp_path}/model")


def test_tfidf_weights(spark):
    """(1 + ln tf) (1 + ln((n + 1) / (df + 1))), of unit length."""
    import math

    from pyspark.ml import Pipeline

    rows = spark.createDataFrame([("aa aa bb",), ("aa cc",), ("aa bb",)], "text string")
    model = Pipeline(stages=features.vectorizer(min_df=1, max_df=3.0)).fit(rows)
    terms = model.stages[3].vocabulary
    v = model.transform(rows.limit(1)).first().features
    got = {terms[i]: x for i, x in zip(v.indices.tolist(), v.values.tolist(), strict=True)}
    plain = {"aa": (1 + math.log(2)) * 1.0, "bb": 1 + math.log(4 / 3), "aa aa": 1 + math.log(2), "aa bb": 1 + math.log(4 / 3)}
    length = math.sqrt(sum(x * x for x in plain.values()))
    assert got == pytest.approx({k: x / length for k, x in plain.items()})


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "t.json").write_text(json.dumps(response()))
    (tmp_path / "shard").write_bytes(b"[]")
    base = {"baseline_macro_f1": 0.5, "candidate_worst_recall": 0.2, "baseline_worst_recall": 0.1, "calibrated_ece": 0.1, "uncalibrated_ece": 0.2, "calibrated_nll": 1.0, "uncalibrated_nll": 2.0, "p95_ms": 10.0, "max_ms": 20.0, "load_seconds": 1.0, "working_set_bytes": 5.0, "artifact_bytes": 5.0}
    models = [{"model": "large", "preference": 1, "candidate_macro_f1": 0.4, **base}, {"model": "small", "preference": 2, "candidate_macro_f1": 0.6, **base}]
    spark.createDataFrame(models).write.parquet(str(tmp_path / "models"))

    def ask(*args):
        code = cli.main(list(args), spark)
        return code, json.loads(capsys.readouterr().out)

    assert ask("profile-taxonomy", "--path", str(tmp_path / "t.json"))[1]["checks"]["counts_reconcile"]
    assert ask("publish-shard", "--path", str(tmp_path / "shard"), "--root", str(tmp_path))[1]["byte_count"] == 2
    assert ask("retention-checkpoint", "--deadline", "2024-02-01", "--now", "2024-01-20")[1] == {"status": "due_soon", "days_left": 12, "cleanup_required": False}
    found = ask("select-model", "--rows", str(tmp_path / "models"))[1]
    assert found["choice"] == {"model": "small", "passed_all_gates": True} and found["candidates"][0]["failed_evidence"] == ["quality_macro_f1"]
    assert ask("lineage", "--root", str(tmp_path / "none"))[0] == 1


def test_acquire_over_http(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            item = {"complaint_id": query["date_received_min"], "date_received": wrong.get(query["date_received_min"], query["date_received_max"]), "complaint_what_happened": "x", "product": "P"}
            raw = json.dumps([{"_source": item}] * 1).encode()
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    wrong: dict[str, str] = {}
    ask = lambda run, counts: W.acquire(spark, str(tmp_path), run, f"http://127.0.0.1:{server.server_port}/export", counts, start="2024-01-01", end="2024-03-01", scheme="http", pause=0)
    try:
        wrong["2024-02-01"] = "2024-03-01"
        with pytest.raises(D.SourceError, match="export_inspection_failed"):
            ask("run-0", {"2024-01": 1, "2024-02": 1})
        assert not list(tmp_path.rglob("*.json"))
        wrong.clear()
        with pytest.raises(D.SourceError, match="run_count_differs"):
            ask("run-0", {"2024-01": 1, "2024-02": 2})
        assert not list(tmp_path.rglob("*.json"))
        assert ask("run-1", {"2024-01": 1, "2024-02": 1}) == {"run_id": "run-1", "shards": 2, "records": 2}
        assert len(D.read_document("runs/run-1.json", str(tmp_path), {"run_id": "run-1"})["shards"]) == 2
    finally:
        server.shutdown()
