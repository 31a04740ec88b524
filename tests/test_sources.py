"""Sources, sinks and streams."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sievework import schemas as S
from sievework.operators import rules
from sievework.sources import documents as D
from sievework.sources import tables
from sievework.streaming import events


def test_envelopes_and_exports(spark, tmp_path):
    hits = [{"_source": {"complaint_id": i, "date_received": f"2024-01-0{i}", "complaint_what_happened": "x" * i, "product": "P", "has_narrative": True}} for i in (1, 2, 2)]
    (tmp_path / "a.json").write_text(json.dumps({"hits": {"hits": hits}}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(hits))
    for rows in (D.read_envelopes(spark, str(tmp_path / "a.json")), D.read_exports(spark, str(tmp_path / "b.json"))):
        assert [r.source_row_ordinal for r in rows.orderBy("source_row_ordinal").collect()] == [0, 1, 2]
        seen = D.inspection(rows, "2024-01-01", "2024-01-02").first()
        assert (seen.record_count, seen.unique_ids, seen.duplicate_ids, seen.narratives, seen.outside_bounds) == (3, 2, 1, 3, 2)
        assert seen.last_date == dt.date(2024, 1, 2)


def test_artifacts(spark, tmp_path):
    body = b"{}"
    name = hashlib.sha256(body).hexdigest()
    (tmp_path / f"{name}.json").write_bytes(body)
    stated = spark.createDataFrame([(f"x/{name}.json", 2, name), ("x/none.json", 2, name)], "relative_path string, byte_count long, sha256 string")
    got = {r.relative_path: tuple(r)[1:] for r in D.verified_artifacts(spark, str(tmp_path), stated).collect()}
    assert got[f"x/{name}.json"] == (True, True, True, True) and got["x/none.json"] == (False, False, False, False)


def test_documents_and_settings(tmp_path):
    (tmp_path / "r.json").write_text('{"version": "1", "x": NaN}')
    with pytest.raises(D.SourceError):
        D.read_document("r.json", str(tmp_path), {})
    (tmp_path / "r.json").write_text('{"version": "1"}')
    assert D.read_document("r.json", str(tmp_path), {"version": "1"}) == {"version": "1"}
    for path, want in (("../r.json", {}), ("r.json", {"version": "2"}), ("/etc/hosts", {})):
        with pytest.raises(D.SourceError):
            D.read_document(path, str(tmp_path), want)
    (tmp_path / "env").write_text("A=1\nexport B='2'\n")
    assert D.settings(("A", "B"), str(tmp_path / "env"), {"A": "3"}) == {"A": "3", "B": "2"}
    with pytest.raises(D.SourceError):
        D.settings(("C",), None, {})


def test_shards_and_retention(spark):
    shards = D.monthly_shards(spark, "2023-09-01", "2025-01-01")
    assert shards.count() == 16 and shards.orderBy("month").first().request_max == dt.date(2023, 9, 30)
    counts = spark.createDataFrame([("2023-09", 5), ("2023-10", 0), ("2023-11", 100_000), ("2031-01", 1)], "month string, n long")
    found = {r.month: r.problem for r in D.preflight(shards, counts).collect()}
    assert (found["2023-09"], found["2023-10"], found["2023-11"], found["2031-01"], found["2024-01"]) == (None, "count_invalid", "export_limit_reached", "unexpected", "missing")
    at = lambda x: F.lit(x).cast("timestamp")
    r = spark.range(1).select(D.retention(at("2024-02-01"), at("2024-01-31 12:00:00")).alias("a"), D.retention(at("2024-01-01"), at("2024-01-02")).alias("b"), D.retention(at("2025-01-01"), at("2024-01-02")).alias("c")).first()
    assert tuple(r.a) == ("due_soon", 1) and r.b.status == "overdue" and r.c.status == "scheduled"


def test_store_is_append_only(spark, tmp_path):
    store = tables.Store(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("b", i, "1.1.0", "a" * 64, "quarantined", ["date_received_invalid"]) for i in range(3)], "raw_batch_id string, source_row_ordinal int, transformation_version string, source_record_sha256 string, outcome_status string, quarantine_reasons array<string>")
    header = spark.createDataFrame([("b", "1.1.0", 3, 0, 3, 3)], "raw_batch_id string, transformation_version string, input_record_count int, accepted_record_count int, quarantined_record_count int, output_record_count int")
    names = ("staging.complaint_outcomes", rows, "staging.transformation_batches", header, "b-1.1.0")
    assert store.append(*names) and not store.append(*names)
    with pytest.raises(tables.IdentityConflict):
        store.append(*names[:3], header.withColumn("input_record_count", F.lit(4)), names[4])
    stored = store.read("staging.complaint_outcomes")
    assert stored.schema == S.TABLES["staging.complaint_outcomes"] and stored.count() == 3
    assert all(r.n_violations == 0 for r in rules.table_violations(stored, "staging.complaint_outcomes").collect())
    broken = stored.withColumn("outcome_status", F.lit("accepted"))
    assert {r.rule: r.n_violations for r in rules.table_violations(broken, "staging.complaint_outcomes").collect()}["accepted_has_no_reasons"] == 3
    path = f"file://{tmp_path}/r.json"
    tables.publish(spark, path, {"b": 1, "a": 2})
    tables.publish(spark, path, {"a": 2, "b": 1})
    with pytest.raises(tables.IdentityConflict):
        tables.publish(spark, path, {"a": 3})
    assert tables.markdown(header.select("raw_batch_id")) == "| raw_batch_id |\n| --- |\n| b |"


def test_every_table_has_constraints():
    assert set(S.TABLES) == set(rules.CONSTRAINTS) == set(rules.KEYS) and sum(len(t) for t in S.TABLES.values()) >= 95


def test_stream_equals_batch(spark, small, tmp_path):
    table = spark.read.schema(events.EVENTS).parquet(f"{small}/events.parquet")
    table.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"))
    events.run_once(events.first_seen(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.first_seen(table).count()
    events.run_once(events.tumbling(stream), str(tmp_path / "windows"), str(tmp_path / "check2"))
    batch = {(r.start, r.event_type): r.n for r in events.tumbling(table).collect()}
    found = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "windows")).collect()}
    assert found and all(batch[k] == v for k, v in found.items())
    assert events.sessions(table).agg(F.sum("n")).first()[0] == table.count()
    assert events.sliding(table).agg(F.sum("n")).first()[0] == 2 * table.count()


def test_http_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from sievework.sources import http

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = b'{"hits": {"hits": []}}' if "big" not in self.path else b"1" * 500
            self.send_response(302 if "move" in self.path else 200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Location", "/else")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(http.BoundedHttp)
    read = lambda *urls, **options: spark.read.format("bounded_http").options(urls=json.dumps(urls), host="127.0.0.1", scheme="http", maxbytes="100", **options).load()
    got = read(f"{base}/a", f"{base}/b").collect()
    assert [r.status for r in got] == [200, 200] and json.loads(got[0].document) == {"hits": {"hits": []}}
    for bad in (f"{base}/big", f"{base}/move", "http://other/a"):
        with pytest.raises(Exception):  # noqa: B017
            read(bad).collect()
    server.shutdown()
    http.check_url("https://h/p?a=1", "h", "/p", {"a": "1"})
    for url in ("http://h/p?a=1", "https://u@h/p?a=1", "https://h:99/p?a=1", "https://h/p?a=1&b=2", "https://h/q?a=1", "https://h/p?a=1#f", "https://h:x/p?a=1"):
        with pytest.raises(D.SourceError):
            http.check_url(url, "h", "/p", {"a": "1"})
    assert "size=5" in http.export_url("https://h/p", "2024-01-01", "2024-01-31", 5)
    with pytest.raises(D.SourceError):
        http.export_url("https://h/p", "2024-01-01", "2024-01-31", 100_000)


def test_run_manifest(spark, tmp_path):
    expected = D.monthly_shards(spark, "2024-01-01", "2024-03-01")
    shards = spark.createDataFrame([("2024-01", "a", "x", 3, 3), ("2024-02", "b", "y", 4, 4)], "month string, batch_id string, artifact_sha256 string, returned long, unique_ids long")
    assert D.run_manifest_checks(shards, expected).first() == (True, True, True, True, 7)
    assert not D.run_manifest_checks(shards.where("month = '2024-01'"), expected).first().months_complete
    (tmp_path / "z.json").write_text("{}")
    stated = spark.createDataFrame([("z.json", 2, "0" * 64), ("q.json", 2, "0" * 64)], "relative_path string, byte_count long, sha256 string")
    assert {r.relative_path: r.action for r in D.cleanup_inventory(spark, str(tmp_path), stated).collect()} == {"z.json": "differs", "q.json": "absent"}


def test_retention_of_parts_of_seconds(spark):
    """Whole days are rounded up to the microsecond."""
    now = "2024-01-15 06:00:00"
    cases = {"2024-01-16 06:00:00": ("due_soon", 1), "2024-01-16 06:00:00.000001": ("due_soon", 2), "2024-02-14 06:00:00.4": ("scheduled", 31), "2024-02-14 06:00:00": ("due_soon", 30), "2024-01-15 06:00:00.5": ("due_soon", 1), "2024-01-15 05:59:59.9": ("overdue", 0)}
    rows = spark.createDataFrame([(x,) for x in cases], "x string").select("x", D.retention(F.col("x").cast("timestamp"), F.lit(now).cast("timestamp")).alias("r"))
    assert {r.x: tuple(r.r) for r in rows.collect()} == cases


def test_months_of_a_table_have_no_export_limit(spark, tmp_path):
    import duckdb

    from sievework.plans import catalog

    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT range AS o_orderkey, TIMESTAMP '1995-01-02' AS o_orderdate FROM range(100001)")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    got = {(r.month, r.n, r.problem) for r in catalog.QUERIES["e151_preflight"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(catalog.ORACLE_SQL["e151_preflight"]).fetchall()) and ("1995-01", 100001, None) in got
