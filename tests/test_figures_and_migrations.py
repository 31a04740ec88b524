"""Figures, steps of a store's tables, closed reports, lineage, and aggregates over HTTP."""

import json
import subprocess
import threading
import xml.etree.ElementTree as ET
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sievework import cli
from sievework import schemas as S
from sievework.plans import workflows as W
from sievework.sources import figures, migrations, tables
from sievework.sources.documents import SourceError
from sievework.sources.tables import IdentityConflict, Store


def test_curves_lie_where_their_values_say(spark):
    bins = spark.createDataFrame([(0, 0.0, 0.0), (7, 0.5, 1.0), (14, 1.0, 0.5), (3, None, None)], "bin int, mean_confidence double, accuracy double")
    points = {r.bin: (r.x, r.y) for r in figures.reliability_points({"a": bins}).collect()}
    assert points == {0: (figures.LEFT, figures.BOTTOM), 7: ((figures.LEFT + figures.RIGHT) / 2, figures.TOP), 14: (figures.RIGHT, (figures.TOP + figures.BOTTOM) / 2)}
    drawn = figures.reliability_svg({'a <"&': bins, "empty": bins.where("false")})
    root = ET.fromstring(drawn)
    assert drawn == figures.reliability_svg({'a <"&': bins, "empty": bins.where("false")}) and 'a <"&' in "".join(root.itertext())
    name = "{http://www.w3.org/2000/svg}"
    assert len(root.findall(f"{name}circle")) == 3 and len(root.findall(f"{name}polyline")) == 1
    swept = spark.createDataFrame([(0.0, 1.0, 0.4), (0.5, 0.5, 0.1), (0.95, 0.0, None)], "threshold double, coverage double, selective_risk double")
    assert len(ET.fromstring(figures.risk_coverage_svg(swept)).findall(f"{name}circle")) == 2
    with pytest.raises(ValueError):
        figures.reliability_points({})


def test_figures_are_published_once(spark, tmp_path, capsys):
    n = len(S.LABELS)
    scores = F.array(*[F.when(F.col("id") % n == k, 2.0).otherwise(0.0) + F.when(F.col("id") % 7 == k, 2.5).otherwise(0.0) for k in range(n)])
    rows = spark.range(1100).select((F.col("id") % n).cast("int").alias("label_id"), scores.alias("scores"), F.when(F.col("id") < 500, "fit").otherwise("evaluation").alias("partition"))
    rows.write.parquet(str(tmp_path / "rows"))
    ask = ["draw-figures", "--rows", str(tmp_path / "rows"), "--root", f"file://{tmp_path}/figures"]
    assert cli.main(ask, spark) == 0 and len(json.loads(capsys.readouterr().out)["figures"]) == 2
    assert (tmp_path / "figures" / "reliability.svg").read_text().startswith("<svg")
    assert cli.main(ask, spark) == 0
    (tmp_path / "figures" / "risk-coverage.svg").write_text("<svg/>\n")
    (tmp_path / "figures" / ".risk-coverage.svg.crc").unlink(missing_ok=True)
    assert cli.main(ask, spark) == 1


def header(spark, batch):
    return spark.createDataFrame([(batch, "2.0.0")], "batch_id string, manifest_version string")


def test_steps_up_and_down(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert migrations.current(store) == "base"
    assert migrations.upgrade(store, "0002") == ["0001", "0002"] and migrations.current(store) == "0002"
    assert store.exists("staging.complaint_outcomes", "none") and not store.exists("analytical.split_runs", "none")
    assert W.migrate(store, "0004") == {"from": "0002", "to": "0004", "steps": ["0003", "0004"]} and migrations.upgrade(store) == []
    assert all(store.read(t).schema == S.TABLES[t] for t in S.TABLES)
    with pytest.raises(SourceError):
        migrations.upgrade(store, "0001")
    with pytest.raises(SourceError):
        migrations.downgrade(store, "0009")
    raw = spark.createDataFrame([("b", 0, "1")], "batch_id string, source_row_ordinal int, complaint_id string")
    store.append("raw.complaints", raw, "raw.ingestion_batches", header(spark, "b"), "b")
    assert migrations.downgrade(store, "0001") == ["0004", "0003", "0002"] and not store.exists("staging.complaint_outcomes", "none")
    with pytest.raises(IdentityConflict):
        W.migrate(store, "base")
    assert migrations.current(store) == "0001" and store.read("raw.complaints", "b").count() == 1


def test_a_lost_step_is_finished_and_a_gap_is_an_error(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    spark.createDataFrame([], S.TABLES["raw.complaints"]).write.parquet(store.path("raw.complaints", "none"))  # an attempt that ended here
    assert migrations.upgrade(store, "0001") == ["0001"] and store.exists("raw.ingestion_batches", "none")
    tables.claim(spark, f"{store.root}/_revisions/0003", "0003")
    with pytest.raises(SourceError, match="migration_gap"):
        migrations.current(store)


def test_statements_are_sql_that_spark_takes(spark, tmp_path, capsys):
    up = migrations.statements("base", "0004", f"file://{tmp_path}")
    assert len(up) == len(S.TABLES) and migrations.statements("0004", "base", "x") == [f"DROP TABLE IF EXISTS {s.split('EXISTS ')[1].split(' (')[0]}" for s in reversed(up)]
    for statement in up:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    assert cli.main(["migration-sql", "--root", "x", "--start", "0001", "--revision", "0002"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)["statements"]) == 2


def test_reports_are_closed(spark):
    @W.reported("a", "b")
    def some(extra: bool) -> dict:
        return {"a": 1, "b": 2} | ({"c": 3} if extra else {})

    assert some(False) == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="'c'"):
        some(True)


def test_a_split_runs_from_a_clean_checkout_only(spark, tmp_path):
    place = tmp_path / "checkout"
    place.mkdir()
    git = lambda *args: subprocess.run(["git", "-C", str(place), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)
    git("init")
    (place / "run.json").write_text("{}\n")
    git("add", ".")
    git("commit", "-m", "a")
    store = Store(spark, f"file://{tmp_path}/store")
    migrations.upgrade(store)
    assert W.build_split_here(store, "r-1", str(place), str(place / "run.json"))["written"]
    stored = store.read("analytical.split_runs", "r-1").first()
    assert len(stored.implementation_commit_sha) == 40 and stored.source_run_manifest_sha256 == W.acquisition.file_sha256(place / "run.json")
    (place / "more").write_text("x")
    with pytest.raises(SourceError, match="lineage_not_clean"):
        W.build_split_here(store, "r-2", str(place), str(place / "run.json"))


def test_aggregates_over_http(spark):
    months = [{"key_as_string": f"2024-0{m}-01T00:00:00Z", "doc_count": m} for m in (1, 2)]
    answer = {"aggregations": {"product": {"doc_count": 3, "product": {"sum_other_doc_count": 0, "buckets": [{"key": S.LABELS[0], "doc_count": 3, "trend_period": {"buckets": months}}]}}}}
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            raw = json.dumps(answer).encode() + (b" " * 3_000_001 if "large" in self.path else b"")
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/trends?lens=product"
    try:
        report = W.fetch_taxonomy(spark, base, "2024-01", "2024-03", scheme="http")
        assert report["labels"] == [{"label": S.LABELS[0], "n": 3, "first": "2024-01", "last": "2024-02"}] and report["checks"]["counts_reconcile"] and asked == ["/trends?lens=product"]
        with pytest.raises(SourceError):
            W.fetch_taxonomy(spark, f"{base}&size=0", scheme="http")
        with pytest.raises(Exception, match="response_byte_limit_exceeded"):
            W.fetch_taxonomy(spark, f"{base}&large=1", scheme="http")
    finally:
        server.shutdown()
