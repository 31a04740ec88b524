"""The commands end to end, from an export to a stored split."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sievework import cli
from sievework.plans import workflows as W
from sievework.sources.tables import IdentityConflict, Store


def export(tmp_path, n=40):
    items = []
    for i in range(n):
        day = f"2024-{1 + i % 12:02d}-15"
        words = "the end of the road" if i % 5 else "los que el y fin"
        items.append({"_source": {"complaint_id": i, "date_received": day, "complaint_what_happened": f"{words} {i // 2 if i % 4 == 1 else i}", "product": "Mortgage" if i % 3 else "Credit card", "has_narrative": True}})
    body = json.dumps(items).encode()
    sha = hashlib.sha256(body).hexdigest()
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / f"{sha}.json").write_bytes(body)
    manifest = {
        "batch_id": "b-1", "manifest_version": "2.0.0", "is_synthetic": True,
        "request": {"request_fingerprint_sha256": "0" * 64, "parameters": {"format": "json", "has_narrative": "true"}},
        "artifact": {"relative_path": f"raw/{sha}.json", "byte_count": len(body), "sha256": sha},
        "records": {"returned": n, "min_date": "2024-01-15", "max_date": "2024-12-15"},
    }
    return manifest, str(tmp_path / "raw")


def test_from_export_to_split(spark, tmp_path, capsys):
    manifest, files = export(tmp_path)
    store = Store(spark, f"file://{tmp_path}/store")
    first = W.ingest(store, manifest, files)
    assert first["written"] and first["record_count"] == 40 and not W.ingest(store, manifest, files)["written"]
    assert cli.main(["stage-raw-batch", "--root", store.root, "--batch", "b-1"], spark) == 0
    assert json.loads(capsys.readouterr().out)["counts"]["accepted_record_count"] == 40
    population = W.report_population(store, "b-1")
    assert population["counts"]["eligible_record_count"] == 32 and population["reasons"] == [{"reason": "language_not_english", "n": 8}]
    layers = W.report_layers(store)
    assert all(v for v in layers.values() if isinstance(v, bool))
    done = W.build_split(store, "r-1", "a" * 40, "b" * 64)
    assert done["written"] and all(done["checks"].values()) and all(c["n_violations"] == 0 for c in done["constraints"])
    assert done["counts"]["input_record_count"] == 32
    with pytest.raises(IdentityConflict):
        W.build_split(store, "r-1", "c" * 40, "b" * 64)
    broken = json.loads(json.dumps(manifest))
    broken["artifact"]["byte_count"] += 1
    with pytest.raises(W.sources.SourceError):
        W.ingest(store, broken, files)


def test_model_reports(spark, tmp_path, capsys):
    rows = spark.range(300).select(
        (F.col("id") % 3).cast("int").alias("label_id"), F.array(*[F.when(F.col("id") % 3 == k, 2.0).otherwise(0.0) + F.when(F.col("id") % 7 == k, 2.5).otherwise(0.0) for k in range(3)]).alias("scores"), F.when(F.col("id") < 150, "fit").otherwise("evaluation").alias("partition"),
    )
    report = W.calibrate(rows, F.col("scores"), F.col("label_id"), 3, F.col("partition") == "fit")
    assert report["after"]["nll"] <= report["before"]["nll"] + 1e-6 and all(report["checks"].values())
    table = spark.range(200).select(F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split_assignment"), F.when(F.col("id") % 5 == 0, "B").otherwise("A").alias("label"), (F.col("id") % 50 + 1).alias("length"), F.col("id").alias("key"))
    table.write.parquet(str(tmp_path / "rows"))
    assert cli.main(["evaluate-majority-baseline", "--rows", str(tmp_path / "rows")], spark) == 0
    assert json.loads(capsys.readouterr().out)["label"] == "A"
    assert {x["label"] for x in W.token_profile(table, "length", "label")["lengths"]} == {None, "A", "B"}
    assert W.dataset_shapes(table, "key", "length")["records"] == 200
    assert len(cli.COMMANDS) >= 13 and cli.main(["ingest-raw-batch", "--root", "x", "--manifest", "../x", "--files", "y"], spark) == 1
