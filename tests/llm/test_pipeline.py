"""The pipeline against plain versions of its stages, each on what the one before kept."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("sievework.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import base_spans, components, crc, prose, tokenizer  # noqa: E402

from sievework.llm import quality, store  # noqa: E402


def written(spark, folder, rows, bench) -> str:
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash string, key int, c0 string, _id long, found string"
    spark.createDataFrame([(i, t, None, "s", None, "h", 1, "x", 5, None) for i, t in rows], schema).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_of_defined_cases(spark, tmp_path):
    """Nulls in any column, blank and very long texts, repeated rows, and columns named like the operators' own."""
    rng = random.Random(21)
    long, item = prose(rng, 60_000), prose(rng, 30)
    a, b = prose(rng, 50), prose(rng, 50)
    leaky = f"{prose(rng, 20)} {item} {prose(rng, 20)}"
    rows = [(1, a), (1, a), (2, a), (None, a), (3, None), (4, ""), (5, " \n"), (6, long), (6, b), (7, leaky), (None, None), (8, b + " password: hunter2222 end"), (9, "too short")]
    folder = written(spark, tmp_path, rows, [(1, item), (None, item), (2, None), (3, " ")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store.written(stage(spark, docs, folder), name)
        assert docs.columns[:3] == ["doc_id", "text", "lang"] and len(docs.columns) == 10
        kept[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert kept["quality_rules"] == sorted((r for r in rows if r[1] and len(r[1].split()) >= 20), key=repr)
    assert kept["near_duplicates"] == sorted([(1, a), (6, long), (6, b), (7, leaky)], key=repr)  # 8 is like b
    assert kept["benchmark_leaks"] == kept["secret_spans"] == sorted([(1, a), (6, long), (6, b)], key=repr)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == {1, 6} and max(r.piece for r in pieces) > 5


def test_pipeline_of_nothing(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [(1, "x" * 50)])).count() == 0
    (tmp_path / "bare").mkdir()
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "bare", [(1, None)], [])).count() == 0


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    bench = [r.text.lower().replace("\n", " ") for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    kept_ids = {r.doc_id for r in quality.quality_query(docs).where("kept").collect()}
    steps, data = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        out = store.written(stage(spark, data, small), name)
        assert name == "packed_pieces" or out.columns == docs.columns
        steps[name], data = out, out
    assert {r.doc_id for r in steps["quality_rules"].collect()} == kept_ids
    rows = sorted(r for r in rows if r[0] in kept_ids)
    roots = components([(r[0], r[1]) for r in rows])
    first: dict[int, int] = {}
    for r, root in zip(rows, roots, strict=True):
        first.setdefault(root, r[0])
    rows = [r for r in rows if r[0] in first.values()]
    assert {r.doc_id for r in steps["near_duplicates"].collect()} == {r[0] for r in rows}
    leaked = {r[0] for r in rows if any(b in r[1].lower().replace("\n", " ") for b in bench)}
    rows = [r for r in rows if r[0] not in leaked]
    assert {r.doc_id for r in steps["benchmark_leaks"].collect()} == {r[0] for r in rows}
    clean = {}
    for r in rows:
        out, at = "", 0
        for a, _, e, _ in base_spans(r[1]):
            if a >= at:
                out += r[1][at:a] + "[secret]"
            at = max(at, e)
        clean[r[0]] = out + r[1][at:]
    assert {r.doc_id: r.text for r in steps["secret_spans"].collect()} == clean
    _, encode = tokenizer("word_bpe_49k.json")
    pieces = {(i, k, crc(ids[a : a + 4096])) for i, t in clean.items() for ids in [encode(t) + [1]] for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in data.collect()} == pieces
    assert corpus_pipeline.run(spark, small).count() == len(pieces)
