"""Operators 11 to 13 against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import json
import math
from collections import Counter, defaultdict

import numpy as np
import parity
import pytest
from pyspark.sql import functions as F

from sievework.llm import alignment, negatives, numbering, oracles, queries, sharding, store, tokens

tokenizers = pytest.importorskip("public_tokenizers")
VECTORS = "vec_id long, embedding array<float>, label int, extra string"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_sharding"])
def test_equals_sql(spark, small, name):
    got = queries.QUERIES[name](spark, small)
    cursor = parity.duck(small).execute(oracles.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert parity.rows(got.columns, got.collect()) == parity.rows(names, cursor.fetchall())


# Hard negatives


def mined(rows, every=50):
    """Plain definition over (vec_id, embedding, label) rows, in Python integers."""
    seen = set()
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(float(np.float32(x)) * 256) for x in v):
            continue
        seen.add((i, (int(math.fmod(label + 1, 10)) if i % 7 == 0 else label), tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a in seen:
        if a[0] % every:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2]))  # noqa: B023, B905, E731
        others = sorted(((-score(b), b[0], b[1]) for b in seen if b[0] != a[0]))
        for s, i, _ in [o for o in others if o[2] == a[1]][:5]:
            inside = [o for o in others if o[2] != a[1] and 50 * -s <= 100 * -o[0] <= 95 * -s][:3]
            out += [(a[0], i, r, o[1], -s, -o[0]) for r, o in enumerate(inside, 1)]
    return sorted(out)


def _mine(spark, rows):
    return sorted(map(tuple, negatives.hard_negatives(spark.createDataFrame(rows, VECTORS)).collect()))


def test_negatives_of_clusters_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "STRIP_LEAST", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 5))
    rows = [(i, [float(x) for x in np.round(centres[i % 6] + rng.normal(size=5) * 0.3, 2)], int(rng.integers(0, 3)), "x") for i in range(0, 400, 2)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 0.0], i % 3, "copy") for i in range(60)]  # one common vector
    rows += [rows[0], (50, [0.1, 0.2, 0.3, 0.4, 0.5], 1, "same id"), (None, [1.0] * 5, 1, None), (1, None, 1, None), (3, [1.0] * 5, None, None)]
    rows += [(5, [1.0, None, 0.0, 0.0, 0.0], 1, None), (7, [float("nan")] * 5, 1, None), (9, [float("inf")] * 5, 1, None), (100, [1.0, 2.0], 1, "short"), (150, [], 2, "none")]
    assert _mine(spark, rows) == mined(rows) != []


def test_negatives_of_large_numbers_and_none(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=3) * 3e5], i % 2, "") for i in range(0, 500, 10)]
    assert _mine(spark, rows + [(500, [1e30, 0.0, 0.0], 0, "")]) == mined(rows) != []
    assert _mine(spark, []) == [] and _mine(spark, [(50, [1.0], 1, "")]) == []


def test_brackets_hold_every_score():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(300, 16)) * 90)
    space = negatives.Space(x[:8].tolist(), 16, float((x * x).sum(1).max()))
    d, q = space.of_rows(x), x[::10]
    bracket = negatives.Bracket(q, space.of_anchors(q), space.most)
    scores = q @ x.T
    assert (bracket.upper(d, d) >= scores).all() and (bracket.lower(d) <= scores).all()
    assert (bracket.upper(d.min(0)[None], d.max(0)[None])[:, 0] >= scores.max(1)).all()


# Sharding


@pytest.mark.parametrize("n", [1, 2, 3, 23, 24, 25, 1000, 4099])
def test_permutation_is_one_and_inverts(spark, n):
    rows = sharding.permuted(spark.range(n), "id", "p", n)
    got = dict(map(tuple, rows.select("id", "p").collect()))
    assert sorted(got.values()) == list(range(n))
    back = sharding.permuted(spark.createDataFrame(list(got.items()), "i long, p long"), "p", "q", n, inverse=True)
    assert all(r.i == r.q for r in back.collect())
    some = range(0, n, max(1, n // 50))
    assert all(sharding.place(i, n) == got[i] and sharding.row_at(got[i] % 24, got[i] // 24, n) == i for i in some)
    assert n < 1000 or sharding.place(5, n, seed=1) != sharding.place(5, n, seed=2)


def test_permutation_scatters():
    n = 100_003
    p = [sharding.place(i, n) for i in range(3000)]
    assert abs(np.mean(p) / n - 0.5) < 0.03 and abs(np.corrcoef(np.arange(3000), p)[0, 1]) < 0.08
    assert max(Counter(x % 24 for x in p).values()) < 3000 / 24 * 1.5


def test_shards_of_odd_rows_are_even_and_reproducible(spark):
    rows = [(i, "w " * (i % 9), "s") for i in range(200)] + [(7, "hot", "x")] * 300 + [(None, None, None), (None, "a", "b"), (3, None, "c"), (3, "", "d"), (4, "é" * 200_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    runs = [sorted(map(tuple, sharding.sharded(d).collect()), key=repr) for d in (docs, docs.repartition(5).orderBy("text"))]
    assert runs[0] == runs[1]
    at = defaultdict(list)
    for r in sharding.sharded(docs).collect():
        at[r.shard].append(r.slot)
        assert sharding.row_at(r.shard, r.slot, len(rows)) == r.row_number and r.law == "rows" and r.grown_shard is None
    assert max(map(len, at.values())) - min(map(len, at.values())) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in at.values())
    sizes = Counter(r.size for r in sharding.sharded(docs).collect())
    assert sizes == Counter(len((t or "").encode()) + 8 for _, t, _ in rows)
    assert sharding.sharded(docs.limit(0)).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "v") for i in range(500)], "doc_id long, text string, value string")
    sharding.write_shards(docs, f"{tmp_path}/out", shards=4, files=3)
    want = {r.doc_id: (r.shard, r.slot) for r in sharding.sharded(docs, 4).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("slot", F.lit(1)), f"{tmp_path}/no")


def test_numbers_do_not_follow_partitions(spark):
    rows = spark.range(1000).select(F.expr("id * 7919 % 1000").alias("k"))
    for parts in (1, 7):
        assert all(r.k == r.row_number for r in numbering.ordered(rows.repartition(parts), [F.col("k")], "t").collect())


# Alignment


def _a_bytes(path):
    """Token bytes of the byte-level vocabulary, by its own alphabet."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    return {i: bytes(byte[c] for c in t) for t, i in json.load(open(path))["model"]["vocab"].items()}


def plain_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
    first, second = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    first.encode_special_tokens = True
    entry = _a_bytes(path_a)
    docs = []
    for text in texts:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        pieces = [second.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        bytes_a = [entry[i] for i in a]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        spans = []
        for ids, parts in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for i, p in zip(ids, parts, strict=True):
                out.append((at, at + len(p), i))
                at += len(p)
            spans.append(out)
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, x, y = [], 0, 0
        for c in cuts:
            left, right = [], []
            while x < len(spans[0]) and spans[0][x][1] <= c:
                left.append(str(spans[0][x][2]))
                x += 1
            while y < len(spans[1]) and spans[1][y][1] <= c:
                right.append(str(spans[1][y][2]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        docs.append((a, b, links, groups))
    count = Counter(p for d in docs for p in set(d[2]))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [
        (len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for a, b, links, groups in docs
    ]


ODD = ["", " ", "a", "two  spaces   and\n\nlines \t x", "<|endoftext|> and <s> </s> <0x0A> <unk>", "naïve café déjà vu — “quotes”", "日本語のテキスト and 한국어", "👩‍👩‍👧 é \x00 nul", "▁ literal", "x▁y z", "a\r\nb  ", "1234567 3.14e-7 $#@!", "  lead", "trail  ", "supercalifragilistic" * 500, "ﬁ Å   nbsp　wide", "same text", "same text"]


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 3])
def test_alignment_of_odd_texts(spark, monkeypatch, heavy):
    monkeypatch.setattr(alignment, "HEAVY", heavy)
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(100, None, "x"), (None, "same text", "y"), (0, "same text", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links string")
    got = alignment.alignment(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")).collect()
    want = [(r[0], *x) for r, x in zip(rows, plain_alignment([r[1] or "" for r in rows]), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_alignment_of_a_space_at_the_end_and_unassigned_code_points(spark):
    """A text that ends with one space has tokens; a code point that this Python's Unicode version lacks is a letter for the library."""
    texts = ["a ", "I ", "one two ", "\t ", "trail  ", "a \u1c89\u1c89's \ua7cb", "x\U000105c0b's", "\U000e0fff's", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, alignment.alignment(docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")).collect()))
    assert got == [(i, *x) for i, x in enumerate(plain_alignment(texts))] and all(r[1] > 0 for r in got)


def test_alignment_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op12_tokenizer_alignment"](spark, small).collect()))
    rows = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id, *x) for r, x in zip(rows, plain_alignment([r.text or "" for r in rows]), strict=True))
    assert got == want
    assert alignment.alignment(docs.limit(0), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_the_librarys(name):
    """Ids of texts with each added token's literal equal those of an untouched tokenizer."""
    from tokenizers import Tokenizer

    from sievework.llm import textkit as K
    import pyarrow as pa

    plain = Tokenizer.from_file(tokenizers.path(name))
    texts = [f"a {t} b{t}{t}c {t.upper()}" for t in (x.content for x in plain.get_added_tokens_decoder().values())] + ["no literal", "<|endoftext", "é <|endoftext|> İ", "", "İ é"]
    ids, bounds = tokens.Encoder(tokenizers.path(name)).encode(*K.buffers(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_scratch_is_in_the_shared_folder(spark):
    assert store.scratch_path(spark, "x").startswith(store.shared_dir(spark))
