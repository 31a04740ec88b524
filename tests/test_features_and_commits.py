"""Language identifier, word pieces, as-of joins, epoch order, temperature and the commit protocol."""

import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import asof, calibration, features, language, profile, wordpiece
from sievework.sources import tables

NAMES = ("staging.complaint_outcomes", "staging.transformation_batches")


def batch(spark, n):
    rows = spark.createDataFrame([("b", i, "1.1.0", "a" * 64, "quarantined", ["date_received_invalid"]) for i in range(n)], "raw_batch_id string, source_row_ordinal int, transformation_version string, source_record_sha256 string, outcome_status string, quarantine_reasons array<string>")
    header = spark.createDataFrame([("b", "1.1.0", n, 0, n, n)], "raw_batch_id string, transformation_version string, input_record_count int, accepted_record_count int, quarantined_record_count int, output_record_count int")
    return rows, header


def test_two_writers_of_one_identity(spark, tmp_path, monkeypatch):
    """Both write their rows before either commits: one version stands whole, the other is a conflict or a replay."""
    meet, claim = threading.Barrier(2, timeout=120), tables.claim
    first = threading.local()

    def together(session, path, text):
        if not getattr(first, "met", False):
            first.met = True
            meet.wait()
        return claim(session, path, text)

    monkeypatch.setattr(tables, "claim", together)
    found = {}

    def write(name, n):
        rows, header = batch(spark, n)
        try:
            found[name] = tables.Store(spark, f"file://{tmp_path}").append(NAMES[0], rows, NAMES[1], header, "b-1")
        except tables.IdentityConflict:
            found[name] = "conflict"

    writers = [threading.Thread(target=write, args=x) for x in (("x", 3), ("y", 5))]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert sorted(map(str, found.values())) == ["True", "conflict"]
    store, n = tables.Store(spark, f"file://{tmp_path}"), 3 if found["x"] is True else 5
    assert store.read(NAMES[0], "b-1").count() == n == store.read(NAMES[0]).count() and store.read(NAMES[1]).first().input_record_count == n


def test_rows_without_a_commit_are_not_there(spark, tmp_path, monkeypatch):
    store = tables.Store(spark, f"file://{tmp_path}")
    rows, header = batch(spark, 2)
    claim = tables.claim

    def lost(*_):
        raise OSError("executor and driver gone")

    monkeypatch.setattr(tables, "claim", lost)
    with pytest.raises(OSError):
        store.append(NAMES[0], rows, NAMES[1], header, "b")
    assert not store.exists(NAMES[1], "b") and store.read(NAMES[0]).count() == 0
    seen = []
    monkeypatch.setattr(tables, "claim", lambda *a: claim(*a) if not seen.append(a) and len(seen) == 1 else lost())
    with pytest.raises(OSError):  # lost between its two commits
        store.append(NAMES[0], rows, NAMES[1], header, "b")
    monkeypatch.setattr(tables, "claim", claim)
    assert store.append(NAMES[0], rows, NAMES[1], header, "b") is False and store.read(NAMES[0], "b").count() == 2


def test_epochs_do_not_follow_partitions(spark):
    rows = spark.range(500)
    runs = [[r.id for r in profile.epoch_order(rows.repartition(p), "id", 1, e, 64).orderBy("position").collect()] for p, e in ((1, 0), (7, 0), (3, 1))]
    assert runs[0] == runs[1] != runs[2] and sorted(runs[0]) == sorted(runs[2]) == list(range(500))
    assert {r.position for r in profile.epoch_order(rows, "id", 1, 0, 64).collect()} == set(range(500))
    assert profile.epoch_order(rows.limit(0), "id", 1, 0).count() == 0


def test_buffered_shuffle_loses_nothing(spark):
    rows = spark.range(5000, numPartitions=3).withColumn("v", F.col("id").cast("string"))
    got = [tuple(r) for r in profile.buffer_shuffled(rows, 100, 7).collect()]
    assert sorted(got) == [(i, str(i)) for i in range(5000)] and got != sorted(got) and got == [tuple(r) for r in profile.buffer_shuffled(rows, 100, 7).collect()]


def greedy(word, vocabulary):
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                break
        else:
            return [vocabulary["[UNK]"]]
        out.append(vocabulary[piece])
        at = end
    return out if len(word) <= 100 else [vocabulary["[UNK]"]]


def test_word_pieces_equal_a_plain_greedy_match(spark, small):
    rng = random.Random(3)
    texts = [None, "", "Un#believable  ##x, [CLS] é日本", "z" * 101, "ab" * 50, "abc abd\tabe"] + ["".join(rng.choice("abcd .,") for _ in range(rng.randrange(60))) for _ in range(200)]
    pieces = ["[CLS]", "[SEP]", "[UNK]", *"abcde.,#[]un", "##b", "##c", "##bc", "ab", "abc", "##ab", "##d", "believ", "##able", "##a", "##", "日本"]
    vocabulary = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = spark.createDataFrame(list(vocabulary.items()), "piece string, id int")
    words = {r.id: r.w for r in rows.select("id", wordpiece.words(F.col("text")).alias("w")).collect()}
    for limit in (384, 9):
        got = {r.id: r.input_ids for r in wordpiece.encode(rows, "id", "text", table, limit).collect()}
        assert got == {i: [0, *[p for w in words[i] for p in greedy(w, vocabulary)][: limit - 2], 1] for i in words}
    with pytest.raises(ValueError):
        wordpiece.encode(rows, "id", "text", table.where("piece != '[UNK]'"))


def test_identifier_as_a_column_equals_the_join(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "", "en"), (10**6 + 2, "zz", None), (10**6 + 3, "1234 !!", "de")], "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id % 2 = 0"), "text", "lang", grams=500)
    joined = {r.doc_id: r.language for r in language.scored(docs.union(odd), "doc_id", "text", model).collect()}
    column = {r.doc_id: r.x for r in docs.union(odd).select("doc_id", language.identifier(model)("text").alias("x")).collect()}
    assert joined == column and all(joined[10**6 + i] is None for i in range(4))
    held = [(r.lang, joined[r.doc_id]) for r in docs.where("doc_id % 2 = 1 AND length(text) > 100").collect()]
    assert np.mean([a == b for a, b in held if b]) > 0.97 and np.mean([b is not None for _, b in held]) > 0.8


@pytest.mark.parametrize("span", ["day", "year"])
def test_as_of_joins(spark, span):
    rng = random.Random(8)
    right = [(rng.choice([1, 2, None]), rng.choice([None, *range(60)]), rng.randrange(5)) for _ in range(80)]
    left = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(70)]), i) for i in range(120)] + [(1, 5, 999)] * 3
    stamp = lambda rows, c: spark.createDataFrame(rows, f"k int, h int, {c} int").select("k", F.timestamp_seconds(F.col("h") * 3600 * 7).alias("t"), c, "h")
    got = asof.as_of(stamp(left, "i").drop("h").withColumn("h", F.lit(1)), stamp(right, "v").drop("h"), "k", "t", span).collect()
    want = []
    for k, h, i in left:
        fits = [(b, v) for a, b, v in right if a == k and a is not None and b is not None and h is not None and b <= h]
        want.append((i, max(fits)[1] if fits else None))
    assert sorted(((r.i, r.matched.v if r.matched else None) for r in got), key=str) == sorted(want, key=str)


def test_temperature_of_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(400, 4)) * 3
    labels = [int(rng.choice(4, p=np.exp(s / 2.5) / np.exp(s / 2.5).sum())) for s in scores]
    rows = spark.createDataFrame([(s.tolist(), y) for s, y in zip(scores, labels, strict=True)], "s array<double>, y int")
    passes, first = [], type(rows).first
    monkeypatch.setattr(type(rows), "first", lambda self: passes.append(1) or first(self))
    fitted = calibration.fit_temperature(rows, F.col("s"), F.col("y"))

    def loss(t):
        z = scores / t
        return float(np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(400), labels]))

    grid = np.linspace(math.log(fitted["temperature"]) - 0.01, math.log(fitted["temperature"]) + 0.01, 201)
    assert abs(min(grid, key=lambda x: loss(math.exp(x))) - math.log(fitted["temperature"])) <= 1.01e-4 and abs(loss(fitted["temperature"]) - fitted["nll"]) < 1e-9 and len(passes) <= 10


def test_candidates_share_one_vectoriser(spark, monkeypatch):
    rng = random.Random(4)
    words = {"a": "alpha beta gamma".split(), "b": "delta epsilon zeta".split()}
    rows = spark.createDataFrame([(" ".join(rng.choice(words[y] + ["common", "shared"]) for _ in range(8)), y) for y in "ab" * 40], "text string, label string")
    fits, counter = [], features.CountVectorizer._fit
    monkeypatch.setattr(features.CountVectorizer, "_fit", lambda self, df: fits.append(1) or counter(self, df))
    both = features.fit_all(rows, "text", "label", {"x": (0.5, False), "y": (1.0, True)}, max_iter=50)
    assert len(fits) == 1
    alone, _ = features.fit(rows, "text", "label", c=1.0, balanced=True, max_iter=50)
    # Terms of equal counts may stand in any order of the vocabulary.
    weights = lambda m: dict(zip(m.stages[3].vocabulary, m.stages[-1].coefficientMatrix.toArray().T.round(4).tolist(), strict=True))
    one, two = weights(both["y"][0]), weights(alone)
    assert one.keys() == two.keys() and all(np.allclose(one[t], two[t], atol=2e-3) for t in one)


@pytest.mark.parametrize("heavy", [features.HEAVY, 3])
def test_tfidf_sums_equal_the_sql(spark, tmp_path, monkeypatch, heavy):
    """Words with numbers such as a raised 2 count, as in the SQL; frequent terms and rare ones meet by different joins."""
    import duckdb
    import parity

    from sievework.plans import catalog

    monkeypatch.setattr(features, "HEAVY", heavy)
    rng = random.Random(3)
    words = "m² alpha beta_1 Über a b ½½ x̂y gamma delta".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + [None, "", "once only", "a"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (SELECT unnest($1) AS doc_id, unnest($2) AS text)", [list(range(len(texts))), texts])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    got = catalog.QUERIES["e137_tfidf_weights"](spark, str(tmp_path))
    cursor = con.execute(catalog.ORACLE_SQL["e137_tfidf_weights"])
    assert parity.rows(got.columns, got.collect()) == parity.rows([c[0] for c in cursor.description], cursor.fetchall())


def test_vocabulary_and_partitions_of_a_model(spark, monkeypatch):
    """The most frequent terms stay, of equal ones the first in order; partitions follow the texts' size."""
    rows = spark.createDataFrame([("bb aa cc dd bb",), ("aa bb cc",), ("zz aa dd",)], "text string").selectExpr("split(text, ' ') AS t")
    fitted = lambda **p: features.CountVectorizer(inputCol="t", outputCol="c", **p).fit(rows).vocabulary
    assert fitted() == ["aa", "bb", "cc", "dd", "zz"] and fitted(vocabSize=3) == ["aa", "bb", "cc"] and fitted(vocabSize=1) == ["aa"]
    assert fitted(minDF=2.0, maxDF=2.0) == ["bb", "cc", "dd"] and fitted(minDF=0.5) == ["aa", "bb", "cc", "dd"] and fitted(maxDF=0.9) == ["bb", "cc", "dd", "zz"]
    monkeypatch.setattr(features, "PART_CHARS", 100)
    parts, made = [], features._regression
    monkeypatch.setattr(features, "_regression", lambda rows, *a: parts.append(rows.rdd.getNumPartitions()) or made(rows, *a))
    texts = spark.createDataFrame([(f"alpha beta {y}{y} word", y) for y in "ab" * 60], "text string, label string").coalesce(1)
    features.fit(texts, "text", "label", max_iter=3)
    assert parts[0] >= 15


@pytest.mark.parametrize("balanced", [False, True])
def test_regression_reaches_its_optimum(spark, monkeypatch, balanced):
    """Rare words beside frequent ones: the loss has no slope left, a few passes do, and predictions equal those of the model's stages."""
    for name in ("COUNTED", "BLOCK", "CHUNK"):
        monkeypatch.setattr(features.regression, name, 50)
    passes, passed = [], features.regression._passed
    monkeypatch.setattr(features.regression, "_passed", lambda *a: passes.append(1) or passed(*a))
    rng = random.Random(6)
    texts = [(" ".join(rng.choice(["the", "a b", "ΟΔΟΣ", f"{y}{y}", f"rare{rng.randrange(150)}"]) for _ in range(rng.randrange(2, 40))), y) for y in "abbccc" * 15] + [("", "a"), ("- !", "c")]
    rows = spark.createDataFrame(texts, "text string, label string")
    model, converged = features.fit(rows, "text", "label", balanced=balanced, min_df=2)
    assert converged and len(passes) < 45
    found = features.predictions(model, rows).collect()
    made = model.transform(rows).collect()
    assert [(r.text, r.label) for r in found] == [(r.text, r.label) for r in made] and [r.predicted for r in found] == ["abc"[int(r.prediction)] for r in made]
    assert np.allclose([r.probabilities for r in found], [r.probability.toArray() for r in made], atol=1e-9)
    x, y = np.array([r.features.toArray() for r in made]), np.eye(3)[[int(r.label_id) for r in made]]
    terms = {t for r in made for t in r._terms if sum(t in o._terms for o in made) >= 2 and sum(t in o._terms for o in made) <= 0.995 * len(made)}
    assert set(model.stages[3].vocabulary) == terms and np.allclose(np.linalg.norm(x, axis=1), [bool(terms & set(r._terms)) for r in made])
    weight = (len(y) / 3 / y.sum(0))[y.argmax(1)] if balanced else np.ones(len(y))
    slope = (np.array([r.probabilities for r in found]) - y) * weight[:, None] / len(y)
    w = model.stages[-1].coefficientMatrix.toArray()
    assert np.linalg.norm(slope.T @ x + w / len(y)) < 5e-4 and np.linalg.norm(slope.sum(0)) < 5e-4


def test_trigrams_of_texts_are_scored_in_blocks(spark):
    """No row for each trigram is made: a text's trigrams are counted and looked up where it is read."""
    texts = ["the cat and the hat", "der Hund und die Katze", "𝒳𝒴𝒵 ab", None, "", "a", "é è ê the the"]
    rows = spark.createDataFrame([(i, t, "de" if i == 1 else "en") for i, t in enumerate(texts)], "id long, text string, lang string")
    model = language.train(rows, "text", "lang")
    got = {(r.lang, r.gram): r.loglik for r in model.collect()}
    plain = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    grams = {t: [plain(t)[i : i + 3] for i in range(len(plain(t)) - 2)] for t in texts if t is not None}
    counts = {"en": {}, "de": {}}
    for i, t in enumerate(texts):
        for g in grams.get(t, []):
            own = counts["de" if i == 1 else "en"]
            own[g] = own.get(g, 0) + 1
    every = set(counts["en"]) | set(counts["de"])
    want = {(x, g): math.log((c.get(g, 0) + 1) / (sum(c.values()) + len(c))) for x, c in counts.items() for g in every}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    out = language.scored(rows, "id", "text", model)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.language for r in out.collect()} == {0: "en", 1: "de", 2: "en", 3: None, 4: None, 5: None, 6: "en"}


def test_word_pieces_forget(monkeypatch):
    """What a worker remembers is bounded, and long words are never kept."""
    import pyarrow as pa

    pieces = wordpiece.Pieces({"[UNK]": 0, "a": 1, "##a": 2, "b": 3, "##b": 4})
    monkeypatch.setattr(wordpiece, "KNOWN", 3, raising=False)
    for n in range(1, 12):
        ids, bounds = pieces.batch(pa.array([["a" * n, "b" * 101], ["ba"]], pa.list_(pa.string())))
        assert ids.tolist() == [1] + [2] * (n - 1) + [0, 3, 2] and bounds.tolist() == [0, n + 1, n + 3]
        assert len(pieces.known) <= 5 and "b" * 101 not in pieces.known
