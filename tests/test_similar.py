"""Near-duplicate narratives against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sievework.operators import similar


def sets_of(texts):
    out = []
    for text in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    return out


def linked(sets):
    """All pairs of rows that are alike enough, by an index of shingles."""
    where, pairs = {}, set()
    for i, s in enumerate(sets):
        near = {}
        for x in s:
            for j in where.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            where[x].append(i)
        pairs |= {(j, i) for j, n in near.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)}
    return pairs


def groups(n, pairs):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(i) for i in range(n)]


def test_documents_against_all_pairs(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    ids = [r.doc_id for r in docs]
    sets = sets_of([r.text for r in docs])
    pairs = linked(sets)
    got = {r.id: r for r in similar.similar_narratives(spark.read.parquet(f"{medium}/documents.parquet"), "doc_id", "text").collect()}
    assert len(got) == len(ids) and all(got[i].n_shingles == len(s) for i, s in zip(ids, sets, strict=True))
    by_set = {}
    for i, s in zip(ids, sets, strict=True):
        if s:
            by_set.setdefault(frozenset(s), []).append(i)
    assert all(got[i].class_id == min(own) for own in by_set.values() for i in own)
    # Equal sets always meet, so recall is that of links between different sets.
    different = [(ids[a], ids[b]) for a, b in pairs if sets[a] != sets[b]]
    together = sum(got[a].group_id == got[b].group_id for a, b in different)
    assert len(different) >= 10 and together >= 0.9 * len(different)
    # No group is larger than the true one.
    true = groups(len(ids), pairs)
    place = {i: k for k, i in enumerate(ids)}
    assert all(true[place[i]] == true[place[r.group_id]] for i, r in got.items())


@pytest.mark.parametrize("hot", [4, 32])
def test_large_groups_are_cut_and_stay_whole(spark, hot, monkeypatch):
    """Hundreds of near copies of few texts: candidates stay far below all pairs, and groups are the true ones."""
    dice = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for size in (400, 150, 3):
        base = [dice.choice(words) for _ in range(120)]
        for _ in range(size):
            own = list(base)
            own[dice.randrange(len(own))] = dice.choice(words)
            texts.append(" ".join(own))
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    met = similar._cut(similar.members(similar.signatures(similar.classes(rows, "id", "text"))))
    pairs = similar._cut(similar.candidates(met.withColumn("root", F.col("kind")), hot=hot))
    made = pairs.count()
    assert made <= similar.BANDS * (hot + 2) * len(texts) and (hot > 4 or made < 0.25 * 400 * 399 / 2)
    first = similar._cut(similar.led_pairs(met))
    assert first.count() <= similar.BANDS * len(texts)
    monkeypatch.setattr(similar, "WANTED", 0 if hot == 4 else similar.WANTED)  # a shuffled join of the sets, and a broadcast one
    both = pairs.unionByName(first).distinct()
    got = dict(similar.grouped(similar.links(similar.sets_of(rows, "text", both), both)).collect())
    kinds = {r.id: r.kind for r in similar.classes(rows, "id", "text").collect()}
    true = groups(len(texts), linked(sets_of(texts)))
    roots = {}
    for i, t in enumerate(true):
        roots.setdefault(t, set()).add(got.get(kinds[i], kinds[i]))
    assert len(set(true)) == 3 and all(len(r) == 1 for r in roots.values()) and len(set.union(*roots.values())) == 3


def test_defined_cases(spark):
    long = " ".join(f"a{i}" for i in range(300))
    rows = spark.createDataFrame(
        [(5, long), (3, long.upper()), (9, long + " end"), (1, None), (2, " \t\n"), (7, "one two"), (8, "ONE  two"), (10, "one two three"), (5, long), (None, "x y z u v w"), (None, None), (11, "word " * 50_000)],
        "doc int, text string",
    ).withColumn("kind", F.lit("clash")).withColumn("id", F.lit("clash"))
    got = sorted(similar.similar_narratives(rows, "doc", "text").collect(), key=lambda r: (r.id is None, r.id or 0, r.n_shingles))
    assert [(r.id, r.n_shingles, r.class_id, r.group_id) for r in got] == [
        (1, 0, 1, 1), (2, 0, 2, 2), (3, 296, 3, 3), (5, 296, 3, 3), (5, 296, 3, 3), (7, 1, 7, 7), (8, 1, 7, 7), (9, 297, 9, 3), (10, 1, 10, 10), (11, 1, 11, 11), (None, 0, None, None), (None, 2, None, None),
    ]
    assert similar.similar_narratives(rows.where("false"), "doc", "text").count() == 0


def test_no_link_is_lost(spark):
    """Hundreds of pairs that lie just at the bound: the groups are those of all pairs."""
    dice = random.Random(11)
    texts = []
    for k in range(1500):
        base = [f"w{k}x{i}" for i in range(dice.randrange(40, 120))]
        texts += [" ".join(base), " ".join(base[: round(len(base) * dice.uniform(0.8, 0.86))])]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = {r.id: r.group_id for r in similar.similar_narratives(rows, "id", "text").collect()}
    true = groups(len(texts), linked(sets_of(texts)))
    assert [got[i] for i in range(len(texts))] == true and len(set(true)) < 2900
