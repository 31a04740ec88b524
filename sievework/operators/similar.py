"""Near-duplicate narratives: classes of equal sets, and the groups that links join, all exact.

A text's set is its distinct shingles of five words (lower-cased, by white space). Texts of equal sets are one class. Two classes are
linked if 100 * common >= 80 * union; the links are those of the exact join of ``llm.jaccard`` (no link is lost), over the lower-cased texts.

MinHash bands give candidates alone, for callers to whom a share of the links is enough (two sets at 0.8 meet with probability
1 - (1 - 0.8^4)^10 = 0.995). A class has ``BANDS`` keys of ``ROWS`` minima each; classes of one key are candidates (``candidates``), or each
class and the least class of its keys (``led_pairs``). A key that more than ``HOT`` classes have is never paired in full: its classes are
paired inside finer keys, which add two minima of the next band; a finer key that is hot too is cut by a hash of the class into cells of about
half of ``HOT``, and has a least class of its own. ``links`` counts on the whole sets.

Defined cases: a null or blank text has no set, is in no class of others and linked with nothing; one of fewer than five words is one shingle;
repeated rows are in one class; a null id is returned with the ids of its class and group, null where none has one; of ties the least
id names class and group; an empty table gives no rows; other columns aren't read. Texts are read whole.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import jaccard, store

WORDS = 5
PERCENT = 80
BANDS, ROWS = 10, 4
#: Classes that a key may have to be paired in full.
HOT = 32
#: Classes of candidates whose names (of 32 bytes) are broadcast at most.
WANTED = 1 << 20


def _cut(rows: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder; in a temporary one only where none is named and the master is local."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sievework-checkpoint-"))
    return rows.checkpoint()


def shingles(text: Column, words: int = WORDS) -> Column:
    """The distinct shingles as sorted 64-bit hashes; null without a word."""
    split = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    short = lambda w: F.array(F.xxhash64(F.array_join(w, " ")))
    long = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
    # The words are bound by an outer lambda, or they would be split anew for each shingle.
    made = F.transform(F.array(split), lambda w: F.when(F.size(w) >= words, F.sort_array(F.array_distinct(long(w)))).when(F.size(w) > 0, short(w)))
    return F.get(made, F.lit(0))


def classes(rows: DataFrame, key: str, text: str, words: int = WORDS) -> DataFrame:
    """id, kind (names the set by 128 bits), n_shingles and set of each row; the last three null or 0 without a set."""
    own = rows.select(F.col(key).alias("id"), shingles(F.col(text), words).alias("set"))
    kind = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), "set")), 16, "0") for k in (1, 2)])
    return own.select("id", F.when(F.col("set").isNotNull(), kind).alias("kind"), F.coalesce(F.size("set"), F.lit(0)).cast("long").alias("n_shingles"), "set")


def signatures(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """kind, n_shingles and m, the minima of bands * rows hashes. Minima combine before the shuffle."""
    each = sets.select("kind", "n_shingles", F.explode("set").alias("s"))
    least = [F.min(F.xxhash64("s", F.lit(k))).alias(f"m{k}") for k in range(bands * rows)]
    return each.groupBy("kind", "n_shingles").agg(*least).select("kind", "n_shingles", F.array(*[f"m{k}" for k in range(bands * rows)]).alias("m"))


def members(signed: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """kind, n_shingles, key and finer of each class in each band; finer adds two minima of the next band."""
    at = lambda k: F.get("m", F.lit(k % (bands * rows)))
    hashed = lambda b, n: F.xxhash64(F.lit(b), *[at(b * rows + r) for r in range(n)])
    return signed.select("kind", "n_shingles", F.inline(F.array(*[F.struct(hashed(b, rows).alias("key"), hashed(b, rows + 2).alias("finer")) for b in range(bands)])))


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b").distinct()


def _led(sized: DataFrame) -> DataFrame:
    """Every member with its key's least class."""
    led = sized.select(F.col("_least.kind").alias("a"), F.col("_least.n_shingles").alias("n_a"), F.col("kind").alias("b"), F.col("n_shingles").alias("n_b"))
    return led.where("a < b")


def led_pairs(own: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each class with the least class of its keys: one pair at most for each member."""
    least = own.groupBy("key").agg(F.count("*").alias("_n"), F.min(F.struct("kind", "n_shingles")).alias("_least")).where("_n > 1")
    return _fitting(_led(own.join(least, "key")), percent)


def _sized(own: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """Members of keys of 2 to ``hot`` classes that aren't all joined yet, and those of larger ones with their number and least class."""
    sizes = own.groupBy("key").agg(F.count("*").alias("_n"), F.min(F.struct("kind", "n_shingles")).alias("_least"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").drop("_lo", "_hi")
    both = _cut(own.join(sizes, "key"))  # a key's members meet one row: the larger side of a hot key can be split
    return both.where(F.col("_n") <= hot).select(*own.columns), both.where(F.col("_n") > hot)


def _paired(own: DataFrame) -> DataFrame:
    a, b = (own.select("key", F.col("kind").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("root").alias(f"root_{x}")) for x in ("a", "b"))
    return a.join(b, "key").where("a < b AND root_a != root_b").drop("key", "root_a", "root_b")


def candidates(own: DataFrame, hot: int = HOT, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs a < b of classes of different roots that meet in a key and whose sizes allow a link.

    own: ``members`` with root, what earlier links join a class to (the class itself where there is none)."""
    few, many = _sized(own, hot)
    finer = many.select("kind", "n_shingles", "root", F.xxhash64("key", "finer").alias("key"))
    few_finer, many_finer = _sized(finer, hot)
    cell = F.pmod(F.xxhash64("kind", "key"), F.ceil(F.col("_n") / F.lit(max(1, hot // 2))))
    cells = many_finer.select("kind", "n_shingles", "root", F.xxhash64("key", cell).alias("key"))
    found = _paired(few.drop("finer")).unionByName(_paired(few_finer)).unionByName(_paired(cells)).unionByName(_led(many_finer))
    return _fitting(found, percent)


def sets_of(rows: DataFrame, text: str, pairs: DataFrame) -> DataFrame:
    """kind and set of the classes in pairs, made anew from the texts, so that sets of no candidate are never written or shuffled.

    The kinds are broadcast where they are ``WANTED`` at most; beyond that, sets meet them in a shuffle."""
    kinds = _cut(pairs.select(F.explode(F.array("a", "b")).alias("kind")).distinct())
    texts = rows.where(F.col(text).rlike(r"[^\x20\x09-\x0D]")).select(text)
    every = classes(texts.withColumn("_none", F.lit(None)), "_none", text).select(F.coalesce("kind", F.lit("")).alias("kind"), "set")  # never null, so that no filter computes it first
    bounded = kinds.count() <= WANTED
    return every.join(F.broadcast(kinds) if bounded else kinds, "kind", "left_semi").groupBy("kind").agg(F.first("set").alias("set"))


def links(sets: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b, n_common and n_union of the pairs whose sets are alike enough, counted on the whole sets."""
    side = lambda x: sets.select(F.col("kind").alias(x), F.col("set").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.size("set_a") + F.size("set_b")).alias("n"), F.size(F.array_intersect("set_a", "set_b")).alias("n_common"))
    union = F.col("n") - F.col("n_common")
    return both.where(100 * F.col("n_common") >= percent * union).select("a", "b", F.col("n_common").cast("long").alias("n_common"), union.cast("long").alias("n_union"))


def grouped(found: DataFrame) -> DataFrame:
    """kind and root, the least class that links reach, of each linked class.

    Each round takes the least root among the neighbours, then that root's own, so paths halve; minima combine
    before the shuffle, and a round ends in a checkpoint."""
    both = _cut(found.select(F.inline(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))
    roots = _cut(both.groupBy(F.col("a").alias("kind")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("kind").alias("b"), "root"), "b").groupBy(F.col("a").alias("kind")).agg(F.min("root").alias("near"))
        nearer = roots.join(near, "kind").select("kind", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        up = roots.select(F.col("kind").alias("mid"), F.col("root").alias("top"))
        after = _cut(nearer.join(up, "mid", "left").select("kind", "was", F.least("mid", F.coalesce("top", "mid")).alias("root")))
        if after.where("was != root").isEmpty():
            return after.select("kind", "root")
        roots = after.select("kind", "root")


def similar_narratives(rows: DataFrame, key: str, text: str, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, class_id (least id of an equal set) and group_id (least id that links reach) of every row; ids are whole numbers."""
    named = jaccard.linked_rows(rows.select(F.col(key).cast("long").alias("doc_id"), F.lower(text).alias("text")), percent)
    own = store.written(named.select(F.col("doc_id").cast(rows.schema[key].dataType).alias("id"), "n_shingles", "kind", "root"), "similar")
    heads = store.written(own.where("kind IS NOT NULL").groupBy("kind", "root").agg(F.min("id").alias("class_id")), "similar-classes")
    groups = heads.groupBy("root").agg(F.min("class_id").alias("group_id"))
    found = heads.join(groups, "root").select("kind", "class_id", "group_id")
    alone = F.col("kind").isNull()
    return own.join(found, "kind", "left").select("id", "n_shingles", *[F.when(alone, F.col("id")).otherwise(F.col(c)).alias(c) for c in ("class_id", "group_id")])
