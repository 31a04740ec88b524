"""Self-join of documents by the Jaccard similarity of their word shingles, as a T-occurrence search.

Two sets of J >= 0.8 share at least 0.8 of each of them, so the shares of a set that occur in no
other set bound what it can reach. The steps, all exact:

1. Documents of equal sets are one class from the first block on; a class is the set's fingerprint.
2. Inverted lists: tasks cut the shingles by hash ranges and ship packed slices (five bytes a
   shingle). A range knows which shingles have lists of two classes or more; only their entries
   return. A class with fewer listed shingles than 0.8 of its set has no partner and goes.
3. The rest is listed again among itself, rarest lists first. Each class's n - ceil(0.8 n) + 1 rarest
   shingles name the lists in which every partner must meet it; a list's smallest class leads it, and
   all members of lists with one leader are its star. Any two linked classes have a star in common.
4. A star is searched by DivideSkip, in salted chunks of bounded size that all hold the leader. The
   leader is the first query, then each member that isn't in the leader's component by its turn; so of
   any two members that are apart in the end, one was a query. A query merges its short lists by a
   heap, keeps what reaches T less the number of long lists, and probes the long lists by bisection.
   Only links that join two components are returned: fewer than members.
5. Stars of several chunks are searched once more: members outside the leader's component are queries of
   all other chunks, in blocks of bounded size. Components of the links are the documents' components.

Defined cases: a null or blank text has no shingles, n_shingles 0, and is its own component; a text of
fewer than five words is one shingle; equal texts and repeated rows share a component; a null doc_id
is kept and never names a component of others; an empty table gives no rows; a very long text is one
set, whole; of equal similarities none is preferred, since components need no order; other columns are
not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import graph, store
from sievework.llm import textkit as K

SIZE = 5
#: Similarity as a percentage.
PERCENT = 80
#: Bits of a shingle's hash that a slice keeps, beside those of its range.
KEPT_BITS = 40
#: Listed shingles of a star's members, or of its queries, that a task holds at once, about.
CHUNK = 60_000


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle) of the distinct shingles, ordered; set sizes and set fingerprints by document."""
    buf = K.LOWER[buf]
    words = K.Words(buf, off)
    names = K.RangeHash(buf).of(words.start, words.end)
    at, prints = words.windows(names, size)
    doc = words.doc[at]
    count = words.counts()
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        doc = np.concatenate((doc, short))
        prints = np.concatenate((prints, K.RangeHash(names).of(words.first[short], words.first[short + 1])))
    order = np.lexsort((prints, doc))
    doc, prints = doc[order], prints[order]
    if len(doc):
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (prints[1:] != prints[:-1])))
        doc, prints = doc[new], prints[new]
    n = K.per_doc(doc, len(off) - 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(prints), dtype=np.uint64)))
    first = np.concatenate(([0], np.cumsum(n)))
    return doc, prints, n, K.mix(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64)).view(np.int64)


_WIDTHS = (np.uint8, np.uint16, np.uint32)
_SLICE = "part int, range int, kinds binary, counts binary, low binary, high binary"
#: The ``range`` of slices that hold a block's documents instead of shingles.
_DOCUMENTS = -1


def _joined(values: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind)


def _packed(key: np.ndarray, kind: np.ndarray, token: np.ndarray, ranges: int) -> dict[str, list]:
    """Entries (kind, token), ordered by ``key`` (0 to ranges) and kind, as a slice for each key."""
    out: dict[str, list] = {"part": [], "kinds": [], "counts": [], "low": [], "high": []}
    bounds = np.searchsorted(key, np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(bounds)):
        k, t = kind[bounds[r] : bounds[r + 1]], token[bounds[r] : bounds[r + 1]]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        counts = np.diff(np.append(first, len(k)))
        out["part"].append(int(r))
        out["kinds"].append(k[first].tobytes())
        out["counts"].append(counts.astype(next(w for w in _WIDTHS if counts.max() <= np.iinfo(w).max)).tobytes())
        out["low"].append(t.astype(np.uint32).tobytes())
        out["high"].append((t >> 32).astype(np.uint8).tobytes())
    return out


def _unpacked(rows: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """(kind, token) of the entries of some slices."""
    kinds = _joined(rows["kinds"], np.int64)
    widths = [_WIDTHS[(8 * len(c) // len(k)).bit_length() - 1] for k, c in zip(rows["kinds"], rows["counts"], strict=True)]
    counts = np.concatenate([np.frombuffer(c, w).astype(np.int64) for c, w in zip(rows["counts"], widths, strict=True)])
    token = _joined(rows["low"], np.uint32).astype(np.int64) | _joined(rows["high"], np.uint8).astype(np.int64) << 32
    return np.repeat(kinds, counts), token


def _batch(out: dict[str, list], range_: int) -> pa.RecordBatch:
    n = len(out["part"])
    return K.table(part=pa.array(out["part"], pa.int32()), range=pa.array([range_] * n, pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in out.items() if k != "part"})


def _slices_kernel(ranges: int):
    """Shingles by range, and the documents of each block, by whatever range."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in K.blocks(batches):
            doc, prints, n, kind = shingle_sets(buf, off)
            ids, hashes = rows.column("doc_id"), rows.column("hash").to_numpy()
            known = ids.fill_null(0).to_numpy().astype(np.int64)
            nulls = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8)
            place = int(hashes[0]) % ranges
            yield _batch({"part": [place], "kinds": [kind.tobytes()], "counts": [n.astype(np.int64).tobytes()], "low": [known.tobytes()], "high": [hashes.tobytes() + nulls.tobytes()]}, _DOCUMENTS)
            _, one = np.unique(kind, return_index=True)  # one document of each class of the block
            chosen = np.zeros(len(kind), bool)
            chosen[one] = True
            doc, prints = doc[chosen[doc]], prints[chosen[doc]]
            part = ((prints >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            out = _packed(part[order], kind[doc[order]], (prints[order] & np.uint64((1 << KEPT_BITS) - 1)).astype(np.int64), ranges)
            if out["part"]:
                yield _batch(out, 0)

    return kernel


def _documents_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            kind, n, ids = (np.frombuffer(row[k], np.int64) for k in ("kinds", "counts", "low"))
            hashes, nulls = np.frombuffer(row["high"][: 8 * len(n)], np.int64), np.frombuffer(row["high"][8 * len(n) :], np.uint8)
            yield K.table(doc_id=pa.array(ids, mask=nulls == 1), hash=hashes, n_shingles=n, kind=pa.array(kind, mask=n == 0))


def _listed_kernel(ranges: int):
    """Entries of the shingles that two classes or more have, of the ranges of this partition, dealt by class."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_key(batches, ["part"]):
            at = [i for i, r in enumerate(rows["range"]) if r == _DOCUMENTS]
            if at:
                yield _batch({k: [rows[k][i] for i in at] for k in ("part", "kinds", "counts", "low", "high")}, _DOCUMENTS)
            rows = {k: [x for x, r in zip(v, rows["range"], strict=True) if r != _DOCUMENTS] for k, v in rows.items()}
            if not rows["part"]:
                continue
            kind, token = _unpacked(rows)
            order = np.argsort(token)
            token, kind = token[order], kind[order]
            new = np.concatenate(([True], token[1:] != token[:-1]))
            start = np.flatnonzero(new)
            # Lists of one class only, however many blocks it is in, go.
            several = np.minimum.reduceat(kind, start) != np.maximum.reduceat(kind, start)
            many = several[np.cumsum(new) - 1]
            token, kind = token[many], kind[many]
            order = np.lexsort((token, kind))
            token, kind = token[order], kind[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (kind[1:] != kind[:-1])
            token, kind = token[new], kind[new]
            bucket = _bucket(kind, ranges)
            order = np.argsort(bucket, kind="stable")
            out = _packed(bucket[order], kind[order], token[order], ranges)
            if out["part"]:
                yield _batch(out, part[0])

    return kernel


def _bucket(kind: np.ndarray, buckets: int) -> np.ndarray:
    return ((K.mix(kind.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _sets_of_bucket_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The listed shingles of each class, from the slices of all ranges."""
    for _, rows in _by_key(batches, ["part"]):
        kind, token = _unpacked(rows)
        each = [len(x) // 4 for x in rows["low"]]
        token = token | np.repeat(np.array(rows["range"], np.int64), each) << KEPT_BITS
        order = np.argsort(kind, kind="stable")
        kind, token = kind[order], token[order]
        bounds = np.append(np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))), len(kind))
        for a in range(0, len(bounds) - 1, 1024):
            b = bounds[a : a + 1025]
            yield K.table(kind=kind[b[:-1]], tokens=pa.ListArray.from_arrays(pa.array((b - b[0]).astype(np.int32)), pa.array(token[b[0] : b[-1]])))


def _by_key(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Rows of a partition sorted by ``key``, a group at a time."""
    now, held = None, {}
    for batch in batches:
        columns = {name: _arrays(column) if pa.types.is_list(column.type) else column.to_pylist() for name, column in zip(batch.schema.names, batch.columns, strict=True)}
        keys = list(zip(*(columns[k] for k in key), strict=True))
        a = 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            if keys[a] != now:
                if now is not None:
                    yield now, held
                now, held = keys[a], {k: [] for k in columns}
            for k, v in columns.items():
                held[k] += v[a:b]
            a = b
    if now is not None:
        yield now, held


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """Each list as an array."""
    off, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


class DivideSkip:
    """Inverted lists of some sets, searched for those that share T elements or more with a query."""

    def __init__(self, sets: list[np.ndarray]):
        token = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        holder = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(token, kind="stable")
        self.holder = holder[order]
        self.token, self.start = np.unique(token[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))

    def search(self, query: np.ndarray, least: int, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the sets that share at least ``least`` elements with the query, and how many they
        share. ``wanted`` says, before long lists are probed, which indexes matter."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.token):
            return none
        place = np.minimum(np.searchsorted(self.token, query), len(self.token) - 1)
        known = place[self.token[place] == query]
        if len(known) < least or least < 1:
            return none
        start, length = self.start[known], self.end[known] - self.start[known]
        order = np.argsort(length, kind="stable")
        start, length = start[order], length[order]
        n_long = min(least - 1, int(least / (0.01 * np.log2(length[-1] + 1) + 1)))
        n_short = len(known) - n_long
        lists = [self.holder[a : a + n].tolist() for a, n in zip(start[:n_short].tolist(), length[:n_short].tolist(), strict=True)]
        found: dict[int, int] = {}
        now, count = -1, 0
        for i in heapq.merge(*lists):
            if i == now:
                count += 1
                continue
            if now >= 0 and count >= least - n_long:
                found[now] = count
            now, count = i, 1
        if now >= 0 and count >= least - n_long:
            found[now] = count
        at, counts = np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
        if wanted is not None and len(at):
            keep = wanted(at)
            at, counts = at[keep], counts[keep]
        for k in range(n_long):  # longest last: each left list can add one
            if not len(at):
                break
            a = start[n_short + k]
            members = self.holder[a : a + length[n_short + k]]
            where = np.minimum(np.searchsorted(members, at), len(members) - 1)
            counts = counts + (members[where] == at)
            keep = counts + (n_long - k - 1) >= least
            at, counts = at[keep], counts[keep]
        enough = counts >= least
        return at[enough], counts[enough]


class Forest:
    """Components of a chunk's sets, with the links that joined them."""

    def __init__(self, own: list[int]):
        self.up = own

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def joins(self, a: int, b: int) -> bool:
        """Join two components; false if they are one already."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


def _search_kernel(percent: int):
    """rows of one (leader, salt, block): members and queries with the component known of each. Members
    that aren't in ``main``, the leader's component, are queries where the chunk has none of its own."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (leader, _, _), rows in _by_key(batches, ["leader", "salt", "block"]):
            kinds, sizes, sets = rows["kind"], np.array(rows["n"], np.int64), rows["tokens"]
            mine = [i for i, q in enumerate(rows["query"]) if not q]
            asked = [i for i, q in enumerate(rows["query"]) if q]
            first: dict[int, int] = {}
            forest = Forest([first.setdefault(r, i) for i, r in enumerate(rows["root"])])
            index = DivideSkip([sets[i] for i in mine])
            place = np.array(mine, np.int64)
            a, b = [], []

            def search(q: int) -> None:
                size, own = int(sizes[q]), forest.root(q)

                def wanted(at: np.ndarray) -> np.ndarray:
                    fits = (100 * sizes[place[at]] >= percent * size) & (100 * size >= percent * sizes[place[at]])
                    return fits & np.array([forest.root(mine[i]) != own for i in at.tolist()], bool)

                at, shared = index.search(sets[q], -(-percent * size // 100), wanted)
                for i, n in zip(at.tolist(), shared.tolist(), strict=True):
                    x = mine[i]
                    if 100 * n >= percent * (size + int(sizes[x]) - n) and forest.joins(q, x):
                        a.append(kinds[q])
                        b.append(kinds[x])

            for q in asked:
                search(q)
            if rows["turns"][0]:
                main = asked[0]  # the leader
                for q in mine:
                    if forest.root(q) != forest.root(main):
                        search(q)
            if a:
                yield K.table(leader=pa.array([leader] * len(a), pa.int64()), a=pa.array(a, pa.int64()), b=pa.array(b, pa.int64()))

    return kernel


def _dealt(slices: DataFrame) -> DataFrame:
    parts = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slices.repartitionById(parts, F.pmod("part", F.lit(parts))).sortWithinPartitions("part")


def _entries(rows: DataFrame) -> DataFrame:
    """Slices of listed shingles, by class, and of documents, from one pass over (doc_id, hash, text)."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = K.map_blocks(rows, _slices_kernel(ranges), _SLICE)
    return store.written(_dealt(slices).mapInArrow(_listed_kernel(ranges), _SLICE), "entries")


def _listed_classes(entries: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(kind, n, tokens) of classes whose listed shingles could reach a partner."""
    shingles = entries.where(F.col("range") != _DOCUMENTS)
    sets = _dealt(shingles).mapInArrow(_sets_of_bucket_kernel, "kind long, tokens array<long>").join(sizes, "kind")
    return store.written(sets.where(100 * F.size("tokens") >= percent * F.col("n")).select("kind", "n", "tokens"), "listed")


def _ranked_classes(sets: DataFrame, percent: int) -> DataFrame:
    """The same, listed among themselves: tokens by rising list length, those of one class gone."""
    entries = sets.select("kind", "n", F.explode("tokens").alias("token"))
    lengths = entries.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    ranked = entries.join(lengths, "token").groupBy("kind", "n").agg(F.sort_array(F.collect_list(F.struct("length", "token"))).alias("ranked"))
    ranked = ranked.where(100 * F.size("ranked") >= percent * F.col("n"))
    return store.written(ranked.select("kind", "n", F.col("ranked.token").alias("tokens")), "ranked")


def _searched(rows: DataFrame, sets: DataFrame, percent: int, turns: bool) -> DataFrame:
    """Links (leader, a, b) that join components; rows: (leader, salt, block, kind, root, query)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ("leader", "salt", "block")
    dealt = rows.join(sets, "kind").repartition(parts, *key).sortWithinPartitions(*key, F.col("query").desc(), "kind")
    K.bound_batches(rows.sparkSession)
    dealt = dealt.select(*key, "kind", "root", "query", "n", "tokens", F.lit(turns).alias("turns"))
    return dealt.mapInArrow(_search_kernel(percent), "leader long, a long, b long")


def linked_classes(entries: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the classes that are linked with another class; sizes: (kind, n) of all classes."""
    listed = _listed_classes(entries, sizes, percent)
    sets = _ranked_classes(listed, percent)
    store.discard(listed)
    # Of the n - ceil(t n) + 1 rarest shingles, those in no list come first.
    prefix = F.expr(f"slice(tokens, 1, cast(size(tokens) - ceil({percent} * n / 100) + 1 AS int))")
    met = sets.select("kind", F.size("tokens").alias("size"), F.explode(prefix).alias("token"))
    leaders = met.groupBy("token").agg(F.min("kind").alias("leader"), F.max("kind").alias("last")).where("leader != last")
    stars = store.written(met.join(leaders.select("token", "leader"), "token").select("leader", "kind", "size").where("kind != leader").distinct(), "stars")
    # Stars larger than a chunk are few, so chunks come to their members by a join of two columns.
    large = stars.groupBy("leader").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    large = store.written(large, "large")
    salted = stars.join(large, "leader", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    salted = salted.select("leader", F.pmod("kind", F.col("chunks")).cast("int").alias("salt"), "kind", "size")
    members = salted.select("leader", "salt", F.lit(0).alias("block"), "kind", F.col("kind").alias("root"), F.lit(False).alias("query"))
    heads = salted.select("leader", "salt").distinct().select("leader", "salt", F.lit(0).alias("block"), F.col("leader").alias("kind"), F.col("leader").alias("root"), F.lit(True).alias("query"))
    roots = graph.components(_searched(members.union(heads), sets, percent, True), "first")
    if not large.isEmpty():
        own = roots.select(F.col("node").alias("kind"), "root")
        led = roots.select(F.col("node").alias("leader"), F.col("root").alias("led"))
        known = salted.join(large.select("leader", "chunks"), "leader").join(own, "kind", "left").join(led, "leader", "left")
        known = known.select("leader", "salt", "kind", "size", "chunks", F.coalesce("root", "kind").alias("root"), F.coalesce("led", "leader").alias("led"))
        known = store.written(known, "known")
        apart = known.where("root != led")
        blocks = apart.groupBy("leader").agg(F.ceil(F.sum("size") / CHUNK).cast("int").alias("blocks"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        members = known.join(blocks, "leader").select("leader", "salt", every.alias("block"), "kind", "root", F.lit(False).alias("query"))
        others = F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: c != F.col("salt")))
        asked = apart.join(blocks, "leader").select("leader", others.alias("salt"), F.pmod(F.xxhash64("kind"), "blocks").cast("int").alias("block"), "kind", "root", F.lit(True).alias("query"))
        more = _searched(members.union(asked), sets, percent, False).select("a", "b")
        roots = graph.components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "all")
        store.discard(known)
    store.discard(sets, stars, large)
    return roots


def linked_rows(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, hash of the text, n_shingles, kind (the class of equal sets) and root (the class that names the component) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    entries = _entries(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")))
    K.bound_batches(docs.sparkSession)
    listing = entries.where(F.col("range") == _DOCUMENTS).mapInArrow(_documents_kernel, "doc_id long, hash long, n_shingles long, kind long")
    own = store.written(listing, "sets", gathered=True)
    sizes = own.where("kind IS NOT NULL").groupBy("kind").agg(F.max("n_shingles").alias("n"))
    roots = linked_classes(entries, sizes, percent)
    store.discard(entries)
    joined = own.join(roots.select(F.col("node").alias("kind"), "root"), "kind", "left")
    return joined.select("doc_id", "hash", "n_shingles", "kind", F.coalesce("root", "kind").alias("root"))


def _classes(docs: DataFrame, percent: int) -> DataFrame:
    return linked_rows(docs, percent).drop("kind")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    own = store.written(_classes(docs, percent).drop("hash"), "classes")
    # Written, so that the join reads two shuffles, of which the larger can be split at a common root.
    least = store.written(own.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return own.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, with their own columns, less all but one row of each component: that of the smallest
    doc_id (null ones last), then of the smallest hash of the text. Rows without shingles all stay.

    A verdict is on a row, by doc_id and text, so rows of one doc_id with different texts are judged apart.
    """
    own = store.written(_classes(docs, percent), "classes")
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")
    best = own.where("n_shingles > 0").groupBy("root").agg(F.min(row).alias("row"))
    kept = store.written(best.select(F.col("row.doc_id").alias("_id"), F.col("row.hash").alias("_hash")), "kept")
    copies = own.where("n_shingles > 0").groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1")
    repeat = not copies.isEmpty()
    held = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    keyed = held.withColumn("_own", F.col(key).cast("long")).withColumn("_print", F.xxhash64(text))
    blank = held.where(~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    chosen = keyed.join(kept, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_hash")))
    if repeat:
        # Equal rows: the first of each, combined before the shuffle.
        whole = F.first(F.struct(*held.columns)).alias("row")
        chosen = chosen.groupBy("_id", "_hash").agg(whole).select("row.*")
    return chosen.select(*held.columns).union(blank).toDF(*docs.columns)
