"""Hard negatives by a pivot table: inner products as Euclidean distances, bracketed by the triangle inequality.

Components become whole numbers floor(256 * x). A row x gets one more coordinate, sqrt(M - |x|^2) with M the
largest squared length of all rows, and an anchor q gets 0, so |q' - x'|^2 = |q|^2 + M - 2 q.x: the largest inner
product is the smallest distance. Distances of every row to ``PIVOTS`` stored rows form the pivot table. For a
pivot p, |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p), which brackets the score q.x from both sides; only rows whose
bracket reaches the wanted scores are scored exactly.

Rows are numbered in order of (label, nearest pivot, distance to it, vec_id) and cut into strips, so a strip holds
few labels and a narrow ring of distances. The anchors of a strip are one block of queries. Spark joins blocks
with strips by the strip's group: for positives only strips that share a label, for negatives all. A task
holds one block and one strip at a time, keeps the best few a query, and only those are shuffled. The sample that is fitted
is the ``PIVOTS`` rows of least hash; every row is in the table, and the result is exact.

Defined cases: rows with a null label, vector or vec_id, with a component that is null or not finite, or of a squared
length of 2^62 or more (their scores need not fit a long), take no part; rows equal in all three columns count once; rows of one vec_id that differ otherwise are
rows of their own, but never each other's positive or negative; vectors of unequal lengths count as padded with zeros,
an empty one scores 0; ties go to the smaller vec_id; anchors without positives, or without negatives in the window,
return nothing; whole numbers too large for exact sums of doubles are scored by Python integers; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import numbering, store
from sievework.llm import textkit as K

PIVOTS = 8
#: Rows of a strip: at most so many, and bytes of its vectors.
STRIP_ROWS, STRIP_BYTES = 32768, 8 << 20
#: Fewer rows a strip where there would not be so many strips, but not fewer than ``STRIP_LEAST``.
STRIPS, STRIP_LEAST = 24, 2048
#: Queries that are scored at once.
QUERIES = 128
_EXACT = float(1 << 47)
_BOX = "strip long, n int, dim int, ids binary, labels binary, vecs binary, dists binary, lo binary, hi binary, nq int, q_ids binary, q_labels binary, q_vecs binary, q_dists binary, tau binary"


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, label and whole-number vectors (as doubles) of the rows that take part."""
    whole = F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("vec", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)).alias("vec")).where(_length() < 2.0**62).distinct()


def _length() -> Column:
    return F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of doubles as rows padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n, off = len(column), column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    if n and (size == dim).all():
        return values[off[0] : off[-1]].reshape(n, dim)
    out = np.zeros((n, dim))
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], size)] = values[off[0] : off[-1]]
    return out


class Space:
    """The pivots, and distances of rows and anchors to them."""

    def __init__(self, pivots: list[list[float]], dim: int, most: float):
        self.dim, self.most = dim, most
        self.pivots = np.zeros((len(pivots), dim))
        for i, p in enumerate(pivots):
            self.pivots[i, : len(p)] = p
        self.more = self._more(self.pivots)

    def _more(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - np.einsum("ij,ij->i", x, x), 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.most - 2 * (x @ self.pivots.T + np.outer(self._more(x), self.more)), 0))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", q, q)[:, None] + self.most - 2 * q @ self.pivots.T, 0))


def _assign_kernel(space: Space):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = space.of_rows(_matrix(batch.column("vec"), space.dim))
            cell = d.argmin(1) if d.shape[1] else np.zeros(len(d), np.int64)
            near = d[np.arange(len(d)), cell] if d.shape[1] else np.zeros(len(d))
            yield K.table(vec_id=batch.column("vec_id"), label=batch.column("label"), vec=batch.column("vec"), cell=pa.array(cell.astype(np.int32)), near=pa.array(near))

    return kernel


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones the smaller ids first."""
    if not len(scores):
        return np.zeros(0, np.int64)
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: floats where sums stay below 2^47, Python integers elsewhere."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)))
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < _EXACT:
        return q.astype(float) @ x.astype(float).T
    whole = [[[int(v) for v in row] for row in m] for m in (q, x)]
    out = np.empty((len(q), len(x)), object)
    for i, a in enumerate(whole[0]):
        out[i] = [sum(u * v for u, v in zip(a, b, strict=True)) for b in whole[1]]
    return out


def _packed(x: np.ndarray) -> np.ndarray:
    """In the narrowest exact type."""
    top = float(np.abs(x).max()) if x.size else 0.0
    return x.astype(np.int16) if top < 2**15 else x.astype(np.int32) if top < 2**31 else x


def _unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, {2: np.int16, 4: np.int32, 8: np.float64}[len(raw) // (n * dim)] if raw else np.int16).reshape(n, dim)


class Bracket:
    """Upper and lower bounds of scores from distances to pivots."""

    def __init__(self, q: np.ndarray, q_dists: np.ndarray, most: float):
        self.length = np.einsum("ij,ij->i", q.astype(float), q.astype(float)) + most
        self.q_dists = q_dists
        self.slack = 1e-9 * self.length + 1e-6

    def upper(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of each query against rows whose distances lie in [lo, hi] by row and pivot."""
        if not lo.shape[1]:
            return np.full((len(self.length), len(lo)), np.inf)
        least = np.zeros((len(self.length), len(lo)))
        for p in range(lo.shape[1]):
            q = self.q_dists[:, p : p + 1]
            np.maximum(least, np.maximum(lo[None, :, p] - q, q - hi[None, :, p]), out=least)
        return (self.length[:, None] - least * least) / 2 + self.slack[:, None]

    def lower(self, hi: np.ndarray) -> np.ndarray:
        if not hi.shape[1]:
            return np.full((len(self.length), len(hi)), -np.inf)
        most = np.full((len(self.length), len(hi)), np.inf)
        for p in range(hi.shape[1]):
            np.minimum(most, self.q_dists[:, p : p + 1] + hi[None, :, p], out=most)
        return (self.length[:, None] - most * most) / 2 - self.slack[:, None]


def _pack_kernel(space: Space, every: int, positives: int):
    """A strip's rows as one row: ids, labels, vectors, pivot table, its ring, and its anchors with the score that
    their last positive inside the strip has."""

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row_number")
        ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
        x = _matrix(rows.column("vec"), space.dim)
        d = space.of_rows(x)
        at = np.flatnonzero(ids % every == 0)
        tau = np.full(len(at), -np.inf)
        for i in range(0, len(at), QUERIES):
            part = _product(x[at[i : i + QUERIES]], x)
            for j, row in enumerate(part):
                mine = at[i + j]
                own = np.flatnonzero((labels == labels[mine]) & (ids != ids[mine]))
                if len(own) >= positives:
                    tau[i + j] = float(np.sort(row[own])[-positives])
        blob = lambda v, kind=None: [np.ascontiguousarray(v, kind).tobytes()]
        low, high = (d.min(0), d.max(0)) if d.size else (np.zeros(0), np.zeros(0))
        values = [key[0].as_py(), len(ids), space.dim]
        return pa.table({
            "strip": pa.array(values[:1], pa.int64()), "n": pa.array(values[1:2], pa.int32()), "dim": pa.array(values[2:], pa.int32()),
            "ids": blob(ids, np.int64), "labels": blob(labels, np.int64), "vecs": blob(_packed(x)), "dists": blob(d, float), "lo": blob(low, float), "hi": blob(high, float),
            "nq": pa.array([len(at)], pa.int32()), "q_ids": blob(ids[at], np.int64), "q_labels": blob(labels[at], np.int64), "q_vecs": blob(_packed(x[at])), "q_dists": blob(space.of_anchors(x[at]), float), "tau": blob(tau, float),
        })

    return pack


class _Block:
    """A block of queries, as a joined row has it; a query is named by its strip and its place in the block."""

    def __init__(self, row: dict):
        self.strip = row["q_strip"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "q_labels"))
        self.x = _unpacked(row["q_vecs"], len(self.ids), row["dim"])
        self.dists = np.frombuffer(row["q_dists"], float).reshape(len(self.ids), -1)
        self.tau = np.frombuffer(row["tau"], float)


class _Strip:
    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = _unpacked(row["vecs"], n, dim)
        self.dists = np.frombuffer(row["dists"], float).reshape(n, -1)
        self.lo, self.hi = (np.frombuffer(row[c], float)[None, :] for c in ("lo", "hi"))


_PAIR = ("q_strip", "q_ids", "q_labels", "q_vecs", "q_dists", "tau", "n", "dim", "ids", "labels", "vecs", "dists", "lo", "hi")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, _Block, _Strip]]:
    kept: tuple[int, _Block] | None = None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            if kept is None or kept[0] != row["q_strip"]:
                kept = row["q_strip"], _Block(row)
            yield row, kept[1], _Strip(row)


def _positive_kernel(space: Space, k: int):
    """The k best rows of the anchor's label in each strip, where a bracket lets them be among the best of all."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, strip in _pairs(batches):
            out: list[tuple] = []
            ring = Bracket(block.x, block.dists, space.most).upper(strip.lo, strip.hi)[:, 0]
            want = np.flatnonzero((ring >= block.tau) & np.isin(block.labels, strip.labels))
            for i in range(0, len(want), QUERIES):
                rows = want[i : i + QUERIES]
                reach = Bracket(block.x[rows], block.dists[rows], space.most).upper(strip.dists, strip.dists) >= block.tau[rows, None]
                reach &= (block.labels[rows, None] == strip.labels[None, :]) & (block.ids[rows, None] != strip.ids[None, :])
                some = np.flatnonzero(reach.any(0))
                scores = _product(block.x[rows], strip.x[some])
                for j, q in enumerate(rows):
                    own = np.flatnonzero(reach[j, some])
                    for at in own[best(scores[j, own], strip.ids[some[own]], k)]:
                        out.append((block.strip, int(q), int(strip.ids[some[at]]), int(scores[j, at])))
            if out:
                yield _rows(out, ("q_strip", "at", "positive_id", "positive_score"), ("int64", "int32", "int64", "int64"))

    return kernel


def _rows(rows: list[tuple], names: tuple[str, ...], kinds: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.type_for_alias(t)) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def _negative_kernel(space: Space, k: int, low: int, high: int):
    """For each anchor and positive the k best rows of other labels in each strip whose scores lie in the window
    [low, high] hundredths of the positive's."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block, strip in _pairs(batches):
            out: list[tuple] = []
            wanted: dict[int, list[tuple[int, int, int]]] = {}
            for w in row["wanted"]:
                wanted.setdefault(w["at"], []).append((w["place"], w["positive_id"], w["positive_score"]))
            rows = np.array(sorted(wanted), np.int64)
            least = np.array([min(low * p[2] for p in wanted[q]) / 100 for q in rows.tolist()])
            most = np.array([max(high * p[2] for p in wanted[q]) / 100 for q in rows.tolist()])
            ring = Bracket(block.x[rows], block.dists[rows], space.most)
            keep = (ring.upper(strip.lo, strip.hi)[:, 0] >= least) & (ring.lower(strip.hi)[:, 0] <= most)
            rows, least, most = rows[keep], least[keep], most[keep]
            for i in range(0, len(rows), QUERIES):
                part = slice(i, i + QUERIES)
                bracket = Bracket(block.x[rows[part]], block.dists[rows[part]], space.most)
                reach = (bracket.upper(strip.dists, strip.dists) >= least[part, None]) & (bracket.lower(strip.dists) <= most[part, None])
                reach &= (block.labels[rows[part], None] != strip.labels[None, :]) & (block.ids[rows[part], None] != strip.ids[None, :])
                some = np.flatnonzero(reach.any(0))
                scores = _product(block.x[rows[part]], strip.x[some])
                for j, q in enumerate(rows[part].tolist()):
                    own = np.flatnonzero(reach[j, some] & (100 * scores[j] >= min(low * p[2] for p in wanted[q])))
                    s, ids = scores[j, own], strip.ids[some[own]]
                    order = best(s, ids, len(own))
                    s, ids = s[order], ids[order]
                    for number, positive, score in wanted[q]:
                        inside = np.flatnonzero((100 * s <= high * score) & (100 * s >= low * score))[:k]
                        out += [(block.strip, int(q), number, int(block.ids[q]), positive, score, int(ids[t]), int(s[t])) for t in inside]
            if out:
                yield _rows(out, ("q_strip", "at", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), ("int64", "int32", "int32", "int64", "int64", "int64", "int64", "int64"))

    return kernel


def _joined(blocks: DataFrame, strips: DataFrame, numbers: Column, *more: str) -> DataFrame:
    """Blocks of queries beside the strips that ``numbers`` names, joined on the strip's number."""
    left = blocks.select(F.col("strip").alias("q_strip"), "q_ids", "q_labels", "q_vecs", "q_dists", "tau", *more, F.explode(numbers).alias("strip"))
    return left.join(strips.select("strip", "n", "dim", "ids", "labels", "vecs", "dists", "lo", "hi"), "strip").select(*_PAIR, *more)


def hard_negatives(vectors: DataFrame, *, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``; for each of an anchor's first ``positives`` rows of its label, the
    first ``negatives`` rows of other labels that score between ``low`` and ``high`` hundredths of the positive's score.
    """
    spark = vectors.sparkSession
    K.bound_batches(spark)
    rows = store.written(clean(vectors), "negatives-rows")
    n, dim, most = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.max(_length()), F.lit(0.0))).first()
    dim = max(dim, 1)
    pivots = [r.vec for r in rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(PIVOTS).select("vec").collect()]
    space = Space(pivots, dim, most)
    strip_rows = max(1, min(STRIP_ROWS, STRIP_BYTES // (2 * dim), max(STRIP_LEAST, -(-n // STRIPS))))
    assigned = rows.mapInArrow(_assign_kernel(space), "vec_id long, label long, vec array<double>, cell int, near double")
    numbered = numbering.ordered(assigned, [F.col(c) for c in ("label", "cell", "near", "vec_id")], "negatives-order").withColumn("strip", F.call_function("div", F.col("row_number"), F.lit(strip_rows)))
    strips = store.written(numbered.select("strip", "row_number", "vec_id", "label", "vec").groupBy("strip").applyInArrow(_pack_kernel(space, every, positives), _BOX), "negatives-strips")
    by_label = numbered.groupBy("label").agg(F.min("strip").alias("first"), F.max("strip").alias("last"))
    reach = numbered.select("strip", "label").distinct().join(by_label, "label").groupBy("strip").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    blocks = strips.where("nq > 0")
    pairs = _joined(blocks.join(reach, "strip"), strips, F.sequence("first", "last"))
    found = pairs.mapInArrow(_positive_kernel(space, positives), "q_strip long, at int, positive_id long, positive_score long")
    of_anchor = Window.partitionBy("q_strip", "at").orderBy(F.desc("positive_score"), "positive_id")
    chosen = store.written(found.withColumn("place", F.row_number().over(of_anchor)).where(F.col("place") <= positives), "negatives-positives")
    wanted = chosen.groupBy(F.col("q_strip").alias("strip")).agg(F.collect_list(F.struct("at", "place", "positive_id", "positive_score")).alias("wanted"))
    count = -(-n // strip_rows)
    pairs = _joined(blocks.join(wanted, "strip"), strips, F.sequence(F.lit(0).cast("long"), F.lit(max(count - 1, 0)).cast("long")), "wanted")
    found = pairs.mapInArrow(_negative_kernel(space, negatives, low, high), "q_strip long, at int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    of_pair = Window.partitionBy("q_strip", "at", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(of_pair)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
