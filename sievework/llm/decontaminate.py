"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

A test item of m characters may occur in a document with up to k = m / 10 edits. Cut into k + 1
pieces, at least one piece of such an occurrence is untouched, so exact hits of pieces (an
Aho-Corasick automaton over all pieces) give every candidate. A hit fixes where the item would lie.
Windows that lack more four-byte grams of the item than its edits could destroy are passed over;
Myers' algorithm finds the least edit distance of the whole item to any part of the others.

A piece that many items share (test questions of one template do) would bring all of them up for checking wherever the template
occurs. For such pieces the grams of all their items are counted at once, Myers' algorithm runs over all that are left side by side,
and a place is looked at once for all pieces of a template.

Texts and items are compared with A-Z lowered and white space as single bytes of space; distances
count UTF-8 bytes. An item of fewer than ``SHORT`` bytes (its ends' white space aside) has no edit to
spare: it matches where it lies unchanged and no letter, digit or byte outside ASCII adjoins it. Items are written to
the shared folder in blocks of about ``BLOCK_ITEMS`` and read by the tasks, so neither the driver nor a
task's automaton grows with the benchmark; each block is one pass over the documents.

Defined cases: an item of a null item_id is an item like others, returned with it; a null or blank item text matches nothing, and neither does a null or empty text; a pair is
returned once with its least distance, and of places with equal distances none is preferred; rows of a
null doc_id are returned with it; repeated rows give their pairs once; an empty table gives no rows; a
very long text is searched whole, as a block of its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import store
from sievework.llm import textkit as K

#: Edits allowed, one in so many bytes of the item.
PER_EDIT = 10
#: Items of fewer bytes match without edits, between white space.
SHORT = 40
#: Items of one piece from which on their grams are counted at once.
SHARED = 16
#: Fewer items than these are verified one by one.
FEW = 256
#: Items in one automaton, about.
BLOCK_ITEMS = 20_000

_PLAIN = K.LOWER.copy()
_PLAIN[K.IS_SPACE] = 0x20
#: Bytes of words: letters, digits and all outside ASCII.
_WORDLY = np.zeros(256, bool)
_WORDLY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def normal(text: str) -> bytes:
    return _PLAIN[np.frombuffer(text.encode(), np.uint8)].tobytes()


class Item:
    """A pattern with its edit budget, its pieces, and its bit masks."""

    def __init__(self, pattern: bytes):
        self.short = len(pattern.strip()) < SHORT
        self.pattern = pattern.strip() if self.short else pattern
        self.size = len(self.pattern)
        self.budget = 0 if self.short else self.size // PER_EDIT
        bounds = np.linspace(0, self.size, self.budget + 2).astype(int).tolist()
        self.pieces = list(zip(bounds[:-1], bounds[1:], strict=True)) if self.size else []

    @cached_property
    def grams(self) -> frozenset[int]:
        return frozenset(grams(np.frombuffer(self.pattern, np.uint8)).tolist())

    @property
    def least(self) -> int:
        """An edit destroys four grams at most, so an occurrence keeps so many of the distinct ones."""
        return len(self.grams) - 4 * self.budget

    @cached_property
    def masks(self) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, byte in enumerate(self.pattern):
            out[byte] = out.get(byte, 0) | 1 << i
        return out

    def distance(self, window: bytes) -> int:
        """The least edit distance of the pattern to any part of the window."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        best = score
        for byte in window:
            equal = self.masks.get(byte, 0)
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up = minus | ~(across | plus) & full
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1 & full, down << 1 & full
            plus = down | ~(vertical | up) & full
            minus = up & vertical
            if score < best:
                best = score
        return best


def grams(buf: np.ndarray) -> np.ndarray:
    """The four bytes from each position on, as a number."""
    wide = buf.astype(np.uint32)
    return wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24 if len(buf) > 3 else np.zeros(0, np.uint32)


class Shared:
    """The items of a piece that many have: their grams in a row, and Myers' bit masks side by side."""

    def __init__(self, items: list[Item], numbers: list[int]):
        self.numbers = np.array(numbers)
        self.items = [items[n] for n in numbers]
        each = [np.array(sorted(item.grams), np.uint32) for item in self.items]
        self.grams, self.first = np.concatenate(each), np.cumsum([0, *map(len, each)])[:-1]
        self.least = np.array([item.least for item in self.items])
        self.budget = np.array([item.budget for item in self.items])

    @cached_property
    def masks(self) -> tuple[dict[int, np.ndarray], np.ndarray]:
        """(for each byte the places where items have it, as words x items; items' sizes)."""
        size = np.array([item.size for item in self.items])
        wide = np.zeros((len(size), -(-int(size.max()) // 64) * 64), np.uint8)
        for row, item in zip(wide, self.items, strict=True):
            row[: item.size] = np.frombuffer(item.pattern, np.uint8)
        inside = np.arange(wide.shape[1]) < size[:, None]
        return {b: np.ascontiguousarray(np.packbits((wide == b) & inside, axis=1, bitorder="little").view("<u8").T) for b in np.unique(wide[inside]).tolist()}, size

    def fitting(self, window: np.ndarray) -> np.ndarray:
        """Items (their places here) that have grams enough in a window."""
        window = np.unique(window)
        if not len(window):
            return np.flatnonzero(self.least <= 0)
        at = np.minimum(np.searchsorted(window, self.grams), len(window) - 1)
        return np.flatnonzero(np.add.reduceat(window[at] == self.grams, self.first) >= self.least)

    def distances(self, some: np.ndarray, window: bytes) -> np.ndarray:
        """The least edit distances of some items to any part of the window, all items a step, 64 rows a word."""
        masks, size = self.masks
        score = size[some].copy()
        best, last = score.copy(), (size[some] - 1) // 64
        top = np.uint64(1) << ((size[some] - 1) % 64).astype(np.uint64)
        words = int(last.max()) + 1
        plus, minus = np.full((words, len(some)), ~np.uint64(0)), np.zeros((words, len(some)), np.uint64)
        none, one, high = np.zeros(len(some), np.uint64), np.uint64(1), np.uint64(63)
        taken = {b: m[:words, some] for b, m in masks.items() if b in set(window)}
        for byte in window:
            equal = taken.get(byte)
            up_in, down_in = none, none
            for w in range(words):
                own, p, m = none if equal is None else equal[w], plus[w], minus[w]
                vertical, own = own | m, own | down_in
                across = (((own & p) + p) ^ p) | own
                up, down = m | ~(across | p), p & across
                ends = last == w
                score += (ends & ((up & top) != 0)).astype(np.int64) - (ends & ((down & top) != 0))
                up_out, down_out = up >> high, down >> high
                up, down = up << one | up_in, down << one | down_in
                plus[w], minus[w] = down | ~(vertical | up), up & vertical
                up_in, down_in = up_out, down_out
            np.minimum(best, score, out=best)
        return best


class Matcher:
    """An automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[object, bytes]]):
        import ahocorasick

        self.ids = [i for i, _ in items]
        self.items = [Item(p) for _, p in items]
        where: dict[bytes, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for a, b in item.pieces:
                where.setdefault(item.pattern[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        sets: dict[tuple[int, ...], Shared] = {}
        shapes: dict[tuple, int] = {}
        for piece, places in where.items():
            shared = None
            if len(places) > SHARED and not any(self.items[n].short for n, _ in places):
                numbers, starts = tuple(n for n, _ in places), [a for _, a in places]
                held = sets.get(numbers) or sets.setdefault(numbers, Shared(self.items, list(numbers)))
                # Pieces of one set of items that lie alike in all of them are one shape: a place of it is looked at once.
                shape = shapes.setdefault((numbers, *(a - starts[0] for a in starts)), len(shapes))
                before = max(a + self.items[n].budget for n, a in places)
                after = max(self.items[n].size - a + self.items[n].budget for n, a in places) + 1
                shared = held, shape, starts, before, after
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), places, shared))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def find(self, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, distance) of the pairs in a block of plain bytes."""
        if not self.any or not len(buf):
            return
        raw, codes, bounds = buf.tobytes(), grams(buf), set(off.tolist())
        wordly, seen = _WORDLY[buf], set()
        near: dict[tuple[int, int], int] = {}
        spots: dict[tuple[int, int], set[int]] = {}
        hits = list(self.automaton.iter(raw.decode("latin-1")))
        docs = K.owner(off, np.fromiter((e for e, _ in hits), np.int64, len(hits))).tolist()
        for (end, (size, places, shared)), doc in zip(hits, docs, strict=True):
            start = end + 1 - size
            if start < off[doc]:
                continue
            if shared:
                held, shape, starts, before, after = shared
                if (doc, shape, start - starts[0]) in seen:
                    continue
                seen.add((doc, shape, start - starts[0]))
                a, b = max(int(off[doc]), start - before), min(int(off[doc + 1]), start + after)
                some = held.fitting(codes[a : max(a, b - 3)])
                if len(some) < FEW:
                    for i in some.tolist():
                        n = int(held.numbers[i])
                        spots.setdefault((doc, n), set()).add((start - starts[i]) // (self.items[n].budget + 1))
                    continue
                for part in np.array_split(some, -(-len(some) // 8192) or 1):
                    if len(part):
                        distance = held.distances(part, raw[a:b])
                        for i in np.flatnonzero(distance <= held.budget[part]).tolist():
                            key = doc, int(held.numbers[part[i]])
                            near[key] = min(near.get(key, int(distance[i])), int(distance[i]))
                continue
            for n, a in places:
                if self.items[n].short and not ((start in bounds or not wordly[start - 1]) and (end + 1 in bounds or not wordly[end + 1])):
                    continue
                # Where the item would begin, to a multiple of its budget.
                spots.setdefault((doc, n), set()).add((start - a) // (self.items[n].budget + 1))
        for (doc, n), distance in near.items():
            if (doc, n) not in spots:
                yield doc, n, distance
        for (doc, n), cells in spots.items():
            item, best = self.items[n], near.get((doc, n))
            if item.short:
                yield doc, n, 0
                continue
            for cell in sorted(cells):
                step = item.budget + 1
                a = max(int(off[doc]), cell * step - item.budget)
                b = min(int(off[doc + 1]), (cell + 1) * step + item.size + item.budget)
                if len(item.grams.intersection(codes[a : b - 3].tolist())) < item.least:
                    continue
                distance = item.distance(raw[a:b])
                if distance <= item.budget and (best is None or distance < best):
                    best = distance
            if best is not None:
                yield doc, n, best


_last: tuple[str, Matcher] | None = None


def _matcher(folder: str) -> Matcher:
    """The automaton of a block's items, which a worker keeps until it needs another."""
    global _last
    if _last is None or _last[0] != folder:
        _last = None
        system, place = pafs.FileSystem.from_uri(folder)
        names = sorted(f.path for f in system.get_file_info(pafs.FileSelector(place)) if f.path.endswith(".parquet"))
        rows = [row for name in names for row in pq.read_table(name, filesystem=system).to_pylist()]
        _last = folder, Matcher(sorted(((r["item_id"], normal(r["text"])) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])))
    return _last[1]


def _blocks(benchmark: DataFrame) -> list[str]:
    """Write the items to the shared folder; the folder of each block."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    n_blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    path = store.scratch_path(spark, "items")
    dealt = items.repartition(n_blocks, F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    dealt.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))).write.partitionBy("block").parquet(path)
    there = spark.read.schema("item_id long, text string, block int").parquet(path).select("block").distinct()
    return [f"{path}/block={r['block']}" for r in there.orderBy("block").collect()]


def _kernel(folder: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in K.blocks(batches):
            matcher = _matcher(folder)
            found = list(matcher.find(_PLAIN[buf], off))
            yield K.table(
                doc_id=rows.column("doc_id").take(pa.array([d for d, _, _ in found], pa.int64())),
                item_id=pa.array([matcher.ids[n] for _, n, _ in found], pa.int64()),
                distance=pa.array([x for _, _, x in found], pa.int32()),
            )

    return kernel


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id and distance of every pair of a document and an item that occurs in it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())])
    found = docs.sparkSession.createDataFrame([], schema)
    for folder in _blocks(benchmark):
        found = found.union(K.map_blocks(docs, _kernel(folder), schema))
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def clean_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with their own columns; rows pass through once, unshuffled."""
    bare = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"

    def kernel_of(folder: str):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, buf, off in K.blocks(batches, text):
                keep = np.ones(rows.num_rows, bool)
                keep[[d for d, _, _ in _matcher(folder).find(_PLAIN[buf], off)]] = False
                yield rows.filter(pa.array(keep))

        return kernel

    for folder in _blocks(benchmark):
        bare = K.map_blocks(bare, kernel_of(folder), bare.schema)
    return bare.toDF(*docs.columns)
