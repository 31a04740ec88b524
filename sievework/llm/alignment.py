"""Cross-tokenizer alignment: two tokenizers' tokens of one text, grouped and linked by byte offsets.

A text is aligned where it is tokenised: both tokenizers' ids and their ends in bytes, for a byte-level BPE (A) and a
sentence-piece BPE (B) over space + text, become arrays of a block of documents. Ends that both have are the cuts between
groups, and two tokens overlap in one run of bytes, which ends where the first of them ends, so each end is one link. All
is linear in the text. A document leaves as its counts, the digest of its groups and its links, each a pair's ids as one
number, A's in the upper half.

A pair's count is the number of documents that hold it; Spark counts, and combines before the shuffle. Pairs are
joined back with every link in two ways: the ``HEAVY`` most frequent at most, by powers of two, are broadcast,
the rest, few links, meet by a shuffled join.

Defined cases: a null or empty text, and one whose joined token bytes differ from space + text (U+2581 in it, say), has
no tokens: zeros and an empty groups_sha256; a null doc_id is returned like any other; repeated rows count as documents
of their own; ties for the best count all count; an empty table gives no rows; other columns aren't read. Texts are
tokenised whole; a task's memory follows its longest text, some 100 bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import store, tokens
from sievework.llm import textkit as K

#: Pairs that are broadcast at most.
HEAVY = 1 << 18
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>"
_BLOCK = 1 << 20
#: Pieces that a worker remembers of each tokenizer.
_PIECES = 1_000_000


def _measured(ids: np.ndarray, bounds: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each token, bytes of each document)."""
    size = lengths[np.minimum(ids, len(lengths) - 1)]
    return size, np.diff(np.concatenate(([0], np.cumsum(size)))[bounds])


def _per_doc(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(marks)))[bounds])


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each number's digits and a byte for what follows it, in rows of one width, and the number of digits."""
    texts = np.arange(most).astype(np.bytes_)
    digits = np.zeros((most, texts.dtype.itemsize + 1), np.uint8)
    digits[:, :-1] = texts.view(np.uint8).reshape(most, -1)
    return digits, np.char.str_len(texts)


def _digests(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, bounds_a: np.ndarray, bounds_b: np.ndarray, decimals: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """groups_sha256 of each document; ``cut_a`` and ``cut_b`` mark the tokens that end a group."""
    digits, width = decimals
    # A token's place: after all of its own kind before it, and the other kind's of groups before (of A's own, too, for B's).
    ends_a, ends_b = np.flatnonzero(cut_a) + 1, np.flatnonzero(cut_b) + 1
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    ids, after = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    at_a = np.arange(len(a)) + np.concatenate(([0], ends_b))[group_a]
    at_b = np.arange(len(b)) + ends_a[group_b]
    ids[at_a], ids[at_b] = a, b
    after[at_a], after[at_b] = np.where(cut_a, ord("|"), ord(",")), np.where(cut_b, ord(";"), ord(","))
    rows = digits[ids]
    rows[np.arange(len(ids)), -1] = after
    text = rows[rows != 0].tobytes()
    ends = np.concatenate(([0], np.cumsum(width[ids] + 1)))[bounds_a + bounds_b].tolist()
    return [hashlib.sha256(text[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _kernel(path_a: str, path_b: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = tokens.Encoder.of(path_a, literals=False, most=_PIECES), tokens.PieceEncoder.of(path_b, most=_PIECES)
        decimals = _decimals(max(len(first.lengths()), len(second.lengths())))
        for rows, buf, off in K.blocks(batches, "spaced", _BLOCK):
            a, bounds_a = first.encode(buf, off)
            b, bounds_b = second.encode(buf, off)
            size_a, whole_a = _measured(a, bounds_a, first.lengths())
            size_b, whole_b = _measured(b, bounds_b, second.lengths())
            good = (whole_a == np.diff(off)) & (whole_b == np.diff(off)) & (_per_doc(b == second.lost, bounds_b) == 0)
            n_a, n_b = np.where(good, np.diff(bounds_a), 0), np.where(good, np.diff(bounds_b), 0)
            if not good.all():
                keep_a, keep_b = np.repeat(good, np.diff(bounds_a)), np.repeat(good, np.diff(bounds_b))
                a, size_a, b, size_b = a[keep_a], size_a[keep_a], b[keep_b], size_b[keep_b]
                bounds_a, bounds_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
            # What is left of both kinds covers the same bytes: those of the documents that have tokens.
            end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
            is_a, is_b = (np.zeros(int(size_a.sum()) + 1, bool) for _ in range(2))
            is_a[end_a], is_b[end_b] = True, True
            cut_a, cut_b, ends = is_b[end_a], is_a[end_b], np.flatnonzero(is_a | is_b)
            of_a, of_b = is_a[ends], is_b[ends]
            links = a.astype(np.int64)[np.cumsum(of_a) - of_a] << 32 | b.astype(np.int64)[np.cumsum(of_b) - of_b]
            n_groups = _per_doc(cut_a, bounds_a)
            bounds = np.concatenate(([0], np.cumsum(n_a + n_b - n_groups)))  # an end of both kinds is one link
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups)), pa.array(_digests(a, b, cut_a, cut_b, bounds_a, bounds_b, decimals), pa.string()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(links))],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"],
            )

    return kernel


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 and links of both tokenizers over space + text."""
    spaced = F.when(F.col("text") != "", F.concat(F.lit(" "), "text"))
    return K.map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), spaced.alias("spaced")), _kernel(path_a, path_b), ALIGNED)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count (documents that hold it) and best (whether no pair of its A id counts more)."""
    counts = links.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = store.written(counts.withColumn("a", F.shiftright("pair", 32).cast("int")), "align-counts")
    tops = counts.groupBy("a").agg(F.max("count").alias("top"))  # a row for each id of the vocabulary at most
    return counts.join(F.broadcast(tops), "a").select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))


def _heavy(counts: DataFrame) -> int:
    """The least power of two that at most ``HEAVY`` pairs reach by count."""
    by_power = {r.power: r.n for r in counts.groupBy(F.floor(F.log2("count")).alias("power")).agg(F.count("*").alias("n")).collect()}
    total, power = 0, 64
    while power > 0 and total + by_power.get(power - 1, 0) <= HEAVY:
        power -= 1
        total += by_power.get(power, 0)
    return 1 << power


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    rows = aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id())
    rows = store.written(rows, "align-links")
    weights = store.written(pair_counts(rows), "align-weights")
    least = min(_heavy(weights), (1 << 62))
    heavy = F.broadcast(weights.where(F.col("count") >= least))
    each = rows.select("row", F.explode("links").alias("pair"))
    sums = [F.sum("count").alias("count_sum"), F.sum("best").alias("n_best")]
    often = each.join(heavy, "pair").groupBy("row").agg(*sums)
    seldom = each.join(heavy.select("pair"), "pair", "left_anti").join(weights.where(F.col("count") < least), "pair").groupBy("row").agg(*sums)
    total = often.unionByName(seldom).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    plain = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", F.size("links").cast("long").alias("n_links"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return plain.join(total, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
