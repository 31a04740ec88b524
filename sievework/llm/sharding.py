"""Reproducible shuffle into shards: a Feistel permutation of global row numbers, in DataFrame operations only.

Rows are numbered in an order that follows from their contents (doc_id, then the text's digest), the
numbers are permuted by a keyed Feistel network, and a row's permuted number p says its place: shard
p mod shards, slot p div shards. So the counts of shards are at most one apart, slots have no gaps, and
a row's shard and slot are computed from its number, the number of rows and the seed (``place``, in plain
Python too), and its number from shard and slot (``row_at``).

The network works on pairs (number div b, number mod b) of a grid of a x b cells, just large enough for
the n rows: odd rounds add a keyed function of the right half to the left one modulo a, even rounds
the reverse modulo b. A number that leaves [0, n) is permuted again until it is back (cycle walking).
The grid is the one of fewest spare cells among 1,000 of nearly equal sides: a few for millions of
rows, some thousand for 10^12.

Defined cases: a null text has 0 bytes (size 8) and the checksum 0; a null doc_id sorts first; rows of one
doc_id are ordered by their texts' digests, and rows equal in both are interchangeable; equal texts are
shuffled like any others, since counts at most one apart leave no room to keep thousands of copies
together; an empty table gives no rows; other columns are neither read nor returned by ``sharded``, and
``write_shards`` keeps them but refuses tables that have columns of its own names; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import numbering, store

ROUNDS = 8
SEED = 20240229
#: Modulus of the round function, so that products fit 63 bits.
PRIME = (1 << 31) - 1
#: Grids that are compared.
GRIDS = 1000


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers below ``PRIME`` a round, by SHA-256 of seed and round."""
    digests = [hashlib.sha256(f"{seed}:{i}".encode()).digest() for i in range(rounds)]
    return [tuple(1 + int.from_bytes(d[8 * k : 8 * k + 8], "big") % (PRIME - 1) for k in range(3)) for d in digests]


def grid(n: int) -> tuple[int, int]:
    """Sides (a, b) with a * b >= n and few spare cells; of equal ones that of the smaller a."""
    if n > (PRIME - GRIDS) ** 2:
        raise ValueError("more rows than the permutation has cells")
    least = math.isqrt(max(n - 1, 0)) + 1
    return min(((a, -(-n // a) or 1) for a in range(least, least + GRIDS)), key=lambda s: (s[0] * s[1], s[0]))


def _quotient(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by))


def _plain(x: int, a: int, b: int, seed: int, inverse: bool) -> int:
    """One application of the network to a number below a * b."""
    halves, sides = list(divmod(x, b)), (a, b)
    steps = list(enumerate(round_keys(seed)))
    for i, (first, second, third) in reversed(steps) if inverse else steps:
        changed, side = i % 2, sides[i % 2]
        t = (halves[1 - changed] * first + second) % PRIME
        t = (t * t + third) % PRIME
        t = ((t ^ t >> 15) * second + first) % PRIME
        t = (t * t + t * third) % PRIME % side
        halves[changed] = (halves[changed] + (-t if inverse else t)) % side
    return halves[0] * b + halves[1]


def place(number: int, n: int, seed: int = SEED, inverse: bool = False) -> int:
    """The permuted number of one number below n, or the number that is permuted to it."""
    a, b = grid(n)
    x = _plain(number, a, b, seed, inverse)
    while x >= n:
        x = _plain(x, a, b, seed, inverse)
    return x


def permuted(df: DataFrame, number: str, out: str, n: int, seed: int = SEED, inverse: bool = False) -> DataFrame:
    """``df`` with column ``out``: a keyed permutation of ``number`` in 0 .. n - 1, or its inverse.

    A round is four projections, so that each value is computed once, in generated code. Walks are the spare
    cells' alone, so each cell's end is found once, and rows that land on a spare cell take it from there.
    """
    a, b = grid(n)
    steps = list(enumerate(round_keys(seed)))
    own = [c for c in df.columns if c != out]
    df = df.select(*own, F.col(number).cast("long").alias("_x")).select(*own, _quotient(F.col("_x"), b).alias("_0"), (F.col("_x") % b).alias("_1"))
    t = F.col("_t")
    for i, (first, second, third) in reversed(steps) if inverse else steps:
        changed, other, side = f"_{i % 2}", f"_{1 - i % 2}", (a, b)[i % 2]
        for value in ((F.col(other) * first + second) % PRIME, (t * t + third) % PRIME, (t.bitwiseXOR(F.shiftright(t, 15)) * second + first) % PRIME, (t * t + t * third) % PRIME % side):
            df = df.select(*own, "_0", "_1", value.alias("_t"))
        moved = F.pmod(F.col(changed) - t if inverse else F.col(changed) + t, F.lit(side))
        df = df.select(*own, moved.alias(changed), other)
    x = F.col("_x")
    df = df.select(*own, (F.col("_0") * b + F.col("_1")).alias("_x"))
    ends = [place(cell, n, seed, inverse) if n else 0 for cell in range(n, a * b)]
    return df.select(*own, (F.when(x < n, x).otherwise(F.lit(ends)[(x - n).cast("int")]) if ends and n else x).cast("long").alias(out))


def row_at(shard: int, slot: int, n: int, shards: int = 24, seed: int = SEED) -> int:
    """The global row number that lies in a slot of a shard."""
    return place(slot * shards + shard, n, seed, inverse=True)


def _narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, size, text_crc32 and the digest that orders rows of one doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*columns, F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5"))


def sharded(docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number of each document."""
    narrow = store.written(_narrow(docs), "shard-rows")
    n = narrow.count()
    rows = numbering.ordered(narrow, [F.col("doc_id").asc_nulls_first(), F.col("text_md5")], "shard-order")
    placed = permuted(rows, "row_number", "_p", n, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"), _quotient(F.col("_p"), shards).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")


def write_shards(docs: DataFrame, path: str, shards: int = 24, seed: int = SEED, files: int = 1) -> None:
    """Write documents, all columns, as Parquet folders ``shard=k``, rows in order of ``slot``; each
    shard is cut into ``files`` files of consecutive slots."""
    own = {"shard", "slot", "row_number", "_row", "_p", "_nth", "_at", "_part", "_before", "_0", "_1", "_t", "_x"}
    if clash := own & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are the shards' own")
    text = F.coalesce("text", F.lit(""))
    n = docs.count()
    rows = numbering.ordered(docs.withColumn("_row", F.struct(F.col("doc_id").cast("long"), F.md5(text.cast("binary")))), [F.col("_row").asc_nulls_first()], "shard-order")
    placed = permuted(rows, "row_number", "_p", n, seed).withColumns({"shard": (F.col("_p") % shards).cast("int"), "slot": _quotient(F.col("_p"), shards)})
    per_file = max(1, -(-n // (shards * files)))
    dealt = placed.repartition(shards * files, "shard", _quotient(F.col("slot"), per_file).cast("int")).sortWithinPartitions("shard", "slot")
    dealt.drop("_row", "_p", "row_number").write.mode("errorifexists").partitionBy("shard").parquet(path)
