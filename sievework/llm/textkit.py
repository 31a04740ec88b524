"""Vectorised text kernels over Arrow string buffers.

Every Python-backed operator of this subpackage reads texts as Arrow batches and works on the
UTF-8 buffer itself. A batch is cut into blocks of whole documents of about ``BLOCK_BYTES``, so the
memory of a worker follows the block and the longest single document, never the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Documents are worked on in blocks of about so many bytes.
BLOCK_BYTES = 2 << 20
#: Ranges of so many values are told apart by a polynomial modulo 2^64.
SAFE = 64

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PRIME, _PRIME_BASE = (1 << 31) - 1, 1_220_703_125
_powers: dict[tuple[int, bool], np.ndarray] = {}
#: A random 64-bit word for each byte value.
_BYTE_WORDS = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_BYTE_TERMS = np.random.default_rng(20240301).integers(1, _PRIME, 256, dtype=np.uint64)

#: Word separators of the contracts: space and U+0009 to U+000D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Byte values with A-Z lowered.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that one batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def map_blocks(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with bounded batches."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(kernel, schema)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n+1 offsets of its values; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n, start = len(column), column.offset
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[start : start + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of whole documents, about ``limit`` bytes each."""
    for batch in batches:
        buf, off = buffers(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), buf[off[at] : off[end]], off[at : end + 1] - off[at]
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x = x * _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """B^0 .. B^n modulo 2^64, of the base or of its inverse."""

    def grow(size: int) -> np.ndarray:
        have = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        have[0] = 1
        return np.multiply.accumulate(have)

    return _kept((64, inverse), n, grow)


def prime_powers(n: int, inverse: bool = False) -> np.ndarray:
    """B^0 .. B^n modulo 2^31 - 1, of the prime's base or of its inverse."""

    def grow(size: int) -> np.ndarray:
        base = pow(_PRIME_BASE, -1, _PRIME) if inverse else _PRIME_BASE
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate((have, modulo_prime(have * _U64(pow(base, len(have), _PRIME)))))
        return have[:size].astype(np.uint32)

    return _kept((31, inverse), n, grow)


def _kept(key: tuple[int, bool], n: int, grow: Callable[[int], np.ndarray]) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) <= n:
        size = max(n + 1, BLOCK_BYTES + 4096)
        have = grow(size)
        if size <= 4 * BLOCK_BYTES:
            _powers[key] = have
    return have[: n + 1]


def modulo_prime(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, by folds."""
    p, bits = _U64(_PRIME), _U64(31)
    for _ in range(3):
        x = (x & p) + (x >> bits)
    return np.where(x == p, _U64(0), x)


class RangeHash:
    """64-bit fingerprints of any ranges of a byte or word sequence, from two cumulative sums.

    Polynomials modulo 2^64 alone agree on some strings of two symbols and a thousand bytes (those of Thue
    and Morse) whatever the base, so for ranges of over ``SAFE`` values a second one, modulo the prime
    2^31 - 1, is mixed in.
    """

    def __init__(self, values: np.ndarray):
        """values: bytes, or 64-bit words."""
        words = _BYTE_WORDS[values] if values.dtype == np.uint8 else values
        self.n = len(words)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(words * powers(self.n)[:-1], out=self.sums[1:])
        self.shift = powers(self.n, True)
        self.values, self.terms = values, None

    def short(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same for ranges of at most ``SAFE`` values."""
        return mix(self._first(start, end))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of [start, end); those of equal length and content are equal."""
        out = self._first(start, end)
        if len(far := np.flatnonzero(end - start > SAFE)):
            out[far] += self._second(start[far], end[far]) * _U64(0x9FB21C651E98DF25)
        return mix(out)

    def _second(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.terms is None:
            terms = (_BYTE_TERMS[self.values] if self.values.dtype == np.uint8 else self.values >> _U64(33)) * prime_powers(self.n)[:-1]
            self.terms = np.zeros(self.n + 1, np.uint64)
            np.cumsum((terms & _U64(_PRIME)) + (terms >> _U64(31)), out=self.terms[1:])  # of less than 2^32 each
        return modulo_prime(modulo_prime(self.terms[end] - self.terms[start]) * prime_powers(self.n, True)[start])

    def _first(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.shift[start] + (end - start).astype(np.uint64) * _U64(0xD6E8FEB86659FD93)


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``flag`` that don't cross a document's bounds."""
    n = len(flag)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = np.flatnonzero(flag & (first[:-1] | ~np.concatenate(([False], flag[:-1]))))
    end = np.flatnonzero(flag & (first[1:] | ~np.concatenate((flag[1:], [False])))) + 1
    return start, end


def owner(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The document in which each byte position lies."""
    return np.searchsorted(off, at, "right") - 1


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts, or sums of whole numbers, by document."""
    return np.bincount(doc, weights, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


class Words:
    """The words of a block: runs of anything but U+0020 and U+0009 to U+000D."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.start, self.end = runs(~IS_SPACE[buf], off)
        self.doc = owner(off, self.start)
        self.n_docs = len(off) - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start word, fingerprint) of each window of ``size`` words inside a document."""
        n = len(words)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])
        return at, RangeHash(words).of(at, at + size)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group starts, group sizes) of equal keys, in a stable order."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return order, start, np.diff(np.append(start, len(k)))


def strings(column: list[str]) -> pa.Array:
    return pa.array(column, pa.string())


def table(**columns) -> pa.RecordBatch:
    """A record batch of arrays or lists."""
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
