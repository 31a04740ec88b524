"""Multinomial logistic regression of sparse counts of terms, by L-BFGS over blocks of documents.

A block holds whole documents as a sparse matrix with a dictionary of its own columns, some three bytes an entry. Each step is
one pass over the blocks: tasks stream them and send one sum of gradients each, Spark adds these by ranges of the vector, and the
driver, which never sees a document, holds vectors as long as the vocabulary. Nothing is sampled or left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from sievework.llm import textkit

#: Words that are counted at once, and words of a block, about.
COUNTED, BLOCK = 1 << 20, 1 << 17
#: Numbers that are added up as one row.
CHUNK = 1 << 14
#: Steps that L-BFGS remembers.
MEMORY = 8
_COUNTS = pa.schema([("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])
BLOCKS = "labels binary, lengths binary, scale binary, columns binary, entries binary, wide boolean, counts binary, count_bytes int"


def _lists(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Rows of about ``limit`` words at most, with the numbers of their words and the words; the words are the first column."""
    kept, held = [], 0

    def joined() -> tuple[pa.RecordBatch, np.ndarray, pa.Array]:
        rows = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        lists = rows.column(0)
        return rows, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            begin = int(ends[at - 1]) if at else 0
            end = max(at + (not kept), int(np.searchsorted(ends, begin + limit - held, "right")))
            if end > at:
                kept.append(batch.slice(at, end - at))
                held += int(ends[end - 1]) - begin
                at = end
            if at < batch.num_rows or held >= limit:
                yield joined()
                kept, held = [], 0
    if kept:
        yield joined()


def _neighbours(row: np.ndarray, word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codes of pairs of neighbours in one row; words below 0 have none."""
    fits = (row[1:] == row[:-1]) & (word[1:] >= 0) & (word[:-1] >= 0)
    return row[1:][fits], word[:-1][fits] * size + word[1:][fits]


def _runs(row: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, code) in order, with their numbers."""
    key = np.sort(row * size + code)
    begun = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[begun] // max(size, 1), key[begun] % max(size, 1), np.diff(np.append(begun, len(key)))


def term_counts(rows: DataFrame, column: str, pairs: bool, low: int, high: int, parts: int) -> DataFrame:
    """term, n, df of the terms that ``low`` to ``high`` rows hold: values of an array column and, if wanted, their pairs of neighbours.

    Terms are dealt to ``parts`` by a hash and go there as packed tables, so Spark has a row for each of those, not for each term.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lengths, flat in _lists(batches, COUNTED):
            coded = flat.dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row, size = np.repeat(np.arange(len(lengths)), lengths), len(words)
            sums = np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], np.uint64)
            for paired in (False, True)[: 1 + pairs]:
                at, found, most = (*_neighbours(row, code, size), size * size) if paired else (row, code, size)
                term, n = np.unique(found, return_counts=True)
                df = np.unique(_runs(at, found, most)[1], return_counts=True)[1]
                first, second = (term // max(size, 1), term % max(size, 1)) if paired else (term, term)
                part = (textkit.mix((sums[first] << np.uint64(32)) | sums[second]) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
                order = np.argsort(part, kind="stable")
                first, part = words.take(pa.array(first[order])), part[order]
                text = pc.binary_join_element_wise(first, words.take(pa.array(second[order])), " ") if paired else first
                whole = pa.RecordBatch.from_arrays([text, pa.array(n[order], pa.int64()), pa.array(df[order], pa.int64())], schema=_COUNTS)
                begun = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
                for i, j in zip(begun, [*begun[1:], len(part)], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([int(part[i])], pa.int32()), pa.array([whole.slice(i, j - i).serialize().to_pybytes()], pa.binary())], ["part", "data"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}

        def summed(tables: list[pa.Table]) -> pa.Table:
            found = pa.concat_tables(tables).group_by("term", use_threads=False).aggregate([("n", "sum"), ("df", "sum")])
            return pa.table([found["term"], found["n_sum"], found["df_sum"]], schema=_COUNTS)

        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = held.setdefault(part, [])
                own.append(pa.Table.from_batches([pa.ipc.read_record_batch(data.as_buffer(), _COUNTS)]))
                if len(own) > 1 and sum(t.num_rows for t in own[1:]) > max(own[0].num_rows, 1 << 18):
                    held[part] = [summed(own)]
        while held:
            found = summed(held.popitem()[1])
            found = found.filter(pc.and_(pc.greater_equal(found["df"], low), pc.less_equal(found["df"], high)))
            yield from found.to_batches(max_chunksize=1 << 16)

    dealt = textkit.map_blocks(rows.select(column), counted, "part int, data binary").repartition(parts, "part")
    return textkit.map_blocks(dealt, added, "term string, n long, df long")


class Lookup:
    """Where terms, words or pairs of words with a space between, stand in a vocabulary."""

    def __init__(self, vocabulary: list[str]):
        parts = pc.split_pattern(pa.array(vocabulary, pa.string()), " ")
        coded = parts.flatten().dictionary_encode()
        number, begin = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), parts.offsets.to_numpy()[:-1]
        length = np.diff(parts.offsets.to_numpy())
        self.size, self.words, self.one = len(vocabulary), coded.dictionary, np.full(len(coded.dictionary), -1)
        alone, pairs = np.flatnonzero(length == 1), np.flatnonzero(length == 2)
        self.one[number[begin[alone]]] = alone
        codes = number[begin[pairs]] * len(self.words) + number[begin[pairs] + 1]
        order = np.argsort(codes)
        self.codes, self.terms = codes[order], pairs[order]

    def tally(self, lengths: np.ndarray, flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, term) in order, with their numbers, of rows of words."""
        row = np.repeat(np.arange(len(lengths)), lengths)
        coded = flat.dictionary_encode()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        word = known[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        alone = np.append(self.one, -1)[word]
        found = [(row[alone >= 0], alone[alone >= 0])]
        if len(self.codes):
            at, code = _neighbours(row, word, len(self.words))
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            fits = self.codes[place] == code
            found.append((at[fits], self.terms[place[fits]]))
        return _runs(*(np.concatenate(x) for x in zip(*found, strict=True)), self.size)


def _scale(row: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """What makes each row's weights (1 + ln tf) idf a vector of unit length."""
    squares = np.bincount(row, weights=((1 + np.log(tf)) * idf[term]) ** 2, minlength=n)
    return np.divide(1.0, np.sqrt(squares), out=np.zeros(n), where=squares > 0)


def blocks(rows: DataFrame, words: str, label_id: str, vocabulary: list[str], idf: np.ndarray) -> DataFrame:
    """The rows' TF-IDF vectors of unit length, in blocks."""
    shared = rows.sparkSession.sparkContext.broadcast((Lookup(vocabulary), idf))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, weight = shared.value
        for part, lengths, flat in _lists(batches, BLOCK):
            row, term, tf = lookup.tally(lengths, flat)
            columns, entries = np.unique(term, return_inverse=True)
            wide, kind = len(columns) > 1 << 16, np.min_scalar_type(int(tf.max(initial=0)))
            arrays = [
                part.column(1).to_numpy(zero_copy_only=False).astype(np.int32),
                np.bincount(row, minlength=len(lengths)).astype(np.int64),
                _scale(row, term, tf, weight, len(lengths)),
                columns.astype(np.int32),
                entries.astype(np.int32 if wide else np.uint16),
            ]
            yield pa.RecordBatch.from_pylist([dict(zip(BLOCK_NAMES, [*(a.tobytes() for a in arrays), wide, tf.astype(kind).tobytes(), kind.itemsize], strict=True))], BLOCK_SCHEMA)

    return textkit.map_blocks(rows.select(words, label_id), kernel, BLOCKS)


BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
BLOCK_SCHEMA = pa.schema([(n, {"binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32()}[x.split()[1]]) for n, x in zip(BLOCK_NAMES, BLOCKS.split(", "), strict=True)])


def basis(k: int) -> np.ndarray:
    """An orthonormal basis of the vectors of k numbers whose sum is 0: the best weights of each term are among them."""
    out = np.zeros((k, k - 1))
    for i in range(1, k):
        out[:i, i - 1], out[i, i - 1] = 1 / math.sqrt(i * (i + 1)), -i / math.sqrt(i * (i + 1))
    return out


def _passed(found: DataFrame, weights: np.ndarray, bias: np.ndarray, of_class: np.ndarray, squares: bool) -> np.ndarray:
    """Over all blocks: the gradient by weights (q x terms, of columns without their idf) and bias, the loss, and squares of the columns if wanted."""
    q, size = weights.shape
    spark = found.sparkSession
    shared = spark.sparkContext.broadcast((weights, bias, of_class))

    def gradients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, by_class = shared.value
        turn = basis(q + 1)
        total = np.zeros(q * size + q + 1 + squares * size)
        by_term, ends, column_squares = total[: q * size].reshape(q, size), total[q * size : q * size + q + 1], total[q * size + q + 1 :]
        for batch in batches:
            for x in batch.to_pylist():
                label, lengths, scale, columns = (np.frombuffer(x[c], kind) for c, kind in (("labels", np.int32), ("lengths", np.int64), ("scale", np.float64), ("columns", np.int32)))
                entries, tf = np.frombuffer(x["entries"], np.int32 if x["wide"] else np.uint16), np.frombuffer(x["counts"], f"u{x['count_bytes']}")
                entries = entries.astype(np.intp)
                most = int(tf.max(initial=1))
                grown = (1 + np.log(np.arange(1, most + 1)))[tf - 1] if most < 1 << 20 else 1 + np.log(tf)
                some = lengths > 0
                starts, own = (np.cumsum(lengths) - lengths)[some], w[:, columns]
                score = np.zeros((len(label), q))
                if len(entries):
                    for k in range(q):
                        score[some, k] = np.add.reduceat(own[k][entries] * grown, starts)
                score = (score * scale[:, None] + b) @ turn.T
                score -= score.max(1, keepdims=True)
                share = np.exp(score)
                whole = share.sum(1)
                weight, at = by_class[label], np.arange(len(label))
                ends[q] += float(weight @ (np.log(whole) - score[at, label]))
                share /= whole[:, None]
                share[at, label] -= 1
                slope = (share * weight[:, None]) @ turn
                ends[:q] += slope.sum(0)
                slope *= scale[:, None]
                for k in range(q):
                    by_term[k, columns] += np.bincount(entries, weights=grown * np.repeat(slope[:, k], lengths), minlength=len(columns))
                if squares:
                    column_squares[columns] += np.bincount(entries, weights=(grown * np.repeat(scale * np.sqrt(weight), lengths)) ** 2, minlength=len(columns))
        for i in range(0, len(total), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([total[i : i + CHUNK].tobytes()], pa.binary())], ["chunk", "data"])

    def added(rows: pa.Table) -> pa.Table:
        data = np.zeros(0)
        for x in rows["data"]:
            part = np.frombuffer(x.as_buffer())
            data = data + part if len(data) else part
        return pa.table({"chunk": rows["chunk"][:1], "data": pa.array([data.tobytes()], pa.binary())})

    schema = "chunk int, data binary"
    rows = textkit.map_blocks(found, gradients, schema).groupBy("chunk").applyInArrow(added, schema).collect()
    shared.destroy()
    return np.concatenate([np.frombuffer(r.data) for r in sorted(rows, key=lambda r: r.chunk)])


def _dot(x: np.ndarray, y: np.ndarray) -> float:
    """Without the threads of a library, which spin longer than they add."""
    return float(np.einsum("i,i", x, y))


def minimum(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, began: tuple[float, np.ndarray], curvature: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, int]:
    """Where a convex function is least, and the steps taken: L-BFGS, with a diagonal estimate of the Hessian for its start.

    It ends where the square of the gradient's length, measured by that estimate, is at most ``tol`` squared times the value, or after ``max_iter`` steps.
    """
    (f, g), steps, past = began, 0, []
    while steps < max_iter and _dot(g, g / curvature) > tol * tol * abs(f):
        d, alphas = -g, []
        for s, y, sy in reversed(past):
            alphas.append(_dot(s, d) / sy)
            d -= alphas[-1] * y
        d /= curvature
        if past:
            s, y, sy = past[-1]
            d *= sy / _dot(y, y / curvature)
        for (s, y, sy), a in zip(past, reversed(alphas), strict=True):
            d += (a - _dot(y, d) / sy) * s
        slope, t = _dot(g, d), 1.0
        for _ in range(20):
            f_new, g_new = value(x + t * d)
            if f_new <= f + 1e-4 * t * slope:
                break
            t *= min(0.5, max(0.1, -slope * t / (2 * (f_new - f - slope * t))))
        else:
            break  # no step lowers the value: its digits are used up
        s, y = t * d, g_new - g
        if (sy := _dot(s, y)) > 1e-300:
            past = [*past[1 - MEMORY :], (s, y, sy)]
        x, f, g, steps = x + s, f_new, g_new, steps + 1
    return x, steps


def learned(found: DataFrame, counts: np.ndarray, idf: np.ndarray, c: float, balanced: bool, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Weights (classes x terms), intercepts and steps of the regression on blocks of rows: the mean loss and 1 / (2 c n) of the squared weights, not of the intercepts."""
    k, size, n = len(counts), len(idf), float(counts.sum())
    if k < 2:
        return np.zeros((k, size)), np.zeros(k), 0
    q, turn, reg = k - 1, basis(k), 1 / (c * max(n, 1))
    of_class = n / (k * counts) if balanced else np.ones(k)
    share = counts * of_class / n
    spread = (1 - float(share @ share)) / q  # the classes' variance where only the intercepts are known
    start = np.concatenate([np.zeros(q * size), np.log(share) @ turn])

    def value(x: np.ndarray, squares: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
        w, b = x[: q * size].reshape(q, size), x[q * size :]
        total = _passed(found, w * idf, b, of_class, squares)
        by_term, ends = total[: q * size].reshape(q, size) * idf / n, total[q * size : q * size + q + 1] / n
        return float(ends[q] + reg / 2 * np.vdot(w, w)), np.concatenate([(by_term + reg * w).ravel(), ends[:q]]), total[q * size + q + 1 :] * idf**2 / n if squares else idf

    f, g, second = value(start, True)
    curvature = np.concatenate([np.tile(spread * second + reg, q), np.full(q, spread)])
    x, steps = minimum(lambda x: value(x)[:2], start, (f, g), curvature, max_iter, tol)
    return turn @ x[: q * size].reshape(q, size), turn @ x[q * size :], steps


def probabilities(lookup: Lookup, idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, words: pa.Array) -> np.ndarray:
    """Rows by classes, from rows of words; weights are terms x classes."""
    out = np.zeros((len(words), len(bias)))
    batch = pa.RecordBatch.from_arrays([words], ["words"])
    at = 0
    for part, lengths, flat in _lists(iter([batch]), BLOCK):
        row, term, tf = lookup.tally(lengths, flat)
        value = (1 + np.log(tf)) * idf[term] * _scale(row, term, tf, idf, len(lengths))[row]
        for k in range(len(bias)):
            out[at : at + part.num_rows, k] = np.bincount(row, weights=value * weights[term, k], minlength=part.num_rows) + bias[k]
        at += part.num_rows
    out -= out.max(1, keepdims=True)
    np.exp(out, out=out)
    return out / out.sum(1, keepdims=True)
