"""WordPiece tokens by longest match over a vocabulary table.

A text is normalised, cut into words and punctuation marks by Spark's functions, and each distinct word of a batch is matched once:
from each place on the longest piece of the vocabulary is taken, pieces inside a word being written ``##piece``. A word that can't be
matched whole, or of over ``LONGEST`` characters, is one unknown token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import textkit as K

#: Characters of a word that is matched at most; fixed value.
LONGEST = 100
CLS, SEP, UNKNOWN = "[CLS]", "[SEP]", "[UNK]"
#: Words that a worker remembers.
KNOWN = 1 << 17
#: Pieces of a vocabulary at most, so that it can be sent to all tasks.
VOCABULARY = 500_000


def words(text: Column) -> Column:
    """Lower-cased words, and each punctuation mark as one of its own."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{P}\p{S}]|[^\s\p{P}\p{S}]+"), F.lit(0))


class Pieces:
    """The vocabulary as a trie of characters: one for word beginnings, one for the rest."""

    def __init__(self, vocabulary: dict[str, int]):
        self.unknown = vocabulary[UNKNOWN]
        self.tries: tuple[dict, dict] = ({}, {})
        for piece, i in vocabulary.items():
            inner = piece.startswith("##") and len(piece) > 2
            node = self.tries[inner]
            for c in piece[2:] if inner else piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.known: dict[str, list[int]] = {}

    def of(self, word: str) -> list[int]:
        out, at = [], 0
        while at < len(word) <= LONGEST:
            node, end, piece, i = self.tries[at > 0], at, None, at
            while i < len(word) and (node := node.get(word[i])) is not None:
                i += 1
                if "" in node:
                    end, piece = i, node[""]
            if piece is None:
                return [self.unknown]
            out.append(piece)
            at = end
        return out or [self.unknown]

    def batch(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, the n + 1 bounds of each row's); each distinct word is matched once."""
        coded = column.flatten().dictionary_encode()
        if len(self.known) > KNOWN:
            self.known.clear()
        keep = lambda w: self.known.setdefault(w, self.of(w)) if len(w) <= LONGEST else [self.unknown]
        found = [self.known.get(w) or keep(w) for w in coded.dictionary.to_pylist()]
        count = np.array([len(x) for x in found], np.int64)
        first = np.cumsum(count) - count
        flat = np.array([i for x in found for i in x], np.int32)
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = count[which] if len(which) else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(first[which] - ends[:-1], size) + np.arange(ends[-1])] if len(which) else np.zeros(0, np.int32)
        off = column.offsets.to_numpy() - column.offsets[0].as_py()
        return ids, ends[off]


def encode(rows: DataFrame, key: str, text: str, vocabulary: DataFrame, limit: int = 384) -> DataFrame:
    """key and input_ids of each row: [CLS], pieces, [SEP], at most ``limit`` of them.

    vocabulary: piece, id; it must hold the special tokens. Null and empty texts are the two special tokens alone.
    """
    table = {r.piece: r.id for r in vocabulary.select("piece", "id").limit(VOCABULARY + 1).collect()}
    if len(table) > VOCABULARY or not {CLS, SEP, UNKNOWN} <= set(table):
        raise ValueError("vocabulary_invalid")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(table)
        for batch in batches:
            ids, bounds = pieces.batch(batch.column("words"))
            n = np.minimum(np.diff(bounds), limit - 2)
            size = n + 2
            ends = np.concatenate(([0], np.cumsum(size)))
            out = np.empty(ends[-1], np.int32)
            out[ends[:-1]], out[ends[1:] - 1] = table[CLS], table[SEP]
            steps = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(ends[:-1] + 1, n) + steps] = ids[np.repeat(bounds[:-1], n) + steps]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))], [key, "input_ids"])

    kind = rows.schema[key].dataType.simpleString()
    K.bound_batches(rows.sparkSession)
    return rows.select(key, words(F.col(text)).alias("words")).mapInArrow(kernel, f"{key} {kind}, input_ids array<int>")
