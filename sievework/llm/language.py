"""Language identification by hyperdimensional profiles.

A letter has a random bipolar vector, drawn from its code point as the seed. A trigram is its letters'
vectors, permuted by their places and bound by products; a text is the bundle (sum) of its trigrams; a
language is the bundle of its texts, and a text takes the language of the largest cosine. Trigrams run
over lower-cased letters with one space between words and at both ends.

Bundling is linear, so tasks send one vector for each language to training, and prediction adds up
the products of trigrams with the prototypes, remembered by each worker; no text's own vector is
built. Its length, which the cosine needs but the choice of language doesn't, is that of a sum of
independent random vectors: sqrt(D * sum of squared counts).

Defined cases: a null text or one without letters is ``und`` with score 0; training skips it; without
any training text all are ``und``; ties go to the first language by name; repeated rows get equal
predictions; a row with a null doc_id is not held out and not learned from; a very long text is read
whole, as a block of its own; an empty table gives no rows; extra columns are not read.
Prototypes (languages x D numbers) are all that reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import textkit as K
from sievework.llm import tokens

DIMENSIONS = 2048
SEED = 7919
SPACE = 0x20
#: Trigrams that a worker remembers the products of, before it starts anew.
CACHE_GRAMS = 300_000
UNKNOWN = "und"

_lower: dict[str, np.ndarray] = {}
_letters: dict[int, np.ndarray] = {}


def _lowered(points: np.ndarray) -> np.ndarray:
    table = _lower.setdefault("table", np.zeros(0x110000, np.uint32))
    found = table[points]
    if (found == 0).any():
        for p in np.unique(points[found == 0]).tolist():
            table[p] = ord(chr(p).lower()[0]) or p
        found = table[points]
    return found


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, trigram) of each trigram; three code points of 21 bits each."""
    n = len(off) - 1
    points, at = tokens.code_points(buf)
    doc = K.owner(off, at) if len(at) else np.zeros(0, np.int64)
    letter = tokens._kind_of(points) == tokens._LETTER if len(points) else np.zeros(0, bool)
    symbol = np.where(letter, _lowered(points), SPACE).astype(np.uint64) if len(points) else np.zeros(0, np.uint64)
    bound = np.searchsorted(doc, np.arange(n + 1))
    place = np.concatenate((bound[:-1], bound[1:]))
    ends = np.concatenate((np.arange(n), np.arange(n)))
    order = np.lexsort((np.repeat([0, 1], n), ends, place)) if n else place
    symbol = np.insert(symbol, place[order], np.uint64(SPACE))
    doc = np.insert(doc, place[order], ends[order])
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != SPACE) | (symbol[:-1] != SPACE) | (doc[1:] != doc[:-1])
    symbol, doc = symbol[keep], doc[keep]
    if len(symbol) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = doc[2:] == doc[:-2]
    key = symbol[:-2] << np.uint64(42) | symbol[1:-1] << np.uint64(21) | symbol[2:]
    return doc[2:][inside], key[inside]


def _letter(point: int, dimensions: int) -> np.ndarray:
    if point not in _letters or len(_letters[point]) != dimensions:
        _letters[point] = np.random.default_rng([SEED, point]).integers(0, 2, dimensions, dtype=np.int8) * 2 - 1
    return _letters[point]


def gram_vectors(keys: np.ndarray, dimensions: int) -> np.ndarray:
    """The bound vectors of trigrams, one row each."""
    spots = [(keys >> np.uint64(shift)) & np.uint64(0x1FFFFF) for shift in (42, 21, 0)]
    out = np.ones((len(keys), dimensions), np.int8)
    for turn, spot in zip((2, 1, 0), spots, strict=True):
        unique, which = np.unique(spot, return_inverse=True)
        out *= np.stack([np.roll(_letter(int(p), dimensions), turn) for p in unique])[which]
    return out


def bundle(keys: np.ndarray, counts: np.ndarray, dimensions: int) -> np.ndarray:
    """The sum of trigram vectors times their counts."""
    total = np.zeros(dimensions, np.float64)
    for a in range(0, len(keys), 4096):
        total += counts[a : a + 4096].astype(np.float32) @ gram_vectors(keys[a : a + 4096], dimensions).astype(np.float32)
    return total


def _train_kernel(dimensions: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def settle(lang: str) -> None:
            keys = np.concatenate([k for k, _ in held[lang]])
            counts = np.concatenate([c for _, c in held[lang]])
            unique, which = np.unique(keys, return_inverse=True)
            sums[lang] = sums.get(lang, 0) + bundle(unique, np.bincount(which, counts), dimensions)
            held[lang] = []

        for rows, buf, off in K.blocks(batches):
            doc, key = grams(buf, off)
            langs = rows.column("lang").to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs])
            for i, lang in enumerate(names):
                own = key[of[doc] == i]
                if len(own):
                    held.setdefault(lang, []).append(np.unique(own, return_counts=True))
                    if sum(len(k) for k, _ in held[lang]) > 200_000:
                        settle(lang)
        for lang in held:
            if held[lang]:
                settle(lang)
        if sums:
            yield K.table(lang=list(sums), vector=pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64())))

    return kernel


@dataclass
class Profiles:
    """Languages, and their prototypes as unit vectors."""

    langs: list[str]
    prototypes: np.ndarray


def train(labelled: DataFrame, dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes of the languages of (text, lang)."""
    vectors = K.map_blocks(labelled.select("text", F.col("lang").cast("string").alias("lang")), _train_kernel(dimensions), "lang string, vector array<double>")
    summed = vectors.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", F.col("v.x").alias("x")).orderBy("lang").collect()
    matrix = np.array([r["x"] for r in rows], np.float64).reshape(len(rows), dimensions)
    return Profiles([r["lang"] for r in rows], matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12))


class Scorer:
    """Cosines of texts with prototypes, with the products of known trigrams remembered."""

    def __init__(self, profiles: Profiles):
        self.profiles = profiles
        self.matrix = np.ascontiguousarray(profiles.prototypes.T.astype(np.float32))
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.products = np.zeros((0, len(self.profiles.langs)), np.float32)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Products of sorted distinct trigrams with the prototypes."""
        if len(self.keys) > CACHE_GRAMS:
            self.forget()
        new = keys[~np.isin(keys, self.keys, assume_unique=True)]
        if len(new):
            found = np.concatenate([gram_vectors(new[a : a + 4096], self.matrix.shape[0]).astype(np.float32) @ self.matrix for a in range(0, len(new), 4096)])
            place = np.searchsorted(self.keys, new)
            self.keys, self.products = np.insert(self.keys, place, new), np.insert(self.products, place, found, axis=0)
        return self.products[np.searchsorted(self.keys, keys)]

    def cosines(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        doc, key = grams(buf, off)
        unique, which = np.unique(key, return_inverse=True)
        pair, count = np.unique(doc * max(len(unique), 1) + which, return_counts=True)
        doc, which = pair // max(len(unique), 1), pair % max(len(unique), 1)
        products = self.of(unique)
        length = np.sqrt(self.matrix.shape[0] * np.bincount(doc, count.astype(np.float64) ** 2, n))
        sums = np.stack([np.bincount(doc, count * products[which, i], n) for i in range(products.shape[1])], 1)
        return sums / np.maximum(length, 1e-9)[:, None]


def _has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    points, at = tokens.code_points(buf)
    if not len(points):
        return np.zeros(len(off) - 1, bool)
    return K.per_doc(K.owner(off, at[tokens._kind_of(points) == tokens._LETTER]), len(off) - 1) > 0


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred and score of every document."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(profiles)
        for rows, buf, off in K.blocks(batches):
            known = _has_letter(buf, off) & bool(profiles.langs)
            if profiles.langs:
                cosines = scorer.cosines(buf, off)
                best = cosines.argmax(axis=1)
                score = np.where(known, cosines[np.arange(len(best)), best].clip(0, 1), 0.0)
            else:
                best, score = np.zeros(len(off) - 1, int), np.zeros(len(off) - 1)
            langs = [profiles.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield K.table(doc_id=rows.column("doc_id"), lang_pred=K.strings(langs), score=score.astype(np.float64))

    return K.map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, lang_pred string, score double")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the document's id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def language_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the documents that aren't held out."""
    learned = docs.where(F.col("doc_id").isNotNull() & ~held_out(4, 2) & F.col("lang").isNotNull())
    return predict(docs, train(learned)).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
