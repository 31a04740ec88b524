"""A language identifier: likelihoods of character trigrams, counted by Spark.

A model holds, for the ``GRAMS`` most frequent trigrams of each language, their log-likelihood in every language. Languages
are few and grams are capped by language, so the model's size has a bound, ``LANGUAGES`` squared times ``GRAMS``
numbers, whatever the corpus. A text's score in a language is the mean over its trigrams that the model knows; the best
language is named where it leads the second by ``margin`` a trigram, and nothing is otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import textkit as K

#: Trigrams of each language, and languages, at most.
GRAMS, LANGUAGES = 2000, 64
#: Trigrams that a text must have of the model's, and the lead of the best language a trigram.
LEAST, MARGIN = 5, 0.05


def plain(text: Column) -> Column:
    """Lower-cased words of letters, one space around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, trigram) of every three neighbouring characters of plain texts, in order; a trigram is one number of 21 bits a character."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    doc = np.searchsorted(off, at, "right") - 1
    whole = np.flatnonzero(doc[2:] == doc[:-2])
    return doc[whole], points[whole] << 42 | points[whole + 1] << 21 | points[whole + 2]


def _gram(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _count_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams of a block's texts by language, counted."""
    for rows, buf, off in K.blocks(batches, "_plain"):
        langs = rows.column("lang").dictionary_encode()
        doc, code = trigrams(buf, off)
        of = langs.indices.to_numpy(zero_copy_only=False)[doc]
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            found, n = np.unique(code[of == i], return_counts=True)
            yield K.table(lang=pa.array([lang] * len(found), pa.string()), gram=pa.array(list(map(_gram, found.tolist())), pa.string()), n=pa.array(n.astype(np.int64)))


def train(rows: DataFrame, text: str, language: str, grams: int = GRAMS) -> DataFrame:
    """gram, lang, loglik of the kept trigrams, each in every language; texts or languages that are null teach nothing."""
    taught = rows.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(F.col(language).alias("lang"), plain(F.col(text)).alias("_plain"))
    counts = K.map_blocks(taught, _count_kernel, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    languages = totals.limit(LANGUAGES + 1).collect()
    if len(languages) > LANGUAGES:
        raise ValueError("too_many_languages")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("rank", rank).where(F.col("rank") <= grams).select("gram").distinct()
    each = [F.struct(F.lit(x.lang).alias("lang"), F.lit(x.total).alias("total"), F.lit(x.kinds).alias("kinds")) for x in languages]
    every = kept.select("gram", F.inline(F.array(*each) if each else F.array().cast("array<struct<lang:string,total:bigint,kinds:bigint>>")))
    known = every.join(counts, ["lang", "gram"], "left")
    return known.select("gram", "lang", F.log((F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + F.col("kinds"))).alias("loglik"))


def _matrix(model: DataFrame) -> tuple[list[str], dict[str, int], np.ndarray]:
    """Languages, the row of each trigram, and log-likelihoods by trigram and language."""
    rows = model.orderBy("gram", "lang").collect()  # bounded, see above
    languages = sorted({r.lang for r in rows})
    place: dict[str, int] = {}
    table = np.zeros((len(rows) // max(len(languages), 1), len(languages)))
    for r in rows:
        table[place.setdefault(r.gram, len(place)), languages.index(r.lang)] = r.loglik
    return languages, place, table


def scored(rows: DataFrame, key: str, text: str, model: DataFrame, least: int = LEAST, margin: float = MARGIN) -> DataFrame:
    """key and language (or null) of every row: a block's trigrams are looked up in the model's matrix, and a text leaves
    as a sum for each language. Repeated keys count as one text."""
    languages, place, table = _matrix(model)
    codes = np.array([ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in place], np.int64)
    order = np.argsort(codes)
    codes, table = codes[order], table[order]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, buf, off in K.blocks(batches, "_plain"):
            doc, code = trigrams(buf, off)
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            doc, at, size = doc[known], at[known], block.num_rows
            n = np.bincount(doc, minlength=size)
            for i, lang in enumerate(languages):
                total = np.bincount(doc, table[at, i], minlength=size)
                yield K.table(**{key: block.column("_key"), "lang": pa.array([lang] * size, pa.string()), "total": total, "n": n.astype(np.int64)}).filter(pa.array(n > 0))

    kind = rows.schema[key].dataType.simpleString()
    given = rows.select(F.col(key).alias("_key"), plain(F.coalesce(text, F.lit(""))).alias("_plain"))
    found = K.map_blocks(given, kernel, f"`{key}` {kind}, lang string, total double, n long")
    means = found.groupBy(key, "lang").agg((F.sum("total") / F.sum("n")).alias("score"), F.sum("n").alias("n"))
    top = means.groupBy(key).agg(F.max(F.struct("score", "lang")).alias("best"), F.max("n").alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    lead = F.col("best.score") - F.coalesce(F.get("scores", F.lit(1)), F.col("best.score") - 2 * margin)
    named = top.select(key, F.when((F.col("n") >= least) & (lead >= margin), F.col("best.lang")).alias("language"))
    return rows.select(key).join(named, key, "left")


def identifier(model: DataFrame, least: int = LEAST, margin: float = MARGIN) -> Callable[[Column], Column]:
    """The same as a function of a column, for ``staging.assess``: an Arrow function that holds the model as a matrix."""
    languages, place, table = _matrix(model)

    def name(text: str | None) -> str | None:
        if not text:
            return None
        kept = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
        s = f" {' '.join(kept.split())} "
        at = [p for p in (place.get(s[i : i + 3]) for i in range(len(s) - 2)) if p is not None]
        if len(at) < least or not languages:
            return None
        means = table[at].mean(0)
        order = np.argsort(-means, kind="stable")
        lead = means[order[0]] - means[order[1]] if len(order) > 1 else 2 * margin
        return languages[order[0]] if lead >= margin else None

    @F.pandas_udf("string")
    def identify(texts: pd.Series) -> pd.Series:
        return texts.map(name)

    return identify
