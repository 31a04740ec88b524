"""Text features and models by pyspark.ml."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Mapping
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.ml import Pipeline, PipelineModel, Transformer, feature
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import store, textkit
from sievework.operators import metrics, regression

#: Characters of a word.
WORD = r"[\p{L}\p{M}\p{N}_]{2,}"
#: Terms that are broadcast at most.
HEAVY = 1 << 18
#: Characters of text in a partition that a model learns from, about.
PART_CHARS = 256 << 20
#: Characters of text whose terms a task adds up, about.
COUNT_CHARS = 16 << 20
#: Candidates by id: inverse regularisation, and whether classes are balanced; fixed values.
CANDIDATES = {"c0.5-none": (0.5, False), "c1.0-none": (1.0, False), "c0.5-balanced": (0.5, True), "c1.0-balanced": (1.0, True)}


def first_per_class(rows: DataFrame, label: str, order: list[str], n: int = 100) -> DataFrame:
    """The first rows of each class; the rank filter runs before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("rank") <= n)


def deterministic_sample(rows: DataFrame, fingerprint: str, n: int = 512) -> DataFrame:
    """The n rows of the smallest fingerprints."""
    return rows.orderBy(fingerprint).limit(n)


def vectorizer(text: str = "text", *, min_df: int = 5, max_df: float = 0.995, size: int = 200_000) -> list:
    """Stages from text to TF-IDF vectors of word uni- and bigrams, with 1 + ln(tf), 1 + idf and unit length."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=True),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=size, minDF=float(min_df), maxDF=max_df),
        Sublinear(),
        SmoothIDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="features", p=2.0),
    ]


def tallied(terms: Column) -> Column:
    """Each distinct term of an array with its number: the runs of the sorted terms."""
    # What lambdas read is bound by an outer lambda: they would else evaluate it anew for each element.
    bound = lambda x: F.array(x)
    begun = lambda t: F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1) != x), i)), lambda i: i.isNotNull())
    both = F.transform(bound(F.sort_array(terms)), lambda t: F.struct(t.alias("t"), begun(t).alias("at")))
    run = lambda s: F.transform(s["at"], lambda i, k: F.struct(F.get(s["t"], i).alias("term"), (F.coalesce(F.get(s["at"], k + 1), F.size(s["t"])) - i).alias("tf")))
    return F.get(F.transform(both, run), F.lit(0))


def _bounds(low: float, high: float, n: int) -> tuple[int, int]:
    """Numbers of documents from counts, or from shares below 1."""
    at = lambda x, whole: Decimal(str(x)) * (1 if whole else n)
    return math.ceil(at(low, low >= 1)), min(n, math.floor(at(high, high > 1)))


class CountVectorizer(feature.CountVectorizer):
    """The vocabulary by a count of terms that combines before its shuffle, without a stored copy of every text's terms.

    The ``vocabSize`` most frequent terms stay; of equal ones the first in order. The model knows ``df``, the rows that hold each term."""

    #: Where a column of words is named, terms are those and their pairs of neighbours, without a column of them.
    words: str | None = None
    #: Parts that terms are dealt to; as many as the cluster has cores if 0.
    parts = 0

    def _fit(self, dataset: DataFrame) -> CountVectorizerModel:
        low, high = _bounds(self.getMinDF(), self.getMaxDF(), dataset.count())
        parts = self.parts or dataset.sparkSession.sparkContext.defaultParallelism
        counts = store.written(regression.term_counts(dataset, self.words or self.getInputCol(), self.words is not None, low, high, parts), "vocabulary")
        least, left = 0, self.getVocabSize()
        # Numbers of terms by count, from the most frequent down, until the size is reached: a row for each count there is.
        for n, found in zip(*counts.groupBy("n").agg(F.count("*").alias("terms")).toArrow().sort_by([("n", "descending")]).to_pydict().values(), strict=True):
            if found > left:
                least = n
                break
            left -= found
        chosen = counts.where(F.col("n") > least).toArrow()  # vocabSize at most
        if least and left:
            chosen = pa.concat_tables([chosen, counts.where(F.col("n") == least).orderBy("term").limit(left).toArrow()])
        store.discard(counts)
        chosen = chosen.sort_by([("n", "descending"), ("term", "ascending")])
        model = self._of(chosen["term"].to_pylist())
        model.df = chosen["df"].to_numpy()
        return model


    def _of(self, words: list[str]) -> CountVectorizerModel:
        """The model of a vocabulary, which goes to the JVM as one string: a call for each term takes longer than counting them."""
        own = {"minTF": self.getMinTF(), "binary": self.getBinary()}
        if not words or any("\0" in w for w in words):
            return CountVectorizerModel.from_vocabulary(words, self.getInputCol(), self.getOutputCol(), **own)
        parts = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile("\0", 16).split("\0".join(words), -1)
        model = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", parts)
        return model._set(inputCol=self.getInputCol(), outputCol=self.getOutputCol(), vocabSize=len(words), **own)


def terms(text: Column) -> Column:
    """Lower-cased words and pairs of neighbours, in order; none of a null text."""
    words = F.array(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))
    return F.get(F.transform(words, lambda w: F.concat(w, F.transform(F.slice(w, F.lit(2), F.size(w)), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x)))), F.lit(0))


def tfidf_sums(rows: DataFrame, key: str, text: str, min_df: float = 5, max_df: float = 0.995) -> DataFrame:
    """key, and the number of terms, sum and largest weight of each row's TF-IDF vector of unit length, over every term of the corpus.

    The ``HEAVY`` most frequent terms at most, by powers of two, are broadcast to the rows; the rest, fewer occurrences, meet by a shuffled join.
    """
    own = store.written(rows.select(key, tallied(terms(F.col(text))).alias("tally")).withColumn("_row", F.monotonically_increasing_id()), "tfidf-rows")
    n = own.count()
    low, high = _bounds(min_df, max_df, n)
    each = own.select("_row", F.inline("tally"))
    known = store.written(each.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(low, high)), "tfidf-terms")
    by_power = {r.power: r.n for r in known.groupBy(F.floor(F.log2("df")).alias("power")).agg(F.count("*").alias("n")).collect()}
    power, total = 63, 0
    while power > 0 and total + by_power.get(power - 1, 0) <= HEAVY:
        power -= 1
        total += by_power.get(power, 0)
    least = (1 << power) if power < 63 else (1 << 62)
    heavy = F.broadcast(known.where(F.col("df") >= least))
    value = (1 + F.log("tf")) * (1 + F.log((1.0 + F.lit(n)) / (1 + F.col("df"))))
    sums = [F.count("*").alias("terms"), F.sum("v").alias("total"), F.sum(F.col("v") * F.col("v")).alias("squares"), F.max("v").alias("largest")]
    weighed = lambda found: found.select("_row", value.alias("v")).groupBy("_row").agg(*sums)
    often = weighed(each.join(heavy, "term"))
    seldom = weighed(each.join(heavy.select("term"), "term", "left_anti").join(known.where(F.col("df") < least), "term"))
    both = often.unionByName(seldom).groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("terms", "total", "squares")], F.max("largest").alias("largest"))
    unit = lambda c: F.coalesce(F.col(c) / F.sqrt("squares"), F.lit(0.0)).alias(c)
    return own.select("_row", key).join(both, "_row", "left").select(key, F.coalesce("terms", F.lit(0)).cast("int").alias("terms"), unit("total"), unit("largest"))


def smooth_idf(df: np.ndarray, n: int) -> np.ndarray:
    """1 + ln((n + 1) / (df + 1)) of each term."""
    return np.log((n + 1) / (df + 1)) + 1.0


class Sublinear(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """1 + ln(count) of each entry of ``_counts``. Vectors have no SQL functions, so this is a Python function."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.linalg import SparseVector, VectorUDT

        @F.udf(VectorUDT())
        def grown(v: SparseVector) -> SparseVector:
            return SparseVector(v.size, v.indices, 1.0 + np.log(v.values))

        return dataset.withColumn("_tf", grown("_counts"))


class SmoothIDF(IDF):
    """Inverse document frequency with 1 added, so that a term of all documents keeps its count; the fitted
    stage is a plain scaling of vectors."""

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        model = super()._fit(dataset)
        return ElementwiseProduct(scalingVec=DenseVector(model.idf.toArray() + 1.0), inputCol=self.getInputCol(), outputCol=self.getOutputCol())


def _regression(rows: DataFrame, counts: list[int], idf: np.ndarray, c: float, balanced: bool, max_iter: int, tol: float) -> tuple[LogisticRegressionModel, bool]:
    """The model of one candidate on blocks of rows, and whether it converged."""
    weights, bias, steps = regression.learned(rows, np.array(counts, float), idf, c, balanced, max_iter, tol)
    context = rows.sparkSession.sparkContext
    parts = [_py2java(context, x) for x in (DenseMatrix(*weights.shape, weights.ravel(), True), DenseVector(bias))]
    made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"logreg_{uuid.uuid4().hex[:12]}", *parts, len(counts), True)
    return LogisticRegressionModel(made), steps < max_iter


def fit_all(train: DataFrame, text: str, label: str, candidates: Mapping[str, tuple[float, bool]], *, max_iter: int = 200, tol: float = 1e-3, min_df: int = 5) -> dict[str, tuple[PipelineModel, bool]]:
    """A multinomial logistic regression on TF-IDF features for each candidate, and whether it converged.

    Texts are cut into words twice, for the vocabulary and for their vectors; all candidates learn from the same stored blocks of
    vectors, in partitions of about ``PART_CHARS`` of text, so what a task reads doesn't grow with the table.
    """
    cores = train.sparkSession.sparkContext.defaultParallelism
    sizes = [r.chars or 0 for r in train.groupBy(F.spark_partition_id()).agg(F.sum(F.length(text)).alias("chars")).collect()]
    train = train.select(text, label)
    if max(sizes, default=0) * cores > 2 * sum(sizes):  # a few tasks would read most of the texts
        train = train.repartition(max(cores, sum(sizes) // PART_CHARS + 1))
    index = StringIndexer(inputCol=label, outputCol="label_id", stringOrderType="alphabetAsc").fit(train)
    tokenizer, pairs, both, counter, grown, scaled, unit = vectorizer(text, min_df=min_df)
    counter.words, counter.parts = "_words", cores + sum(sizes) // COUNT_CHARS
    rows = index.transform(tokenizer.transform(train)).select("_words", F.col("label_id").cast("int").alias("label_id"))
    of_label = {r.label_id: r.n for r in rows.groupBy("label_id").agg(F.count("*").alias("n")).collect()}
    counts = [of_label[i] for i in range(len(index.labels))]
    vocabulary = counter.fit(both.transform(pairs.transform(rows)))
    idf = smooth_idf(vocabulary.df, sum(counts))
    scaled = ElementwiseProduct(scalingVec=DenseVector(idf), inputCol=scaled.getInputCol(), outputCol=scaled.getOutputCol())
    stored = regression.blocks(rows, "_words", "label_id", vocabulary.vocabulary, idf)
    stored = stored.repartition(max(cores, sum(sizes) // PART_CHARS + 1)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = {}
        for name, (c, balanced) in candidates.items():
            model, converged = _regression(stored, counts, idf, c, balanced, max_iter, tol)
            model.set(model.featuresCol, "features")
            found[name] = PipelineModel([tokenizer, pairs, both, vocabulary, grown, scaled, unit, index, model]), converged
    finally:
        stored.unpersist()
    return found


def fit(train: DataFrame, text: str, label: str, *, c: float = 1.0, balanced: bool = False, max_iter: int = 200, tol: float = 1e-3, min_df: int = 5) -> tuple[PipelineModel, bool]:
    """The same of one candidate."""
    return fit_all(train, text, label, {"one": (c, balanced)}, max_iter=max_iter, tol=tol, min_df=min_df)["one"]


def search(train: DataFrame, validation: DataFrame, text: str, label: str, labels: list[str], *, candidates: Mapping[str, tuple[float, bool]] = CANDIDATES, max_iter: int = 200, min_df: int = 5) -> tuple[PipelineModel, DataFrame]:
    """Fit every candidate on the training rows; the best by validation metrics, and a row for each.

    A smoke run is the same over few rows, with one candidate and a small ``max_iter`` and ``min_df``.
    """
    models, rows = fit_all(train, text, label, candidates, max_iter=max_iter, min_df=min_df), None
    for name, (c, balanced) in candidates.items():
        model, converged = models[name]
        classes = metrics.per_class(metrics.confusion(predictions(model, validation), label, "predicted", labels))
        row = metrics.summary(classes).select(F.lit(name).alias("candidate_id"), F.lit(float(c)).alias("c"), F.lit(balanced).alias("balanced"), F.lit(converged).alias("converged"), "*")
        rows = row if rows is None else rows.unionByName(row)
    best = metrics.select_candidate(rows).first()
    if best is None:
        raise ValueError("no_candidate_converged")
    return models[best["candidate_id"]][0], rows


def label_ids(label: Column, labels: list[str]) -> Column:
    """The index, from 0, of a label in a list; null outside it."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in labels]), label) - 1, F.lit(-1)).cast("int")


def predictions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with probabilities (array) and predicted label; the stages' parameters are applied to blocks of words."""
    tokenizer, _, _, vocabulary, _, scaled, _, index, classifier = model.stages
    weights, bias = classifier.coefficientMatrix.toArray().T.copy(), classifier.interceptVector.toArray()
    shared = rows.sparkSession.sparkContext.broadcast((regression.Lookup(vocabulary.vocabulary), scaled.getScalingVec().toArray(), weights, bias))
    textkit.bound_batches(rows.sparkSession)

    @F.arrow_udf("array<double>")
    def shares(words: pa.Array) -> pa.Array:
        found = regression.probabilities(*shared.value, words)
        return pa.ListArray.from_arrays(pa.array(range(0, found.size + 1, found.shape[1]), pa.int32()), pa.array(found.ravel()))

    out = tokenizer.transform(rows).withColumn("probabilities", shares("_words")).drop("_words")
    largest = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    return out.withColumn("predicted", F.element_at(F.array(*[F.lit(n) for n in index.labels]), largest))


def tokenized(rows: DataFrame, text: str, tokenizer: Callable[[list[str]], list[list[int]]], limit: int = 384) -> DataFrame:
    """Rows with input_ids of a pluggable tokenizer, cut to ``limit``; Arrow batches of 256 texts."""
    schema = T.StructType([*rows.schema.fields, T.StructField("input_ids", T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                yield part.assign(input_ids=[ids[:limit] for ids in tokenizer(part[text].fillna("").tolist())])

    return rows.mapInPandas(encode, schema)


def library_tokenizer(path: str) -> Callable[[list[str]], list[list[int]]]:
    """A tokenizer of the ``tokenizers`` library from its vocabulary file, loaded once by each worker."""
    loaded: dict[str, object] = {}

    def encode(texts: list[str]) -> list[list[int]]:
        if "t" not in loaded:
            from tokenizers import Tokenizer

            loaded["t"] = Tokenizer.from_file(path)
        return [e.ids for e in loaded["t"].encode_batch(texts)]  # type: ignore[attr-defined]

    return encode


def whitespace_length(text: str) -> Column:
    """Words and two special tokens."""
    return F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")) + 2
