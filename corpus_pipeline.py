"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the
columns of documents, but for the last, which returns packed pieces. ``run`` writes each stage's rows
to the shared folder before the next one reads them.

Defined cases, beside those of the operators: documents with a null or blank text have too few words and
go first; a null in any other column stays; of repeated rows one stays; rows of one doc_id with different
texts are judged apart; a null doc_id stays unless its text is like another document's; extra columns, of
whatever names, are kept up to the last stage; very long texts are worked on whole; empty tables give no
pieces; of documents in one component that of the smallest doc_id stays, so ties play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import decontaminate, jaccard, packing, quality, secrets, store

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return quality.quality_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of similar ones."""
    return jaccard.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.clean_stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secrets.redact_stage(docs)


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids with their sequence and offset."""
    import public_tokenizers

    return packing.pack(packing.cut_pieces(docs, public_tokenizers.path(TOKENIZER), END_ID))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("secret_spans", secret_spans),
    ("packed_pieces", packed_pieces),
]
#: Bin completion has no SQL form; tests hold ``run`` against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
