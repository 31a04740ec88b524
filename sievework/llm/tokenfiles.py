"""Token ids as ORC files: integer run lengths, row indexes, and Bloom filters on document ids.

Documents are dealt by ranges of doc_id and encoded in order, so files and their row groups hold
narrow id ranges: a look-up by doc_id prunes files, stripes and row groups by statistics and Bloom
filters, and a full read splits at stripes. A row says its part and its place within the part; the
place within the whole corpus is that plus the sum of the parts before, one number a part.

Defined cases: a null or empty text is its end id alone; a null doc_id sorts first; rows of one doc_id
are ordered by their place in the scan, so a doc_id that many rows share is split over parts; an empty table gives no rows; other columns are not read. A text is encoded
whole, however long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm import textkit as K
from sievework.llm import tokens

FILE_SCHEMA = "doc_id long, part int, place long, n_tokens long, ids array<int>"
OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}


def _encode_kernel(path: str, end: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for rows, ids, bounds in tokens.encoded_blocks(batches, path, end):
            n = len(bounds) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(place + bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32))),
                ],
                ["doc_id", "part", "place", "n_tokens", "ids"],
            )
            place += int(bounds[-1])

    return kernel


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Encode documents, append ``end`` to each, and write them in order of doc_id as ORC under ``path``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("nth"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("nth"))  # bounds are sampled without reading a text
    dealt = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    K.map_blocks(dealt.select("doc_id", "text"), _encode_kernel(tokenizer, end), FILE_SCHEMA).write.mode("errorifexists").options(**OPTIONS).orc(path)


def _before(files: DataFrame) -> DataFrame:
    """part and how many ids all earlier parts hold: a row for each writing task, so never large."""
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before")))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids."""
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    return files.join(_before(files), "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids")


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches the files' statistics and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids))


def _crc_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        off = lists.offsets.to_numpy()
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8))
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of what ``read_tokens`` returns."""
    return K.map_blocks(read.select("doc_id", "start", "n_tokens", "ids"), _crc_kernel, "doc_id long, start long, n_tokens long, ids_crc32 long")
