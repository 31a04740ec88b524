"""WARC archives: a writer of gzip members, and a reader that splits them at any byte.

Each page is one record in one gzip member. Records of equal payloads (by SHA-1) are stored once: that
of the largest page_id is the response, the others are revisits that refer to it.

The reader's tasks get byte ranges. A task scans its range for the gzip magic, tries to decode a
record's headers at each candidate, and owns the records that begin in its range, so no task needs to
know where another's records end; it reads on past its end for the last one. Members that begin
elsewhere by chance fail to decode and are passed over.

Files are written by a task under a name of its own and listed by the row it returns; the list is
written once as a table, so a repeated task's leftover file is never read. Reading and writing go
through Arrow's file systems, which serve local paths, HDFS and object stores alike.

Headers may be of any length. ``warc_query`` compares the records read with the manifest's count, and fails
where they differ.

Defined cases: a null html is an empty payload; empty payloads equal each other; ties and repeated
rows of one page_id give one record each, of which at most one is the response; a null page_id is
written as 0-prefixed ``null`` and can refer to a response but never be one unless all equal ones are
null; a very long payload is one record, written and decoded in chunks but held whole once; an empty table
writes no file; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import store
from sievework.llm import textkit as K

#: Bytes of a file at which a task begins the next one.
FILE_BYTES = 256 << 20
#: Bytes of a reading task's range.
SPLIT_BYTES = 8 << 20
#: Bytes that are read at a time.
READ_BYTES = 1 << 20
#: Bytes that are searched or decoded at a time.
CHUNK_BYTES = 64 << 10
#: Bytes that are decoded at a time in search of the end of a record's headers.
HEADER_BYTES = 16 << 10

_MAGIC = b"\x1f\x8b\x08"
MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (of responses alone), its size and digest, record_type and refers_to of every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    # The maximum combines before the shuffle; pages come to it by a join whose large side can be split.
    counted = rows.groupBy("digest", "page_id").agg(F.count("*").alias("n")).groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("top"))
    largest = store.written(counted.select("digest", F.col("top.page_id").alias("refers_to"), F.col("top.n").alias("ties")), "largest")
    joined = rows.join(largest, "digest").withColumn("size", F.octet_length("payload").cast("long")).withColumn("first", F.expr("page_id <=> refers_to"))
    if not largest.where("ties > 1").isEmpty():
        # Rows repeat the largest page_id of their payload: one of them, of the least url, responds. Equal rows are
        # counted before the shuffle and told apart again after it, so they may be as many as they like.
        alike = joined.where("ties > 1 AND first").groupBy("digest", "page_id", "url", "refers_to").agg(F.first("payload").alias("payload"), F.max("size").alias("size"), F.count("*").alias("n"))
        url = F.struct(F.col("url").isNull().alias("none"), "url")
        top = alike.groupBy("digest").agg(F.min(url).alias("top"))
        nth = F.explode(F.sequence(F.lit(1).cast("long"), "n"))
        told = alike.join(top, "digest").select("page_id", "url", "payload", "digest", "refers_to", "size", (url == F.col("top")).alias("least"), nth.alias("nth"))
        shared = told.select("page_id", "url", F.when(F.col("nth") == 1, F.col("payload")).alias("payload"), "digest", "refers_to", "size", (F.col("least") & (F.col("nth") == 1)).alias("first"))
        joined = joined.where("ties = 1 OR NOT first").select(*shared.columns).unionByName(shared)
    response = F.col("first")
    return joined.select("page_id", "url", F.when(response, F.col("payload")).alias("payload"), "size", "digest", F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("refers_to")).alias("refers_to"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def member(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; ``size`` is that of the payload, which revisits lack."""
    body = payload or b""
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _write_kernel(folder: str):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, files = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "size", "digest", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, size, digest, kind, refers_to = (c[i].as_py() for c in columns)
                if out is None or files[-1][1] >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append([f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0])
                    system, at = _open(folder)
                    system.create_dir(at, recursive=True)
                    system, at = _open(files[-1][0])
                    out = system.open_output_stream(at, compression=None)
                data = member(page_id, url, payload, size, base64.b32encode(bytes.fromhex(digest)).decode(), kind, refers_to)
                out.write(data)
                files[-1][1] += len(data)
                files[-1][2] += 1
        if out is not None:
            out.close()
            yield K.table(path=[f[0] for f in files], bytes=[f[1] for f in files], records=[f[2] for f in files])

    return kernel


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each page; returns the manifest of files, itself a written table."""
    rows = classify(pages)
    return store.written(K.map_blocks(rows, _write_kernel(folder), MANIFEST), "manifest", f"{folder}/manifest")


class _Range:
    """A file's bytes from a place on, read as needed."""

    def __init__(self, file, start: int):
        self.file, self.at, self.data = file, start, b""

    def need(self, start: int, size: int) -> bytes:
        """The bytes [start, start + size), or what the file has of them; earlier ones are let go."""
        if start < self.at or start > self.at + len(self.data):
            self.at, self.data = start, b""
        elif start - self.at > READ_BYTES:
            self.at, self.data = start, self.data[start - self.at :]
        skip = start - self.at
        if len(self.data) < skip + size:
            self.file.seek(self.at + len(self.data))
            self.data += self.file.read(max(READ_BYTES, skip + size - len(self.data)))
        return self.data[skip : skip + size]


def headers_at(source: _Range, start: int) -> tuple[dict[str, str], bytes] | None:
    """The headers of the record whose member begins at ``start``, and what was decoded after them."""
    unpacker = zlib.decompressobj(31)
    decoded, at, data = bytearray(), start, b""
    try:
        # On and on once the text begins as a record: headers may be of any length.
        while not unpacker.eof and b"\r\n\r\n" not in decoded[-HEADER_BYTES - 3 :]:
            if not data:
                data = source.need(at, HEADER_BYTES)
                at += len(data)
                if not data:
                    break
            decoded += unpacker.decompress(data, HEADER_BYTES)
            data = unpacker.unconsumed_tail
            if not decoded.startswith(b"WARC/1."[: len(decoded)]):
                return None
    except zlib.error:
        return None
    if not decoded.startswith(b"WARC/1."):
        return None
    head, gap, rest = bytes(decoded).partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    return (fields, rest) if "WARC-Type" in fields and "Content-Length" in fields else None


def read_member(source: _Range, start: int) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, body, end) of the record whose member begins at ``start``; None where none does."""
    if headers_at(source, start) is None:
        return None
    unpacker, decoded, at = zlib.decompressobj(31), [], start
    try:
        while not unpacker.eof:
            data = source.need(at, CHUNK_BYTES)
            if not data:
                return None
            decoded.append(unpacker.decompress(data))
            at += len(data) - len(unpacker.unused_data)
    except zlib.error:
        return None
    head, _, rest = b"".join(decoded).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    size = int(fields["Content-Length"])
    return (fields, rest[:size], at) if len(rest) >= size else None


def records_in(path: str, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that begin in [start, end) of a file."""
    system, place = _open(path)
    with system.open_input_file(place) as file:
        source, at = _Range(file, start), start
        while at < end:
            if source.need(at, len(_MAGIC)) != _MAGIC:
                window = source.need(at, CHUNK_BYTES)
                if len(window) < len(_MAGIC):
                    return
                hit = window.find(_MAGIC)
                at += hit if hit >= 0 else len(window) - len(_MAGIC) + 1
                continue
            found = read_member(source, at)
            if found is None:
                at += 1
                continue
            yield found[0], found[1]
            at = found[2]


def _page(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def _read_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
    for batch in batches:
        for split in batch.to_pylist():
            held, size = [], 0
            for fields, body in records_in(split["path"], split["start"], split["end"]):
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(body).digest()).decode()
                held.append(
                    {
                        "page_id": _page(fields["WARC-Record-ID"]),
                        "payload_bytes": int(fields["WARC-Payload-Length"]) if revisit else len(body),
                        "payload_digest": digest,
                        "record_type": fields["WARC-Type"],
                        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
                        "url": fields.get("WARC-Target-URI"),
                        "payload": None if revisit else body,
                    }
                )
                size += len(body) + 300
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the listed files, by tasks over byte ranges."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    starts = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    splits = starts.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end")).repartition(parts)
    return K.map_blocks(splits, _read_kernel, RECORDS)


def warc_query(pages: DataFrame) -> DataFrame:
    """The digest of what is read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    manifest = write_archives(pages, store.scratch_path(spark, "warc"))
    digests = read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return complete(store.written(digests, "digests"), manifest)


def complete(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """The written records, if they are as many as the manifest lists; an error otherwise."""
    listed, found = manifest.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], records.count()
    if listed != found:
        raise ValueError(f"the archives list {listed} records, {found} were read")
    return records
