"""Append-only Parquet tables: a version is written once, and is there once it is committed."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import schemas as S


class IdentityConflict(Exception):
    """A stored version differs from what would be written."""


class Store:
    """Tables under a root, by schema, name and identity. Nothing written is ever changed.

    Rows and header of an attempt go to folders of its own; a commit, made last and only if there is none of that
    identity yet, names them. Readers follow commits alone, so they never see half a batch, nor the rows of an attempt that
    failed or came second.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str, identity: str | None = None) -> str:
        return f"{self.root}/{table.replace('.', '/')}" + (f"/identity={identity}" if identity else "")

    def exists(self, table: str, identity: str) -> bool:
        """Whether a version is committed, or, as ``none``, an empty table laid down."""
        if identity == "none":
            return _there(self.spark, self.path(table, identity))
        return bool(self._attempts(table, identity))

    def _attempts(self, table: str, identity: str | None = None) -> list[str]:
        """The folders of a table's committed rows: one for each version, so as many names as batches."""
        path = f"{self.root}/_commits/{table}"
        if not _there(self.spark, path if identity is None else f"{path}/{identity}"):
            return []
        return [r.value for r in self.spark.read.text(path if identity is None else f"{path}/{identity}").select(F.get_json_object("value", f"$['{table}']").alias("value")).collect() if r.value]

    def versions(self, table: str) -> int:
        """How many versions of a table are committed."""
        return len(self._attempts(table))

    def read(self, table: str, identity: str | None = None) -> DataFrame:
        """A table with its exact schema; only the folders of the identity are listed."""
        reader = self.spark.read.schema(S.TABLES[table])
        found = self._attempts(table, identity)
        return reader.parquet(*[f"{self.root}/{x}" for x in found]) if found else self.spark.createDataFrame([], S.TABLES[table])

    def _fit(self, table: str, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.TABLES[table].fields])

    def create(self) -> list[str]:
        """Lay down the tables that aren't there, empty and with their schemas; returns their names."""
        made = []
        for name, schema in S.TABLES.items():
            if not _there(self.spark, self.path(name)):
                self.spark.createDataFrame([], schema).write.parquet(f"{self.path(name)}/identity=none")
                made.append(name)
        return made

    def remove(self) -> list[str]:
        """Take empty tables away again; an error, before anything goes, where one has rows."""
        there = [n for n in S.TABLES if self.exists(n, "none")]
        for name in there:
            if not self.read(name).isEmpty():
                raise IdentityConflict(name)
        for name in there:
            _delete(self.spark, self.path(name))
        return there

    def append(self, rows_table: str, rows: DataFrame, header_table: str, header: DataFrame, identity: str) -> bool:
        """Write rows and header of a new identity. An identity that is there must have an equal header and
        equal rows (by their count and two sums of hashes), or ``IdentityConflict`` is raised; False then,
        and True after a write."""
        if self.exists(header_table, identity):
            stable = [c for c in header.columns if not c.endswith("_at")]
            fitted = self._fit(header_table, header).select(*stable)
            stored = self.read(header_table, identity).select(*stable)
            if not stored.exceptAll(fitted).isEmpty() or not fitted.exceptAll(stored).isEmpty():
                raise IdentityConflict(identity)
            kept = [c for c in rows.columns if not c.endswith("_at")]
            # A writer that was lost between its two commits left the second one to be made.
            claim(self.spark, f"{self.root}/_commits/{rows_table}/{identity}", self.spark.read.text(f"{self.root}/_commits/{header_table}/{identity}").first()[0])
            if _digest(self.read(rows_table, identity).select(*kept)) != _digest(self._fit(rows_table, rows).select(*kept)):
                raise IdentityConflict(identity)
            return False
        attempt = uuid.uuid4().hex
        places = {t: f"{t.replace('.', '/')}/identity={identity}/attempt={attempt}" for t in (rows_table, header_table)}
        self._fit(rows_table, rows).write.mode("errorifexists").parquet(f"{self.root}/{places[rows_table]}")
        self._fit(header_table, header).write.mode("errorifexists").parquet(f"{self.root}/{places[header_table]}")
        # The header's commit decides; that of the rows repeats it for readers of rows.
        text = json.dumps(places, sort_keys=True)
        if not claim(self.spark, f"{self.root}/_commits/{header_table}/{identity}", text):
            for place in places.values():
                _delete(self.spark, f"{self.root}/{place}")
            return self.append(rows_table, rows, header_table, header, identity)
        claim(self.spark, f"{self.root}/_commits/{rows_table}/{identity}", text)
        return True


def _system(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _there(spark: SparkSession, path: str) -> bool:
    system, target = _system(spark, path)
    return system.exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    system, target = _system(spark, path)
    system.delete(target, True)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with its whole content unless it is there; of several writers one gets True.

    The text goes to a name of its own first. On a local disk a hard link then makes the file or fails; elsewhere
    a rename does, as HDFS refuses to rename onto what is there.
    """
    system, target = _system(spark, path)
    jvm = spark.sparkContext._jvm
    partial = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.{uuid.uuid4().hex}")
    out = system.create(partial, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getScheme() == "file":
            paths = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, partial)]
            try:
                jvm.java.nio.file.Files.createLink(*paths)
            except Py4JJavaError as problem:
                if "FileAlreadyExists" not in str(problem.java_exception.toString()):
                    raise
                return False
            return True
        return not system.exists(target) and system.rename(partial, target)
    finally:
        system.delete(partial, False)


def _digest(rows: DataFrame) -> tuple:
    """What equal rows have in common, in whatever order."""
    h = F.xxhash64(F.to_json(F.struct(*rows.columns)))
    return tuple(rows.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 16))).first())


def canonical(report: dict) -> str:
    return json.dumps(report, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False, default=str)


def publish(spark: SparkSession, path: str, report: dict) -> str:
    """Write a report once, as canonical JSON."""
    return publish_text(spark, path, canonical(report) + "\n")


def publish_text(spark: SparkSession, path: str, text: str) -> str:
    """Write a text once by Hadoop's file system: to a name of its own, then claimed. Equal bytes that
    are there are fine; others are a conflict."""
    system, target = _system(spark, path)
    if system.exists(target):
        stored = spark.read.text(path, wholetext=True).first()[0]
        if stored.rstrip("\n") != text.rstrip("\n"):
            raise IdentityConflict(path)
        return path
    if not claim(spark, path, text):
        return publish_text(spark, path, text)
    return path


def closed(report: dict, fields: set[str]) -> dict:
    """The report, if it has exactly these fields; an error otherwise."""
    if set(report) != fields:
        raise ValueError(f"report_fields_differ: {sorted(set(report) ^ fields)}")
    return report


def bars_svg(rows: list[tuple[str, float]], width: int = 640) -> str:
    """Horizontal bars as an SVG document; values are shares of the width, from 0 to 1."""
    line, left = 22, 240
    bars = []
    for i, (name, value) in enumerate(rows):
        y = 10 + i * line
        safe = name.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        bars.append(f'<text x="{left - 8}" y="{y + 13}" text-anchor="end">{safe}</text><rect x="{left}" y="{y}" width="{max(0.0, min(1.0, value)) * (width - left - 10):.2f}" height="{line - 6}"/>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{20 + line * len(rows)}" font-family="sans-serif" font-size="12">{"".join(bars)}</svg>\n'


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A small report table as Markdown: at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
