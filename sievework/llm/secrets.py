"""Secret scans over a ledger of blobs, in DataFrame operations only.

Every historical version of a text is addressed by its SHA-256. A ledger holds one row for each blob
and rule version that has been scanned, with the spans found. A scan joins the blobs of a table with
the ledger, reads one text for each blob that has a pending rule, runs only pending rules, appends
their rows, and joins findings back to every path that ever held the blob.

Spans are found by regular expressions: what ``split`` leaves between matches and what
``regexp_extract_all`` returns give each match's place in code points.

Defined cases: a null text is an empty one; an empty table appends nothing; repeated rows and rows
with a null doc_id are returned like any other, each once; other columns are untouched. Very long
texts are scanned whole. Spans of several kinds that begin at one place keep the order of the rules. A blob held by a third of all rows is scanned once: one of its rows is
chosen by a minimum, which combines before the shuffle, and findings reach its rows by a join whose
large side can be split. Places of matches are summed, and texts rebuilt, in blocks of ``BLOCK`` matches, so
a text of very many secrets takes time near to linear in them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import store


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``hint`` is a cheap condition on ``text`` that every match implies; ``keep`` is
    a condition on ``m`` (the match) and ``v`` (its group 2, or the match)."""

    kind: str
    version: int
    pattern: str
    hint: str
    keep: str = "true"
    value_group: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: The contract's kinds, in its order; fixed patterns.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", " OR ".join(f"contains(lower(text), '{w}')" for w in _KEYWORDS), "length(v) >= 6", 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "contains(text, 'AKIA')", "length(m) >= 20"),
    # A maximal run of 24 or more is what the open-ended pattern finds and keeps.
    Rule("hex", 1, r"[0-9a-f]{24,}", "text RLIKE '[0-9a-f]{24}'"),
)
#: Kinds beyond the contract's; formats that their issuers publish.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", "contains(text, '-----BEGIN ')"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "contains(text, 'eyJ')"),
    Rule("vcs", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", "contains(text, 'gh')"),
)
RULES = BASE_RULES + MORE_RULES
#: Matches that are folded together.
BLOCK = 512
LEDGER = "blob string, rule string, spans array<struct<start:int,end:int>>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blocks(items: str) -> str:
    """An array in blocks of ``BLOCK``, one empty block where it is empty. A fold that appends to its result copies it
    at each step, so folds run within blocks, and over one value a block."""
    return f"transform(sequence(0, cast((greatest(size({items}), 1) - 1) div {BLOCK} AS int)), b -> slice({items}, b * {BLOCK} + 1, {BLOCK}))"


def spans(rule: Rule) -> Column:
    """The rule's spans in ``text``: array of (start, end) in code points, end exclusive."""
    pattern = _quoted(rule.pattern)
    matches = f"regexp_extract_all(text, {pattern}, 0)"
    values = f", regexp_extract_all(text, {pattern}, {rule.value_group})" if rule.value_group else ""
    keep = rule.keep.replace("length(m)", "length(y['1'])").replace("length(v)", f"length(y['{2 if rule.value_group else 1}'])")
    # What lies before each match, and the match; what lies after the last one has no match beside it.
    zipped = f"filter(arrays_zip(split(text, {pattern}, -1), {matches}{values}), y -> y['1'] IS NOT NULL)"
    lengths = f"transform({zipped}, y -> named_struct('gap', length(y['0']), 'n', length(y['1']), 'keep', {keep}))"
    empty = "cast(array() AS array<struct<start:int,end:int,keep:boolean>>)"
    step = "named_struct('at', acc.at + x.gap + x.n, 'out', concat(acc.out, array(named_struct('start', acc.at + x.gap, 'end', acc.at + x.gap + x.n, 'keep', x.keep))))"
    local = f"transform({_blocks('items')}, k -> aggregate(k, named_struct('at', 0, 'out', {empty}), (acc, x) -> {step}))"
    bases = "aggregate(blocks, array(0), (acc, x) -> concat(acc, array(element_at(acc, -1) + x.at)))"
    moved = "transform(filter(k.out, x -> x.keep), x -> named_struct('start', bases[i] + x.start, 'end', bases[i] + x.end))"
    placed = _bound(lengths, "items", _bound(local, "blocks", _bound(bases, "bases", f"flatten(transform(blocks, (k, i) -> {moved}))")))
    return F.expr(f"CASE WHEN {rule.hint} THEN {placed} ELSE cast(array() AS array<struct<start:int,end:int>>) END")


def redacted(text: str, found: str, mark: str) -> Column:
    """A text with ``mark`` in place of each run of overlapping spans; ``found`` is ordered by start."""
    empty = "cast(array() AS array<struct<from:int,to:int>>)"
    # Where each block begins: the furthest end of the blocks before it.
    reach = "aggregate(blocks, array(0), (acc, k) -> concat(acc, array(greatest(element_at(acc, -1), coalesce(array_max(transform(k, x -> x.end)), 0)))))"
    gap = "CASE WHEN x.start < acc.at THEN acc.out ELSE concat(acc.out, array(named_struct('from', acc.at, 'to', x.start))) END"
    gaps = f"aggregate(k, named_struct('at', reach[i], 'out', {empty}), (acc, x) -> named_struct('at', greatest(acc.at, x.end), 'out', {gap}), acc -> acc.out)"
    chunk = f"substring({text}, reach[i] + 1, reach[i + 1] - reach[i])"
    pieces = f"flatten(transform(blocks, (k, i) -> {_bound(chunk, 'chunk', f'transform({gaps}, g -> substring(chunk, g.from - reach[i] + 1, g.to - g.from))')}))"
    rest = f"array(substring({text}, element_at(reach, -1) + 1))"
    return F.expr(_bound(_blocks(found), "blocks", _bound(reach, "reach", f"array_join(concat({pieces}, {rest}), {_quoted(mark)})")))


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id, text, blob and row_key of every row; the key names a row, or the rows of one text without id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    blob = F.sha2(text, 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), blob.alias("blob")).withColumn("row_key", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), "blob")))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: the spans of blobs under rule versions that the ledger lacks."""
    rows = addressed(docs)
    chosen = rows.groupBy("blob").agg(F.min("row_key").alias("row_key"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        chosen = chosen.join(seen, "blob", "left").withColumn("pending", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where("size(pending) > 0")
    else:
        chosen = chosen.withColumn("pending", every)
    chosen = chosen.select(F.col("blob").alias("chosen"), F.col("row_key").alias("chosen_key"), "pending")
    texts = rows.select("blob", "row_key", "text").join(chosen, (F.col("row_key") == F.col("chosen_key")) & (F.col("blob") == F.col("chosen")))
    if ledger is None:
        found = [F.struct(F.lit(r.key).alias("rule"), spans(r).alias("spans")) for r in rules]
    else:
        found = [F.when(F.array_contains("pending", r.key), F.struct(F.lit(r.key).alias("rule"), spans(r).alias("spans"))) for r in rules]
    return texts.select("blob", F.inline(F.array_compact(F.array(*found))).alias("rule", "spans"))


def update(docs: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger in ``folder`` lacks, append it, and return the ledger."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    ledger = read_ledger(spark, folder) if there else None
    # Ledger rows are short, so they go to files of a sensible size by one more, small, shuffle.
    scan(docs, ledger, rules).hint("rebalance").write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(folder)


def blob_findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and its spans under these rule versions, ordered by start, then kind as listed; blobs
    without spans are left out."""
    order = F.array(*[F.lit(r.key) for r in rules])
    rows = ledger.where(F.size("spans") > 0).withColumn("rank", F.array_position(order, F.col("rule"))).where("rank > 0")
    spans_ = rows.select("blob", "rule", F.inline("spans"), "rank").distinct()  # a blob of repeated rows may be there twice
    return spans_.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", F.substring_index("rule", "@", 1).alias("kind")))).alias("found"))


def _joined(found: str) -> Column:
    return F.expr(f"array_join(transform({found}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def secrets_query(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row."""
    ledger = update(docs, store.scratch_path(docs.sparkSession, "blobs"))
    rows = addressed(docs).select("doc_id", "blob").join(blob_findings(ledger), "blob", "left")
    rows = rows.withColumn("found", F.coalesce("found", F.expr("cast(array() AS array<struct<start:int,rank:bigint,end:int,kind:string>>)")))
    base = f"filter(found, x -> x.rank <= {len(BASE_RULES)})"
    counts = [F.expr(f"cast(size(filter(found, x -> x.kind = '{r.kind}')) AS long)").alias(f"n_{r.kind}") for r in BASE_RULES]
    return rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined("found").alias("spans"))


def redact_stage(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced by ``mark``, and n_chars set anew."""
    ledger = update(docs, store.scratch_path(docs.sparkSession, "blobs"))
    held = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"
    keyed = held.withColumn("_blob", F.sha2(F.coalesce(text, F.lit("")), 256))
    found = blob_findings(ledger).withColumnRenamed("blob", "_blob")
    out = keyed.join(found, "_blob", "left").withColumn(text, F.when(F.col("found").isNull(), F.col(text)).otherwise(redacted(text, "found", mark)))
    if "n_chars" in docs.columns:
        n_chars = f"c{docs.columns.index('n_chars')}"
        out = out.withColumn(n_chars, F.when(F.col("found").isNull(), F.col(n_chars)).otherwise(F.length(text).cast("long")))
    return out.select(*held.columns).toDF(*docs.columns)
