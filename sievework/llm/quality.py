"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document: its measurement is kept, and its verdict is a bit of
``fail_bits``. A policy is a version and a mask of rules, so another policy, or an ablation of one,
is integer arithmetic over the ledger and never reads a text again.

Defined cases: a null or empty text has no words and fails ``too_few_words``; repeated rows get equal
ledger rows; an empty table gives an empty ledger; other columns of the input are neither read nor
needed, whatever their names. The measurements cover whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import textkit as K
from sievework.llm import tokens

WINDOW = 8
#: Rules by bit: name, and the condition under which a document fails, on ledger measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words)"),
    ("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("shouting", "n_letters > 0 AND 2 * n_upper > n_letters"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("exclamations", "5 * n_exclaims > n_words"),
    ("stutter", "2 * n_same_next > n_words"),
)
#: Policies by version: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("too_few_words", "repeated_windows"),
    "prose-1": tuple(name for name, _ in RULES),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_exclaims", "n_same_next")
LEDGER = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"[#*$%&|<>]", np.uint8)[1:-1])
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_CHAR = (np.arange(256) & 0xC0) != 0x80


def measure(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each document of a block."""
    n = len(off) - 1

    def count(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return sums[off[1:]] - sums[off[:-1]]

    words = K.Words(buf, off)
    bytes_ = K.RangeHash(buf)
    out = {"n_words": words.counts(), "word_chars": count(~K.IS_SPACE[buf] & _CHAR[buf]), "n_symbols": count(_SYMBOL[buf])}
    # Lines with a word: the words' line numbers say which; fingerprints say which are equal.
    start, end = _lines(buf, off)
    doc = K.owner(off, np.minimum(start, len(buf) - 1)) if len(start) else start
    has_word = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end, doc = start[has_word], end[has_word], doc[has_word]
    order, first, _ = K.grouped(K.mix(bytes_.of(start, end) ^ K.mix(doc.astype(np.uint64))))
    out["n_lines"] = K.per_doc(doc, n)
    out["n_dup_lines"] = out["n_lines"] - K.per_doc(doc[order[first]], n)
    names = bytes_.of(words.start, words.end)
    same = (names[1:] == names[:-1]) & (words.doc[1:] == words.doc[:-1])
    out["n_same_next"] = K.per_doc(words.doc[1:][same], n)
    at, prints = words.windows(names, WINDOW)
    order, _, sizes = K.grouped(K.mix(prints ^ K.mix(words.doc[at].astype(np.uint64))))
    again = at[order[np.repeat(sizes >= 2, sizes)]]
    size = len(words.start) + 1
    cover = np.cumsum(np.bincount(again, minlength=size) - np.bincount(again + WINDOW, minlength=size))
    out["n_repeat_words"] = K.per_doc(words.doc[cover[:-1] > 0], n)
    out["n_upper"], out["n_letters"], out["n_exclaims"] = count(_UPPER[buf]), count(tokens.letters(buf)), count(buf == 0x21)
    return out


def _lines(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the lines between newlines, for each document."""
    breaks = np.flatnonzero(buf == 0x0A)
    filled = off[:-1][np.diff(off) > 0]
    start = np.sort(np.concatenate((filled, breaks + 1)))
    start = start[start < len(buf)]
    start = np.unique(start)
    end = np.append(start[1:], len(buf)) if len(start) else start
    ends_at_break = (end > 0) & (buf[np.maximum(end - 1, 0)] == 0x0A) if len(start) else np.zeros(0, bool)
    return start, end - ends_at_break


def _ledger_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in K.blocks(batches):
        found = measure(buf, off)
        yield K.table(doc_id=rows.column("doc_id"), **{m: found[m] for m in MEASURES})


def fail_bits_sql() -> str:
    """A bit for each failed rule, the first rule lowest."""
    return " + ".join(f"CASE WHEN {fails} THEN {1 << bit}L ELSE 0L END" for bit, (_, fails) in enumerate(RULES))


def build_ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements and fail_bits of every document; no shuffle."""
    measured = K.map_blocks(docs.select(F.col("doc_id").cast("long"), "text"), _ledger_kernel, LEDGER)
    return measured.withColumn("fail_bits", F.expr(fail_bits_sql()))


def mask(rules: tuple[str, ...]) -> int:
    """The bits of the named rules."""
    bits = {name: 1 << bit for bit, (name, _) in enumerate(RULES)}
    return sum(bits[name] for name in rules)


def apply_policy(ledger: DataFrame, version: str = "prose-1") -> DataFrame:
    """Adds policy and kept: whether none of the policy's rules failed."""
    return ledger.withColumn("policy", F.lit(version)).withColumn("kept", F.expr(f"fail_bits & {mask(POLICIES[version])}L = 0"))


def ablations(ledger: DataFrame, version: str = "prose-1") -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail it alone, and rows kept without it.

    Only distinct masks, at most 2^rules, leave the partial aggregation.
    """
    whole = mask(POLICIES[version])
    masks = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[version]])).alias("r")
    return (
        masks.select("bits", "n", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.expr("sum(CASE WHEN bits & r.bit != 0 THEN n ELSE 0 END)").alias("n_failed"),
            F.expr("sum(CASE WHEN bits = r.bit THEN n ELSE 0 END)").alias("n_failed_alone"),
            F.expr(f"sum(CASE WHEN bits & ({whole}L - r.bit) = 0 THEN n ELSE 0 END)").alias("n_kept_without"),
        )
    )


def quality_query(docs: DataFrame, version: str = "prose-1") -> DataFrame:
    """The digest of the contract: base measurements, base_failed and kept, with the ledger's bits."""
    judged = apply_policy(build_ledger(docs), version)
    base = F.expr(f"fail_bits & {mask(POLICIES['base-1'])}L != 0")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "fail_bits", "policy")


def quality_stage(docs: DataFrame, version: str = "prose-1") -> DataFrame:
    """The documents that a policy keeps, with their own columns; rows pass through once, unshuffled."""
    prefix = "_measured_"
    bare = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in K.blocks(batches, text):
            found = measure(buf, off)
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(found[m]) for m in MEASURES)], [*rows.schema.names, *(prefix + m for m in MEASURES)])

    schema = T.StructType([*bare.schema.fields, *[T.StructField(prefix + m, T.LongType()) for m in MEASURES]])
    bits = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"{prefix}\1", fail_bits_sql())
    kept = K.map_blocks(bare, kernel, schema).where(f"({bits}) & {mask(POLICIES[version])}L = 0")
    return kept.select(*bare.columns).toDF(*docs.columns)
