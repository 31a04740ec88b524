"""Removal of repeated byte strings by prefix doubling over synchronised positions.

A byte goes if it lies in a 200-byte string that also starts elsewhere. Ranking every byte position at
every doubled length would ship each of them several times over, so positions are ranked in groups
that no equal strings can leave, from one rank to the next:

1. The first rank is the string's anchor: its 32-byte gram of the smallest hash, leftmost on ties. The
   anchor depends on the string alone, so equal strings have equal anchors at equal places. The strings
   of one anchor occurrence are a run of neighbours, and one row stands for the run: about a row for
   85 bytes. Spark deals rows by the anchor's hash range.
2. Runs whose whole content (up to 368 bytes) is equal are repeated throughout; equal runs of a block
   are counted before the shuffle. Runs whose anchor is unique, or unique with the 84 bytes to its left
   and to its right, can't be repeated and go: one of the two sides belongs to any such string.
3. The strings of what is left, the edges of repeated passages, are ranked byte by byte inside each
   group: ranks of 8 bytes, paired with the rank at offset 8, then 16, 32, 64, and last the rank of
   128 bytes with that at offset 72. A position whose rank is unique is done; those left are repeated.
4. A group of over ``GROUP_BYTES`` isn't held by a task. Spark deals and sorts its positions again, under
   the rank of a longer string: paired with the rank of half the bytes that are still open, before or
   after those that the group shares. 116 bytes grow to 158, 179, 190 and so on, up to 200; groups that
   have become small are finished as in step 3, and what is alone is unique.

Ranks are 64-bit fingerprints, of pairs in steps 1 and 2; step 3 compares bytes. Defined cases: a null text is empty;
texts under 200 bytes keep everything; repeated rows repeat each other; rows with a null doc_id count
like any other; ties play no part; an empty table gives no rows; other columns are not read. Very long
texts are worked on whole, a run at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import store
from sievework.llm import textkit as K

LENGTH = 200
GRAM = 32
#: Bytes beside the anchor that one of the two sides must share: half of what the anchor leaves.
SIDE = (LENGTH - GRAM) // 2

#: Bytes of a group that one task ranks; larger groups are dealt again under longer ranks.
GROUP_BYTES = 1 << 20

_FIELDS = {"name": np.uint64, "print": np.uint64, "left": np.uint32, "right": np.uint32, "doc": np.uint16, "lo": np.int32, "wide": np.uint8, "place": np.uint8, "many": np.uint8}


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by least values from both ends of chunks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    chunks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(chunks, axis=1).ravel()
    back = np.minimum.accumulate(chunks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchored_runs(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of strings with one anchor: document, first and last start, anchor's place, and fingerprints."""
    side = (length - gram) // 2
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < length:
        return {k: none for k in ("doc", "lo", "hi", "at")} | {k: none.astype(np.uint64) for k in ("name", "print", "left", "right")}
    prints = K.RangeHash(buf)
    at = np.arange(n - gram + 1)
    names = prints.short(at, at + gram)
    place = (1 << 31) - 1
    least = sliding_least(names >> np.uint64(31) << np.uint64(31) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & np.uint64(place)).astype(np.int64)
    fits = np.zeros(n + 1, np.int64)
    long = np.diff(off) >= length
    np.add.at(fits, off[:-1][long], 1)
    np.add.at(fits, off[1:][long] - length + 1, -1)
    fits = np.cumsum(fits)[: len(anchor)] > 0
    first = fits.copy()
    first[1:] &= ~fits[:-1] | (anchor[1:] != anchor[:-1])
    first[off[:-1][long]] = True
    lo = np.flatnonzero(first)
    last = fits.copy()
    last[:-1] &= ~fits[1:] | first[1:]
    hi = np.flatnonzero(last)
    a = anchor[lo]
    out = {"doc": K.owner(off, lo), "lo": lo, "hi": hi, "at": a, "name": names[a]}
    out["print"] = K.mix(prints.of(lo, hi + length) + K.mix((a - lo).astype(np.uint64)))
    has_left, has_right = a - lo >= side, a - hi < side
    left = prints.of(np.maximum(a - side, 0), a + gram)
    right = prints.of(a, np.minimum(a + gram + side, n))
    out["left"], out["right"] = np.where(has_left, left | np.uint64(1), np.uint64(0)), np.where(has_right, right | np.uint64(1), np.uint64(0))
    return out


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of intervals [lo, hi) by document, ordered."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    width = int(hi.max()) + 1
    base = np.unique(doc, return_inverse=True)[1] * width
    reach = np.maximum.accumulate(base + hi)
    new = np.concatenate(([True], (base + lo)[1:] > reach[:-1]))
    start = np.flatnonzero(new)
    return doc[start], lo[start], np.maximum.reduceat(base + hi, start) - base[start]


def _runs_kernel(ranges: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in K.blocks(batches):
            keys = rows.column("key").to_numpy()
            for a in range(0, len(keys), 1 << 16):  # documents are numbered by 16 bits
                b = min(a + (1 << 16), len(keys))
                yield from packed(keys[a:b], buf[off[a] : off[b]], off[a : b + 1] - off[a])

    def packed(keys: np.ndarray, buf: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
        r = anchored_runs(buf, off)
        if not len(r["lo"]):
            return
        order, start, sizes = K.grouped(K.mix(r["name"]) ^ r["print"])
        again = np.zeros(len(order), bool)
        again[order] = np.repeat(sizes >= 2, sizes)
        one = np.sort(order[start])
        doc, lo, hi = merged(r["doc"][again], r["lo"][again], r["hi"][again] + LENGTH)
        lo, hi = lo - off[doc], hi - off[doc]
        own = {k: v[one] for k, v in r.items()}
        fields = {"name": own["name"], "print": own["print"], "left": own["left"], "right": own["right"], "doc": own["doc"], "lo": own["lo"] - off[own["doc"]], "wide": own["hi"] - own["lo"], "place": own["at"] - own["lo"], "many": again[one]}
        fields["left"], fields["right"] = fields["left"].astype(np.uint32), fields["right"].astype(np.uint32)
        # Anchors are least hashes, which crowd the low ranges, so they are mixed once more.
        part = ((K.mix(own["name"]) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        bounds = np.searchsorted(part, np.arange(ranges + 1))
        out: dict[str, list] = {k: [] for k in ("part", "keys", *_FIELDS, "s_key", "s_lo", "s_hi")}
        for p in np.flatnonzero(np.diff(bounds)):
            which = order[bounds[p] : bounds[p + 1]]
            local, numbered = np.unique(fields["doc"][which], return_inverse=True)
            out["part"].append(int(p))
            out["keys"].append(keys[local].tobytes())
            for k, kind in _FIELDS.items():
                out[k].append((numbered if k == "doc" else fields[k][which]).astype(kind).tobytes())
            for k, v in (("s_key", keys[doc]), ("s_lo", lo.astype(np.int32)), ("s_hi", hi.astype(np.int32))):
                out[k].append(v.tobytes() if len(out["part"]) == 1 else b"")
        yield K.table(part=pa.array(out["part"], pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in out.items() if k != "part"})

    return kernel


_RUNS = "part int, keys binary, " + ", ".join(f"{k} binary" for k in _FIELDS) + ", s_key binary, s_lo binary, s_hi binary"
_FOUND = "grp long, key long, lo int, hi int, s int, e int"


def _found(grp: np.ndarray | None, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Without ``grp`` repeated bytes [lo, hi); with it starts lo to hi of strings that have [s, e) in common
    with others of the group."""
    for a in range(0, len(key), 1 << 16):
        b = slice(a, a + (1 << 16))
        own = pa.nulls(len(key[b]), pa.int64()) if grp is None else pa.array(grp[b].view(np.int64))
        yield K.table(grp=own, key=key[b], **{k: v[b].astype(np.int32) for k, v in (("lo", lo), ("hi", hi), ("s", s), ("e", e))})


def _ranked_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated bytes, and starts to rank byte by byte in their group."""
    held: dict[str, list] = {}
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if now is not None and row["part"] != now:
                yield from _ranked(held)
                held = {}
            now = row["part"]
            for k, v in row.items():
                held.setdefault(k, []).append(v)
    if held:
        yield from _ranked(held)


def _ranked(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
    f = {k: np.frombuffer(b"".join(rows[k]), kind) for k, kind in _FIELDS.items()}
    keys = [np.frombuffer(k, np.int64) for k in rows["keys"]]
    base = np.cumsum([0, *map(len, keys)])[:-1]
    key = np.concatenate(keys)[f["doc"].astype(np.int64) + np.repeat(base, [len(x) // 2 for x in rows["doc"]])]
    spans = [np.frombuffer(b"".join(rows[k]), t) for k, t in (("s_key", np.int64), ("s_lo", np.int32), ("s_hi", np.int32))]
    yield from _found(None, *spans, spans[1], spans[2])
    lo = f["lo"].astype(np.int64)
    hi, at = lo + f["wide"], lo + f["place"]
    order = np.lexsort((f["print"], f["name"]))
    name, print_ = f["name"][order], f["print"][order]
    new_name = np.concatenate(([True], name[1:] != name[:-1]))
    new_kind = new_name | np.concatenate(([True], print_[1:] != print_[:-1]))
    kind, of_name = np.cumsum(new_kind) - 1, np.cumsum(new_name) - 1
    start = np.flatnonzero(new_kind)
    many = (np.diff(np.append(start, len(order))) >= 2) | (np.maximum.reduceat(f["many"][order], start) > 0)
    kinds_of = np.bincount(of_name[start])
    open_of = np.bincount(of_name[start], ~many)
    repeated = many[kind]
    which = order[repeated]
    _, s_lo, s_hi = merged(key[which], lo[which], hi[which] + LENGTH)
    s_key = merged(key[which], lo[which], hi[which] + LENGTH)[0]
    yield from _found(None, s_key, s_lo, s_hi, s_lo, s_hi)
    # Runs that aren't repeated, and one of each repeated kind, where an anchor has several kinds.
    ask = (kinds_of[of_name] >= 2) & (open_of[of_name] > 0) & new_kind
    which, opens = order[ask], ~repeated[ask]
    for side, field in ((1, "left"), (2, "right")):
        has = f[field][which] != 0
        w, o = which[has], opens[has]
        grp = K.mix(f["name"][w] ^ K.mix(f[field][w].astype(np.uint64) + np.uint64(side)))
        g_order, g_start, g_size = K.grouped(grp)
        if not len(g_start):
            continue
        live = (g_size >= 2) & (np.add.reduceat(o[g_order].astype(np.int64), g_start) > 0)
        w = w[g_order[np.repeat(live, g_size)]]
        grp = grp[g_order[np.repeat(live, g_size)]]
        a = lo[w] if side == 1 else np.maximum(lo[w], at[w] - SIDE + 1)
        b = np.minimum(hi[w], at[w] - SIDE) if side == 1 else hi[w]
        yield from _found(grp, key[w], a, b, at[w] - SIDE if side == 1 else at[w], at[w] + GRAM if side == 1 else at[w] + GRAM + SIDE)


_CONTEXTS = {"grp": pa.int64(), "key": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "s": pa.int32(), "e": pa.int32(), "bytes": pa.binary()}


def _contexts_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each asked run, from its first start to its last string's end."""
    for rows, buf, off in K.blocks(batches):
        raw = buf.tobytes()
        out: dict[str, list] = {k: [] for k in _CONTEXTS}
        for d, (key, asked) in enumerate(zip(rows.column("key").to_pylist(), rows.column("asked").to_pylist(), strict=True)):
            for x in asked:
                out["grp"].append(x["grp"])
                out["key"].append(key)
                for k in ("lo", "hi", "s", "e"):
                    out[k].append(x[k])
                out["bytes"].append(raw[off[d] + x["lo"] : off[d] + x["hi"] + LENGTH])
        yield K.table(**{k: pa.array(v, _CONTEXTS[k]) for k, v in out.items()})


def doubled(first: np.ndarray, text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the ``starts`` begin a string that another with an equal ``first`` rank begins.

    first: a rank for each start. text: bytes, long enough after each start. Ranks double their length
    by pairs; starts with a unique rank take no part in later rounds.
    """
    n = len(text)
    size = 8
    padded = np.concatenate((text, np.zeros(size, np.uint8)))
    rank = np.zeros(n, np.uint64)
    for i in range(size):
        rank |= padded[i : n + i].astype(np.uint64) << np.uint64(8 * i)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while size * 2 <= length:  # ranks of all places, by content alone
        later = np.concatenate((rank[size:], np.full(min(size, n), -1, np.int64)))
        rank = np.unique(rank * (n + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
        size *= 2
    live = np.arange(len(starts))
    key = first.astype(np.int64)
    for ranks in (rank[starts], rank[starts + length - size]):
        key_live = np.unique(key[live] * (n + 1) + ranks[live], return_inverse=True)[1]
        count = np.bincount(key_live)
        keep = count[key_live] >= 2
        live = live[keep]
        key = np.zeros(len(starts), np.int64)
        key[live] = key_live[keep]
    out = np.zeros(len(starts), bool)
    out[live] = True
    return out


def _longer(row: dict, length: int = LENGTH) -> Iterator[dict]:
    """The row's starts under ranks of longer strings. Of the bytes that [s, e) leaves open, each start has
    either the half before s or the half after e; the bytes of that half make the next rank."""
    s, e, lo, hi, raw = (row[k] for k in ("s", "e", "lo", "hi", "bytes"))
    rest = length - (e - s)
    half = (rest + 1) // 2
    for a, b, s2, e2 in ((lo, min(hi, s - half), s - half, e), (max(lo, s - half + 1), hi, s, e + rest - half + 1)):
        if a > b:
            continue
        more = raw[s2 - lo : s - lo] if s2 < s else raw[e - lo : e2 - lo]
        name = hashlib.blake2b(row["grp"].to_bytes(8, "little", signed=True) + (b"<" if s2 < s else b">") + more, digest_size=8).digest()
        yield {"grp": int.from_bytes(name, "little", signed=True), "key": row["key"], "lo": a, "hi": b, "s": s2, "e": e2, "bytes": raw[a - lo : b - lo + length]}


def _edges_kernel(most: int):
    """Repeated bytes of groups; of a group of over ``most`` bytes, its rows under longer ranks instead, so
    that a task holds no more of it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, own, large = 0, 0, None  # bytes held, of them of the last group, and a group that goes on

        def settle(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            text = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
            base = np.cumsum([0, *(len(r["bytes"]) for r in rows)])[:-1]
            lo, hi, s, e = (np.array([r[k] for r in rows], np.int64) for k in ("lo", "hi", "s", "e"))
            grp = np.unique(np.array([r["grp"] for r in rows], np.int64), return_inverse=True)[1]
            width = hi - lo + 1
            run = np.repeat(np.arange(len(rows)), width)
            step = np.arange(len(run)) - np.repeat(np.cumsum(width) - width, width)
            found = doubled(grp[run] * (LENGTH + 1) + (s - lo)[run] - step, text, base[run] + step)
            p = (lo[run] + step)[found]
            key, a, b = merged(np.array([r["key"] for r in rows], np.int64)[run[found]], p, p + LENGTH)
            yield from done(key, a, b)

        def done(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(key):
                yield K.table(grp=pa.nulls(len(key), pa.int64()), key=key, lo=a.astype(np.int32), hi=b.astype(np.int32), s=a.astype(np.int32), e=b.astype(np.int32), bytes=pa.nulls(len(key), pa.binary()))

        def go_on(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            whole = [r for r in rows if r["e"] - r["s"] == LENGTH]  # several of the group are equal
            at = np.array([r["s"] for r in whole], np.int64)
            yield from done(np.array([r["key"] for r in whole], np.int64), at, at + LENGTH)
            out = [x for r in rows if r["e"] - r["s"] < LENGTH for x in _longer(r)]
            if out:
                yield K.table(**{k: pa.array([x[k] for x in out], kind) for k, kind in _CONTEXTS.items()})

        for batch in batches:
            straight: list[dict] = []
            for row in batch.to_pylist():
                if row["grp"] == large:
                    straight.append(row)
                    continue
                if held and row["grp"] != held[-1]["grp"]:
                    own = 0
                    if size > K.BLOCK_BYTES:
                        yield from settle(held)
                        held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
                own += len(row["bytes"])
                if own > most and own > len(row["bytes"]):  # of two rows at least
                    large = row["grp"]
                    yield from settle([r for r in held if r["grp"] != large])
                    straight += [r for r in held if r["grp"] == large]
                    held, size, own = [], 0, 0
            yield from go_on(straight)
        yield from settle(held)

    return kernel


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(doc_id, text).alias("key"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """key (of a row, by id and text), lo and hi of repeated bytes; spans may overlap."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 1 << max(4, (parts * 2 - 1).bit_length())
    rows = _keyed(docs)
    runs = K.map_blocks(rows.select("key", "text"), _runs_kernel(ranges), _RUNS)
    dealt = runs.repartitionById(parts, F.pmod("part", F.lit(parts))).sortWithinPartitions("part")
    found = store.written(dealt.mapInArrow(_ranked_kernel, _FOUND), "runs", gathered=True)
    asked = found.where("grp IS NOT NULL").groupBy("key").agg(F.collect_list(F.struct("grp", "lo", "hi", "s", "e")).alias("asked"))
    shape = "grp long, key long, lo int, hi int, s int, e int, bytes binary"
    open_ = K.map_blocks(rows.select("key", "text").dropDuplicates(["key"]).join(asked, "key"), _contexts_kernel, shape)
    spans = found.where("grp IS NULL").select("key", "lo", "hi")
    while True:  # a round doubles what the strings of a rank share; 8 rounds at most
        ranked = store.written(open_.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(_edges_kernel(GROUP_BYTES), shape), "edges", gathered=True)
        spans = spans.union(ranked.where("grp IS NULL").select("key", "lo", "hi"))
        open_ = ranked.where("grp IS NOT NULL")
        if open_.isEmpty():
            return spans


def _removed_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in K.blocks(batches):
        los, his = (rows.column(c) for c in ("lo", "hi"))
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        for d in range(rows.num_rows):
            own = buf[off[d] : off[d + 1]]
            lo, hi = (x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in (los[d], his[d]))
            kept = own.tobytes()
            _, lo, hi = merged(np.zeros(len(lo), np.int64), lo.astype(np.int64), hi.astype(np.int64))
            if len(lo):
                ends = np.append(lo[1:], len(own))
                kept = kept[: lo[0]] + b"".join(kept[a:b] for a, b in zip(hi.tolist(), ends.tolist(), strict=True))
            out["n_bytes"].append(len(own))
            out["n_removed"].append(len(own) - len(kept))
            out["n_spans"].append(len(lo))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        yield K.table(doc_id=rows.column("doc_id"), **{k: pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items()})


def repeats_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    spans = repeated_spans(docs).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("s"))
    spans = spans.select("key", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
    rows = _keyed(docs).join(spans, "key", "left").select("doc_id", "text", "lo", "hi")
    return K.map_blocks(rows, _removed_kernel, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
