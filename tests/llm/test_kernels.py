"""Array kernels against plain loops, over generated inputs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("sievework.llm")

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from sievework.llm import language, repeats, warc  # noqa: E402
from sievework.llm import textkit as K  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text("ab \n\tßé .", max_size=30)), max_size=8)


def packed(texts):
    return K.buffers(pa.array(texts, pa.string()))


@settings(deadline=None, max_examples=150)
@given(TEXTS)
def test_words(texts):
    buf, off = packed(texts)
    words = K.Words(buf, off)
    got = [[] for _ in texts]
    for d, a, b in zip(words.doc.tolist(), words.start.tolist(), words.end.tolist(), strict=True):
        got[d].append(buf[a:b].tobytes().decode())
    assert got == [WORD.findall(t or "") for t in texts]
    names = K.RangeHash(buf).of(words.start, words.end)
    flat = [w for t in got for w in t]
    assert len(set(names.tolist())) == len(set(flat))


@settings(deadline=None, max_examples=100)
@given(st.lists(st.text("xyzäö ", max_size=40), max_size=10), st.integers(1, 60))
def test_blocks_hold_whole_documents(texts, limit):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "i": pa.array(list(range(len(texts))), pa.int64())})
    seen = []
    for rows, buf, off in K.blocks(iter([batch.slice(1), batch.slice(0, 1)]), limit=limit):
        seen += [(i, buf[off[k] : off[k + 1]].tobytes().decode()) for k, i in enumerate(rows.column("i").to_pylist())]
        assert len(buf) <= limit or rows.num_rows == 1
    assert sorted(seen) == list(enumerate(texts))


@settings(deadline=None, max_examples=100)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(1, 10)), max_size=30))
def test_merged_intervals(spans):
    doc, lo, hi = (np.array([f(x) for x in spans], np.int64) for f in (lambda x: x[0], lambda x: x[1], lambda x: x[1] + x[2]))
    d, a, b = repeats.merged(doc, lo, hi)
    covered = {(x, p) for x, s, w in spans for p in range(s, s + w)}
    got = [(x, p) for x, s, e in zip(d.tolist(), a.tolist(), b.tolist(), strict=True) for p in range(s, e)]
    assert sorted(got) == sorted(covered) and len(got) == len(covered)


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 12))
def test_sliding_least(values, width):
    if len(values) >= width:
        got = repeats.sliding_least(np.array(values, np.uint64), width)
        assert got.tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


@settings(deadline=None, max_examples=60)
@given(st.binary(min_size=8, max_size=80).map(lambda b: bytes(x % 3 for x in b)))
def test_prefix_doubling(raw):
    length = 20
    starts = np.arange(max(0, len(raw) - length + 1))
    text = np.frombuffer(raw, np.uint8)
    got = repeats.doubled(np.zeros(len(starts), np.int64), text, starts, length)
    windows = [raw[i : i + length] for i in starts]
    assert got.tolist() == [windows.count(w) > 1 for w in windows]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("aB ñ1!", max_size=12), max_size=6))
def test_trigrams(texts):
    buf, off = packed(texts)
    doc, key = language.grams(buf, off)
    got = sorted(zip(doc.tolist(), key.tolist(), strict=True))
    expected = []
    for d, t in enumerate(texts):
        letters = "".join(c.lower() if c.isalpha() else " " for c in t)
        spaced = re.sub(" +", " ", f" {letters} ")
        expected += [(d, ord(a) << 42 | ord(b) << 21 | ord(c)) for a, b, c in zip(spaced, spaced[1:], spaced[2:], strict=False)]
    assert got == sorted(expected)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.binary(max_size=300), min_size=1, max_size=12), st.integers(1, 400))
def test_members_are_owned_once(tmp_path_factory, payloads, step):
    raw = b"".join(warc.member(i, "u", b"\x1f\x8b\x08" + p, len(p) + 3, "A" * 32, "response", None) for i, p in enumerate(payloads))
    path = tmp_path_factory.mktemp("w") / "a.warc.gz"
    path.write_bytes(raw)
    seen = [(f["WARC-Record-ID"], body) for a in range(0, len(raw), step) for f, body in warc.records_in(str(path), a, min(a + step, len(raw)))]
    assert seen == [(f"<urn:page:{i}>", b"\x1f\x8b\x08" + p) for i, p in enumerate(payloads)]


@pytest.mark.parametrize("length", [7, 64, 65, 2048])
def test_range_hashes_tell_strings_apart(length):
    """Thue and Morse's strings, which agree modulo 2^64, and all windows of a random one."""
    a, b = b"a", b"b"
    while len(a) < length:
        a, b = a + b, b + a
    raw = np.frombuffer(a + b, np.uint8)
    both = K.RangeHash(raw).of(np.array([0, len(a)]), np.array([length, len(a) + length]))
    assert both[0] != both[1]
    some = np.random.default_rng(3).integers(97, 99, 6000, dtype=np.uint8)
    some[3000:] = some[:3000]
    start = np.arange(len(some) - length + 1)
    names = K.RangeHash(some).of(start, start + length)
    plain = [some[i : i + length].tobytes() for i in start]
    assert len(set(zip(names.tolist(), plain, strict=True))) == len(set(names.tolist())) == len(set(plain))


def test_a_cluster_must_name_the_shared_folder():
    from types import SimpleNamespace

    from sievework.llm import store

    unset = SimpleNamespace(get=lambda *_: None)
    context = lambda master: SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master=master))
    assert store.shared_dir(context("local[2]")).startswith("file://")
    with pytest.raises(ValueError):
        store.shared_dir(context("spark://host:7077"))
