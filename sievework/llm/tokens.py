"""Token ids by the ``tokenizers`` library, each distinct piece of text encoded once.

The library's BPE never merges across the pieces of its pre-tokenizer, so a text's ids are its
pieces' ids in a row. A block's pieces are found by array operations on code point classes, named by
fingerprints, and only pieces that the worker has not met are given to the library. Texts in which
normalisation could move a piece's bounds, or that hold an added token's literal or a code point of no known
class, are given to it whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from sievework.llm import textkit as K

#: Pieces that a worker remembers before it starts anew.
CACHE_PIECES = 2_000_000

_SPACE, _LETTER, _NUMBER, _OTHER, _UNASSIGNED = 0, 1, 2, 3, 4
#: White space of the Unicode standard; fixed values.
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Contractions that are pieces of their own; fixed values.
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_kinds: dict[str, np.ndarray] = {}


def _kind_of(points: np.ndarray) -> np.ndarray:
    """The class of each code point, looked up in a table that fills as code points are met."""
    table = _kinds.setdefault("table", np.full(0x110000, 255, np.uint8))
    found = table[points]
    if (found == 255).any():
        for p in np.unique(points[found == 255]).tolist():
            major = unicodedata.category(chr(p))[0]
            table[p] = _SPACE if p in _WHITE else _LETTER if major == "L" else _NUMBER if major == "N" else _UNASSIGNED if unicodedata.category(chr(p)) == "Cn" else _OTHER
        found = table[points]
    return found


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of valid UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    return np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), at


def unassigned(buf: np.ndarray) -> bool:
    """Whether a code point is none of this Python's Unicode version; the library's may be a later one, so its class isn't known."""
    return bool((buf >= 0x80).any()) and bool((_kind_of(code_points(buf)[0]) == _UNASSIGNED).any())


def letters(buf: np.ndarray) -> np.ndarray:
    """Which bytes begin a letter of any alphabet."""
    points, at = code_points(buf)
    out = np.zeros(len(buf), bool)
    out[at[_kind_of(points) == _LETTER]] = True
    return out


def pieces(buf: np.ndarray, off: np.ndarray, byte_level: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds of the pre-tokenizer's pieces, in order.

    byte_level: a space before a run belongs to it, runs of digits are one piece and white space is
    kept; otherwise white space goes, each digit is a piece, and contractions are in either case.
    """
    points, at = code_points(buf)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.minimum(_kind_of(points), _OTHER)
    bound = np.zeros(n + 1, bool)
    bound[np.searchsorted(at, off)] = True  # documents begin there
    change = np.concatenate(([True], kind[1:] != kind[:-1], [True])) | bound
    start = np.flatnonzero(change)[:-1]
    end = np.flatnonzero(change)[1:]
    kinds = kind[start]
    # Contractions: a lone apostrophe run, then letters; the letters' run begins after the suffix.
    quote = (kinds == _OTHER) & (end - start == 1) & (points[start] == 0x27)
    quote[-1:] = False
    if byte_level:
        led = (start > 0) & ~bound[start] & (points[np.maximum(start - 1, 0)] == 0x20)
        quote &= ~led
    which = np.flatnonzero(quote)
    which = which[(kinds[which + 1] == _LETTER) & ~bound[start[which + 1]]] if len(which) else which
    taken = np.zeros(len(start), np.int64)
    if len(which):
        s = start[which + 1]
        room = end[which + 1] - s
        one = points[s] if byte_level else points[s] | 0x20
        two = points[np.minimum(s + 1, n - 1)]
        two = two if byte_level else two | 0x20
        for suffix in _CONTRACTIONS:
            text = suffix[1:]
            fits = (room >= len(text)) & (one == ord(text[0])) & (taken[which + 1] == 0)
            if len(text) == 2:
                fits &= two == ord(text[1])
            taken[which[fits] + 1] = len(text)
    joined = np.concatenate((taken[1:] > 0, [False]))
    first, last = start.copy(), end.copy()
    last[joined] += taken[1:][joined[:-1]]
    first += taken
    solid = kinds != _SPACE
    if byte_level:
        # A white run followed by a solid run gives its last space to it, and stays alone otherwise.
        follows = np.zeros(len(start), bool)
        follows[:-1] = ~solid[:-1] & solid[1:] & ~bound[end[:-1]]
        gives = follows & (points[end - 1] == 0x20)
        last[gives] -= 1
        receives = np.concatenate(([False], gives[:-1]))
        first[receives] -= 1
        splits = follows & ~gives & (end - start > 1)
        extra = end[splits] - 1
        last[splits] -= 1
        first, last = np.concatenate((first, extra)), np.concatenate((last, end[splits]))
    else:
        digits = kinds == _NUMBER
        many = np.flatnonzero(kind == _NUMBER)
        keep = solid & ~digits
        first, last = np.concatenate((first[keep], many)), np.concatenate((last[keep], many + 1))
    real = last > first
    first, last = first[real], last[real]
    order = np.argsort(first, kind="stable")
    at = np.append(at, len(buf))
    return at[first[order]], at[last[order]]


class Encoder:
    """A worker's tokenizer with the ids of the pieces that it has met.

    literals: an added token's string in a text is that token, as by the library's default; such texts
    are given to it whole. Otherwise it is plain text.
    """

    _loaded: dict[tuple, Encoder] = {}

    def __init__(self, path: str, literals: bool = True, most: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.path, self.most, self.untouched = path, most, None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if literals else []
        self.literals = re.compile(b"|".join(re.escape(t.encode()) for t in added), re.IGNORECASE) if added else None
        self.byte_level = self.tokenizer.normalizer is None
        self._forget()

    @classmethod
    def of(cls, path: str, **settings: int) -> Encoder:
        key = (cls.__name__, path, *settings.items())
        if key not in cls._loaded:
            cls._loaded[key] = cls(path, **settings)
        return cls._loaded[key]

    def lengths(self) -> np.ndarray:
        """Bytes of each id's token, of a byte-level vocabulary."""
        if not hasattr(self, "_lengths"):
            vocabulary = self.tokenizer.get_vocab()
            self._lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self._lengths[i] = len(token)  # a character stands for a byte
        return self._lengths

    def _bounds(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return pieces(buf, off, self.byte_level)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.names, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, names: np.ndarray, texts: list[str]) -> None:
        """names: sorted fingerprints that are not known yet."""
        if len(self.names) > self.most:
            self._forget()
        new = self._encoded(texts)
        count = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter(chain.from_iterable(new), np.uint32, int(count.sum()))
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate((self.ids, flat))
        place = np.searchsorted(self.names, names)
        self.names, self.first, self.count = (np.insert(x, place, y) for x, y in ((self.names, names), (self.first, first), (self.count, count)))

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in a row, the n+1 bounds of each document's)."""
        start, end = self._bounds(buf, off)
        names = K.RangeHash(buf).of(start, end)
        unique, one, which = np.unique(names, return_index=True, return_inverse=True)
        raw = buf.tobytes()
        if len(self.names) > self.most:
            self._forget()
        unknown = np.flatnonzero(~self._known(unique))
        if len(unknown):
            self._learn(unique[unknown], [raw[start[i] : end[i]].decode() for i in one[unknown]])
        place = np.searchsorted(self.names, unique)
        first, count = self.first[place][which], self.count[place][which]
        bounds = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.repeat(first - bounds[:-1], count) + np.arange(bounds[-1])]
        doc_bounds = bounds[np.searchsorted(start, off)]
        return self._whole_where_needed(raw, off, ids, doc_bounds)

    def _known(self, names: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
        return self.names[place] == names if len(self.names) else np.zeros(len(names), bool)

    def _moves(self, text: str) -> bool:
        """Whether normalisation could move a piece's bounds."""
        return not self.byte_level and (not unicodedata.is_normalized("NFC", text) or "İ" in text)

    def _given(self, literal: bool):  # noqa: ANN202
        """The tokenizer for a whole text; that of literals is loaded when one is met."""
        if literal and self.untouched is None:
            self.untouched = type(self.tokenizer).from_file(self.path)
        return self.untouched if literal else self.tokenizer

    def _whole_where_needed(self, raw: bytes, off: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        literal, unsure = self.literals is not None and self.literals.search(raw) is not None, unassigned(np.frombuffer(raw, np.uint8))
        if not literal and not unsure and (self.byte_level or not self._moves(raw.decode())):
            return ids, bounds
        parts = []
        for d in range(len(off) - 1):
            one = raw[off[d] : off[d + 1]]
            found = literal and self.literals.search(one) is not None
            if found or (unsure and unassigned(np.frombuffer(one, np.uint8))) or self._moves(one.decode()):
                parts.append(np.array(self._given(found).encode(one.decode(), add_special_tokens=False).ids, np.uint32))
            else:
                parts.append(ids[bounds[d] : bounds[d + 1]])
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


class PieceEncoder(Encoder):
    """The same of a sentence-piece BPE over space + text, the space being the one that the library adds.

    No piece of the vocabulary has a space after another character, so texts are cut before each run of
    spaces. A cut whose pieces' bytes aren't its own gets the one id ``lost``. The library takes an empty text for
    no piece at all, so a lone space, which ends a text, is its own piece's id.
    """

    lost = np.uint32(0xFFFFFFFF)

    def __init__(self, path: str, most: int = CACHE_PIECES):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.tokenizer.id_to_piece(i) for i in range(self.tokenizer.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.tokenizer.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        if any("\u2581" in p.lstrip("\u2581") for p in pieces):
            raise ValueError("pieces of this vocabulary run over spaces")
        self.byte_level, self.literals, self.most = True, None, most
        self.space = self.tokenizer.piece_to_id("\u2581")
        self._forget()

    def lengths(self) -> np.ndarray:
        if not hasattr(self, "_lengths"):
            self._lengths = np.array([len(b) for b in self.bytes], np.int64)
        return self._lengths

    def _bounds(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = buf == 0x20
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[off[:-1][np.diff(off) > 0]] = True
        start = np.flatnonzero(first)
        return start, np.append(start[1:], len(buf))[: len(start)]

    def _whole_where_needed(self, raw: bytes, off: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ids, bounds  # spaces are the same in all versions

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        found = [ids if t != " " else [self.space] for t, ids in zip(texts, self.tokenizer.encode([t[1:] for t in texts], num_threads=1), strict=True)]
        return [ids if b"".join([self.bytes[i] for i in ids]) == t.encode() else [0xFFFFFFFF] for t, ids in zip(texts, found, strict=True)]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each document."""
    n = len(bounds) - 1
    out = np.insert(ids, bounds[1:], np.full(n, end, np.uint32))
    return out, bounds + np.arange(n + 1)


def encoded_blocks(batches: Iterator[pa.RecordBatch], path: str, end: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, bounds) of blocks of documents, each document's ids with its end id."""
    encoder = Encoder.of(path)
    for rows, buf, off in K.blocks(batches, text):
        yield rows, *with_end(*encoder.encode(buf, off), end)


def crc32(ids: np.ndarray) -> int:
    """Of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
