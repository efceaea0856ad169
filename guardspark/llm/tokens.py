"""Byte-level BPE over pre-tokens, cut and looked up as arrays.

The ids always come from the tokenizers library. A byte-level BPE merges
inside one pre-token only, so each distinct pre-token needs the library
once. A slice of texts is cut into pre-tokens by array operations on its
bytes (the pattern of byte-level BPE, see :func:`cut`), pre-tokens are named
by two 64-bit hashes, and the distinct ones are looked up in a sorted, bounded
cache; those that are new are merged by the library's own model. Character
classes depend on the Unicode version, so they are proven against the library
(:func:`proven_classes`). A text that holds a special string, and any
tokenizer of another kind, go through the library whole.

The tokenizer file is read on the driver and shipped as text, so workers
need no path.
"""
from __future__ import annotations

import json
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat, segment_hash

CACHE_ENTRIES = 1_000_000     # per worker (no result depends on it)
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
_WHITE = (9, 10, 11, 12, 13, 0x85)
_SURROGATES = (0xD800, 0xE000)        # no characters


def _classes(limit: int = 0x110000) -> np.ndarray:
    """Character class of every code point, as this Python's Unicode has it."""
    kind = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(limit)], np.uint8)
    out[list(_WHITE)] = SPACE
    return out


LATIN = 0x250                         # below it no class has changed with the Unicode version
_LATIN_CLASSES = _classes(LATIN)
_ASCII = np.concatenate([_LATIN_CLASSES[:128], np.zeros(128, np.uint8)])
_BEYOND = 0xC0 | LATIN >> 6           # first byte of what lies above


def proven_classes(pieces) -> np.ndarray:
    """Character classes that agree with the library's. ``pieces(text)`` gives
    the borders of its pre-tokens: characters of one class are one pre-token
    together, so every class is put to the proof as one text, and what the
    library cuts out of it is asked for one by one."""
    out = _classes()
    sample = {LETTER: "a", NUMBER: "1", OTHER: "!"}

    def is_kind(point: int, kind: int) -> bool:
        return len(pieces(sample[kind] + chr(point) + sample[kind])) == 1

    real = np.ones(len(out), bool)
    real[slice(*_SURROGATES)] = False
    doubtful = np.flatnonzero((out == SPACE) & (np.arange(len(out)) != 32)).tolist()
    for kind in sample:
        points = np.flatnonzero((out == kind) & real)
        for lo, hi in pieces("".join(map(chr, points.tolist()))):
            if not is_kind(int(points[lo]), kind):
                doubtful += points[lo:hi].tolist()
    for point in doubtful:
        out[point] = next((k for k in sample if is_kind(point, k)), SPACE)
    return out


def byte_classes(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    c = _ASCII[data]
    for low, high, more in ((0xC0, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xFF, 3)):
        lead = np.flatnonzero((data >= low) & (data <= high))
        if len(lead):
            point = data[lead].astype(np.int64) & (0x3F >> more)
            for i in range(1, more + 1):
                point = point << 6 | (data[lead + i] & 0x3F)
            kind = classes[point]
            for i in range(more + 1):
                c[lead + i] = kind
    return c


def cut(data: np.ndarray, off: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Start positions of the pre-tokens of the texts data[off[i]:off[i+1]]
    (each ends where the next starts), by character ``classes``.

    Runs of letters, numbers and other characters are pre-tokens; a plain
    space right before one belongs to it. Of white space before one, the last
    character is cut off (joined if it is a plain space, else alone). A lone
    apostrophe that no space joins takes s, t, m, d, re, ve or ll behind it.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    c = byte_classes(data, classes)
    first = np.zeros(n + 1, bool)               # a text begins here
    first[off] = True
    new = first[:n].copy()
    new[0] = True
    new[1:] |= c[1:] != c[:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    kind = c[begin]
    # White space with something behind it in the same text.
    w = np.flatnonzero((kind == SPACE) & ~first[end] & (end < n))
    last = end[w] - 1                                             # its last character has up to three bytes
    tail = np.where(data[last] < 0x80, last, np.where(data[np.maximum(last - 1, 0)] >= 0xC0, last - 1, last - 2))
    plain = data[end[w] - 1] == 32
    start = np.zeros(n, bool)
    start[begin] = True
    start[tail] = True
    start[end[w][plain]] = False                                  # the run behind begins at the space
    joined = np.zeros(n + 1, bool)
    joined[end[w][plain]] = True
    a = np.flatnonzero((data[begin] == 39) & (end - begin == 1) & ~joined[begin])
    a = a[(a + 1 < len(begin))]
    a = a[(kind[a + 1] == LETTER) & ~first[begin[a + 1]]]
    if len(a):
        at, room = begin[a + 1], end[a + 1] - begin[a + 1]
        x, y = data[at], data[np.minimum(at + 1, n - 1)]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = (room >= 2) & (((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
        take = np.where(one, 1, np.where(two, 2, 0))
        at, room, take = at[take > 0], room[take > 0], take[take > 0]
        start[at] = False
        start[(at + take)[room > take]] = True
    return np.flatnonzero(start)


def _byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte:
    itself where Latin-1 prints it, else the next from U+0100 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


_ALPHABET = _byte_alphabet()


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Known:
    """Pre-tokens met so far, sorted by hash: a second hash, and where their
    ids lie in one flat array."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.h1, self.h2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.n, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = np.zeros(0, np.uint32)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of each hash pair, -1 where it is new."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        i = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        ok = (self.h1[i] == h1) & (self.h2[i] == h2)
        self.used[i[ok]] = True
        return np.where(ok, i, -1)

    def shrink(self):
        """Too many: keep those that were asked for again since the last
        time, or start again if that is no less than half."""
        if len(self.h1) <= CACHE_ENTRIES:
            return
        keep = self.used
        if 2 * keep.sum() > CACHE_ENTRIES:
            return self.clear()
        n, at = self.n[keep], self.at[keep]
        new = np.concatenate([[0], np.cumsum(n)])
        self.ids = self.ids[np.repeat(at - new[:-1], n) + np.arange(new[-1])]
        self.h1, self.h2, self.n, self.at = self.h1[keep], self.h2[keep], n, new[:-1]
        self.used = np.zeros(len(n), bool)

    def add(self, h1, h2, ids: list[list[int]]):
        n = np.array([len(x) for x in ids], np.int64)
        at = len(self.ids) + np.cumsum(n) - n
        self.ids = np.concatenate([self.ids, np.array([y for x in ids for y in x], np.uint32)])
        place = np.searchsorted(self.h1, h1)
        self.h1, self.h2 = np.insert(self.h1, place, h1), np.insert(self.h2, place, h2)
        self.at, self.n = np.insert(self.at, place, at), np.insert(self.n, place, n)
        self.used = np.insert(self.used, place, False)


class Pretokens:
    """Encodes or counts texts; one per worker process and tokenizer."""

    _made: dict = {}

    @classmethod
    def of(cls, spec: str) -> "Pretokens":
        if spec not in cls._made:
            cls._made.clear()
            cls._made[spec] = cls(spec)
        return cls._made[spec]

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark spreads the work
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        j = json.loads(spec)
        pre = j.get("pre_tokenizer") or {}
        self.by_pretoken = (
            j.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and j["model"].get("type") == "BPE" and not j["model"].get("dropout"))
        self.special = [a["content"] for a in j.get("added_tokens") or []]
        self.all_classes: np.ndarray | None = None
        self.known = Known()
        self.proven: tuple | None = None

    def _classes_for(self, data: np.ndarray) -> np.ndarray:
        """Classes of all characters, worked out when a text first needs them."""
        if not (data >= _BEYOND).any():
            return _LATIN_CLASSES
        if self.all_classes is None:
            self.all_classes = proven_classes(lambda t: [x[1] for x in self.tok.pre_tokenizer.pre_tokenize_str(t)])
        return self.all_classes

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the library's merges on its byte alphabet."""
        return [t.id for t in self.tok.model.tokenize(piece.decode("latin-1").translate(_ALPHABET))]

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts have to go through the library whole."""
        if not self.by_pretoken:
            return np.ones(len(texts), bool)
        out = np.zeros(len(texts), bool)
        for s in self.special:
            out |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return out

    def _cut(self, texts: pa.Array):
        """(pre-token starts and ends, their texts' borders, bytes) of the
        texts that are cut; whole texts have no pre-tokens here."""
        data, off = flat(texts)
        whole = self._whole(texts)
        if whole.any():
            keep = pc.if_else(pa.array(whole), "", texts)
            data, off = flat(keep.combine_chunks() if isinstance(keep, pa.ChunkedArray) else keep)
        start = cut(data, off, self._classes_for(data)) if self.by_pretoken else np.zeros(0, np.int64)
        return data, start, np.append(start[1:], len(data)), np.searchsorted(start, off), np.flatnonzero(whole)

    def _names(self, data, start, end):
        return segment_hash(data, start, end, 0), segment_hash(data, start, end, 1)

    def _places(self, data, start, end, at, h1, h2) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``known`` of the distinct pre-tokens among those ``at``,
        the new ones merged and added, and which of them each one is."""
        self.known.shrink()
        order = np.argsort(h1)
        ranked = h1[order]
        new_run = np.ones(len(order), bool)
        new_run[1:] = ranked[1:] != ranked[:-1]
        distinct, example = ranked[new_run], order[new_run]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new_run) - 1
        second = h2[example]
        if not (h2 == second[inverse]).all():
            raise ValueError("two pre-tokens share a 64-bit hash")       # 2**-64 a pair
        place = self.known.find(distinct, second)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw, first = data.tobytes(), at[example[new]]
            self.known.add(distinct[new], second[new],
                           [self._merge(raw[a:b]) for a, b in zip(start[first].tolist(), end[first].tolist())])
            place = self.known.find(distinct, second)
        return place, inverse

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, borders): text i has ids[borders[i]:borders[i+1]]."""
        data, start, end, first, whole = self._cut(texts)
        place, inverse = self._places(data, start, end, np.arange(len(start)), *self._names(data, start, end))
        n, at = self.known.n[place][inverse], self.known.at[place][inverse]
        out = np.concatenate([[0], np.cumsum(n)])
        ids = self.known.ids[np.repeat(at - out[:-1], n) + np.arange(out[-1])]
        borders = out[first]
        if len(whole):
            parts = [ids[a:b] for a, b in zip(borders, borders[1:])]
            for i, x in zip(whole, self._library([texts[int(i)].as_py() for i in whole])):
                parts[i] = np.array(x, np.uint32)
            borders = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, borders

    def count(self, texts: pa.Array, proven: list[bytes]) -> np.ndarray:
        """Number of ids of each text. A pre-token among ``proven`` counts
        one and is not merged."""
        if self.proven is None:
            raw = np.frombuffer(b"".join(proven), np.uint8)
            size = np.array([len(p) for p in proven], np.int64)
            h1, h2 = self._names(raw, np.cumsum(size) - size, np.cumsum(size))
            order = np.argsort(h1)
            self.proven = h1[order], h2[order]
        data, start, end, first, whole = self._cut(texts)
        h1, h2 = self._names(data, start, end)
        p1, p2 = self.proven
        i = np.minimum(np.searchsorted(p1, h1), len(p1) - 1) if len(p1) else None
        rest = np.flatnonzero((p1[i] != h1) | (p2[i] != h2)) if len(p1) else np.arange(len(h1))
        n = np.ones(len(h1), np.int64)
        place, inverse = self._places(data, start, end, rest, h1[rest], h2[rest])
        if len(rest):
            n[rest] = self.known.n[place][inverse]
        out = np.diff(np.concatenate([[0], np.cumsum(n)])[first])
        if len(whole):
            out[whole] = [len(x) for x in self._library([texts[int(i)].as_py() for i in whole])]
        return out

    def whole_tokens(self) -> list[bytes]:
        """The vocabulary strings proven to encode alone as one token: each
        is one pre-token, and the library returns just its own id for it."""
        if not self.by_pretoken:
            return []
        vocab = self.tok.get_vocab(with_added_tokens=False)
        ids = list(vocab.values())
        texts = self.tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
        arr = pa.array(texts, pa.string())
        _, _, _, first, whole = self._cut(arr)
        one = np.diff(first) == 1
        one[whole] = False
        alone = [(ids[i], texts[i]) for i in np.flatnonzero(one)]
        got = self._library([t for _, t in alone])
        return [t.encode() for (i, t), g in zip(alone, got) if g == [i]]
