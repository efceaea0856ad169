"""Benchmark decontamination with an FM-index per shard of the training texts.

Texts and items become words; a window is ``window`` consecutive words of an
item (a shorter item is one window). Words of items are numbered, every other
word is one further symbol, and a shard of texts is one string of symbols
with a separator after each piece of text. In a task, per shard:

* the suffix array is built by doubling (only suffixes that are not yet apart
  are sorted again), and from it the Burrows-Wheeler transform;
* the transform is kept as a **wavelet tree** (level by level, with rank
  counts), which gives the rank of any symbol in as many steps as the symbols
  have bits;
* all windows are found at once by **backward search** from their last word;
* occurrences are **located** by walking back to the nearest sampled suffix
  position (every SAMPLE-th word of a piece);
* the words of all occurrences are merged into removal spans.

Shards hold about SHARD_BYTES of text. A longer text is cut into pieces of
PIECE_WORDS that overlap by window - 1 words, so that no occurrence is lost
and memory does not follow the longest text.

Items are taken in blocks of bounded size (normally one) that are sent to the
tasks; with more, the spans of the earlier blocks travel with the texts.

Edge cases: null, empty and word-free texts have no words and no hits; items
without words are nowhere; items with a null id take no part; rows that share
an item id are one item with several texts; rows of ``docs`` are documents,
so repeated rows and null ids keep theirs; with an empty item table nothing is
hit; other columns are ignored. Words are compared by 64-bit hashes.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, at_least_slots, slices, text_column
from .terms import item_blocks, lookup, text_terms

WINDOW = 10
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 2 << 20
PIECE_WORDS = 1 << 18
SAMPLE = 16
BITS = 20                       # of a place in a shard
FOUND = "doc_id long, _text string, n_words long, starts array<int>, ends array<int>, items array<string>"


# --- the index ------------------------------------------------------------------

def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order. Separators (0) count as different
    symbols that rise with their place; the last symbol is one."""
    n = len(sym)
    bits = max(1, int(sym.max()).bit_length())
    h = max(1, min(8, (63 - BITS) // bits))
    places = np.arange(n, dtype=np.int64)
    key, closed = np.zeros(n, np.int64), np.zeros(n, bool)
    for j in range(h):                                     # h symbols, up to the first separator
        nxt = np.zeros(n, np.int64)
        nxt[:n - j] = sym[j:]
        key = key << bits | np.where(closed, 0, nxt)
        closed |= nxt == 0
    order = np.sort(key << BITS | places)
    sa = order & ((1 << BITS) - 1)
    first = np.ones(n, bool)                               # of a group of suffixes that are not apart yet
    first[1:] = (order[1:] >> BITS != order[:-1] >> BITS) | closed[sa[1:]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, places, 0))
    while True:
        alone = first & np.concatenate([first[1:], [True]])
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return sa
        at = sa[rows]
        order = np.sort((rank[at] << BITS | rank[at + h]) << BITS | at)
        at = order & ((1 << BITS) - 1)
        sa[rows] = at
        pair = order >> BITS
        first[rows[1:]] = pair[1:] != pair[:-1]
        first[rows[0]] = True
        rank[at] = np.maximum.accumulate(np.where(first[rows], rows, 0))
        h *= 2


class WaveletTree:
    """Rank and access over symbols, a level per bit; each level keeps how many
    zeros precede every place."""

    def __init__(self, sym: np.ndarray, bits: int):
        self.bits, self.zeros = bits, []
        for level in range(bits - 1, -1, -1):
            bit = (sym >> level & 1).astype(bool)
            before = np.zeros(len(sym) + 1, np.int32)
            np.cumsum(~bit, out=before[1:])
            self.zeros.append(before)
            sym = np.concatenate([sym[~bit], sym[bit]])

    def down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the first ``place`` entries end on the last level, going the
        way of ``symbol``; rank = down(symbol, place) - down(symbol, 0)."""
        for level, before in zip(range(self.bits - 1, -1, -1), self.zeros):
            z = before[place]
            place = np.where(symbol >> level & 1, before[-1] + place - z, z)
        return place

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, its place on the last level)."""
        symbol = np.zeros(len(place), np.int64)
        for before in self.zeros:
            z = before[place]
            bit = before[place + 1] == z
            place = np.where(bit, before[-1] + place - z, z)
            symbol = symbol << 1 | bit
        return symbol, place


class FMIndex:
    """Counts and places of patterns in a string of symbols (0: separator, and
    the last symbol; patterns never hold it). ``sampled`` marks the places
    that walks end at, the first of every piece among them."""

    def __init__(self, sym: np.ndarray, sampled: np.ndarray):
        if len(sym) >= 1 << BITS:
            raise ValueError(f"a shard holds fewer than {1 << BITS} symbols")
        self.n = len(sym)
        sa = suffix_array(sym)
        size = int(sym.max()) + 1
        self.bits = max(1, (size - 1).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=size))])
        self.tree = WaveletTree(sym[sa - 1], self.bits)
        self.base = self.tree.down(np.arange(size), np.zeros(size, np.int64))
        self.marked = sampled[sa]
        self.kept = np.concatenate([[0], np.cumsum(self.marked)])
        self.places = sa[self.marked]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals (lo, hi) of the suffixes that start with each pattern;
        pattern i is ``patterns[i, -lengths[i]:]``. Backward, all at once."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.flatnonzero(lengths > 0)
        width = patterns.shape[1]
        for step in range(1, width + 1):
            live = live[lengths[live] >= step]
            c = patterns[live, width - step]
            known = c < len(self.base)
            lo[live[~known]], hi[live[~known]] = 0, 0
            live, c = live[known], c[known]
            from_ = self.before[c] - self.base[c]
            lo[live] = from_ + self.tree.down(c, lo[live])
            hi[live] = from_ + self.tree.down(c, hi[live])
            live = live[lo[live] < hi[live]]
        dead = lo >= hi
        lo[dead], hi[dead] = 0, 0
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places of suffixes, by walking back to sampled ones."""
        row, steps, out = row.copy(), np.zeros(len(row), np.int64), np.empty(len(row), np.int64)
        walking = np.arange(len(row))
        while len(walking):
            here = row[walking]
            done = self.marked[here]
            out[walking[done]] = self.places[self.kept[here[done]]] + steps[walking[done]]
            walking = walking[~done]
            symbol, place = self.tree.access(row[walking])
            row[walking] = self.before[symbol] + place - self.base[symbol]
            steps[walking] += 1
        return out


# --- windows and shards ---------------------------------------------------------

class Windows:
    """The distinct windows of a block of items, as symbol rows (padded in
    front), with the items of each."""

    def __init__(self, block: list, window: int):
        words, owners = [], []
        for item, text in block:
            if item is not None:
                words.append(text_terms(pa.array([text], pa.string()))[0])
                owners.append(str(item))
        self.names = np.array(sorted(set(owners)), object)           # by code point, as the items of a document are listed
        number = {x: i for i, x in enumerate(self.names)}
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        rows, items = [], []
        for w, owner in zip(words, owners):
            s = np.searchsorted(self.vocabulary, w) + 2
            if len(s):
                m = min(window, len(s))
                rows.append(np.pad(np.lib.stride_tricks.sliding_window_view(s, m), ((0, 0), (window - m, 0))))
                items.append(np.full(len(s) - m + 1, number[owner]))
        every = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
        self.rows, at = np.unique(every, axis=0, return_inverse=True)
        self.lengths = (self.rows > 0).sum(axis=1)
        pairs = np.unique(np.stack([at.reshape(-1), np.concatenate(items)]), axis=1) if rows else np.zeros((2, 0), np.int64)
        self.first, self.items = np.searchsorted(pairs[0], np.arange(len(self.rows) + 1)), pairs[1]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """From 2 on for words of the items, 1 for every other word."""
        return np.maximum(lookup(self.vocabulary, hashes) + 2, 1)

    def items_of(self, windows: np.ndarray) -> list[str]:
        got = np.unique(np.concatenate([self.items[self.first[w]:self.first[w + 1]] for w in np.unique(windows)]))
        return self.names[got].tolist()


def pieces(first: np.ndarray, words: int, overlap: int):
    """(doc, lo, hi) of the texts' words, texts over ``words`` cut."""
    out = []
    for d in range(len(first) - 1):
        lo, end = int(first[d]), int(first[d + 1])
        while lo < end:
            hi = min(lo + words, end)
            out.append((d, lo, hi))
            lo = end if hi == end else hi - overlap
    return out


def shards(parts: list, limit: int):
    """Runs of pieces with at most ``limit`` symbols, separators included."""
    run, size = [], 0
    for p in parts:
        need = p[2] - p[1] + 1
        if run and size + need > limit:
            yield run
            run, size = [], 0
        run.append(p)
        size += need
    if run:
        yield run


def occurrences(symbols: np.ndarray, shard: list, windows: Windows, sample: int = SAMPLE):
    """(window, place) of all occurrences in one shard: numbers of windows and
    of words."""
    lo, length = np.array([p[1] for p in shard]), np.array([p[2] - p[1] for p in shard])
    begin = np.cumsum(length + 1) - (length + 1)                     # of each piece in the shard's string
    inside = np.arange(int((length + 1).sum())) - np.repeat(begin, length + 1)
    source = np.repeat(lo, length + 1) + inside
    last = np.repeat(length, length + 1) == inside
    sym = np.where(last, 0, symbols[np.minimum(source, len(symbols) - 1)])
    index = FMIndex(sym, inside % sample == 0)
    a, b = index.search(windows.rows, windows.lengths)
    count = b - a
    which = np.repeat(np.arange(len(a)), count)
    rows = np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    return which, source[index.locate(rows)]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that touch or overlap as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.concatenate([new[1:], [True]])] if len(starts) else ends


def _scan(shared, piece_words: int, keep_text: bool):
    def run(batches):
        w = shared.value
        overlap = w.rows.shape[1] - 1
        limit = (1 << BITS) - 1
        for batch in batches:
            ids, texts = batch.column(0), text_column(batch, "_text")
            old = [batch.column(c).to_pylist() for c in ("starts", "ends", "items")]
            for lo, hi in slices(texts, SHARD_BYTES):
                part = texts.slice(lo, hi - lo)
                h, _, _, first = text_terms(part)
                symbols = w.symbols(h)
                found = [occurrences(symbols, s, w) for s in shards(pieces(first, piece_words, overlap), limit)] if len(w.rows) else []
                which = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.int64)
                place = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.int64)
                doc = np.searchsorted(first, place, side="right") - 1
                order = np.argsort(doc, kind="stable")
                which, place, doc = which[order], place[order], doc[order]
                border = np.searchsorted(doc, np.arange(hi - lo + 1))
                rows = [list(x[lo:hi]) for x in old]
                for d in np.flatnonzero(np.diff(border)):
                    at = slice(border[d], border[d + 1])
                    s = place[at] - first[d]
                    s, e = merged(np.concatenate([np.array(rows[0][d], np.int64), s]),
                                  np.concatenate([np.array(rows[1][d], np.int64), s + w.lengths[which[at]]]))
                    rows[0][d], rows[1][d] = s.tolist(), e.tolist()
                    rows[2][d] = sorted({*rows[2][d], *w.items_of(which[at])})
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), part if keep_text else pa.nulls(hi - lo, pa.string()), pa.array(np.diff(first)),
                     *(pa.array(x, pa.list_(pa.int32())) for x in rows[:2]), pa.array(rows[2], pa.list_(pa.string()))],
                    names=["doc_id", "_text", "n_words", "starts", "ends", "items"])

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                  piece_words: int = PIECE_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, spans (array of start, end: words from
    start up to, not including, end), n_hit (words in spans), items (ids as
    strings, sorted)."""
    spark = docs.sparkSession
    stage = Stage(spark, "fm-index")
    empty = [F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("ends"),
             F.array().cast("array<string>").alias("items")]
    rows = at_least_slots(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"), *empty)
    blocks = item_blocks(spark, items, item_col, item_text_col, block_bytes)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        shared = spark.sparkContext.broadcast(Windows(block, window))
        rows = rows.select("doc_id", "_text", "starts", "ends", "items").mapInArrow(_scan(shared, piece_words, after is not None), FOUND)
        if after is not None:
            rows = stage.put(rows, "scanned")
        block = after
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "n_words", spans.alias("spans"), n_hit.alias("n_hit"), "items")
