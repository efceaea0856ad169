"""Best-fit packing by exact-complement hashing.

Pieces have at most ``capacity`` tokens, so the plan needs their length
histogram only: at most ``capacity`` counts, whatever the corpus. The plan
is a list of patterns (lengths that share one sequence) with multiplicities:

1. exact complements: for each length, largest first, the gap it leaves is
   looked up among the available single lengths, then pair sums, then triple
   sums; a combination that fills the gap exactly is consumed as often as
   the counts allow. Each consumption uses one length up, each failed search
   is final, so the plan is short.
2. the residual lengths are packed best-fit decreasing, whole classes of
   equal gaps at a time.

Pieces get their places without gathering a length anywhere: a piece's rank
among its length is its rank inside its writing task plus the counts of the
tasks before, and ranks map to sequences by the plan's intervals. A length
that a third of all pieces have is therefore no hot group.

Edge cases: null and empty texts are documents of the end id alone; rows are
packed one by one, so repeated rows keep a place each, and null ids too; an
empty table gives an empty result; other columns are ignored. Only documents
above the capacity are cut, into full pieces after a first one that may be
shorter.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, at_least_slots, slices, text_column
from .token_codec import with_end
from .tokens import Pretokens, read_tokenizer

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


# --- plan ---------------------------------------------------------------------

def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (multiplicity, [(length, repeats), ...]); ``counts[l]``:
    pieces of length l, for l from 0 to the capacity (0 unused). Exact fills
    can use up small lengths that the rest would need, so they are tried with
    up to one, two and three complements; the plan with the fewest sequences
    counts (among equals the one with the most exact fills)."""
    plans = [_plan(counts, capacity, sizes) for sizes in ((1, 2, 3), (1, 2), (1,))]
    return min(plans, key=lambda p: sum(times for times, _ in p))


def _plan(counts: np.ndarray, capacity: int, sizes):
    left = counts.astype(np.int64).copy()
    left[0] = 0
    patterns = []

    def consume(lengths):
        uses = {x: lengths.count(x) for x in lengths}
        times = min(left[x] // k for x, k in uses.items())
        for x, k in uses.items():
            left[x] -= times * k
        patterns.append((int(times), sorted(uses.items(), reverse=True)))

    if left[capacity]:
        consume([capacity])
    for size in sizes:
        for a in range(capacity - 1, 0, -1):
            while left[a]:
                left[a] -= 1
                gap = _complement(left, capacity - a, size, a)
                left[a] += 1
                if gap is None:
                    break
                consume([a, *gap])
    return patterns + _best_fit(left, capacity)


def _complement(left: np.ndarray, gap: int, size: int, at_most: int):
    """Available lengths, ``size`` of them, that sum to ``gap``; larger ones
    first, none above ``at_most``."""
    top = min(gap - size + 1, at_most)
    if gap < size or top * size < gap:
        return None
    if size == 1:
        return [gap] if left[gap] else None
    if size == 2:
        b = np.arange(-(-gap // 2), top + 1)
        ok = (left[b] > 0) & (left[gap - b] > (gap - b == b))
        return [int(b[ok][-1]), int(gap - b[ok][-1])] if ok.any() else None
    some = (left[:gap] > 0).astype(np.float32)
    sums = np.convolve(some, some)[:gap] > 0.5                 # pair sums there may be
    for b in range(top, -(-gap // 3) - 1, -1):
        if left[b] and sums[gap - b]:
            left[b] -= 1
            pair = _complement(left, gap - b, 2, b)
            left[b] += 1
            if pair is not None:
                return [b, *pair]
    return None


def _best_fit(left: np.ndarray, capacity: int):
    """Best-fit decreasing over classes: open[gap] lists (bins, pattern)."""
    open_: dict[int, list] = {}
    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            gap = min((g for g in open_ if g >= a), default=None)
            if gap is None:                                   # new sequences, each as full of this length as it gets
                k = min(n, capacity // a)
                bins = n // k
                _put(open_, capacity - a * k, bins, {a: k})
                n -= bins * k
                continue
            bins, pattern = open_[gap].pop()
            k = min(n, gap // a)
            take = min(bins, n // k)
            if not open_[gap]:
                del open_[gap]
            if take < bins:
                _put(open_, gap, bins - take, pattern)
            _put(open_, gap - a * k, take, pattern | {a: pattern.get(a, 0) + k})
            n -= take * k
    return [(bins, sorted(p.items(), reverse=True)) for classes in open_.values() for bins, p in classes]


def _put(open_, gap, bins, pattern):
    open_.setdefault(gap, []).append((bins, pattern))


class Places:
    """Rank among equal lengths -> (sequence, offset), by the plan."""

    def __init__(self, patterns):
        rows: dict[int, list] = {}
        used: dict[int, int] = {}
        seq = 0
        for times, lengths in patterns:
            offset = 0
            for a, k in lengths:
                rows.setdefault(a, []).append((used.get(a, 0), seq, k, offset))
                used[a] = used.get(a, 0) + times * k
                offset += a * k
            seq += times
        self.sequences = seq
        self.rows = {a: np.array(r, np.int64) for a, r in rows.items()}

    def find(self, lengths: np.ndarray, ranks: np.ndarray):
        seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for a in np.unique(lengths):
            at = np.flatnonzero(lengths == a)
            r = self.rows[int(a)]
            i = np.searchsorted(r[:, 0], ranks[at], side="right") - 1
            rel = ranks[at] - r[i, 0]
            seq[at] = r[i, 1] + rel // r[i, 2]
            off[at] = r[i, 3] + rel % r[i, 2] * a
        return seq, off


# --- Spark --------------------------------------------------------------------

def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """One row per piece with its digest and its rank among the equally long
    pieces of its task."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc = Pretokens.of(shared.value)
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), text_column(b, "_text")
            for lo, hi in slices(texts, 2 << 20):
                out = ([], [], [], [], [], [])
                ids, borders = with_end(*enc.encode(texts.slice(lo, hi - lo)))
                raw, borders = ids.astype("<u4").tobytes(), borders.tolist()
                for i, begin, stop in zip(doc_ids[lo:hi], borders, borders[1:]):
                    n = stop - begin
                    cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    for p, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        crc = zlib.crc32(raw[4 * (begin + s):4 * (begin + e)])
                        for col, v in zip(out, (i, p, s, e - s, crc, int(seen[e - s]))):
                            col.append(v)
                        seen[e - s] += 1
                doc, piece, start, length, crc, nth = out
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                     pa.array(np.full(len(doc), part, np.int32)), pa.array(nth, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = at_least_slots(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    stage = Stage(docs.sparkSession, "packing")
    cut = stage.put(pieces(docs, tokenizer, id_col, text_col, capacity), "pieces")
    per_task = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():      # capacity rows at most
        counts[r["length"]] = r["n"]
    places = docs.sparkSession.sparkContext.broadcast(Places(plan(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = (cut.join(base, ["length", "part"])
                 .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")))

    def run(batches):
        for b in batches:
            seq, off = places.value.find(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32",
                                                    "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                  "sequence_id long, offset long")
