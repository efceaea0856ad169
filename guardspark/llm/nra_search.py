"""Ranked lexical search by NRA (no random access).

Every document is scored for every item by term weights and saturated term
frequencies (integers). The documents are read once to count their terms;
what goes on is, per document, its length and the frequencies of the terms
that occur in items. A task then takes shards of documents of a bounded number
of postings, sorts each term's postings by falling impact, and answers each
item by sequential reads alone:

* all lists of the item are read from the top in parallel, in growing steps;
* a document's **lower** bound is the sum of its impacts read so far, its
  **upper** bound adds, for every list where it was not met yet, the impact at
  which that list stands;
* a document never met can reach the sum of those standing impacts. Once that
  is below the k-th best lower bound no new one can enter, and documents whose
  upper bound is below it leave;
* reading goes on until every document that is left has equal bounds: then
  membership, ties and final scores are all resolved.

The k-th score of the task's earlier shards is a floor for the later ones. The
k best of each task meet in one window per item.

Items are taken in blocks of bounded size (normally one), whose terms are sent
to the tasks; the driver gets their document frequencies only.

Edge cases: null, empty and term-free texts are no hit and do not count in N;
rows of ``docs`` are documents, so repeated rows are ranked each, and null ids
come last among equal scores; rows of ``items`` that share an id are one item
whose terms add up (null is an id); items without terms, and empty tables, give
no rows; other columns are ignored. Scores are exact while they fit a signed
64-bit integer. Terms are compared by 64-bit hashes.
"""
from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, at_least_slots, slices, text_column
from .terms import item_blocks, lookup, text_terms

TOP = 10
BLOCK_BYTES = 8 << 20         # of item texts, sent to the tasks at once
SHARD_POSTINGS = 1 << 21
FIRST_READ = 64               # postings of a list in the first step
CELLS = 1 << 28               # (list, document) flags held at once
POSTINGS = "doc_id long, n long, terms array<int>, tf array<int>"
HITS = "item int, doc_id long, score long"


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) per term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated frequencies of postings, with ``n`` their documents' lengths."""
    m = 100 - 75 + (75 * n * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Documents (numbers below ``n_docs``) that can be among the k best, and
    their final scores: all that score at least the k-th best, or ``floor``
    where that is higher. ``lists``: (documents, impacts) by falling impact."""
    lower = np.zeros(n_docs, np.int64)
    met = np.zeros((len(lists), n_docs), bool)
    left = None                                # documents that are still in question; None: all
    at, step = 0, FIRST_READ
    while True:
        for j, (docs, value) in enumerate(lists):
            d = docs[at:at + step]
            lower[d] += value[at:at + step]
            met[j, d] = True
        at, step = at + step, step * 2
        standing = np.array([value[at] if at < len(value) else 0 for _, value in lists], np.int64)
        unmet = int(standing.sum())
        pool = np.flatnonzero(lower) if left is None else left
        low = lower[pool]
        kth = max(floor, int(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else 0, 1)
        if unmet >= kth:
            continue
        upper = low + unmet - (standing @ met[:, pool] if unmet else 0)
        stay = upper >= kth
        left = pool[stay]
        if (upper[stay] == low[stay]).all():
            return left, low[stay]


class _Best:
    """The k best documents of one item so far (score, then id; null ids last)."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> int:
        return self.rows[-1][0] if len(self.rows) == self.k else 0

    def add(self, ids, null, scores):
        new = [(int(s), bool(x), int(i)) for i, x, s in zip(ids, null, scores)]
        self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1], r[2]))[:self.k]


def _first(scores: np.ndarray, null: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, null, -scores))[:k]


def _within(docs: np.ndarray, value: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """A list's postings of the documents from ``lo`` up to ``hi``, numbered from 0."""
    own = (docs >= lo) & (docs < hi)
    return docs[own] - lo, value[own]


class Shard:
    """Impact-sorted lists of one shard of documents."""

    def __init__(self, ids, null, doc, term, value, n_terms):
        order = np.lexsort((doc, -value, term))
        self.ids, self.null, self.doc, self.value = ids, null, doc[order], value[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def search(self, terms, weights, best: _Best):
        lists = []
        for t, w in zip(terms, weights):
            part = slice(self.start[t], self.start[t + 1])
            if w and part.stop > part.start:
                lists.append((self.doc[part], self.value[part] * w))
        if not lists:
            return
        # An item of very many terms meets the shard's documents in parts.
        step = max(1, CELLS // len(lists))
        for lo in range(0, len(self.ids), step):
            hi = min(lo + step, len(self.ids))
            part = lists if hi - lo == len(self.ids) else [_within(*x, lo, hi) for x in lists]
            docs, scores = nra(part, hi - lo, best.k, best.floor())
            docs = docs + lo
            top = _first(scores, self.null[docs], self.ids[docs], best.k)
            docs = docs[top]
            best.add(self.ids[docs], self.null[docs], scores[top])


def postings(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Per document: its number of terms, and the frequencies of the terms
    whose hash is in the broadcast sorted ``vocabulary``."""
    def run(batches):
        words = vocabulary.value
        for b in batches:
            ids, texts = b.column(0), text_column(b, "_text")
            for lo, hi in slices(texts):
                h, _, _, first = text_terms(texts.slice(lo, hi - lo))
                n = np.diff(first)
                at = lookup(words, h)
                doc = np.repeat(np.arange(hi - lo), n)
                pair, tf = np.unique((doc * (len(words) + 1) + at)[at >= 0], return_counts=True)
                first = pa.array(np.searchsorted(pair, np.arange(hi - lo + 1) * (len(words) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n),
                     pa.ListArray.from_arrays(first, pa.array((pair % (len(words) + 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(first, pa.array(tf.astype(np.int32)))], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")) \
               .mapInArrow(run, POSTINGS)


def _list_values(batch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _search(shared, k: int, shard_postings: int):
    def run(batches):
        items, weights, n_docs, n_terms = shared.value
        best = [_Best(k) for _ in items]
        held: list[tuple] = []

        def answer():
            base = np.cumsum([0] + [len(x[0]) for x in held])
            ids, null, doc, term, value = (np.concatenate([x[i] + base[j] if i == 2 else x[i] for j, x in enumerate(held)])
                                           for i in range(5))
            shard = Shard(ids, null, doc, term, value, len(weights))
            for (terms, times), b in zip(items, best):
                shard.search(terms, times * weights[terms], b)
            held.clear()

        size = 0
        for b in batches:
            n = b.column("n").to_numpy()
            count = b.column("terms").value_lengths().to_numpy()
            some = np.flatnonzero(count)
            doc, tf = np.repeat(np.arange(len(some)), count[some]), _list_values(b, "tf")
            ids = b.column("doc_id")
            held.append((ids.fill_null(0).to_numpy()[some], ids.is_null().to_numpy(zero_copy_only=False)[some], doc,
                         _list_values(b, "terms"), impacts(tf, n[some][doc], n_docs, n_terms)))
            size += len(tf)
            if size >= shard_postings:
                answer()
                size = 0
        if held:
            answer()
        rows = [(i, None if null else doc, score) for i, b in enumerate(best) for score, null, doc in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                          pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    return run


def _block_hits(docs: DataFrame, block: list, stage: Stage, id_col, text_col, k, shard_postings) -> DataFrame:
    spark = docs.sparkSession
    texts: dict = {}
    for i, text in block:
        texts.setdefault(i, Counter()).update(text_terms(pa.array([text], pa.string()))[0].tolist())
    vocabulary = np.array(sorted({t for c in texts.values() for t in c}), np.uint64)
    table = stage.put(postings(docs, spark.sparkContext.broadcast(vocabulary), id_col, text_col), "postings")
    n_docs, n_terms = table.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in table.select(F.explode("terms").alias("t")).groupBy("t").count().collect():     # a row per vocabulary term
        df[r["t"]] = r["count"]
    items = [(np.searchsorted(vocabulary, np.array(sorted(c), np.uint64)), np.array([c[t] for t in sorted(c)], np.int64))
             for c in texts.values()]
    shared = spark.sparkContext.broadcast((items, term_weights(df, n_docs), n_docs, n_terms))
    return table.mapInArrow(_search(shared, k, shard_postings), HITS)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                  shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """The k best documents of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    stage = Stage(spark, "nra-search")
    docs = at_least_slots(docs)
    names = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema[item_col].dataType)])
    ranks = []
    for block in item_blocks(spark, items, item_col, item_text_col, block_bytes):
        hits = _block_hits(docs, block, stage, id_col, text_col, k, shard_postings)
        w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        of = spark.createDataFrame(list(enumerate(dict.fromkeys(i for i, _ in block))), names)
        ranks.append(best.join(F.broadcast(of), "item").select("item_id", "rank", "doc_id", "score"))     # a block's ids: bounded
    out = ranks[0]
    for r in ranks[1:]:
        out = out.unionByName(r)
    return out
