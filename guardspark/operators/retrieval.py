"""Exact cosine top-k retrieval and context assembly.

Top-k is exact, like a flat inner-product index, but no pair of (query,
vector) ever becomes a row, no side is broadcast and nothing passes through
the driver. One plan at every size: corpus rows are hashed into shards of
about GROUP_BYTES of vectors (as many as there are task slots where rows
suffice), each of them is sent once whatever the number of queries, and
queries go to every shard. A task reads its shard, sorts the rows into blocks
with inverted lists of block maxima, and streams the queries through in tiles
(:mod:`pruned_topk`): memory is the shard and one tile.

Where there are more shards than slots, one of them is searched first; its k-th
scores go with the queries to the others, which then find few rows in vain.

Only the k best per query and shard go on, and a per-query ``row_number``
(planned as a WindowGroupLimit) picks the global top-k. Ties break on the
smaller corpus id. Scores are ``dot / sqrt(|q|^2 |c|^2)`` in float64; for
integer count vectors this is exact and identical in every engine.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import NO_CONTEXT, SIMILARITY_THRESHOLD, TOP_K
from ..functions.text import preview
from ..session import stored
from . import pruned_topk as PT

CAND_SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()),
                            T.StructField("score", T.DoubleType())])
GROUP_BYTES = 64 << 20           # of vectors in a shard, of their own type
SHARD_ROWS = 2048                # at least, where more shards would only serve more task slots
FIRST_ROUNDS, FIRST_PARTS = 2, 64    # rounds of shards from which one shard is searched before the others, and its parts at most


def _arrow_matrix(col) -> np.ndarray:
    """A list<number> Arrow column of equal-length rows as a matrix of the
    column's own numbers."""
    import pyarrow as pa
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _finish(cands: DataFrame, k: int, threshold: float) -> DataFrame:
    """Global top-k per query from local candidates; rank starts at 0 and is
    taken before the threshold drops low scores."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    # Filtering on the row number itself lets the planner add a group limit
    # (also applied map-side, before the shuffle).
    return (cands.withColumn("_rn", F.row_number().over(w))
                 .where(F.col("_rn") <= k)
                 .where(F.col("score") >= threshold)
                 .select("query_id", "id", (F.col("_rn") - 1).cast("bigint").alias("rank"), "score"))


def _vector_type(*sides: DataFrame) -> str:
    """Vectors travel as they are where both sides agree, else as doubles."""
    kinds = {df.schema["v"].dataType.simpleString() for df in sides}
    return kinds.pop() if len(kinds) == 1 and kinds <= {"array<int>", "array<float>"} else "array<double>"


def _shards(vectors: DataFrame, kind: str = "array<double>") -> int:
    bytes_each = 8 if kind == "array<double>" else 4
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    slots = vectors.sparkSession.sparkContext.defaultParallelism
    s = max(1, -(-n * bytes_each * (width or 1) // GROUP_BYTES), min(slots, n // SHARD_ROWS))
    return s if s <= slots else -(-s // slots) * slots       # shards are alike: a last round of a few would leave slots idle


def _segments(batch):
    """(kind, lo, hi) runs of a batch sorted by kind."""
    kind = batch.column("kind").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
    return [(int(kind[lo]), lo, hi) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]


def _shard_search(k: int, floor: float):
    """Task of one shard: its corpus rows come first, then the queries, with a
    score ``f`` that each one surely reaches where it is known."""
    import pyarrow as pa

    def hits(shard, ids, vectors, floors):
        q, c, s = shard.search(vectors, k, floor if np.isnan(floors).all() else np.fmax(floors, floor))
        return pa.RecordBatch.from_arrays([pa.array(ids[q], pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.float64())],
                                          names=CAND_SCHEMA.fieldNames())

    def joined(parts):
        return tuple(np.concatenate(x) for x in zip(*parts))

    def run(batches):
        corpus, queries, waiting, shard = [], [], 0, None
        for b in batches:
            for kind, lo, hi in _segments(b):
                part = b.slice(lo, hi - lo)
                rows = (part.column("id").to_numpy(), _arrow_matrix(part.column("v")))
                if kind == 0:
                    corpus.append(rows)
                    continue
                if shard is None:
                    if not corpus:
                        return
                    shard = PT.Shard(*joined(corpus))
                    corpus = []
                queries.append((*rows, part.column("f").to_numpy(zero_copy_only=False).astype(float)))
                waiting += hi - lo
                if waiting >= shard.tile:
                    (ids, m, f), at = joined(queries), 0
                    while len(ids) - at >= shard.tile:           # which the first search decides
                        n = shard.tile
                        yield hits(shard, ids[at:at + n], m[at:at + n], f[at:at + n])
                        at += n
                    queries, waiting = [(ids[at:], m[at:], f[at:])], len(ids) - at
        if shard is not None and waiting:
            yield hits(shard, *joined(queries))

    return run


def _dealt(parts: int) -> F.Column:
    """A part of a vector, independent of its shard."""
    return F.pmod(F.hash("v", "id"), F.lit(parts)).cast("int")


def _each(parts: int) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def _candidates(q: DataFrame, q_part: F.Column, c: DataFrame, c_part: F.Column, parts: int, k: int, threshold: float) -> DataFrame:
    """The k best of each part's rows for its queries, those that reach the
    query's ``f`` where it has one."""
    rows = (c.select(c_part.alias("part"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("f"))
             .unionByName(q.select(q_part.alias("part"), F.lit(1).alias("kind"), "id", "v", "f")))
    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("kind")
    return dealt.select("kind", "id", "v", "f").mapInArrow(_shard_search(k, threshold), CAND_SCHEMA)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, threshold: float = SIMILARITY_THRESHOLD,
                query_id: str = "query_id", query_vec: str = "vector", corpus_id: str = "id",
                corpus_vec: str = "vector", shards: int | None = None, payload: list[str] | None = None,
                k_col: str | None = None) -> DataFrame:
    """Exact top-k neighbours by cosine for every query row; ``k_col`` names a
    query column with its own number of neighbours, up to ``k`` (null: ``k``).

    Returns (query_id, id, rank, score) plus the corpus ``payload`` columns.
    Without ``shards`` one aggregate counts the corpus rows and the widest
    vector. Rows without an id or a vector take no part. Corpus rows that
    repeat an id each count as a neighbour (a re-ingested chunk is found
    twice); they share one of their payloads, so a query never gets more than
    k rows.
    """
    q = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vec).alias("v")).where("v is not null and id is not null")
    c = corpus.select(F.col(corpus_id).cast("long").alias("id"), F.col(corpus_vec).alias("v")).where("v is not null and id is not null")
    kind = _vector_type(q, c)
    s = _shards(c, kind) if shards is None else max(1, shards)
    slots, shard = queries.sparkSession.sparkContext.defaultParallelism, F.pmod(F.xxhash64("id", "v"), F.lit(s)).cast("int")
    q = q.select("id", F.col("v").cast(kind).alias("v"), F.lit(None).cast("double").alias("f"))
    c = c.select("id", F.col("v").cast(kind).alias("v"))
    if shards is None and s >= FIRST_ROUNDS * slots:
        # One of the shards first, by as many tasks as share the queries: its k-th scores are what the others' rows must reach.
        q, parts = stored(q, "queries"), min(slots, FIRST_PARTS)
        first = stored(_finish(_candidates(q, _dealt(parts), c.where(shard == 0), _each(parts), parts, k, threshold), k, threshold), "first")
        kth = first.where(F.col("rank") == k - 1).select(F.col("query_id").alias("id"), F.col("score").alias("f"))
        rest = _candidates(q.drop("f").join(kth, "id", "left"), _each(s), c.where(shard != 0), _dealt(s), s, k, threshold)
        hits = _finish(rest.unionByName(first.select("query_id", "id", "score")), k, threshold)
    else:
        hits = _finish(_candidates(q, _each(s), c, shard, s, k, threshold), k, threshold)
    if k_col is not None:
        own = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(k_col).cast("int").alias("_k")).distinct()
        hits = hits.join(own, "query_id").where(F.col("rank") < F.coalesce("_k", F.lit(k))).drop("_k")
    if not payload:
        return hits
    # One row per hit again where ids repeat; the hits are worked out once.
    side = corpus.select(F.col(corpus_id).cast("long").alias("id"), F.struct(*payload).alias("_p"))
    return (hits.join(side, "id").groupBy("query_id", "rank")
                .agg(F.first("id").alias("id"), F.first("score").alias("score"), F.first("_p").alias("_p"))
                .select("query_id", "id", "rank", "score", *(F.col(f"_p.{c}").alias(c) for c in payload)))


def format_context(hits: DataFrame, queries: DataFrame, key: str = "query_id", max_length: int | None = None,
                   source_col: str = "source_file", index_col: str = "chunk_index",
                   content_col: str = "content") -> DataFrame:
    """Per query: ``[Source: f, Chunk i]\\ncontent`` blocks in rank order
    joined by a blank line; with ``max_length`` each block counts its
    length + 2, the first block that does not fit is cut to the remaining
    room plus ``...`` when more than 100 characters remain, and nothing
    after it is kept. Queries without hits get the no-context sentence."""
    block = F.concat(F.lit("[Source: "), F.col(source_col), F.lit(", Chunk "), F.col(index_col).cast("string"),
                     F.lit("]\n"), F.col(content_col))
    h = hits.withColumn("_blk", block)
    if max_length is not None:
        # Blocks before the first one that does not fit are kept whole; the
        # running total of the earlier blocks decides both the fit and the
        # room left for the cut block.
        upto = Window.partitionBy(key).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        h = h.withColumn("_before", F.coalesce(F.sum(F.length("_blk") + 2).over(upto), F.lit(0)))
        fail = F.col("_before") + F.length("_blk") > max_length
        h = h.withColumn("_first_fail", F.min(F.when(fail, F.col("rank"))).over(Window.partitionBy(key)))
        room = F.lit(max_length) - F.col("_before")
        ff = F.col("_first_fail")
        h = h.withColumn("_blk", F.when(ff.isNull() | (F.col("rank") < ff), F.col("_blk"))
                                  .when((F.col("rank") == ff) & (room > 100),
                                        F.concat(F.expr("substring(_blk, 1, " + str(max_length) + " - _before)"),
                                                 F.lit("..."))))
        h = h.where(F.col("_blk").isNotNull())
    agg = (h.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "_blk"))).alias("_parts"))
             .select(key, F.array_join(F.transform("_parts", lambda p: p["_blk"]), "\n\n").alias("context")))
    return (queries.select(key).join(agg, key, "left")
                   .select(key, F.coalesce(F.col("context"), F.lit(NO_CONTEXT)).alias("context")))


def source_previews(hits: DataFrame, key: str = "query_id", content_col: str = "content") -> DataFrame:
    """Per hit: 200-char preview with ``...`` when longer (the sources list)."""
    return hits.withColumn("preview", preview(content_col, 200))


def score_band(score) -> F.Column:
    """Display band of a retrieval score: >0.7 high, >0.4 medium, else low."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s > 0.7, "high").when(s > 0.4, "medium").otherwise("low")
