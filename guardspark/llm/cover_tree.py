"""Exact top-k inner products by a dual-tree cover-tree search.

Vectors become integers (floor of scale times the component), so scores are
exact. The space is cut into regions around pivots (a bounded sample only
shapes the regions; every vector is indexed), regions into shards of bounded
size, and the queries of neighbouring regions into blocks. In a task, a cover tree is
built over a shard and another over a block of queries; the two are descended
together. A pair of nodes with centres q, x, covering radii r, s, angular
radii a, b and largest norms Q, X can reach at most the smaller of

    <q, x> + r |x| + s |q| + r s    and    Q X cos(angle(q, x) - a - b)

and goes when that is below the worst k-th score of the query node's group.
Queries first search the shards of their own region; the k-th scores found
there then rule out whole regions by the same bounds with the region's radii,
before anything is sent to them. Data goes only to the query blocks that have
its region open.

Edge cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; shorter vectors count as padded with 0; a
vec_id appears at most once per query, with its best score, so repeated rows
do no harm; ties go to the smaller vec_id; fewer candidates than k are all
returned; an empty table gives an empty result; other columns are ignored.
Scores are exact while they fit a signed 64-bit integer.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage

SCALE = 1024
TOP = 10
EVERY = 100
PIVOTS = 64
SHARD_ROWS = 8192
BLOCK_QUERIES = 4096
LEAF = 48
FAN = 12
HITS = "query_id long, vec_id long, score long"


class Node:
    __slots__ = ("center", "radius", "norm", "rows", "children", "angle", "top")

    def __init__(self, center, norm, radius, rows, top, angle, children=()):
        self.center, self.norm, self.radius, self.rows, self.children = center, norm, radius, rows, children
        self.top, self.angle = top, angle


def angles(dots, norms):
    """Angles from inner products and products of norms (norm 0: pi)."""
    cosine = np.divide(dots, norms, out=np.full(np.shape(dots), -1.0), where=np.asarray(norms) > 0)
    return np.arccos(np.clip(cosine, -1, 1))


def angular_bound(angle, top):
    """Highest inner product at an angle of at least ``angle`` with norms of
    at most ``top`` together (0 from a right angle on)."""
    return top * np.cos(np.clip(angle, 0, np.pi / 2))


def build(points: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Node:
    """Cover tree: a node's centre is one of its points and its radius covers
    them all; children's centres are picked farthest first until half the
    radius covers the rest (or the fan is full), points go to the nearest."""
    norms = np.sqrt((points ** 2).sum(axis=1))

    def node(rows, center_row):
        center, norm, own = points[center_row], float(norms[center_row]), norms[rows]
        square = ((points[rows] - center) ** 2).sum(axis=1)
        dist = np.sqrt(square)
        radius, top = float(dist.max()), float(own.max())
        angle = float(angles((own ** 2 + norm ** 2 - square) / 2, own * norm).max()) + 1e-7
        if len(rows) <= leaf or radius == 0:
            return Node(center, norm, radius, rows, top, angle)
        centers, owner, near = [center_row], np.zeros(len(rows), np.int64), dist
        while len(centers) < fan and near.max() > radius / 2:
            centers.append(rows[int(near.argmax())])
            d = np.sqrt(((points[rows] - points[centers[-1]]) ** 2).sum(axis=1))
            closer = d < near
            owner[closer], near = len(centers) - 1, np.minimum(near, d)
        return Node(center, norm, radius, rows, top, angle, [node(rows[owner == i], c) for i, c in enumerate(centers)])

    return node(np.arange(len(points)), 0)


class DualSearch:
    """k best data rows of every query, from one query and one data tree."""

    def __init__(self, q_ids, q, x_ids, x, floor, k):
        self.q_ids, self.x_ids, self.k = q_ids, x_ids, k
        self.q, self.x = q.astype(np.float64), x.astype(np.float64)
        big = np.sqrt((self.q ** 2).sum(axis=1).max() * (self.x ** 2).sum(axis=1).max())
        self.exact = (q, x) if big >= 2.0 ** 52 else (self.q, self.x)     # doubles hold smaller sums exactly
        self.slack = 1e-9 * big + 1e-9
        self.none = np.iinfo(np.int64).min
        self.scores = np.full((len(q), k), self.none, np.int64)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
        self.floor = floor.astype(np.float64)                             # a known k-th score, or -inf

    def bound(self, a: Node, b: Node) -> float:
        dot = float(a.center @ b.center)
        reach = dot + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        size = a.norm * b.norm
        apart = math.acos(min(1.0, max(-1.0, dot / size))) - a.angle - b.angle if size else 0.0
        if apart > 0:
            reach = min(reach, a.top * b.top * max(0.0, math.cos(apart)))
        return reach + self.slack

    def worst(self, a: Node) -> float:
        last = self.scores[a.rows, -1]
        return float(np.maximum(np.where(last == self.none, -np.inf, last), self.floor[a.rows]).min())

    def run(self):
        stack = [(np.inf, build(self.q), build(self.x))]
        while stack:
            bound, a, b = stack.pop()
            if bound < self.worst(a):
                continue
            if not a.children and not b.children:
                self.leaves(a.rows, b.rows)
                continue
            split_a = a.children and (not b.children or a.radius >= b.radius)
            pairs = [(c, b) for c in a.children] if split_a else [(a, c) for c in b.children]
            stack.extend(sorted(((self.bound(c, d), c, d) for c, d in pairs), key=lambda p: p[0]))
        return self

    def leaves(self, qr, xr):
        q, x = self.exact
        s = (q[qr] @ x[xr].T).astype(np.int64)
        s[self.q_ids[qr][:, None] == self.x_ids[xr][None, :]] = self.none
        hit = np.flatnonzero(s.max(axis=1) >= np.maximum(self.scores[qr, -1], self.none + 1))
        if not len(hit):
            return
        rows = qr[hit]
        score = np.concatenate([self.scores[rows], s[hit]], axis=1)
        ids = np.concatenate([self.ids[rows], np.broadcast_to(self.x_ids[xr], (len(hit), len(xr)))], axis=1)
        ids = np.where(score == self.none, np.iinfo(np.int64).max, ids)
        order = np.lexsort((~score, ids), axis=1)                         # ~: falling scores without overflow
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        score[:, 1:][ids[:, 1:] == ids[:, :-1]] = self.none               # an id counts once, with its best score
        ids = np.where(score == self.none, np.iinfo(np.int64).max, ids)
        order = np.lexsort((ids, ~score), axis=1)[:, :self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    def batch(self) -> pa.Table:
        ok = self.scores != self.none
        return pa.table({"query_id": pa.array(np.broadcast_to(self.q_ids[:, None], ok.shape)[ok], pa.int64()),
                         "vec_id": pa.array(self.ids[ok], pa.int64()), "score": pa.array(self.scores[ok], pa.int64())})


def _matrix(col, width: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), width)


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("_v"))
                 .where(F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & F.coalesce(finite, F.lit(False)))
                 .select("vec_id", F.transform("_v", lambda x: F.floor(x * scale).cast("long")).alias("vec")))


def region_bins(centers: np.ndarray, asking: np.ndarray, block_queries: int) -> np.ndarray:
    """Bin of every region: regions next to each other (along the direction in
    which the centres differ most) that have about a block of queries together."""
    apart = centers - centers.mean(axis=0)
    along = np.argsort(apart @ np.linalg.svd(apart, full_matrices=False)[2][0], kind="stable")
    bins, size, current = np.zeros(len(centers), np.int64), 0, 0
    for i in along:
        if size and size + asking[i] > block_queries:
            size, current = 0, current + 1
        bins[i] = current
        size += int(asking[i])
    return bins


def exact_topk(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = TOP,
               pivots: int = PIVOTS, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is
    divisible by ``every``, its k best other rows."""
    spark = table.sparkSession
    stage = Stage(spark, "cover-tree")
    ints = table_of_ints = stage.put(integer_vectors(table, id_col, vec_col), "ints")
    width = ints.agg(F.max(F.size("vec"))).first()[0]
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    ints = ints.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("vec"))))
    # A bounded sample shapes the regions: the rows of smallest hashed id.
    chosen = ints.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(pivots).select("vec").collect()
    centers = np.unique(np.array([r[0] for r in chosen], np.float64), axis=0)
    shared = spark.sparkContext.broadcast(centers)

    def assign(batches):
        c = shared.value
        c2 = (c ** 2).sum(axis=1)
        for b in batches:
            x = _matrix(b.column(1), width).astype(np.float64)
            region = (c2[None, :] - 2 * (x @ c.T)).argmin(axis=1)
            own, norm = c[region], np.sqrt((x ** 2).sum(axis=1))
            dist = np.sqrt(((x - own) ** 2).sum(axis=1))
            angle = angles((x * own).sum(axis=1), norm * np.sqrt(c2[region]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(region.astype(np.int32)), pa.array(dist), pa.array(angle), pa.array(norm)],
                names=["vec_id", "vec", "region", "dist", "angle", "norm"])

    placed = stage.put(ints.mapInArrow(assign, "vec_id long, vec array<long>, region int, dist double, angle double, norm double"), "placed")
    stage.drop(table_of_ints)
    n = len(centers)
    radius, angle, top = np.full(n, -1.0), np.zeros(n), np.zeros(n)
    shards, asking = np.zeros(n, np.int64), np.zeros(n, np.int64)
    asks = F.col("vec_id") % every == 0
    for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks).alias("q"), F.max("dist").alias("r"),
                                          F.max("angle").alias("a"), F.max("norm").alias("t")).collect():   # one row a pivot
        i = r["region"]
        radius[i], angle[i], top[i] = r["r"], r["a"], r["t"]
        shards[i], asking[i] = -(-r["n"] // shard_rows), r["q"]
    bins = region_bins(centers, asking, block_queries)
    blocks = -(-np.bincount(bins, weights=asking).astype(np.int64) // block_queries)       # per bin of regions

    def per_region(values, region: str = "region"):
        return F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col(region) + 1)

    data = placed.select("vec_id", "vec", "region", F.pmod(F.xxhash64("vec_id", "vec"), per_region(shards)).cast("int").alias("shard"))
    queries = placed.where(asks).select("vec_id", "vec", F.col("region").alias("own"), per_region(bins).alias("home"),
                                        F.pmod(F.xxhash64("vec_id"), per_region(blocks[bins])).cast("int").alias("block"))
    keys = ["region", "shard", "home", "block"]

    def search(q: pa.Table, x: pa.Table) -> pa.Table:
        if q.num_rows == 0 or x.num_rows == 0:
            return _EMPTY
        return DualSearch(q.column("vec_id").to_numpy(), _matrix(q.column("vec"), width), x.column("vec_id").to_numpy(),
                          _matrix(x.column("vec"), width), q.column("floor").to_numpy(), k).run().batch()

    def searched(q: DataFrame, x: DataFrame) -> DataFrame:
        """``q``: queries with the region they ask; ``x``: data of a region for
        a block of queries."""
        q = q.select("vec_id", "vec", "floor", "region", "home", "block",
                     F.explode(F.sequence(F.lit(0), per_region(shards) - 1)).alias("shard"))
        return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(search, HITS)

    def best(hits: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return (hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
                    .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))

    at_home = data.where(per_region(asking) > 0).withColumn("home", per_region(bins)) \
                  .withColumn("block", F.explode(F.sequence(F.lit(0), per_region(blocks[bins]) - 1)))
    home = stage.put(searched(queries.withColumn("region", F.col("own")).withColumn("floor", F.lit(float("-inf"))), at_home), "home")
    floors = best(home).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))

    def regions(batches):
        c = shared.value
        norm = np.sqrt((c ** 2).sum(axis=1))
        for b in batches:
            x = _matrix(b.column(1), width).astype(np.float64)
            size, dots = np.sqrt((x ** 2).sum(axis=1)), x @ c.T
            ball = dots + size[:, None] * radius[None, :]
            apart = angles(dots, size[:, None] * norm[None, :]) - angle[None, :]
            reach = np.minimum(ball, angular_bound(apart - 1e-7, size[:, None] * top[None, :]))
            slack = 1e-9 * (1 + size[:, None] * (norm + np.maximum(radius, 0))[None, :])
            own = b.column(2).to_numpy()
            open_ = (reach + slack >= b.column(4).to_numpy()[:, None]) & (radius >= 0)[None, :]
            open_[np.arange(len(own)), own] = False
            row, region = np.nonzero(open_)
            t = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(t) for i in (0, 1, 3, 5, 4)), pa.array(region.astype(np.int32))],
                                             names=["vec_id", "vec", "home", "block", "floor", "region"])

    asked = stage.put(queries.join(floors, "vec_id", "left")
                             .select("vec_id", "vec", "own", "home", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "block")
                             .mapInArrow(regions, "vec_id long, vec array<long>, home int, block int, floor double, region int"), "open")
    opened = asked.select("region", F.col("home").alias("h"), F.col("block").alias("b")).distinct()
    elsewhere = data.join(opened, "region").select("vec_id", "vec", "region", "shard", F.col("h").alias("home"), F.col("b").alias("block"))
    hits = home.unionByName(searched(asked, elsewhere))
    out = stage.put(best(hits).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "result")
    stage.drop_all_but(out)
    return out


_EMPTY = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
