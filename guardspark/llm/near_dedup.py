"""MinHash near-duplicate classes by a signature-coordinate inverted join.

A document's set holds its distinct k-word shingles. Its signature has K
MinHash coordinates; every (coordinate, value) pair is one posting. Two
documents whose sets overlap by the threshold collide in far more than T of
the K coordinates, so candidates are pairs with at least T collisions:

* **skip**: a posting whose pair occurs once cannot collide and goes; a
  document left with fewer than T postings can reach no partner and goes.
* **prefix**: a document's m postings are ordered by how many documents
  hold them. Partners share at least T postings, hence at least one among
  each other's rarest m - T + 1. Only those are merged; the long lists are
  never walked, their collisions are counted from the signatures.
* **match threshold**: candidates with T collisions or more are confirmed
  on the full shingle sets of the whole texts.

Equal sets are one class from the start, so copies are never paired. The
result needs components, so a list is first linked to one leader per list
and then only across the components that this leaves: members of one
component are never paired with each other again, and no pair in different
components is left untested.

T is K/2: at the similarity of 0.75 a pair collides in 0.75 K coordinates
on average and misses T = 48 of K = 96 with a probability below 1e-7.
Shingles are 64-bit hashes of A-Z lower-cased words; a set's identity is a
128-bit sum over them.

Hot groups: postings of a key that many classes share (as those of one class in
SAMPLED show; the keys, fewer than HOT_KEYS, are sent to the tasks) are never
counted in one place; partners of a list are limited before the shuffle; the
lists that the prefix rule leaves hold a key's classes once each. Joins on a
component's smallest id or on a set's identity have one row on the other side,
so adaptive execution splits them.

Edge cases: null or word-free text has an empty set, is linked with nothing
and is its own component; texts under k words have one shingle, the whole
sequence; rows that share a doc_id are one document with several texts; a
null doc_id takes no part in naming a component (``component_id`` is null
if its whole class has none). Columns besides id and text are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stage, at_least_slots, flat, mix64, shingle_hashes, slices, text_column, word_hashes, word_spans

SHINGLE_WORDS = 5
THRESHOLD_PCT = 75
COORDINATES = 96
MATCHES = 48
LIKELY_TURNS = 1        # rounds of likely pairs on the refined lists before all pairs across components
PARTNERS = 3            # of a list's largest component, for each member outside it
SAMPLED = 64            # one class in so many shows which keys are hot
HOT_KEYS, HOT_LEAST, HOT_COUNT = 10_000, 16, 1 << 60
SALTS = 64

SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
                       T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
                       T.StructField("sig", T.ArrayType(T.LongType(), False))])


def distinct_shingles(arr: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, with row borders."""
    data, off = flat(arr)
    starts, ends, first = word_spans(data, off)
    h, first = shingle_hashes(word_hashes(data, starts, ends), first, k)
    for i in np.flatnonzero(np.diff(first) > 1):
        h[first[i]:first[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[first[:-1][np.diff(first) > 0]] = True
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def _coordinate_params(coords: int):
    mult = mix64(np.arange(1, coords + 1, dtype=np.uint64)) | np.uint64(1)
    salt = mix64(np.arange(1, coords + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return mult, salt


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
               coords: int = COORDINATES) -> DataFrame:
    """(doc_id, n, k1, k2, sig): set size, 128-bit set identity and the
    MinHash values, each mixed with its coordinate (empty array: empty set)."""
    def run(batches):
        mult, salt = _coordinate_params(coords)
        for b in batches:
            ids, texts = b.column(0).cast(pa.int64()), text_column(b, "_text")
            for lo, hi in slices(texts):
                u, first = distinct_shingles(texts.slice(lo, hi - lo), k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                at = first[:-1][full]
                k1, k2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                sig = np.empty((len(full), coords), np.uint64)
                if len(full):
                    k1[full] = np.add.reduceat(u, at)
                    k2[full] = np.add.reduceat(mix64(u ^ salt[0]), at)
                    for j in range(coords):
                        sig[:, j] = mix64(np.minimum.reduceat(u * mult[j] + salt[j], at) ^ salt[j])
                size = np.where(n > 0, coords, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                                 pa.array(sig.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                     lists], names=SIGNED.fieldNames())

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")) \
               .mapInArrow(run, SIGNED)


def sampled(rep: str = "rep"):
    """The classes that hot keys are looked for in."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(rep)), F.lit(SAMPLED)) == 0


def hot_keys(sample: DataFrame) -> list[int]:
    """Keys that hold many of the sampled postings (column ``key``): those with
    more than one in HOT_KEYS of them, so fewer than HOT_KEYS keys."""
    counts = sample.groupBy("key").count().where(F.col("count") >= HOT_LEAST)
    least = sample.count() // HOT_KEYS
    return [r["key"] for r in counts.where(F.col("count") > least).select("key").collect()]


def with_counts(post: DataFrame, hot: list[int]) -> DataFrame:
    """Postings with ``cnt``, by which a document's keys are ordered: how many
    hold the key, and more than any count for a hot one. All that the rules
    need is one order of the keys and which of them occur once, so the rows of
    a hot key need not meet: they are dealt out over salts."""
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    own = F.when(is_hot, F.pmod(F.xxhash64("rep"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    counted = F.count(F.lit(1)).over(Window.partitionBy("key", "_salt"))
    return post.withColumn("_salt", own).withColumn("cnt", F.when(is_hot, F.lit(HOT_COUNT)).otherwise(counted)).drop("_salt")


def prefix_postings(classes: DataFrame, hot: list[int], matches: int = MATCHES) -> DataFrame:
    """(key, rep, n): the postings that the skip and prefix rules leave."""
    post = classes.select("rep", "n", F.explode("sig").alias("key"))
    shared = with_counts(post, hot).where("cnt > 1")
    per_doc = (shared.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("cnt", "key"))).alias("p"))
                     .where(F.size("p") >= matches))
    return (per_doc.select("rep", "n", F.explode(F.slice("p", F.lit(1), F.size("p") - matches + 1)).alias("p"))
                   .select(F.col("p.key").alias("key"), "rep", "n"))


def _size_fits(n1, n2, pct: int):
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * pct)


def leader_pairs(lists: DataFrame, pct: int) -> DataFrame:
    """Each list's members paired with the list's smallest id."""
    lead = F.min(F.struct("rep", "n")).over(Window.partitionBy("key"))
    return (lists.withColumn("lead", lead)
                 .where((F.col("lead.rep") < F.col("rep")) & _size_fits(F.col("lead.n"), F.col("n"), pct))
                 .select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct())


def multi_component_members(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, comp, n) of the members of lists that hold several components."""
    m = (lists.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
              .withColumn("comp", F.coalesce("comp", "rep")))
    w = Window.partitionBy("key")
    return (m.withColumn("lo", F.min("comp").over(w)).withColumn("hi", F.max("comp").over(w))
             .where("lo <> hi").select("rep", "comp").distinct())


def shingle_postings(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, pct: int, stage: Stage) -> DataFrame:
    """(key, rep, n) over full shingle sets of the members, left by the exact
    skip and prefix rules."""
    text = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("t"))

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), text_column(b, "t")
            for lo, hi in slices(texts):
                u, first = distinct_shingles(texts.slice(lo, hi - lo), k)
                n = np.diff(first)
                rep = np.repeat(ids.slice(lo, hi - lo).to_numpy(), n)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(rep), pa.array(np.repeat(n, n))],
                                                 names=["key", "rep", "n"])

    def postings(of: DataFrame) -> DataFrame:
        return text.join(of.select("rep"), "rep").select("rep", "t").mapInArrow(run, "key long, rep long, n long")

    hot = hot_keys(stage.put(postings(members.where(sampled())), "sampled-shingles"))
    need = F.floor((F.col("n") * pct + 99) / 100).cast("int")
    shared = with_counts(postings(members), hot).where("cnt > 1")
    per_doc = (shared.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("cnt", "key"))).alias("p"))
                     .where(F.size("p") >= need))
    return (per_doc.select("rep", "n", F.size("p").alias("m"),
                           F.posexplode(F.slice("p", F.lit(1), F.size("p") - need + 1)).alias("pos", "p"))
                   .select(F.col("p.key").alias("key"), "rep", "n", (F.col("m") - F.col("pos")).alias("room")))


def _outside_largest(fine: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the lists that hold several components: the members outside each
    list's largest one (x...), and all members with ``in_main`` (y...)."""
    m = (fine.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
             .withColumn("comp", F.coalesce("comp", "rep")))
    per = (m.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("main"), F.count(F.lit(1)).alias("comps"))
            .where("comps > 1").drop("comps"))
    m = m.join(per, "key")
    x = m.where("comp <> main").select("key", F.col("rep").alias("x"), F.col("n").alias("xn"), F.col("room").alias("xr"),
                                       F.col("comp").alias("xc"))
    y = m.select("key", F.col("rep").alias("y"), F.col("n").alias("yn"), F.col("room").alias("yr"), F.col("comp").alias("yc"),
                 (F.col("comp") == F.col("main")).alias("in_main"))
    return x, y


def _paired(x: DataFrame, y: DataFrame, pct: int) -> DataFrame:
    return (x.join(y, "key")
             .where((F.col("xc") != F.col("yc")) & (F.col("in_main") | (F.col("x") < F.col("y"))))
             .where(_may_overlap(F.col("xn"), F.col("xr"), F.col("yn"), F.col("yr"), pct))
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def likely_pairs(fine: DataFrame, labels: DataFrame, pct: int, partners: int, turn: int) -> DataFrame:
    """Members outside a list's largest component, each with a few of its
    members: first those with the most left to share (ties dealt anew per
    list), in later turns any. A member that one of them joins need not meet
    the others."""
    x, y = _outside_largest(fine, labels)
    best = [F.col("yr").desc()] if turn == 0 else []
    nth = F.row_number().over(Window.partitionBy("key").orderBy(*best, F.xxhash64(F.lit(turn), "key", "y")))
    return _paired(x, y.where("in_main").withColumn("nth", nth).where(F.col("nth") <= partners), pct)


def _may_overlap(n1, room1, n2, room2, pct: int):
    """Upper bound of the overlap from a common posting on (sets ordered
    alike share nothing before their first common one) against what the
    similarity needs: 100 I >= pct (n1 + n2 - I)."""
    return F.least(room1, room2) * (100 + pct) >= (n1 + n2) * pct


def cross_pairs(fine: DataFrame, labels: DataFrame, pct: int) -> DataFrame:
    """All pairs of list members in different components that may still
    overlap enough."""
    return _paired(*_outside_largest(fine, labels), pct)


def count_matches(pairs: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Pairs whose signatures collide in at least ``matches`` coordinates."""
    sig = classes.select("rep", "sig")
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return (pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
                 .join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
                 .where(same >= matches).select("a", "b"))


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, pct: int) -> DataFrame:
    """Pairs whose full shingle sets overlap by ``pct`` percent or more."""
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")) \
               .where(F.col("id").isNotNull())
    both = (pairs.join(text.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
                 .join(text.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
                 .select("a", "b", "ta", "tb"))

    def run(batches):
        for batch in batches:
            ta, tb = text_column(batch, "ta"), text_column(batch, "tb")
            linked = np.zeros(batch.num_rows, bool)
            for lo, hi in slices(pa.array([f"{x}\n{y}" for x, y in zip(ta.to_pylist(), tb.to_pylist())], pa.string())):
                ua, fa = distinct_shingles(ta.slice(lo, hi - lo), k)
                ub, fb = distinct_shingles(tb.slice(lo, hi - lo), k)
                for i in range(hi - lo):
                    x, y = ua[fa[i]:fa[i + 1]], ub[fb[i]:fb[i + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked[lo + i] = common and 100 * common >= pct * (len(x) + len(y) - common)
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)],
                                             names=["a", "b"])

    return both.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, stage: Stage, name: str = "cc") -> DataFrame:
    """(id, comp): smallest id reachable over the links, by label hooking
    and pointer jumping until nothing changes; every round is written."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stage.put(both.where("a <> b").distinct(), f"{name}-edges")
    labels = stage.put(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")),
                       f"{name}-0")
    step = 0
    while True:
        step += 1
        near = (edges.join(labels.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b")
                     .groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c")))
        hooked = labels.join(near, "id", "left").select("id", F.col("comp").alias("old"),
                                                        F.least("comp", F.coalesce("c", "comp")).alias("comp"))
        up = labels.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        jumped = hooked.join(up, "comp", "left").select("id", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
        new = stage.put(jumped, f"{name}-{step}")
        if new.where("comp <> old").isEmpty():
            stage.drop(labels, edges)
            return new.select("id", "comp")
        stage.drop(labels)
        labels = new.drop("old")
        labels._stage_path = new._stage_path


def extended(labels: DataFrame, links: DataFrame, stage: Stage) -> DataFrame:
    """Labels after further links: only the components that these join are
    worked out, on a graph whose nodes are the components so far."""
    def side(c):
        return labels.select(F.col("id").alias(c), F.col("comp").alias(f"{c}_comp"))

    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    between = (links.join(side("a"), "a", "left").join(side("b"), "b", "left")
                    .select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")))
    joined = components(between, stage, "joined").select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    known = labels.unionByName(nodes.join(labels, "id", "left_anti").select("id", F.col("id").alias("comp")))
    return stage.put(known.join(joined, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                    pct: int = THRESHOLD_PCT, coords: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    stage = Stage(docs.sparkSession, "near-dedup")
    docs = at_least_slots(docs)
    signed = stage.put(signatures(docs, id_col, text_col, k, coords), "signed")
    classes = stage.put(signed.where("n > 0").groupBy("k1", "k2")
                              .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")),
                        "classes")
    named = classes.where("rep is not null")
    hot = hot_keys(named.where(sampled()).select(F.explode("sig").alias("key")))
    lists = stage.put(prefix_postings(named, hot, matches), "lists")
    tested = stage.put(leader_pairs(lists, pct), "leader-pairs")

    def found(pairs):
        return stage.put(confirm(count_matches(pairs, named, matches), docs, id_col, text_col, k, pct), "links")

    links = found(tested)
    labels = components(links, stage, "cc")
    split = stage.put(multi_component_members(lists, labels), "split")
    fine = stage.put(shingle_postings(split, docs, id_col, text_col, k, pct, stage), "fine-lists")
    for turn in range(LIKELY_TURNS):
        pairs = stage.put(likely_pairs(fine, labels, pct, PARTNERS, turn).join(tested, ["a", "b"], "left_anti"), f"likely-{turn}")
        if pairs.isEmpty():
            break
        more = found(pairs)
        if not more.isEmpty():
            labels = extended(labels, more, stage)
        tested = tested.unionByName(pairs)
    rest = stage.put(cross_pairs(fine, labels, pct).join(tested, ["a", "b"], "left_anti"), "cross-pairs")
    if not rest.isEmpty():
        more = found(rest)
        if not more.isEmpty():
            labels = extended(labels, more, stage)
    comp = (classes.select("k1", "k2", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
                   .select("k1", "k2", F.coalesce("comp", "rep").alias("component_id")))
    rows = (signed.where("n > 0").select("doc_id", "n", "k1", "k2").join(comp, ["k1", "k2"])
                   .select("doc_id", "n", "component_id"))
    empty = signed.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = stage.put(rows.unionByName(empty)
                    .select("doc_id", F.col("n").alias("n_shingles"), "component_id",
                            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "result")
    stage.drop_all_but(out)
    return out
