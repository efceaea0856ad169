"""Mixing sources to target weights by hierarchical budgeting.

Documents hang below a tree of levels (by default domain, language, source).
A token target is handed down: a node's budget is split among its children
by weight, and a child that cannot supply its share (its tokens times the
epochs allowed) passes the shortage to its siblings, again by weight; only
what they cannot supply either goes up, to the siblings of the ancestor.
Budgets are tables, one per level (a source of its own for every web host is
a leaf, so there may be millions): children that run dry are those with the
least supply per weight, so sums over the distinct values of that ratio say
for every node at once which children give all they have and what the others
get per weight.

A leaf's budget is met from seeded epochs: every epoch orders the leaf's
documents by a hash of seed, epoch and id; full epochs are taken whole, and
of the last one the longest prefix whose tokens fit the budget. No leaf is
sorted in one place: its documents are dealt into as many buckets of the hash
as its row count asks for, bucket totals find the bucket where the budget
ends, and only that one is ordered inside. A source that holds a third of all
rows is therefore many tasks.

Edge cases: null values of a level are a leaf of their own; null or empty
texts have 0 tokens and are taken with the prefix they fall into; rows of one
id in one leaf are taken together; leaves without a weight get
DEFAULT_WEIGHT, weights of absent leaves are ignored; a target above the
supply takes everything the epochs allow; an empty table gives an empty
result; columns with clashing names pass through in ``_row``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, at_least_slots

DEFAULT_WEIGHT = 1.0
SEED = 20
MAX_EPOCHS = 2
BUCKET_ROWS = 4096
SALTS = 16

#: Weights by path below the root; what is missing has DEFAULT_WEIGHT.
WEIGHTS = {("web",): 6.0, ("reference",): 3.0, ("forum",): 2.0,
           ("web", "en"): 5.0, ("web", "de"): 2.0, ("reference", "en"): 4.0, ("forum", "en"): 4.0}
TARGET_SHARE = 0.6
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The domain of a source, from its trailing number (null: other)."""
    n = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    names = F.array(*(F.lit(x) for x in ("web", "reference", "forum", "web")))
    return F.when(n == "", "other").otherwise(F.element_at(names, (F.pmod(n.cast("long"), F.lit(4)) + 1).cast("int")))


def word_tokens(text: Column) -> Column:
    """Words of a text as its tokens (a token column may be given instead)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.size(F.array_remove(F.split(t, "[ \\t\\n\\x0B\\f\\r]+"), "")).cast("long")


def _weights(path: Column, weights: dict, depth: int) -> Column:
    """Weights of the nodes of one depth (the dict is a parameter)."""
    out = F.lit(DEFAULT_WEIGHT)
    for key, w in weights.items():
        if len(key) == depth:
            out = F.when(path == F.array(*(F.lit(x) for x in key)), F.lit(float(w))).otherwise(out)
    return out


def shares(children: DataFrame) -> DataFrame:
    """(path, budget) from (parent, path, w, cap, given): each parent's
    ``given`` by weight, what a child cannot supply going to its siblings by
    weight."""
    able = children.where((F.col("w") > 0) & (F.col("cap") > 0)).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = able.groupBy("parent", "ratio").agg(F.sum("cap").alias("c"), F.sum("w").alias("w"), F.max("given").alias("given"))
    upto = Window.partitionBy("parent").orderBy("ratio")
    all_of = Window.partitionBy("parent")
    ranked = (by_ratio.withColumn("before", F.sum("c").over(upto) - F.col("c")).withColumn("after", F.sum("w").over(all_of) - F.sum("w").over(upto) + F.col("w"))
                      .withColumn("rest", F.least("given", F.sum("c").over(all_of)) - F.col("before")))
    dry = F.col("ratio") * F.col("after") <= F.col("rest")
    # The first ratio that does not run dry: what is left there, per weight.
    level = (ranked.where(~dry).groupBy("parent").agg(F.min_by(F.struct("rest", "after"), "ratio").alias("m"), F.min("ratio").alias("edge"))
                   .select("parent", "edge", (F.greatest(F.col("m.rest"), F.lit(0.0)) / F.col("m.after")).alias("per_weight")))
    part = children.withColumn("ratio", F.when(F.col("w") > 0, F.col("cap") / F.col("w"))).join(level, "parent", "left")
    budget = (F.when((F.col("w") <= 0) | (F.col("cap") <= 0), F.lit(0.0))
               .when(F.col("edge").isNull() | (F.col("ratio") < F.col("edge")), F.col("cap"))
               .otherwise(F.col("per_weight") * F.col("w")))
    return part.select("path", budget.alias("budget"))


def budgets(leaves: DataFrame, target_share: float, weights: dict, max_epochs: int, depth: int, stage: Stage) -> DataFrame:
    """(path, given): token budget of every leaf of (path, tokens, rows), top
    down: a node is never given more than its leaves can supply, so a shortage
    reaches an ancestor's siblings only after the node's own children."""
    cap = leaves.select("path", (F.coalesce("tokens", F.lit(0)) * max_epochs).cast("double").alias("cap"))
    total = cap.agg(F.coalesce(F.sum("cap"), F.lit(0.0))).first()[0]
    target = min(target_share * total / max_epochs, total)
    given = None
    for i in range(1, depth + 1):
        nodes = (cap.groupBy(F.slice("path", 1, i).alias("path")).agg(F.sum("cap").alias("cap"))
                    .withColumn("parent", F.slice("path", 1, i - 1)).withColumn("w", _weights(F.col("path"), weights, i)))
        if given is None:
            nodes = nodes.withColumn("given", F.lit(float(target)))
        else:
            nodes = nodes.join(given.select(F.col("path").alias("parent"), F.col("budget").alias("given")), "parent")
        given = stage.put(shares(stage.put(nodes, f"nodes-{i}")), f"budgets-{i}")
    return given.select("path", F.floor(F.col("budget") + 1e-6).cast("long").alias("given"))


def _hash(seed: int, epoch: Column) -> Column:
    """52 bits of an epoch's order of the ids."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.col("_id"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _bucket() -> Column:
    return F.floor(F.col("h").cast("double") / float(1 << 52) * F.col("buckets")).cast("long")


def leaf_cutoffs(light: DataFrame, target_share: float, weights: dict, seed: int, max_epochs: int,
                 bucket_rows: int, depth: int, stage: Stage) -> DataFrame:
    """One row per leaf: whole epochs to take, and the place in the order of
    the last one up to which documents are taken (``cut``: a bucket, and in
    it the last (hash, id); null there: none of the bucket)."""
    leaves = stage.put(light.groupBy("path").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves")
    given = budgets(leaves, target_share, weights, max_epochs, depth, stage)
    whole = F.when(F.col("tokens") > 0, F.least(F.expr("given div tokens"), F.lit(max_epochs))).otherwise(0).cast("int")
    rest = F.when(F.col("whole") < max_epochs, F.col("given") - F.col("whole") * F.col("tokens")).otherwise(-1)      # -1: nothing of a further epoch
    table = stage.put(leaves.join(given, "path").withColumn("whole", whole)
                            .select("path", "whole", rest.cast("long").alias("rest"),
                                    F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows)).cast("long").alias("buckets")), "leaf-plan")
    ordered = _at_leaf(light, table).withColumn("h", _hash(seed, F.col("whole"))).withColumn("bucket", _bucket())
    upto = Window.partitionBy("path").orderBy("bucket")
    edge = (ordered.groupBy("path", "rest", "bucket").agg(F.sum("n_tokens").alias("t"))
                   .withColumn("upto", F.sum("t").over(upto)).where("upto > rest")
                   .groupBy("path").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("e"))
                   .select("path", F.col("e.bucket").alias("bucket"), F.col("e.before").alias("before")))
    # Peers in (hash, id) are summed together: the default range frame.
    inside = Window.partitionBy("path", "bucket").orderBy("h", "_id")
    last = (ordered.join(edge, ["path", "bucket"])                     # a bucket of each leaf
                   .withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside)).where("upto <= rest")
                   .groupBy("path").agg(F.max(F.struct("h", "_id")).alias("last")))
    return (table.join(edge.select("path", F.col("bucket").alias("edge")), "path", "left").join(last, "path", "left")
                 .select("path", "whole", "rest", "buckets", "edge", F.col("last.h").alias("last_h"),
                         F.col("last._id").alias("last_id")))


def _at_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with the columns of their leaf. The rows of a leaf are dealt
    out over SALTS, unless the table of leaves is small enough for Spark to
    send it to the rows."""
    own = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    dealt = leaves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", own).join(dealt, ["path", "_salt"]).drop("_salt")


def mix(docs: DataFrame, levels: list[Column], tokens: Column, target_share: float = TARGET_SHARE, weights=None,
        seed: int = SEED, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``_row`` (struct of all columns), ``path`` (array), ``n_tokens`` and
    ``epoch`` (from 0) of every document taken, once per epoch.

    Which documents a leaf gives is one place in its seeded order, so the
    documents are filtered where they are read: texts are not shuffled.
    """
    stage = Stage(docs.sparkSession, "mixing")
    docs = at_least_slots(docs)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = docs.select(row, F.array(*(c.cast("string") for c in levels)).alias("path"),
                       tokens.cast("long").alias("n_tokens"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"))
    light = stage.put(rows.select("path", "n_tokens", "_id"), "light")
    cut = stage.put(leaf_cutoffs(light, target_share, WEIGHTS if weights is None else weights, seed, max_epochs, bucket_rows,
                                 len(levels), stage), "cut")
    stage.drop(light)
    placed = _at_leaf(rows, cut).withColumn("h", _hash(seed, F.col("whole"))).withColumn("bucket", _bucket())
    at_edge = (F.col("h") < F.col("last_h")) | ((F.col("h") == F.col("last_h")) & (F.col("_id") <= F.col("last_id")))
    before = F.col("edge").isNull() | (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & F.coalesce(at_edge, F.lit(False)))
    epochs = F.col("whole") + ((F.col("rest") >= 0) & before).cast("int")
    return (placed.withColumn("_n", epochs).where("_n > 0")
                  .select("_row", "path", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("epoch")))
