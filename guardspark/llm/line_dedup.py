"""Line dedup: lines whose normalised form occurs in many documents go.

Whole texts are split at newlines. A line's key is the line without
separators at both ends and with A-Z lower-cased, hashed to 128 bits. What a
text loses depends on the text alone, so equal texts (by a 128-bit hash) are
one row with the number of their copies, and everything is decided per
distinct text: each offers every hash once with its copies, copies per hash
are summed (partial sums before the shuffle), and hashes at or above the
threshold drop their lines. The decisions come back to the documents as
position lists, and the lines that stay are joined again in place. Built-in
functions only.

Hot groups: copies meet as partial aggregates (one row per text and task); a
line that a third of all texts share is summed the same way, and its join is
dealt out by salt over the texts; a text with at least one in HOT_SHARE of all
rows as its copies has its decisions replicated over the salts and its rows
dealt out over them (there are at most HOT_SHARE such texts, whose hashes are
sent to the tasks).

Edge cases: null or empty text is one empty line; a line with an empty key
is never dropped; rows are documents, so a repeated row counts again and
gets the same result; a null doc_id is an id like any other. Columns other
than id and text pass through :func:`dedup_lines` unchanged; one that has the name
of a result column gives way to it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, at_least_slots

MIN_DOCS = 10
MIN_CHARS = 1
SALTS = 32
HOT_SHARE = 1000         # texts with a larger share of the rows than one in so many are dealt out
HOT_COPIES = 100         # and more copies than that
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; the plain function suffices where the text is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def line_keys(text: Column) -> Column:
    """Keys of a text's lines in order (one step per array, so that each
    line is trimmed and lowered once)."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    return F.transform(trimmed, ascii_lower)


def _hash(key: Column) -> Column:
    """128 bits of a key; null for a key that is too short to count."""
    return F.when(F.char_length(key) >= MIN_CHARS,
                  F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))


def distinct_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, copies, _k): one row per distinct text, with its hash, the
    number of its rows and the hashes of its lines in order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text_hash(text).alias("_h"), F.transform(line_keys(text), _hash).alias("_k"))
    return (rows.groupBy(F.col("_h.a").alias("a"), F.col("_h.b").alias("b"))
                .agg(F.count(F.lit(1)).alias("copies"), F.first("_k").alias("_k")))


def line_decisions(texts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(a, b, _drop): positions (from 0) of the lines to drop, for the
    :func:`distinct_texts` that lose any."""
    per_key = (texts.select("copies", F.explode(F.array_compact(F.array_distinct("_k"))).alias("k"))
                    .groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
                    .agg(F.sum("copies").alias("n_docs")).where(F.col("n_docs") >= min_docs))
    frequent = per_key.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    at = texts.select("a", "b", F.posexplode("_k").alias("pos", "k")).where("k is not null") \
              .select("a", "b", "pos", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"),
                      F.pmod(F.xxhash64("a", "pos"), F.lit(SALTS)).cast("int").alias("salt"))
    return (at.join(frequent, ["h1", "h2", "salt"], "left_semi")
              .groupBy("a", "b").agg(F.sort_array(F.collect_set("pos")).alias("_drop")))


def text_hash(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("text"), text).alias("b"))


def dedup_lines(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS,
                out_col: str = "_kept_text", id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` plus ``out_col`` (the text without
    dropped lines), ``_n_lines`` and ``_n_dropped``."""
    docs = at_least_slots(docs)
    stage = Stage(docs.sparkSession, "line-dedup")
    texts = stage.put(distinct_texts(docs, text_col), "texts")
    decisions = stage.put(line_decisions(texts, min_docs), "decisions")
    total = texts.agg(F.sum("copies")).first()[0] or 0
    hot = texts.where(F.col("copies") > max(total // HOT_SHARE, HOT_COPIES)).select("a", "b").withColumn("_hot", F.lit(True))
    hot = F.broadcast(stage.put(hot, "hot"))                # at most HOT_SHARE hashes
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row.alias("_row"), text.alias("_t")).withColumn("_h", text_hash(F.col("_t")))
    rows = rows.select("_row", "_t", F.col("_h.a").alias("a"), F.col("_h.b").alias("b")).join(hot, ["a", "b"], "left")
    # Rows of a hot text are told apart by what they are and where they lie.
    own = F.pmod(F.xxhash64(F.col("_row")[id_col].cast("string"), F.spark_partition_id()), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("salt", F.when(F.col("_hot"), own).otherwise(F.lit(0)))
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = decisions.join(hot, ["a", "b"], "left").select("a", "b", "_drop", F.explode(salts).alias("salt"))
    joined = rows.join(dealt, ["a", "b", "salt"], "left")
    joined = joined.withColumn("_p", F.split("_t", "\n"))     # read several times: stays a column
    parts = F.col("_p")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drop"))
    kept = F.when(F.col("_drop").isNull(), F.col("_t")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    made = {out_col, "_n_lines", "_n_dropped"}
    return joined.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c not in made), kept.alias(out_col), F.size(parts).cast("long").alias("_n_lines"),
                         F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("_n_dropped"))
