"""The stored chunk table: dense increasing ids, free-form metadata, and
deletes that rewrite only what they touch.

Rows are partitioned by a hash bucket of their source (``source_bucket``), so
a source's chunks lie together and a delete reads and rewrites the buckets of
its sources alone.

Ids are dense and increase over appends: new rows are sorted by range into
parts (source, document, chunk), each row knows its place in its part, and a
prefix sum over the row counts of the parts, one row per part, gives every
part its first id. No task sorts more than its part, and nothing passes
through the driver but the highest id so far.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import FALSE_WORDS
from ..session import work_dir

BUCKETS = 64                     # of the table; a large table takes thousands
ORDER = ("source_file", "doc_id", "chunk_index")
_PLACE_BITS = 33                 # of monotonically_increasing_id: the row's place in its partition


def source_bucket(buckets: int = BUCKETS, col: str = "source_file") -> Column:
    return F.pmod(F.xxhash64(F.col(col)), F.lit(buckets)).cast("int")


def number_rows(df: DataFrame, order: list[str] | tuple[str, ...], first_id: int, work: str, id_col: str = "id") -> DataFrame:
    """``df`` with dense ids from ``first_id`` on in the given order (nulls
    first; equal rows in any order). ``work``: a fresh shared folder that the
    sorted rows are written to, so that places are fixed once."""
    spark = df.sparkSession
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
       .withColumn("_at", F.monotonically_increasing_id()).write.parquet(work))
    rows = spark.read.parquet(work)
    part = F.shiftright("_at", _PLACE_BITS)
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = (rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))         # one row per part
                  .select("_part", F.coalesce(before, F.lit(0)).alias("_start")))
    place = F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return (rows.withColumn("_part", part).join(F.broadcast(starts), "_part")             # as many rows as shuffle partitions
                .withColumn(id_col, F.lit(first_id).cast("bigint") + F.col("_start") + place).drop("_part", "_at", "_start"))


def next_id(spark: SparkSession, path: str) -> int:
    """One more than the highest id of the table; 0 where there is none."""
    if not _exists(spark, path):
        return 0
    top = spark.read.parquet(path).agg(F.max("id")).first()[0]
    return 0 if top is None else top + 1


def append_numbered(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append chunks (``source_file, doc_id, chunk_index, content, vector`` and
    more) with the next ids. A source that is ingested again is appended
    again, with ids of its own; a chunk without a vector fails the job."""
    spark = chunks.sparkSession
    whole = F.when(F.col("vector").isNull(), F.raise_error(F.lit("chunk without a vector"))).otherwise(F.col("vector"))
    # Written before the range sort, which reads its input twice (bounds, then rows).
    made, work = work_dir(spark, "made"), work_dir(spark, "append")
    new = chunks.drop("id").withColumn("vector", whole)
    new.write.parquet(made)
    rows = number_rows(spark.read.schema(new.schema).parquet(made), ORDER, next_id(spark, path), work)
    # One file per bucket and task that sorted it: rows of a source are neighbours already.
    rows.withColumn("source_bucket", source_bucket(buckets)).write.mode("append").partitionBy("source_bucket").parquet(path)
    _delete(spark, work)
    _delete(spark, made)


def delete_sources(spark: SparkSession, path: str, sources: DataFrame, col: str = "source_file", buckets: int = BUCKETS) -> int:
    """Remove the chunks of the listed sources in place and return their
    number. Only buckets that lose rows are written again, all other files
    stay as they are; rows without a source stay."""
    gone = sources.select(F.col(col).alias("source_file")).where("source_file is not null").distinct()
    asked = [r[0] for r in gone.select(source_bucket(buckets)).distinct().collect()]          # at most ``buckets``
    if not asked:
        return 0
    table = spark.read.parquet(path).where(F.col("source_bucket").isin(asked))
    hit = table.join(gone, "source_file", "left_semi").groupBy("source_bucket").count().collect()
    if not hit:
        return 0
    touched = [r["source_bucket"] for r in hit]
    work = work_dir(spark, "delete")
    left = table.where(F.col("source_bucket").isin(touched)).join(gone, "source_file", "left_anti")
    left.write.partitionBy("source_bucket").parquet(work)
    kept = spark.read.schema(table.schema).parquet(work)
    (kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_bucket").parquet(path))
    for b in set(touched) - {r[0] for r in kept.select("source_bucket").distinct().collect()}:
        _delete(spark, f"{path}/source_bucket={b}")                                              # nothing was left to write
    _delete(spark, work)
    return sum(r["count"] for r in hit)


# --- metadata -------------------------------------------------------------------

def metadata_map(columns: list[str]) -> Column:
    """MAP<STRING,STRING> of the columns that are not null."""
    if not columns:
        return F.create_map().cast("map<string,string>")
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _flag(metadata: Column, key: str) -> Column:
    v = F.lower(F.trim(metadata[key]))
    return F.coalesce(~v.isin(*FALSE_WORDS), F.lit(False))


def provenance(df: DataFrame, as_of: str | None = None, fresh_days: int = 90, metadata_col: str = "metadata") -> DataFrame:
    """``df`` with ``verified`` and ``fresh`` from its metadata: verified where
    ``verified_source`` is set; fresh where ``fresh_content`` is set or
    ``modified`` (a date) lies at most ``fresh_days`` before ``as_of`` (today
    by default) and not after it. Missing or unreadable entries mean no."""
    m = F.col(metadata_col)
    day = F.to_date(F.lit(as_of)) if as_of is not None else F.current_date()
    age = F.date_diff(day, F.try_to_date(m["modified"]))
    return (df.withColumn("verified", _flag(m, "verified_source"))
              .withColumn("fresh", _flag(m, "fresh_content") | F.coalesce((age >= 0) & (age <= fresh_days), F.lit(False))))


# --- files ------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)
