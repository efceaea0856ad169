"""Security event log: schema, load, append, export, clear.

The log is an append-only parquet table partitioned by event date, so
dashboard queries over a time range prune partitions and read only the
columns they use.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import EVENT_TEXT_CHARS

DETAILS = T.StructType([
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("patterns_matched", T.ArrayType(T.StringType())),
    T.StructField("reason", T.StringType()),
    T.StructField("chunk_index", T.LongType()),
    T.StructField("issues", T.ArrayType(T.StringType())),
    T.StructField("regex_score", T.DoubleType()),
    T.StructField("semantic_score", T.DoubleType()),
    T.StructField("category_votes", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("type", T.StringType()),
])
EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("input_text", T.StringType()),
    T.StructField("details", DETAILS),
    T.StructField("threat_level", T.DoubleType()),
    T.StructField("action_taken", T.StringType()),
    T.StructField("session_id", T.StringType()),
])


STORED_SCHEMA = T.StructType(EVENT_SCHEMA.fields + [T.StructField("event_date", T.DateType())])


def load_events(spark: SparkSession, path: str, fmt: str = "parquet", json_array: bool = False) -> DataFrame:
    """Read the log. ``fmt='json'`` reads JSON lines, or with ``json_array``
    one JSON array per file (the service's log file); malformed records land
    in ``_corrupt_record`` instead of failing the read."""
    if fmt == "json":
        # ``categories`` may be a list or one string, so it is read as text.
        raw = T.StructType([T.StructField("categories", T.StringType())] + DETAILS.fields[1:])
        schema = T.StructType([T.StructField("details", raw) if f.name == "details" else f for f in EVENT_SCHEMA.fields]
                              + [T.StructField("_corrupt_record", T.StringType())])
        read = (spark.read.schema(schema).option("multiLine", str(json_array).lower()).option("mode", "PERMISSIVE")
                     .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
        c = F.col("details.categories")
        listed = F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.isNotNull(), F.array(c))
        return read.withColumn("details", F.when(F.col("details").isNotNull(), F.struct(
            listed.alias("categories"), *(F.col(f"details.{f.name}") for f in DETAILS.fields[1:]))))
    return spark.read.schema(STORED_SCHEMA).parquet(path)


FOREIGN_SCHEMA = T.StructType([T.StructField("details", T.VariantType()) if f.name == "details" else f for f in STORED_SCHEMA.fields])


def load_foreign_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of another service's log: ``details`` may hold any fields of
    any type and stays as it is, a VARIANT (null where it is not JSON);
    malformed records land in ``_corrupt_record``."""
    fields = [T.StructField("details", T.StringType()) if f.name == "details" else f for f in EVENT_SCHEMA.fields]
    raw = (spark.read.schema(T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())]))
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return raw.withColumn("details", F.try_parse_json("details"))


def append_foreign_events(events: DataFrame, path: str) -> None:
    """Append events with VARIANT details to a date-partitioned log."""
    _clustered(prepare_events(events)).write.mode("append").partitionBy("event_date").parquet(path)


def load_foreign_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FOREIGN_SCHEMA).parquet(path)


def _clustered(events: DataFrame) -> DataFrame:
    """By date, so that a day's rows come from few tasks."""
    return events.repartition("event_date", F.pmod(F.xxhash64("session_id", "timestamp"), F.lit(8)))


def prepare_events(events: DataFrame) -> DataFrame:
    """Stamp missing times, cut ``input_text`` to 500 chars, default the
    threat level and action, and add the ``event_date`` partition column."""
    return (events.withColumn("timestamp", F.coalesce(F.col("timestamp").cast("timestamp"), F.current_timestamp()))
                  .withColumn("input_text", F.coalesce(F.substring("input_text", 1, EVENT_TEXT_CHARS), F.lit("")))
                  .withColumn("threat_level", F.coalesce(F.col("threat_level"), F.lit(0.0)))
                  .withColumn("action_taken", F.coalesce(F.col("action_taken"), F.lit("")))
                  .withColumn("session_id", F.coalesce(F.col("session_id"), F.lit("")))
                  .withColumn("event_date", F.to_date("timestamp")))


def full_details(events: DataFrame) -> DataFrame:
    """``details`` with every field of the log's schema, absent ones null."""
    have = {f.name for f in events.schema["details"].dataType.fields}
    return events.withColumn("details", F.struct(*(
        (F.col(f"details.{f.name}") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in DETAILS.fields)))


def append_events(events: DataFrame, path: str) -> None:
    """Append to the date-partitioned log, clustered by date so that a day's
    rows come from few tasks (AQE splits a large day again)."""
    _clustered(prepare_events(full_details(events))).write.mode("append").partitionBy("event_date").parquet(path)


def export_events(events: DataFrame, path: str) -> None:
    """Dump the log as JSON lines."""
    events.write.mode("overwrite").json(path)


def clear_events(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], STORED_SCHEMA).write.mode("overwrite").partitionBy("event_date").parquet(path)
