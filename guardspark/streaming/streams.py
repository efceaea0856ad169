"""Structured Streaming versions of the screening, redaction and dashboard
jobs.

The column logic is the batch logic (stateless operators run unchanged on a
stream). Stateful panels use an event-time watermark. Every sink is a table
of one folder per micro-batch, written with overwrite: a batch that is run
again replaces its own folder, so results are exactly once, and a reader
never meets a half-written table. The timeline keeps the newest row of each
window (:func:`compact_timeline` folds old batches into one), the KPI panel
the newest batch. All files live under the session's checkpoint folder, which
a cluster points at shared storage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import EVENT_TEXT_CHARS, HIGH_THREAT
from ..operators import audit as A
from ..operators import output_scan as OS
from ..operators import screen as SCR
from ..session import work_dir  # noqa: F401  (callers take it from here)


ROWS_PER_FILE = 100_000
SLICES = 8                   # landing slices at least, so that a stream takes several micro-batches


def land(df: DataFrame, path: str, order_col: str | None = None, rows_per_file: int = ROWS_PER_FILE) -> int:
    """Write a table as a landing folder, the way upstream writers would, and
    return how many files a micro-batch of one slice has.

    The file count follows the rows. With ``order_col`` the slices are
    consecutive ranges of it, landed one after the other (sources take files
    by age, and rows older than the watermark would count as late). Rows
    without a value belong to the first slice.
    """
    if order_col is None:
        per_slice = _per_slice(df.count(), rows_per_file)
        df.repartition(per_slice * SLICES).write.mode("overwrite").parquet(path)
        return per_slice
    at = F.unix_micros(F.col(order_col).cast("timestamp"))
    n, cuts = df.agg(F.count(F.lit(1)), F.percentile_approx(at, [i / SLICES for i in range(1, SLICES)], 10_000)).first()
    per_slice = _per_slice(n, rows_per_file)
    # The input is written once, by slice; the slices then land one by one.
    later = [(at >= c).cast("int") for c in sorted(set(cuts or []))]
    number = F.coalesce(sum(later, F.lit(0)), F.lit(0))
    staged = f"{path}-slices"
    df.withColumn("_slice", number).repartition(per_slice * SLICES, "_slice", F.pmod(F.xxhash64(order_col), F.lit(per_slice))) \
      .write.mode("overwrite").partitionBy("_slice").parquet(staged)
    slices = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(staged)
    for i in range(len(later) + 1):
        slices.where(F.col("_slice") == i).drop("_slice").coalesce(per_slice).write.mode("append").parquet(path)
    return per_slice


def _per_slice(rows: int, rows_per_file: int) -> int:
    return -(-max(SLICES, -(-rows // rows_per_file)) // SLICES)


def _run(writer, checkpoint: str):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def data_batches(query) -> int:
    """Micro-batches of a finished query that carried rows."""
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)


def late_rows(query) -> int:
    """Rows that came later than the watermark and were dropped by the state."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


def _per_batch(out_path: str):
    def write(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    return write


def stream_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Event stream with ``timestamp`` as TIMESTAMP (watermarks reject NTZ)."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def stream_timeline(events: DataFrame, out_path: str, checkpoint: str, watermark: str = "1 hour"):
    """Hourly totals with a watermark, upserted per micro-batch.

    State is keyed by the event-time window (which the watermark expires)
    and the local hour label; windows align to epoch hours, local hours may
    not (half-hour zones), so readers add the pieces of each hour."""
    hour = F.date_format(F.date_trunc("hour", "timestamp"), A.HOUR_LABEL)
    agg = (events.withWatermark("timestamp", watermark)
                 .groupBy(F.window("timestamp", "1 hour").alias("w"), hour.alias("hour"))
                 .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("action_taken") == "blocked").alias("blocked")))

    rows = agg.select(F.col("w.start").alias("window_start"), "hour", "total", "blocked")
    return _run(rows.writeStream.outputMode("update").foreachBatch(_per_batch(out_path)), checkpoint)


def _newest_windows(spark: SparkSession, out_path: str) -> DataFrame:
    w = Window.partitionBy("window_start", "hour").orderBy(F.col("batch_id").desc())
    return spark.read.parquet(out_path).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def compact_timeline(spark: SparkSession, out_path: str, to_path: str) -> None:
    """Write the table's current windows, one row each, as a table of one
    batch (the newest so far) for readers and later batches to go on from."""
    t = _newest_windows(spark, out_path)
    last = spark.read.parquet(out_path).agg(F.max("batch_id")).first()[0]
    t.drop("batch_id").write.mode("overwrite").parquet(f"{to_path}/batch_id={last}")


def read_timeline(spark: SparkSession, out_path: str) -> DataFrame:
    """Current timeline: the newest upserted row of every window, by hour."""
    return _newest_windows(spark, out_path).groupBy("hour").agg(F.sum("total").cast("bigint").alias("total"),
                                                                F.sum("blocked").cast("bigint").alias("blocked"))


def stream_kpis(events: DataFrame, out_path: str, checkpoint: str):
    """Running KPIs (complete mode): one row per batch, the newest counts."""
    agg = events.agg(F.count(F.lit(1)).alias("total_events"),
                     F.count_if(F.col("action_taken") == "blocked").alias("blocked_count"),
                     F.count_if(F.col("action_taken") == "sanitized").alias("sanitized_count"),
                     F.sum("threat_level").alias("_sum"), F.count("threat_level").alias("_scored"),
                     F.count_if(F.col("threat_level") >= HIGH_THREAT).alias("high_threat_count"))

    return _run(agg.writeStream.outputMode("complete").foreachBatch(_per_batch(out_path)), checkpoint)


def read_kpis(spark: SparkSession, out_path: str) -> DataFrame:
    k = spark.read.parquet(out_path).orderBy(F.col("batch_id").desc()).limit(1)
    return k.select("total_events", "blocked_count", "sanitized_count",
                    F.coalesce(F.bround(F.try_divide(F.col("blocked_count"), F.col("total_events")), 3),
                               F.lit(0.0)).alias("block_rate"),
                    F.coalesce(F.bround(F.try_divide(F.col("_sum"), F.col("_scored")), 3),
                               F.lit(0.0)).alias("avg_threat_level"),
                    "high_threat_count")


PANEL_ROWS = 8


def stream_high_threat(events: DataFrame, out_path: str, checkpoint: str, n: int = PANEL_ROWS):
    """Alert panel: the newest ``n`` events at or above the high-threat level.

    Every micro-batch picks its own newest ``n``, folds them into the ``n`` of
    the batch before and writes the new panel, so what is kept is bounded and
    a reader sorts nothing but the panel. Events may come in any order."""
    spark = events.sparkSession
    newest = [F.col("timestamp").desc(), F.col("event_id").asc()]

    def write(batch: DataFrame, batch_id: int):
        top = batch.where(F.col("threat_level") >= HIGH_THREAT).orderBy(*newest).limit(n)
        before = _panel(spark, out_path, batch_id)
        if before is not None:
            top = before.unionByName(top).orderBy(*newest).limit(n)
        _per_batch(out_path)(top.coalesce(1), batch_id)

    return _run(events.writeStream.outputMode("append").foreachBatch(write), checkpoint)


def _panel(spark: SparkSession, out_path: str, before: int | None = None) -> DataFrame | None:
    """The panel of the newest whole batch (earlier than ``before``)."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = jvm.Path(out_path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    ids = sorted((int(x.split("=")[1]) for x in names if x.startswith("batch_id=")), reverse=True)
    for i in ids:
        if (before is None or i < before) and fs.exists(jvm.Path(f"{out_path}/batch_id={i}/_SUCCESS")):
            return spark.read.parquet(f"{out_path}/batch_id={i}")
    return None


def read_high_threat(spark: SparkSession, out_path: str) -> DataFrame:
    """The alert panel as of the newest micro-batch."""
    return A.recent_high_threat(_panel(spark, out_path), PANEL_ROWS)


def once_per_prompt(prompts: DataFrame, event_time: str = "timestamp", delay: str = "10 days", key: str = "prompt_id") -> DataFrame:
    """A stream with each prompt once, however often its rows land, also
    across restarts from the same checkpoint. Keys are remembered for
    ``delay`` of event time; rows behind that are dropped as late."""
    return prompts.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def stream_screen(prompts: DataFrame, out_path: str, checkpoint: str, events_path: str | None = None):
    """Screen prompts as they arrive; decisions are appended, and blocked
    prompts also become events at ``events_path``. Where the same prompt may
    land twice, pass the stream through :func:`once_per_prompt`."""
    s = SCR.screen_prompts(prompts, "query", "prompt_id")
    cols = ["prompt_id", "regex_score", "semantic_score", "semantic_category", "judge_used", "threat_level",
            "decision", "blocked", "primary_category", "reason"]
    joined = F.array_join("categories", ",").alias("categories")

    def write(batch: DataFrame, batch_id: int):
        batch = batch.persist()
        _per_batch(out_path)(batch.select(*cols, joined), batch_id)
        if events_path is not None:
            _per_batch(events_path)(blocked_events(batch), batch_id)
        batch.unpersist()

    return _run(s.select(*cols, "categories", "query").writeStream.outputMode("append").foreachBatch(write), checkpoint)


def blocked_events(screened: DataFrame) -> DataFrame:
    """Audit events of screened prompts that were blocked."""
    return screened.where("blocked").select(
        "prompt_id", F.lit("INPUT_BLOCKED").alias("event_type"),
        F.substring("query", 1, EVENT_TEXT_CHARS).alias("input_text"), "categories", "regex_score", "semantic_score",
        F.col("threat_level").cast("double").alias("threat_level"), F.lit("blocked").alias("action_taken"))


def stream_redact(answers: DataFrame, out_path: str, checkpoint: str, text_col: str = "raw_answer"):
    """Scan and redact answers in flight."""
    c = OS.check_outputs(answers, text_col)
    out = c.select("prompt_id", F.col("out_blocked").alias("blocked"), F.col("out_had_issues").alias("had_issues"),
                   F.size("out_issues").cast("bigint").alias("n_issues"), F.col("out_sanitized").alias("sanitized"),
                   F.array_join(F.transform("out_issues", lambda i: i["category"]), ",").alias("issue_categories"))
    return _run(out.writeStream.outputMode("append").format("parquet").option("path", out_path), checkpoint)
