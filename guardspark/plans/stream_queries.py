"""Streaming queries: each lands its input from the given tables, runs the
stream to completion (``availableNow``) and returns the sink's final state,
which must equal the batch query of the same name without the prefix."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import fixtures as FX
from ..sources.fixtures import audit_events
from ..streaming import streams as ST
from .registry import QUERIES, register


def _same_oracle(batch_name: str):
    return lambda: QUERIES[batch_name].oracle()


def _landed_events(spark, sf, name):
    d = ST.work_dir(spark, name)
    files = ST.land(audit_events(spark, sf), f"{d}/in", "timestamp")
    schema = spark.read.parquet(f"{d}/in").schema
    return d, ST.stream_events(spark, f"{d}/in", schema, files)


def _landed(spark, df, name):
    d = ST.work_dir(spark, name)
    files = ST.land(df, f"{d}/in")
    schema = spark.read.parquet(f"{d}/in").schema
    return d, spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{d}/in")


@register("stream_timeline", _same_oracle("activity_timeline"))
def stream_timeline_q(spark, sf):
    """Hourly timeline maintained by a watermarked stream (update mode)."""
    d, s = _landed_events(spark, sf, "timeline")
    ST.stream_timeline(s, f"{d}/out", f"{d}/ckpt")
    return ST.read_timeline(spark, f"{d}/out")


@register("stream_kpis", _same_oracle("event_kpis"))
def stream_kpis_q(spark, sf):
    """Running dashboard KPIs maintained by a stream (complete mode)."""
    d, s = _landed_events(spark, sf, "kpis")
    ST.stream_kpis(s, f"{d}/out", f"{d}/ckpt")
    return ST.read_kpis(spark, f"{d}/out")


@register("stream_high_threat", _same_oracle("recent_high_threat"))
def stream_high_threat_q(spark, sf):
    """Panel of the newest eight alerts, kept by a stream."""
    d, s = _landed_events(spark, sf, "alerts")
    ST.stream_high_threat(s, f"{d}/out", f"{d}/ckpt")
    return ST.read_high_threat(spark, f"{d}/out")


@register("stream_screen", _same_oracle("screen_prompts"))
def stream_screen_q(spark, sf):
    """Prompts screened as they arrive."""
    d, s = _landed(spark, FX.prompts(spark, sf).select("prompt_id", "query"), "screen")
    ST.stream_screen(s, f"{d}/out", f"{d}/ckpt")
    return spark.read.parquet(f"{d}/out").drop("batch_id")


@register("stream_events", lambda: (
    "SELECT prompt_id, 'INPUT_BLOCKED' AS event_type, categories, threat_level, 'blocked' AS action_taken "
    f"FROM ({QUERIES['screen_prompts'].oracle()}) WHERE blocked"))
def stream_events_q(spark, sf):
    """Audit events that the screening stream appends for blocked prompts."""
    d, s = _landed(spark, FX.prompts(spark, sf).select("prompt_id", "query"), "events")
    ST.stream_screen(s, f"{d}/out", f"{d}/ckpt", f"{d}/events")
    return spark.read.parquet(f"{d}/events").select(
        "prompt_id", "event_type", F.array_join("categories", ",").alias("categories"), "threat_level", "action_taken")


@register("stream_events_once", _same_oracle("stream_events"))
def stream_events_once_q(spark, sf):
    """Events of blocked prompts when every prompt lands three times: twice
    before the stream starts, and once more before it restarts from its
    checkpoint. Each prompt gives one event."""
    d = ST.work_dir(spark, "once")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod("conv_id", F.lit(7200)) * 60 + F.pmod("turn", F.lit(60)))
    p = FX.prompts(spark, sf).select("prompt_id", "query", at.alias("timestamp"))
    files = ST.land(p.unionByName(p), f"{d}/in/first")
    schema = spark.read.parquet(f"{d}/in/first").schema

    def screen():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4 * files).option("recursiveFileLookup", "true").parquet(f"{d}/in")
        ST.stream_screen(ST.once_per_prompt(s).drop("timestamp"), f"{d}/out", f"{d}/ckpt", f"{d}/events")

    screen()
    ST.land(p, f"{d}/in/second")
    screen()
    return spark.read.parquet(f"{d}/events").select(
        "prompt_id", "event_type", F.array_join("categories", ",").alias("categories"), "threat_level", "action_taken")


@register("stream_redact", _same_oracle("check_outputs"))
def stream_redact_q(spark, sf):
    """Answers scanned and redacted in flight."""
    d, s = _landed(spark, FX.answers(spark, sf, FX.prompts(spark, sf)), "redact")
    ST.stream_redact(s, f"{d}/out", f"{d}/ckpt")
    return spark.read.parquet(f"{d}/out")
