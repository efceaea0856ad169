"""Audit analytics over a security event table.

Input columns: ``timestamp`` (TIMESTAMP or TIMESTAMP_NTZ), ``event_type``,
``input_text``, ``details`` (struct with ``categories`` and
``patterns_matched`` arrays), ``threat_level``, ``action_taken`` and an
``event_id`` tie-breaker. Every panel is one partial/final hash aggregate
over a pruned scan; the only windows run over already-aggregated rows whose
count is bounded by the number of types, categories or hours.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import HIGH_THREAT, MEDIUM_THREAT
from ..functions.text import preview

HOUR_LABEL = "yyyy-MM-dd'T'HH"      # ISO timestamp cut after the hour
TS_LABEL = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _blocked():
    return F.col("action_taken") == "blocked"


def event_kpis(ev: DataFrame) -> DataFrame:
    """Headline numbers; an empty log gives one row of zeros."""
    total = F.count(F.lit(1))
    k = ev.agg(total.alias("total_events"),
               F.count_if(_blocked()).alias("blocked_count"),
               F.count_if(F.col("action_taken") == "sanitized").alias("sanitized_count"),
               F.avg("threat_level").alias("_avg"),
               F.count_if(F.col("threat_level") >= HIGH_THREAT).alias("high_threat_count"))
    return k.select(
        "total_events", "blocked_count", "sanitized_count",
        F.coalesce(F.bround(F.try_divide(F.col("blocked_count"), F.col("total_events")), 3),
                   F.lit(0.0)).alias("block_rate"),
        F.coalesce(F.bround("_avg", 3), F.lit(0.0)).alias("avg_threat_level"),
        "high_threat_count")


def event_summary(ev: DataFrame) -> DataFrame:
    """Total, unrounded average threat, high count, first and last event."""
    return ev.agg(F.count(F.lit(1)).alias("total_events"),
                  F.coalesce(F.avg("threat_level"), F.lit(0.0)).alias("avg_threat_level"),
                  F.count_if(F.col("threat_level") >= HIGH_THREAT).alias("high_threat_count"),
                  F.date_format(F.min("timestamp"), TS_LABEL).alias("first_event"),
                  F.date_format(F.max("timestamp"), TS_LABEL).alias("last_event"))


def events_by_type(ev: DataFrame) -> DataFrame:
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


def event_categories(ev: DataFrame):
    """Categories of an event: ``details.categories`` when non-empty, else
    ``details.patterns_matched``, else none."""
    cats = F.col("details.categories")
    pats = F.coalesce(F.col("details.patterns_matched"), F.array().cast("array<string>"))
    return F.when(F.size(F.coalesce(cats, F.array().cast("array<string>"))) > 0, cats).otherwise(pats)


def events_by_category(ev: DataFrame) -> DataFrame:
    return (ev.select(F.explode(event_categories(ev)).alias("category"))
              .groupBy("category").agg(F.count(F.lit(1)).alias("n_events")))


def threat_histogram(ev: DataFrame) -> DataFrame:
    """Three buckets, always present: one aggregate, then ``stack``."""
    t = F.col("threat_level")
    h = ev.agg(F.count_if(t >= HIGH_THREAT).alias("high"),
               F.count_if((t >= MEDIUM_THREAT) & (t < HIGH_THREAT)).alias("medium"),
               F.count_if(~(t >= MEDIUM_THREAT) | t.isNull()).alias("low"))
    return h.select(F.expr("stack(3, 'low', low, 'medium', medium, 'high', high) AS (bucket, n_events)"))


def activity_timeline(ev: DataFrame) -> DataFrame:
    """Per hour: total and blocked, ascending; hours without events are absent."""
    return (ev.groupBy(F.date_format(F.date_trunc("hour", "timestamp"), HOUR_LABEL).alias("hour"))
              .agg(F.count(F.lit(1)).alias("total"), F.count_if(_blocked()).alias("blocked"))
              .orderBy("hour"))


def timeline_scale(ev: DataFrame) -> DataFrame:
    """Timeline with each hour scaled by ``max(1, max total)``; the window
    runs over the aggregated hours only."""
    tl = activity_timeline(ev)
    return tl.withColumn("scaled", F.round(F.col("total") / F.greatest(F.lit(1), F.max("total").over(Window.partitionBy())), 6))


def recent_high_threat(ev: DataFrame, n: int = 8) -> DataFrame:
    """Newest ``n`` events at or above the high-threat level (top-k)."""
    return (ev.where(F.col("threat_level") >= HIGH_THREAT)
              .orderBy(F.col("timestamp").desc(), F.col("event_id").asc())
              .limit(n)
              .select(F.date_format("timestamp", TS_LABEL).alias("timestamp"), "event_type", "threat_level",
                      preview("input_text", 80).alias("preview")))


def get_events(ev: DataFrame, event_type: str | None = None, min_threat: float = 0.0,
               limit: int = 100) -> DataFrame:
    """Filtered feed, newest first, at most ``limit`` rows (top-k)."""
    if event_type:
        ev = ev.where(F.col("event_type") == event_type)
    if min_threat > 0:
        ev = ev.where(F.col("threat_level") >= min_threat)
    return ev.orderBy(F.col("timestamp").desc(), F.col("event_id").asc()).limit(limit)


def event_feed(ev: DataFrame, event_type: str | None = None, limit: int = 20) -> DataFrame:
    """Log panel rows: 100-char preview and display class by action."""
    top = get_events(ev, event_type, 0.0, limit)
    act = F.col("action_taken")
    return top.select("event_id", F.date_format("timestamp", TS_LABEL).alias("timestamp"), "event_type",
                      preview("input_text", 100).alias("input_preview"), "threat_level", "action_taken",
                      F.when(act == "blocked", "blocked").when(act == "sanitized", "warning")
                       .otherwise("info").alias("css_class"))


def type_share(ev: DataFrame) -> DataFrame:
    """Donut data: types with a positive count and their share of all events."""
    t = events_by_type(ev).where(F.col("n_events") > 0)
    return t.withColumn("share", F.round(F.col("n_events") / F.sum("n_events").over(Window.partitionBy()), 6))


def category_ranking(ev: DataFrame) -> DataFrame:
    """Bar data: categories by count, bar width as percent of the largest."""
    c = events_by_category(ev)
    w = Window.orderBy(F.col("n_events").desc(), F.col("category").asc())
    return (c.withColumn("pct_of_max", F.round(100.0 * F.col("n_events") / F.max("n_events").over(Window.partitionBy()), 6))
             .withColumn("position", F.row_number().over(w).cast("bigint")))
