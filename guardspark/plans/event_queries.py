"""Queries over the security event log (audit analytics)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..sources.fixtures import audit_events
from .fixture_sql import audit_events_cte
from .registry import register

_TS = "'%Y-%m-%d %H:%M:%S.%f'"
_CATS = ("CASE WHEN len(categories) > 0 THEN categories ELSE coalesce(patterns_matched, []::VARCHAR[]) END")


def _w(body: str) -> str:
    return "WITH " + audit_events_cte() + "\n" + body


def _preview(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END"


@register("event_kpis", lambda: _w(
    "SELECT CAST(count(*) AS BIGINT) AS total_events, "
    "CAST(count(*) FILTER (WHERE action_taken = 'blocked') AS BIGINT) AS blocked_count, "
    "CAST(count(*) FILTER (WHERE action_taken = 'sanitized') AS BIGINT) AS sanitized_count, "
    "coalesce(round_even(CAST(count(*) FILTER (WHERE action_taken = 'blocked') AS DOUBLE) / nullif(count(*), 0), 3), 0.0) "
    "AS block_rate, coalesce(round_even(avg(threat_level), 3), 0.0) AS avg_threat_level, "
    "CAST(count(*) FILTER (WHERE threat_level >= 0.7) AS BIGINT) AS high_threat_count FROM audit_events"))
def event_kpis_q(spark, sf):
    """Dashboard KPIs: totals, block rate, average threat, high-threat count."""
    return A.event_kpis(audit_events(spark, sf))


@register("event_summary", lambda: _w(
    "SELECT CAST(count(*) AS BIGINT) AS total_events, round(coalesce(avg(threat_level), 0.0), 6) AS avg_threat_level, "
    "CAST(count(*) FILTER (WHERE threat_level >= 0.7) AS BIGINT) AS high_threat_count, "
    f"strftime(min(timestamp), {_TS}) AS first_event, strftime(max(timestamp), {_TS}) AS last_event "
    "FROM audit_events"))
def event_summary_q(spark, sf):
    """Log summary: totals, mean threat, first and last event."""
    return A.event_summary(audit_events(spark, sf)).withColumn("avg_threat_level", F.round("avg_threat_level", 6))


@register("events_by_type", lambda: _w(
    "SELECT event_type, CAST(count(*) AS BIGINT) AS n_events FROM audit_events GROUP BY event_type"))
def events_by_type_q(spark, sf):
    """Event counts per type."""
    return A.events_by_type(audit_events(spark, sf))


@register("events_by_category", lambda: _w(
    f"SELECT category, CAST(count(*) AS BIGINT) AS n_events FROM (SELECT unnest({_CATS}) AS category "
    "FROM audit_events) GROUP BY category"))
def events_by_category_q(spark, sf):
    """Event counts per attack category (categories, else matched patterns)."""
    return A.events_by_category(audit_events(spark, sf))


@register("threat_histogram", lambda: _w(
    "SELECT b.bucket, CAST(coalesce(c.n, 0) AS BIGINT) AS n_events FROM "
    "(VALUES ('low'), ('medium'), ('high')) AS b(bucket) LEFT JOIN "
    "(SELECT CASE WHEN threat_level >= 0.7 THEN 'high' WHEN threat_level >= 0.4 THEN 'medium' ELSE 'low' END "
    "AS bucket, count(*) AS n FROM audit_events GROUP BY 1) c ON b.bucket = c.bucket"))
def threat_histogram_q(spark, sf):
    """Low / medium / high counts, zero-filled."""
    return A.threat_histogram(audit_events(spark, sf))


_TIMELINE = ("SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%dT%H') AS hour, CAST(count(*) AS BIGINT) AS total, "
             "CAST(count(*) FILTER (WHERE action_taken = 'blocked') AS BIGINT) AS blocked FROM audit_events GROUP BY 1")


@register("activity_timeline", lambda: _w(_TIMELINE))
def activity_timeline_q(spark, sf):
    """Hourly totals and blocked counts, no gap filling."""
    return A.activity_timeline(audit_events(spark, sf))


@register("timeline_scale", lambda: _w(
    f"SELECT hour, total, blocked, round(total / greatest(1, max(total) OVER ()), 6) AS scaled FROM ({_TIMELINE})"))
def timeline_scale_q(spark, sf):
    """Hourly timeline normalised by max(1, largest hour)."""
    return A.timeline_scale(audit_events(spark, sf))


@register("recent_high_threat", lambda: _w(
    f"SELECT strftime(timestamp, {_TS}) AS timestamp, event_type, threat_level, {_preview('input_text', 80)} AS preview "
    "FROM audit_events WHERE threat_level >= 0.7 ORDER BY audit_events.timestamp DESC, event_id LIMIT 8"))
def recent_high_threat_q(spark, sf):
    """Eight newest high-threat events with an 80-char preview."""
    return A.recent_high_threat(audit_events(spark, sf))


@register("get_events", lambda: _w(
    f"SELECT event_id, strftime(timestamp, {_TS}) AS timestamp, event_type, threat_level, action_taken FROM audit_events "
    "WHERE event_type = 'INPUT_BLOCKED' AND threat_level >= 0.5 ORDER BY audit_events.timestamp DESC, event_id LIMIT 50"))
def get_events_q(spark, sf):
    """Blocked inputs at threat >= 0.5, newest 50 (the API's default limit)."""
    ev = A.get_events(audit_events(spark, sf), "INPUT_BLOCKED", 0.5, 50)
    return ev.select("event_id", F.date_format("timestamp", A.TS_LABEL).alias("timestamp"), "event_type",
                     "threat_level", "action_taken")


@register("event_feed", lambda: _w(
    f"SELECT event_id, strftime(timestamp, {_TS}) AS timestamp, event_type, {_preview('input_text', 100)} AS input_preview, "
    "threat_level, action_taken, CASE WHEN action_taken = 'blocked' THEN 'blocked' WHEN action_taken = 'sanitized' "
    "THEN 'warning' ELSE 'info' END AS css_class FROM audit_events ORDER BY audit_events.timestamp DESC, event_id LIMIT 20"))
def event_feed_q(spark, sf):
    """Log panel: newest 20 events with preview and display class."""
    return A.event_feed(audit_events(spark, sf))


@register("type_share", lambda: _w(
    "SELECT event_type, n_events, round(n_events / sum(n_events) OVER (), 6) AS share FROM "
    "(SELECT event_type, CAST(count(*) AS BIGINT) AS n_events FROM audit_events GROUP BY 1) WHERE n_events > 0"))
def type_share_q(spark, sf):
    """Share of each event type in the log."""
    return A.type_share(audit_events(spark, sf))


@register("category_ranking", lambda: _w(
    "SELECT category, n_events, round(100.0 * n_events / max(n_events) OVER (), 6) AS pct_of_max, "
    "CAST(row_number() OVER (ORDER BY n_events DESC, category) AS BIGINT) AS position FROM "
    f"(SELECT category, CAST(count(*) AS BIGINT) AS n_events FROM (SELECT unnest({_CATS}) AS category "
    "FROM audit_events) GROUP BY category)"))
def category_ranking_q(spark, sf):
    """Categories ranked by count with bar width relative to the largest."""
    return A.category_ranking(audit_events(spark, sf))
