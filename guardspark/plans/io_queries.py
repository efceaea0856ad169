"""Round-trip queries for the sinks: write derived tables under the
session's checkpoint folder, read them back, and answer a question whose
oracle already exists (the read-back must equal the in-memory result)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import sq_norm
from ..operators import audit as A
from ..sources import corpus as C
from ..sources import events as E
from ..sources.fixtures import audit_events
from ..sources.tables import read_table
from ..streaming.streams import work_dir
from . import sqlgen as S
from .registry import QUERIES, register
from .text_queries import _CLEAN_SRC


def _same_oracle(name: str):
    return lambda: QUERIES[name].oracle()


def _ingested(spark, sf, where=None):
    d = read_table(spark, sf, "documents", spread=True).withColumnRenamed("source", "source_file")
    if where is not None:
        d = d.where(where)
    return C.ingest_corpus(d)


def _chunk_view(t):
    return t.select("id", "doc_id", "source_file", "chunk_index", sq_norm("vector").alias("sq_norm"))


@register("save_load_chunks", _same_oracle("ingest_corpus"))
def save_load_chunks_q(spark, sf):
    """Chunk table written to parquet and read back."""
    path = work_dir(spark, "chunks") + "/t"
    C.save_chunks(_ingested(spark, sf), path)
    return _chunk_view(C.load_chunks(spark, path))


@register("append_chunks", _same_oracle("ingest_corpus"))
def append_chunks_q(spark, sf):
    """One source ingested first, the others appended later: same table."""
    path = work_dir(spark, "append") + "/t"
    C.save_chunks(_ingested(spark, sf, F.col("source") == "src0"), path)
    C.append_chunks(_ingested(spark, sf, F.col("source") != "src0"), path)
    return _chunk_view(C.load_chunks(spark, path))


@register("clear_chunks", lambda: S.with_ctes(S.chunk_ctes(_CLEAN_SRC),
          "SELECT source_file, CAST(count(*) AS BIGINT) AS n_before, CAST(0 AS BIGINT) AS n_cleared, "
          "CAST(count(*) FILTER (WHERE source_file <> 'src0') AS BIGINT) AS n_after FROM chunks GROUP BY source_file"))
def clear_chunks_q(spark, sf):
    """Chunks per source before a clear, after it, and after all but one
    source are appended again."""
    path = work_dir(spark, "clear")
    t = _ingested(spark, sf)
    C.save_chunks(t, f"{path}/before")
    C.save_chunks(C.load_chunks(spark, f"{path}/before"), f"{path}/t")
    C.clear_chunks(spark, f"{path}/t", t.schema)
    cleared = {r["source_file"]: r["n_chunks"] for r in C.corpus_status(C.load_chunks(spark, f"{path}/t")).collect()}
    C.append_chunks(C.load_chunks(spark, f"{path}/before").where("source_file <> 'src0'"), f"{path}/t")
    before, after = (C.corpus_status(C.load_chunks(spark, f"{path}/{x}")).drop("n_docs", "n_chars") for x in ("before", "t"))
    return (before.withColumnRenamed("n_chunks", "n_before").join(after.withColumnRenamed("n_chunks", "n_after"), "source_file", "left")
                  .select("source_file", "n_before", F.lit(sum(cleared.values())).cast("bigint").alias("n_cleared"),
                          F.coalesce("n_after", F.lit(0)).cast("bigint").alias("n_after")))


@register("load_events_details", lambda: (
    "SELECT event_id, (event_id % 3 = 0) AS one_string, CASE event_id % 3 WHEN 0 THEN 'solo,kind' WHEN 1 THEN 'a|b' END AS categories, "
    "CASE WHEN event_id % 2 = 0 THEN 'issue one|issue two' END AS issues, CAST(event_id % 7 AS DOUBLE) / 8 AS regex_score, "
    "CAST(event_id % 5 AS BIGINT) AS votes FROM events"))
def load_events_details_q(spark, sf):
    """A service log with every detail field, categories as list, string or
    absent, loaded, appended to the table and read back."""
    d = work_dir(spark, "details")
    i = F.col("event_id")
    cats = F.when(i % 3 == 0, F.lit('"solo,kind"')).when(i % 3 == 1, F.lit('["a", "b"]')).otherwise(F.lit("null"))
    line = F.concat(F.lit('{"timestamp": "2024-01-01T00:00:00", "event_type": "X", "session_id": "'), i, F.lit('", "details": {"categories": '), cats,
                    F.when(i % 2 == 0, F.lit(', "issues": ["issue one", "issue two"]')).otherwise(F.lit("")),
                    F.lit(', "regex_score": '), (i % 7).cast("double") / 8, F.lit(', "category_votes": {"k": '), i % 5, F.lit("}}}"))
    read_table(spark, sf, "events").select(line.alias("value")).write.text(f"{d}/json")
    E.append_events(E.load_events(spark, f"{d}/json", fmt="json").drop("_corrupt_record"), f"{d}/log")
    t = E.load_events(spark, f"{d}/log")
    return t.select(F.col("session_id").cast("bigint").alias("event_id"),
                    F.coalesce(F.get("details.categories", 0) == "solo,kind", F.lit(False)).alias("one_string"),
                    F.array_join("details.categories", "|").alias("categories"), F.array_join("details.issues", "|").alias("issues"),
                    F.col("details.regex_score").alias("regex_score"), F.col("details.category_votes")["k"].cast("bigint").alias("votes"))


@register("clear_events", lambda: (
    "SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_cleared, "
    "count(*) AS n_after FROM events"))
def clear_events_q(spark, sf):
    """Rows of an event log before a clear, after it, and appended again."""
    path = work_dir(spark, "clear-events") + "/log"
    ev = audit_events(spark, sf).drop("event_id")
    counts = []
    E.append_events(ev, path)
    counts.append(E.load_events(spark, path).count())
    E.clear_events(spark, path)
    counts.append(E.load_events(spark, path).count())
    E.append_events(ev, path)
    return E.load_events(spark, path).agg(F.lit(counts[0]).cast("bigint").alias("n_before"),
                                          F.lit(counts[1]).cast("bigint").alias("n_cleared"), F.count(F.lit(1)).alias("n_after"))


@register("append_load_events", _same_oracle("event_kpis"))
def append_load_events_q(spark, sf):
    """Audit events appended to the date-partitioned log and read back."""
    path = work_dir(spark, "events") + "/log"
    ev = audit_events(spark, sf).drop("event_id")
    E.append_events(ev, path)
    return A.event_kpis(E.load_events(spark, path))


@register("export_events", _same_oracle("events_by_type"))
def export_events_q(spark, sf):
    """Event log exported as JSON lines and loaded again."""
    path = work_dir(spark, "export") + "/json"
    E.export_events(audit_events(spark, sf).drop("event_id"), path)
    return A.events_by_type(E.load_events(spark, path, fmt="json"))
