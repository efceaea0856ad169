"""Queries over chunk sanitizing and trust scoring (planted dirty texts)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import chunking as CH
from ..operators import scrub as SC
from ..sources.fixtures import dirty_texts
from ..sources.tables import read_table
from . import sqlgen as S
from .fixture_sql import dirty_texts_cte
from .registry import register


def _w(body: str, extra: list[str] | None = None) -> str:
    return S.with_ctes([dirty_texts_cte()] + (extra or []), body)


@register("normalize_homoglyphs", lambda: _w(
    f"SELECT id, {S.homoglyphs('text')} AS normalized, ({S.homoglyphs('text')} <> text) AS changed FROM dirty_texts"))
def normalize_homoglyphs_q(spark, sf):
    """Look-alike letters mapped to ASCII."""
    d = dirty_texts(spark, sf)
    n = TX.normalize_homoglyphs("text")
    return d.select("id", n.alias("normalized"), (n != F.col("text")).alias("changed"))


@register("sanitize_text", lambda: _w(
    f"SELECT id, s AS sanitized, CAST(length(text) - length(s) AS BIGINT) AS chars_removed "
    f"FROM (SELECT id, text, {S.sanitize('text')} AS s FROM dirty_texts)"))
def sanitize_text_q(spark, sf):
    """Whole planted documents through the full sanitizer."""
    s = SC.sanitize_text(dirty_texts(spark, sf), "text", "sanitized")
    return s.select("id", "sanitized", (F.length("text") - F.length("sanitized")).cast("bigint").alias("chars_removed"))


@register("sanitize_pages", lambda: f"SELECT page_id, {S.sanitize('html')} AS sanitized FROM pages")
def sanitize_pages_q(spark, sf):
    """Raw web pages through the sanitizer (comments, markup, markers)."""
    p = read_table(spark, sf, "pages", spread=True)
    return SC.sanitize_text(p, "html", "sanitized").select("page_id", "sanitized")


def _emb_sql(x: str) -> str:
    t = S.homoglyphs(x)
    t = f"regexp_replace({t}, '(?s)<!--.*?-->', '', 'g')"
    t = f"regexp_replace({t}, '(?s)/\\*.*?\\*/', '', 'g')"
    return S.py_strip(t)


@register("sanitize_for_embedding", lambda: _w(f"SELECT id, {_emb_sql('text')} AS text FROM dirty_texts"))
def sanitize_for_embedding_q(spark, sf):
    """Light pre-embedding pass: look-alikes and comments."""
    return dirty_texts(spark, sf).select("id", SC.sanitize_for_embedding("text").alias("text"))


def _detect_sql() -> str:
    parts = []
    for p, _, cat in S.sanitizer_delete_re2():
        one = "regexp_replace(m, '\\n\\n$', '')" if cat == "labeled_instruction" else "m"
        parts.append(f"SELECT id, '{cat}' AS category, {S.count_matches('text', p)} AS n_matches, "
                     f"array_to_string(list_transform(regexp_extract_all(text, {S.lit(p)})[1:3], lambda m: left({one}, 100)), ' ¦ ') "
                     f"AS samples FROM dirty_texts")
    return _w(f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n_matches > 0")


@register("detect_instructions", _detect_sql)
def detect_instructions_q(spark, sf):
    """Instruction patterns found per planted document, with up to three samples."""
    d = SC.detect_instructions(dirty_texts(spark, sf), ["id"], "text")
    return d.select("id", "category", "n_matches", F.array_join("samples", " ¦ ").alias("samples"))


def _report_sql() -> str:
    kinds = " + ".join(f"CASE WHEN {S.matches('text', p)} THEN 1 ELSE 0 END" for p, _, _ in S.sanitizer_delete_re2())
    each = ", ".join(f"CASE WHEN {S.matches('text', p)} THEN '{c}:' || {S.count_matches('text', p)} END"
                     for p, _, c in S.sanitizer_delete_re2())
    return _w("SELECT id, CAST(n0 AS BIGINT) AS original_length, CAST(n1 AS BIGINT) AS sanitized_length, "
              "CAST(n0 - n1 AS BIGINT) AS characters_removed, "
              "round(CASE WHEN n0 > 0 THEN (n0 - n1) / n0 * 100.0 ELSE 0.0 END, 6) AS removal_percentage, "
              f"CAST(k AS BIGINT) AS instruction_kinds, array_to_string(list_filter(e, lambda x: x IS NOT NULL), ',') AS instructions "
              f"FROM (SELECT id, [{each}] AS e, length(text) AS n0, "
              f"length({S.sanitize('text')}) AS n1, {kinds} AS k FROM dirty_texts)")


@register("sanitization_report", _report_sql)
def sanitization_report_q(spark, sf):
    """Per document: characters removed, percent and instruction kinds."""
    r = SC.sanitization_report(dirty_texts(spark, sf), ["id"], "text")
    return r.withColumn("instructions", F.array_join(F.transform("instructions", lambda i: F.concat_ws(
        ":", i["category"], i["n_matches"])), ","))


@register("trust_score", lambda: _w(f"SELECT id, round({S.trust('text')}, 6) AS trust_score FROM dirty_texts"))
def trust_score_q(spark, sf):
    """Trust of every planted document at the neutral retrieval score."""
    return dirty_texts(spark, sf).select("id", F.round(SC.trust_score("text"), 6).alias("trust_score"))


def _trust_report_sql() -> str:
    from ..functions.patterns import TRUST_NEGATIVE, TRUST_POSITIVE

    def hits(bank):
        items = ", ".join(f"CASE WHEN {S.matches('text', S.re2(p))} THEN '{c}:{round(d * 100)}:' || {S.count_matches('text', S.re2(p))} END"
                          for p, d, c in bank)
        return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"

    return _w(f"SELECT id, round(t, 6) AS trust_score, sus AS suspicious_patterns, pos AS trust_patterns, "
              f"CAST({S.max_context('t')} AS INTEGER) AS max_context_allowed, "
              f"CASE WHEN t >= 0.6 THEN 'include' ELSE 'limit' END AS recommendation FROM "
              f"(SELECT id, {S.trust('text')} AS t, {hits(TRUST_NEGATIVE)} AS sus, {hits(TRUST_POSITIVE)} AS pos "
              f"FROM dirty_texts)")


@register("trust_report", _trust_report_sql)
def trust_report_q(spark, sf):
    """Trust, pattern categories that moved it, context cap, recommendation."""
    r = SC.trust_report(dirty_texts(spark, sf), ["id"], "text")
    return r.select("id", F.round("trust_score", 6).alias("trust_score"),
                    *(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["category"], F.round(x["impact"] * 100).cast("int"), x["count"])),
                                   ",").alias(c) for c in ("suspicious_patterns", "trust_patterns")),
                    "max_context_allowed", "recommendation")


def _dirty_chunks_sql() -> list[str]:
    src = f"SELECT id AS doc_id, source AS source_file, {S.clean_text('text')} AS t FROM dirty_texts"
    return S.chunk_ctes(src)


def _dirty_chunks(spark, sf):
    d = dirty_texts(spark, sf).select(F.col("id").alias("doc_id"), F.col("source").alias("source_file"),
                                      TX.clean_text("text").alias("text"))
    return CH.chunk_documents(d, "text", ["doc_id", "source_file"])


@register("trusted_chunks", lambda: _w(
    f"SELECT doc_id, chunk_index, round({S.trust('content')}, 6) AS trust_score FROM chunks "
    f"WHERE {S.trust('content')} >= 0.6", _dirty_chunks_sql()))
def trusted_chunks_q(spark, sf):
    """Chunks of the planted corpus that pass the trust threshold."""
    c = _dirty_chunks(spark, sf).withColumn("t", SC.trust_score("content"))
    return c.where(SC.trusted("t")).select("doc_id", "chunk_index", F.round("t", 6).alias("trust_score"))


@register("max_context_length", lambda: _w(
    f"SELECT source_file, round(a, 6) AS avg_trust, CAST({S.max_context('a')} AS INTEGER) AS max_context "
    f"FROM (SELECT source_file, avg({S.trust('content')}) AS a FROM chunks GROUP BY source_file)", _dirty_chunks_sql()))
def max_context_length_q(spark, sf):
    """Context budget per source from the average trust of its chunks."""
    c = _dirty_chunks(spark, sf).groupBy("source_file").agg(F.avg(SC.trust_score("content")).alias("a"))
    return c.select("source_file", F.round("a", 6).alias("avg_trust"), SC.max_context_length("a").alias("max_context"))
