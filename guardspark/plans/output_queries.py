"""Queries over output scanning: redaction, PII counts, output checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import SENSITIVE_PATTERNS
from ..operators import output_scan as osc
from ..sources.tables import read_table
from . import sqlgen as S
from .registry import register

_CATS = [c for _, _, c in SENSITIVE_PATTERNS]


def _redact_sensitive_sql() -> str:
    ctes, final, col = S.redact_ctes("documents", "text")
    body = (f"SELECT doc_id, {col} AS redacted, ({col} <> text) AS changed, "
            + " + ".join(f"n_{c}" for c in _CATS) + f" AS n_redactions FROM {final}")
    return S.with_ctes(ctes, body)


@register("redact_sensitive", _redact_sensitive_sql)
def redact_sensitive_q(spark, sf):
    """Every document with the ten sensitive patterns applied in order."""
    docs = read_table(spark, sf, "documents", spread=True).select("doc_id", "text")
    r = osc.redact_sensitive(docs, "text", "redacted")
    return r.select("doc_id", "redacted", (F.col("redacted") != F.col("text")).alias("changed"),
                    sum((F.col(f"n_{c}") for c in _CATS[1:]), F.col(f"n_{_CATS[0]}")).alias("n_redactions"))


def _corpus_sql() -> str:
    return ("corpus AS (SELECT 'documents' AS kind, doc_id AS row_id, source, text FROM documents "
            "UNION ALL SELECT 'pages' AS kind, page_id AS row_id, 'web' AS source, html AS text FROM pages)")


def _corpus(spark, sf):
    docs = read_table(spark, sf, "documents", spread=True).select(F.lit("documents").alias("kind"),
                                                     F.col("doc_id").alias("row_id"), "source", "text")
    pages = read_table(spark, sf, "pages", spread=True).select(F.lit("pages").alias("kind"), F.col("page_id").alias("row_id"),
                                                  F.lit("web").alias("source"), F.col("html").alias("text"))
    return docs.unionByName(pages)


def _pii_long_sql() -> str:
    ctes, final, _ = S.redact_ctes("corpus", "text")
    unpivot = " UNION ALL ".join(
        f"SELECT kind, row_id, source, '{c}' AS category, n_{c} AS match_count FROM {final} WHERE n_{c} > 0"
        for c in _CATS)
    return [_corpus_sql()] + ctes, unpivot


def _pii_counts_sql() -> str:
    ctes, body = _pii_long_sql()
    return S.with_ctes(ctes, f"SELECT kind, row_id, category, match_count FROM ({body})")


@register("pii_counts", _pii_counts_sql)
def pii_counts_q(spark, sf):
    """Matches per (document or page, category), counted stage by stage."""
    return osc.pii_counts(_corpus(spark, sf), ["kind", "row_id"], "text")


def _pii_by_source_sql() -> str:
    ctes, body = _pii_long_sql()
    return S.with_ctes(ctes, f"SELECT source, category, CAST(count(*) AS BIGINT) AS n_rows, "
                             f"CAST(sum(match_count) AS BIGINT) AS n_matches FROM ({body}) GROUP BY source, category")


@register("pii_by_source", _pii_by_source_sql)
def pii_by_source_q(spark, sf):
    """Flagship: rows with hits and total matches per (source, category)."""
    long = osc.pii_counts(_corpus(spark, sf), ["kind", "row_id", "source"], "text")
    return (long.groupBy("source", "category")
                .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("match_count").cast("bigint").alias("n_matches")))


# --- Answers (planted fixture) -------------------------------------------
from ..functions.patterns import HARMFUL_PATTERNS, MANIPULATION_PATTERNS  # noqa: E402
from ..functions.regex import re2  # noqa: E402
from ..sources import fixtures as FX  # noqa: E402
from .fixture_sql import canary_token_sql, prompt_ctes  # noqa: E402


def _answers(spark, sf):
    p = FX.prompts(spark, sf)
    return FX.answers(spark, sf, p)


def _issues_sql_ctes() -> list[str]:
    """answers -> checked(prompt_id, raw_answer, sanitized, blocked, issues list of struct)."""
    ctes, final, col = S.redact_ctes("answers", "raw_answer")
    harm = S.harmful_list("raw_answer")
    manip = S.manipulation_list("raw_answer")
    sens = ", ".join(f"CASE WHEN n_{c} > 0 THEN {{'type': 'sensitive_data', 'category': '{c}', 'count': n_{c}, "
                     f"'action': 'redacted'}} END" for c in _CATS)
    issues = (f"list_concat(list_concat(list_transform({harm}, lambda c: {{'type': 'harmful_content', 'category': c, "
              f"'count': NULL::BIGINT, 'action': 'blocked'}}), list_transform({manip}, lambda c: "
              f"{{'type': 'manipulation_indicator', 'category': c, 'count': NULL::BIGINT, 'action': 'flagged'}})), "
              f"list_filter([{sens}], lambda x: x IS NOT NULL))")
    return prompt_ctes() + ctes + [
        f"checked AS (SELECT prompt_id, raw_answer, {col} AS sanitized, {issues} AS issues, "
        f"(len({harm}) > 0 OR len({manip}) > 0) AS blocked FROM {final})"]


@register("check_outputs", lambda: S.with_ctes(_issues_sql_ctes(),
          "SELECT prompt_id, coalesce(blocked, false) AS blocked, coalesce(len(issues) > 0, false) AS had_issues, "
          "CAST(len(issues) AS BIGINT) AS n_issues, sanitized, "
          "array_to_string(list_transform(issues, lambda i: i.category), ',') AS issue_categories FROM checked"))
def check_outputs_q(spark, sf):
    """Every answer scanned: block flags, issue list, redacted text."""
    c = osc.check_outputs(_answers(spark, sf), "raw_answer", strict=True)
    return c.select("prompt_id", F.col("out_blocked").alias("blocked"), F.col("out_had_issues").alias("had_issues"),
                    F.size("out_issues").cast("bigint").alias("n_issues"), F.col("out_sanitized").alias("sanitized"),
                    F.array_join(F.transform("out_issues", lambda i: i["category"]), ",").alias("issue_categories"))


@register("issue_rollup", lambda: S.with_ctes(_issues_sql_ctes(),
          "SELECT i.type AS issue_type, i.category AS category, CAST(count(*) AS BIGINT) AS answers, "
          "CAST(sum(coalesce(i.count, 0)) AS BIGINT) AS matches FROM (SELECT unnest(issues) AS i FROM checked) "
          "GROUP BY 1, 2"))
def issue_rollup_q(spark, sf):
    """Issue counts over all answers by type and category."""
    return osc.issue_rollup(osc.check_outputs(_answers(spark, sf), "raw_answer"))


def _flag_sql(bank) -> str:
    parts = " UNION ALL ".join(
        f"SELECT prompt_id, '{c}' AS category FROM answers WHERE {S.matches('raw_answer', re2(p))}" for p, c in bank)
    return S.with_ctes(prompt_ctes(), parts)


@register("harmful_flags", lambda: _flag_sql(HARMFUL_PATTERNS))
def harmful_flags_q(spark, sf):
    """(answer, harmful category) pairs; any pair blocks the answer."""
    a = _answers(spark, sf)
    return a.select("prompt_id", F.explode(osc.harmful_flags("raw_answer")).alias("category"))


@register("manipulation_flags", lambda: _flag_sql(MANIPULATION_PATTERNS))
def manipulation_flags_q(spark, sf):
    """(answer, manipulation indicator) pairs; they block in strict mode."""
    a = _answers(spark, sf)
    return a.select("prompt_id", F.explode(osc.manipulation_flags("raw_answer")).alias("category"))


@register("safety_report", lambda: S.with_ctes(_issues_sql_ctes(),
          "SELECT prompt_id, NOT blocked AND len(issues) = 0 AS safe, blocked, CAST(len(issues) AS BIGINT) AS issues_found, "
          "coalesce(list_bool_or(list_transform(issues, lambda i: i.type = 'sensitive_data')), false) AS sensitive_data_redacted, "
          "coalesce(list_bool_or(list_transform(issues, lambda i: i.type = 'harmful_content')), false) AS harmful_content_detected, "
          "coalesce(list_bool_or(list_transform(issues, lambda i: i.type = 'manipulation_indicator')), false) AS manipulation_detected, "
          "CAST(length(raw_answer) AS BIGINT) AS original_length, CAST(length(sanitized) AS BIGINT) AS sanitized_length "
          "FROM checked"))
def safety_report_q(spark, sf):
    """Per answer: safe flag, issue counts, type flags and lengths."""
    r = osc.safety_report(_answers(spark, sf), "raw_answer")
    return r.drop("raw_answer")


@register("issue_canary", lambda: S.with_ctes(prompt_ctes(),
          f"SELECT prompt_id, {canary_token_sql('query', 'prompt_id')} AS canary_token FROM prompts"))
def issue_canary_q(spark, sf):
    """A canary token per prompt (seed = prompt text, nonce = prompt id)."""
    return FX.prompts(spark, sf).select("prompt_id", osc.canary_token("query", "prompt_id").alias("canary_token"))


@register("canary_instruction", lambda: S.with_ctes(prompt_ctes(),
          f"SELECT prompt_id, {S.lit(osc.CANARY_SENTENCE.split('{token}')[0])} || {canary_token_sql('query', 'prompt_id')}"
          f" || {S.lit(osc.CANARY_SENTENCE.split('{token}')[1])} AS instruction FROM prompts"))
def canary_instruction_q(spark, sf):
    """The sentence that plants each prompt's token in the locked prompt."""
    p = FX.prompts(spark, sf)
    return p.select("prompt_id", osc.canary_instruction(osc.canary_token("query", "prompt_id")).alias("instruction"))


@register("canary_scan", lambda: S.with_ctes(prompt_ctes() + [
    f"tok AS (SELECT a.prompt_id, a.raw_answer, {canary_token_sql('p.query', 'p.prompt_id')} AS token "
    f"FROM answers a JOIN prompts p ON a.prompt_id = p.prompt_id)"],
    "SELECT prompt_id, coalesce(raw_answer <> '' AND contains(raw_answer, token), false) AS canary_leaked, "
    "CASE WHEN coalesce(raw_answer <> '' AND contains(raw_answer, token), false) THEN replace(raw_answer, token, "
    "'[CANARY REDACTED]') ELSE raw_answer END AS canary_sanitized FROM tok"))
def canary_scan_q(spark, sf):
    """Answers scanned for their own prompt's canary token."""
    p = FX.prompts(spark, sf)
    a = FX.answers(spark, sf, p)
    j = a.join(p.select("prompt_id", osc.canary_token("query", "prompt_id").alias("token")), "prompt_id")
    return osc.canary_scan(j, "raw_answer", "token").select("prompt_id", "canary_leaked", "canary_sanitized")
