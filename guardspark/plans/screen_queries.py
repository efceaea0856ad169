"""Queries over input screening (planted prompts and judge replies)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import screen as SCR
from ..session import stored
from ..sources import fixtures as FX
from . import sqlgen as S
from .fixture_sql import prompt_ctes, system_turns_cte
from .registry import register


def _reason_sql(x: str, table: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {S.lit(v)}" for k, v in table.items()) + f" ELSE {S.lit(default)} END"


def _sig_ctes() -> list[str]:
    from .. import operators  # noqa: F401
    sig_w = SCR.SIGNATURE_WEIGHTS
    return [
        f"sig AS (SELECT prompt_id, query, {S.signature_list('query')} AS m FROM prompts)",
        f"sig2 AS (SELECT prompt_id, query, m, {S.decayed_sum('list_transform(m, lambda x: x.score)', sig_w)} "
        f"AS sig_score FROM sig)",
        "sigcat AS (SELECT prompt_id, category, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY ms DESC, "
        "category) - 1 AS INTEGER) AS ord FROM (SELECT prompt_id, x.category AS category, max(x.score) AS ms FROM "
        "(SELECT prompt_id, unnest(m) AS x FROM sig) GROUP BY 1, 2))",
        "sigagg AS (SELECT prompt_id, string_agg(category, ', ' ORDER BY ord) AS cats FROM sigcat GROUP BY 1)",
    ]


def _screen_ctes(judged: bool) -> list[str]:
    ctes = prompt_ctes() + _sig_ctes() + S.semantic_ctes("prompts", "prompt_id", "query")
    fw = SCR.FUSION_WEIGHTS
    if judged:
        jp = S.judge_parse_cols("v.raw")
        prov = S.decayed_sum("list_filter([s.sig_score, coalesce(se.sem_score, 0.0)], lambda x: x > 0)", fw)
        ctes.append(
            f"base0 AS (SELECT s.prompt_id, s.sig_score, coalesce(se.sem_score, 0.0) AS sem_score, "
            f"coalesce(se.sem_category, '') AS sem_category, {prov} AS prov, coalesce({jp['available']}, false) AS avail, "
            f"{jp['score']} AS js, {jp['category']} AS jc FROM sig2 s LEFT JOIN sem se ON se.k = s.prompt_id "
            f"LEFT JOIN verdicts v ON v.prompt_id = s.prompt_id)")
        ctes.append(f"base AS (SELECT *, (prov >= {P.JUDGE_GRAY_LOW} AND prov < {P.JUDGE_GRAY_HIGH} AND avail) AS used, "
                    f"CASE WHEN prov >= {P.JUDGE_GRAY_LOW} AND prov < {P.JUDGE_GRAY_HIGH} AND avail THEN js ELSE 0.0 END "
                    f"AS jscore, CASE WHEN prov >= {P.JUDGE_GRAY_LOW} AND prov < {P.JUDGE_GRAY_HIGH} AND avail THEN jc "
                    f"ELSE '' END AS jcat FROM base0)")
    else:
        ctes.append("base AS (SELECT s.prompt_id, s.sig_score, coalesce(se.sem_score, 0.0) AS sem_score, "
                    "coalesce(se.sem_category, '') AS sem_category, false AS used, 0.0 AS jscore, '' AS jcat "
                    "FROM sig2 s LEFT JOIN sem se ON se.k = s.prompt_id)")
    ctes += [
        f"fused AS (SELECT *, {S.decayed_sum('list_filter([sig_score, sem_score, jscore], lambda x: x > 0)', fw)} AS f "
        f"FROM base)",
        "votes AS (SELECT c.prompt_id, c.category AS c, b.sig_score AS v, c.ord AS o FROM sigcat c JOIN base b "
        "ON b.prompt_id = c.prompt_id UNION ALL SELECT prompt_id, sem_category, sem_score, 1000 FROM base "
        "UNION ALL SELECT prompt_id, jcat, jscore, 2000 FROM base)",
        "vf AS (SELECT prompt_id, c, max(v) AS v, min(o) AS o FROM votes WHERE c IS NOT NULL AND "
        "c NOT IN ('', 'none', 'unknown') GROUP BY 1, 2)",
        "prim AS (SELECT prompt_id, c AS primary_category FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id "
        "ORDER BY v DESC, o) AS rn FROM vf) WHERE rn = 1)",
        "cats AS (SELECT prompt_id, string_agg(c, ',' ORDER BY c) AS categories FROM vf GROUP BY 1)",
        f"screened AS (SELECT f.prompt_id, round_even(f.sig_score, 3) AS regex_score, "
        f"round_even(f.sem_score, 3) AS semantic_score, f.sem_category AS semantic_category, f.used AS judge_used, "
        f"round_even(f.f, 3) AS threat_level, {S.status('f.f', P.FUSION_WARN, P.FUSION_BLOCK)} AS st, "
        f"coalesce(p.primary_category, '') AS primary_category, coalesce(c.categories, '') AS categories "
        f"FROM fused f LEFT JOIN prim p ON p.prompt_id = f.prompt_id LEFT JOIN cats c ON c.prompt_id = f.prompt_id)",
    ]
    return ctes


def _screen_sql(judged: bool) -> str:
    ctes = _screen_ctes(judged)
    body = (f"SELECT prompt_id, regex_score, semantic_score, semantic_category, judge_used, threat_level, "
            f"CASE WHEN st = 'pass' THEN 'allow' ELSE st END AS decision, st = 'block' AS blocked, primary_category, "
            f"CASE WHEN st = 'block' THEN {_reason_sql('primary_category', P.FUSION_REASONS, P.FUSION_DEFAULT_REASON)} "
            f"ELSE '' END AS reason, categories FROM screened")
    return S.with_ctes(ctes, body)


_SCREEN_COLS = ["prompt_id", "regex_score", "semantic_score", "semantic_category", "judge_used", "threat_level",
                "decision", "blocked", "primary_category", "reason"]


def screened_prompts(spark, sf, judged: bool = False):
    p = FX.prompts(spark, sf)
    v = FX.verdicts(spark, sf, p) if judged else None
    return SCR.screen_prompts(p, "query", "prompt_id", verdicts=v, judge_enabled=judged)


@register("screen_prompts", lambda: _screen_sql(False))
def screen_prompts_q(spark, sf):
    """Fused signature + semantic decision per prompt (judge off, the default)."""
    s = screened_prompts(spark, sf)
    return s.select(*_SCREEN_COLS, F.array_join("categories", ",").alias("categories"))


@register("screen_prompts_judged", lambda: _screen_sql(True))
def screen_prompts_judged_q(spark, sf):
    """Same with judge replies consulted for gray-zone prompts."""
    s = screened_prompts(spark, sf, judged=True)
    return s.select(*_SCREEN_COLS, F.array_join("categories", ",").alias("categories"))


def _sigscan_sql() -> str:
    ctes = prompt_ctes() + _sig_ctes()
    reason = _reason_sql("first_cat", P.SIGNATURE_REASONS, P.FUSION_DEFAULT_REASON)
    return S.with_ctes(ctes + [
        "fc AS (SELECT prompt_id, category AS first_cat FROM sigcat WHERE ord = 0)",
        "wl AS (SELECT prompt_id, string_agg('Suspicious pattern detected: ' || category, '|' ORDER BY ord) AS w "
        "FROM sigcat GROUP BY 1)"],
        f"SELECT s.prompt_id, round(s.sig_score, 6) AS threat_level, s.sig_score >= {P.SIGNATURE_BLOCK} AS blocked, "
        f"CASE WHEN s.sig_score >= {P.SIGNATURE_BLOCK} THEN {reason} ELSE '' END AS reason, "
        f"CASE WHEN s.sig_score < {P.SIGNATURE_BLOCK} AND s.sig_score >= {P.SIGNATURE_WARN} THEN coalesce(wl.w, '') "
        f"ELSE '' END AS warnings, CAST(len(s.m) AS BIGINT) AS n_signatures FROM sig2 s "
        f"LEFT JOIN fc ON fc.prompt_id = s.prompt_id LEFT JOIN wl ON wl.prompt_id = s.prompt_id")


@register("signature_scan", _sigscan_sql)
def signature_scan_q(spark, sf):
    """Signature guard alone: score, block, reason, warnings."""
    s = SCR.signature_scan(FX.prompts(spark, sf), "query")
    return s.select("prompt_id", F.round("sig_score", 6).alias("threat_level"), F.col("sig_blocked").alias("blocked"),
                    F.col("sig_reason").alias("reason"), F.array_join("sig_warnings", "|").alias("warnings"),
                    F.size("sig_matches").cast("bigint").alias("n_signatures"))


def _siglong_sql() -> str:
    from ..functions.patterns import INPUT_SIGNATURES
    from ..functions.regex import re2
    parts = " UNION ALL ".join(
        f"SELECT prompt_id, {i} AS pattern_id, '{c}' AS category, CAST(len(regexp_extract_all(query, "
        f"{S.lit(re2(p, 'input'))})) AS BIGINT) AS n_matches, regexp_extract_all(query, {S.lit(re2(p, 'input'))})[1] "
        f"AS first_match FROM prompts WHERE {S.matches('query', re2(p, 'input'))}"
        for i, (p, s, c) in enumerate(INPUT_SIGNATURES))
    return S.with_ctes(prompt_ctes(), parts)


@register("signature_matches_long", _siglong_sql)
def signature_matches_long_q(spark, sf):
    """One row per (prompt, matched signature): match count and first match."""
    m = SCR.signature_matches_long(FX.prompts(spark, sf), ["prompt_id"], "query", max_matches=None)
    return m.select("prompt_id", "pattern_id", "category", F.size("matches").cast("bigint").alias("n_matches"),
                    F.get("matches", 0).alias("first_match"))


@register("threat_summary", lambda: S.with_ctes(prompt_ctes() + _sig_ctes(),
          "SELECT s.prompt_id, CASE WHEN s.sig_score = 0 THEN 'No threats detected' ELSE "
          "(CASE WHEN s.sig_score >= 0.8 THEN 'HIGH' WHEN s.sig_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END) || "
          "printf(' threat level (%.2f): ', s.sig_score) || coalesce(a.cats, '') END AS summary "
          "FROM sig2 s LEFT JOIN sigagg a ON a.prompt_id = s.prompt_id"))
def threat_summary_q(spark, sf):
    """Human-readable signature threat line per prompt."""
    s = SCR.signature_scan(FX.prompts(spark, sf), "query")
    return s.select("prompt_id", SCR.threat_summary("sig_score", "sig_categories").alias("summary"))


@register("semantic_similarity", lambda: S.with_ctes(prompt_ctes() + S.semantic_ctes("prompts", "prompt_id", "query"),
          "SELECT s.k AS prompt_id, round(sem_score, 6) AS sem_score, sem_category, sem_example, coalesce(cats, '') AS categories, "
          "coalesce(cat_sum, 0.0) AS category_sum FROM sem s LEFT JOIN sem_cats c ON c.k = s.k"))
def semantic_similarity_q(spark, sf):
    """Nearest attack seed per prompt (hashed bag-of-words cosine)."""
    s = SCR.semantic_similarity(FX.prompts(spark, sf), "query")
    total = F.aggregate(F.map_values("sem_per_category"), F.lit(0.0), lambda a, x: a + x)
    return s.select("prompt_id", F.round("sem_score", 6).alias("sem_score"), "sem_category", "sem_example",
                    F.array_join(F.sort_array(F.map_keys("sem_per_category")), ",").alias("categories"),
                    F.round(total, 6).alias("category_sum"))


def _judge_parse_sql() -> str:
    jp = S.judge_parse_cols("raw")
    return S.with_ctes(prompt_ctes(), "SELECT prompt_id, " + ", ".join(f"{v} AS {k}" for k, v in jp.items())
                       + " FROM verdicts")


@register("judge_parse", _judge_parse_sql)
def judge_parse_q(spark, sf):
    """Judge replies parsed into verdict, clamped score, category, rationale."""
    p = FX.prompts(spark, sf)
    v = FX.verdicts(spark, sf, p)
    return v.select("prompt_id", SCR.judge_parse("raw").alias("j")).select("prompt_id", "j.*")


def _judge_route_sql() -> str:
    ctes = prompt_ctes() + _sig_ctes() + S.semantic_ctes("prompts", "prompt_id", "query")
    prov = S.decayed_sum("list_filter([s.sig_score, coalesce(se.sem_score, 0.0)], lambda x: x > 0)", SCR.FUSION_WEIGHTS)
    return S.with_ctes(ctes, f"SELECT prompt_id, round(prov, 6) AS provisional FROM (SELECT s.prompt_id, {prov} AS prov "
                             f"FROM sig2 s LEFT JOIN sem se ON se.k = s.prompt_id) WHERE prov >= {P.JUDGE_GRAY_LOW} "
                             f"AND prov < {P.JUDGE_GRAY_HIGH}")


@register("judge_route", _judge_route_sql)
def judge_route_q(spark, sf):
    """Prompts whose provisional score falls in the judge's gray zone."""
    s = SCR.semantic_similarity(SCR.signature_scan(FX.prompts(spark, sf), "query"), "query")
    # Materialise the scored rows so the gray-zone filter is not pushed
    # below the scoring projections (it would copy them into the predicate).
    s = stored(s.select("prompt_id", "sig_score", "sem_score"), "scores")
    r = SCR.judge_route(s)
    prov = SCR.decayed_sum(F.filter(F.array("sig_score", "sem_score"), lambda x: x > 0), SCR.FUSION_WEIGHTS)
    return r.select("prompt_id", F.round(prov, 6).alias("provisional"))


@register("judge_prompt", lambda: S.with_ctes(prompt_ctes(),
          f"SELECT prompt_id, {S.lit(SCR.JUDGE_REQUEST.split('{text}')[0])} || left({S.py_strip('query')}, 2000) || "
          f"{S.lit(SCR.JUDGE_REQUEST.split('{text}')[1])} AS judge_request FROM prompts"))
def judge_prompt_q(spark, sf):
    """Classification request text per prompt (input stripped, 2,000 chars)."""
    return FX.prompts(spark, sf).select("prompt_id", SCR.judge_prompt("query").alias("judge_request"))


@register("threat_band", lambda: S.with_ctes(_screen_ctes(False),
          "SELECT prompt_id, CAST(pct AS BIGINT) AS pct, CASE WHEN pct >= 75 THEN 'red' WHEN pct >= 45 THEN 'yellow' "
          "ELSE 'green' END AS band FROM (SELECT prompt_id, floor(threat_level * 100 + 0.5) AS pct FROM screened)"))
def threat_band_q(spark, sf):
    """Threat meter: percent (half up) and colour band per screened prompt."""
    s = screened_prompts(spark, sf)
    pct = F.floor(F.col("threat_level") * 100 + 0.5)
    return s.select("prompt_id", pct.cast("bigint").alias("pct"),
                    F.when(pct >= 75, "red").when(pct >= 45, "yellow").otherwise("green").alias("band"))


from ..operators.prompts import DEFAULT_PROMPT, LOCKED_PROMPT  # noqa: E402


def _override_sql() -> str:
    items = ", ".join(f"CASE WHEN {S.matches('system_prompt', S.re2(p))} THEN '{c}' END" for p, c in P.OVERRIDE_PATTERNS)
    return S.with_ctes([system_turns_cte()],
                       f"SELECT prompt_id, (system_prompt <> {S.lit(LOCKED_PROMPT)} AND system_prompt <> "
                       f"{S.lit(DEFAULT_PROMPT)}) AS is_override_attempt, true AS would_be_blocked, "
                       f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',') AS suspicious_patterns, "
                       f"CAST(length(system_prompt) AS BIGINT) AS prompt_length, "
                       f"{S.preview('system_prompt', 200)} AS prompt_preview FROM system_turns")


@register("override_audit", _override_sql)
def override_audit_q(spark, sf):
    """System-prompt override attempts: patterns, length, preview."""
    a = SCR.override_audit(FX.system_turns(spark, sf), "system_prompt", LOCKED_PROMPT, DEFAULT_PROMPT)
    return a.select("prompt_id", "is_override_attempt", "would_be_blocked",
                    F.array_join("suspicious_patterns", ",").alias("suspicious_patterns"), "prompt_length",
                    "prompt_preview")
