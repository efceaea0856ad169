"""DuckDB SQL text for the correctness oracles.

Each helper writes the RE2/DuckDB form of one operator as a CTE so the
oracle queries in :mod:`guardspark.plans.registry` can be read side by side
with the Spark code. Nothing here runs on Spark.
"""
from __future__ import annotations

from ..functions.patterns import (HARMFUL_PATTERNS, HOMOGLYPHS, MANIPULATION_PATTERNS,
                                  SENSITIVE_PATTERNS)
from ..functions.regex import PY_WHITESPACE, WS_NO_NL_CLASS, re2


def lit(s: str) -> str:
    """SQL string literal; control characters go through chr()."""
    parts, buf = [], []
    for ch in s:
        if ch in "\n\t\r" or ord(ch) < 32 or ord(ch) in (0x85, 0xA0) or ord(ch) > 0x7E:
            if buf:
                parts.append("'" + "".join(buf).replace("'", "''") + "'")
                buf = []
            parts.append(f"chr({ord(ch)})")
        else:
            buf.append(ch)
    if buf or not parts:
        parts.append("'" + "".join(buf).replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


def py_strip(x: str) -> str:
    return f"trim({x}, {lit(PY_WHITESPACE)})"


def clean_text(x: str) -> str:
    t = f"regexp_replace({x}, {lit(chr(10))} || '{{3,}}', {lit(chr(10) * 2)}, 'g')"
    t = f"regexp_replace({t}, ' {{2,}}', ' ', 'g')"
    t = f"regexp_replace({t}, '{WS_NO_NL_CLASS}*\\n{WS_NO_NL_CLASS}*', {lit(chr(10))}, 'g')"
    return py_strip(t)


def homoglyphs(x: str) -> str:
    src = "".join(a for a, _ in HOMOGLYPHS)
    dst = "".join(b for _, b in HOMOGLYPHS)
    return f"translate({x}, {lit(src)}, {lit(dst)})"


def preview(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END"


def count_matches(x: str, pattern_re2: str) -> str:
    return f"CAST(coalesce(len(regexp_extract_all({x}, {lit(pattern_re2)})), 0) AS BIGINT)"


def matches(x: str, pattern_re2: str) -> str:
    return f"regexp_matches({x}, {lit(pattern_re2)})"


def redact_ctes(src: str, text_col: str, prefix: str = "rd") -> tuple[list[str], str, str]:
    """CTEs applying the sensitive patterns in order with per-stage counts.

    Returns (ctes, final cte name, final text column ``{prefix}_text``).
    Counts are columns ``n_<category>``.
    """
    ctes = []
    prev, cur = src, text_col
    for i, (p, repl, cat) in enumerate(SENSITIVE_PATTERNS):
        name = f"{prefix}{i}"
        rp = re2(p)
        ctes.append(f"{name} AS (SELECT *, {count_matches(cur, rp)} AS n_{cat}, "
                    f"regexp_replace({cur}, {lit(rp)}, {lit(repl)}, 'g') AS {prefix}_t{i} FROM {prev})")
        prev, cur = name, f"{prefix}_t{i}"
    final = f"{prefix}_final"
    ctes.append(f"{final} AS (SELECT *, {cur} AS {prefix}_text FROM {prev})")
    return ctes, final, f"{prefix}_text"


def harmful_list(x: str) -> str:
    items = [f"CASE WHEN {matches(x, re2(p))} THEN '{cat}' END" for p, cat in HARMFUL_PATTERNS]
    return f"list_filter([{', '.join(items)}], lambda c: c IS NOT NULL)"


def manipulation_list(x: str) -> str:
    items = [f"CASE WHEN {matches(x, re2(p))} THEN '{cat}' END" for p, cat in MANIPULATION_PATTERNS]
    return f"list_filter([{', '.join(items)}], lambda c: c IS NOT NULL)"


def with_ctes(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def _rfind_rel(w: str, sep: str) -> str:
    """0-based last index of ``sep`` in ``w`` or -1."""
    rs = lit(sep[::-1])
    p = f"strpos(reverse({w}), {rs})"
    return f"(CASE WHEN {p} > 0 THEN length({w}) - {len(sep)} - ({p} - 1) ELSE -1 END)"


def chunk_end(t: str, n: str, s: str, size: int = 500) -> str:
    """End of the window starting at ``s`` (the chunker's break rules)."""
    half = size // 2
    w = f"substring({t}, {s} + 1, {size})"
    cases = []
    for sep in ["\n\n", ". ", "! ", "? ", "\n"]:
        r = _rfind_rel(w, sep)
        cases.append(f"WHEN {r} > {half} THEN {s} + {r} + {len(sep)}")
    return (f"(CASE WHEN {s} + {size} < {n} THEN (CASE {' '.join(cases)} ELSE {s} + {size} END) "
            f"ELSE {s} + {size} END)")


def chunk_ctes(src_sql: str, size: int = 500, overlap: int = 50, name: str = "chunks") -> list[str]:
    """Recursive CTE reproducing the chunker.

    ``src_sql`` selects (doc_id, source_file, t). Result CTE ``name`` has
    doc_id, source_file, chunk_index, start_index, end_index, content.
    """
    e = chunk_end("c.t", "c.n", "st.s", size)
    piece = py_strip(f"substring(c.t, st.s + 1, {e} - st.s)")
    nxt = f"({e} - {overlap})"
    return [
        f"csrc AS (SELECT doc_id, source_file, t, length(t) AS n FROM ({src_sql}) WHERE {py_strip('t')} <> '')",
        f"csteps(doc_id, s, last_s, idx) AS (SELECT doc_id, 0, -1, 0 FROM csrc UNION ALL "
        f"SELECT st.doc_id, CASE WHEN ({piece} <> '' AND {nxt} <= st.s) OR ({piece} = '' AND "
        f"((st.last_s >= 0 AND {nxt} <= st.last_s) OR (st.last_s < 0 AND {nxt} < 0))) THEN {e} ELSE {nxt} END, "
        f"CASE WHEN {piece} <> '' THEN st.s ELSE st.last_s END, "
        f"st.idx + CASE WHEN {piece} <> '' THEN 1 ELSE 0 END "
        f"FROM csteps st JOIN csrc c ON c.doc_id = st.doc_id "
        f"WHERE (CASE WHEN ({piece} <> '' AND {nxt} <= st.s) OR ({piece} = '' AND "
        f"((st.last_s >= 0 AND {nxt} <= st.last_s) OR (st.last_s < 0 AND {nxt} < 0))) THEN {e} ELSE {nxt} END) < c.n)",
        f"{name} AS (SELECT st.doc_id, c.source_file, CAST(st.idx AS BIGINT) AS chunk_index, "
        f"CAST(st.s AS BIGINT) AS start_index, CAST({e} AS BIGINT) AS end_index, {piece} AS content "
        f"FROM csteps st JOIN csrc c ON c.doc_id = st.doc_id WHERE {piece} <> '')",
    ]


# --- Sanitizer and trust (RE2 forms; lookaheads rewritten).
def sanitizer_delete_re2() -> list[tuple[str, str, str]]:
    """(pattern, replacement, category) for DuckDB, in order."""
    from ..functions.patterns import SANITIZER_DELETE
    out = []
    for p, cat in SANITIZER_DELETE:
        if cat == "labeled_instruction":
            out.append((r"(?ims)(?:^|\n)\s*(?:INSTRUCTION|SYSTEM|PROMPT|COMMAND|NOTE TO AI|AI INSTRUCTION)[:\s]"
                        r"(?s:.*?)(\n\n|\z)", r"\1", cat))
        elif cat == "roleplay_instruction":
            out.append((r"(?ims)(?:^|\n).*?(?:you are|you're|you will be|act as|pretend to be).*?"
                        r"(?:evil|malicious|unrestricted|unfiltered|uncensored)[^\n]*", "", cat))
        elif cat == "override_instruction":
            out.append((r"(?ims)(?:IGNORE|DISREGARD|FORGET)\s+(?:PREVIOUS|ABOVE|ALL)\s+[^\n]*", "", cat))
        else:
            out.append((re2(p, "sanitize"), "", cat))
    return out


def sanitize(x: str) -> str:
    """Nested expression: homoglyphs, deletions, redactions, collapse, strip."""
    from ..functions.patterns import SANITIZER_REDACT
    t = homoglyphs(x)
    for p, repl, _ in sanitizer_delete_re2():
        t = f"regexp_replace({t}, {lit(p)}, {lit(repl)}, 'g')"
    for p, repl in SANITIZER_REDACT:
        t = f"regexp_replace({t}, {lit(re2(p))}, {lit(repl)}, 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', {lit(chr(10) * 2)}, 'g')"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN {x} ELSE {py_strip(t)} END"


def trust(x: str, r: str = "0.5", more: tuple[str, ...] = ()) -> str:
    """``more``: further terms, added last."""
    from ..functions.patterns import TRUST_NEGATIVE, TRUST_POSITIVE
    t = f"(0.7 + ({r} - 0.5) * 0.3)"
    for p, d, _ in TRUST_NEGATIVE + TRUST_POSITIVE:
        t = f"({t} + CASE WHEN {matches(x, re2(p))} THEN {d!r} ELSE 0.0 END)"
    t = (f"({t} + CASE WHEN length({x}) < 50 THEN -0.1 WHEN length({x}) > 2000 THEN -0.05 ELSE 0.0 END)")
    for term in more:
        t = f"({t} + {term})"
    return f"greatest(0.0, least(1.0, {t}))"


def max_context(a: str) -> str:
    return f"CASE WHEN {a} >= 0.6 THEN 4000 ELSE CAST(trunc(2000.0 + 2000.0 * ({a} / 0.6)) AS INTEGER) END"


# --- Screening -------------------------------------------------------------
def dbl(x: float) -> str:
    """Exact double literal."""
    return f"CAST('{x!r}' AS DOUBLE)"


def decayed_sum(list_expr: str, weights: list[float]) -> str:
    w = "[" + ", ".join(dbl(x) for x in weights) + "]"
    srt = f"list_sort({list_expr}, 'DESC')"
    return (f"(CASE WHEN len({list_expr}) = 0 THEN 0.0 ELSE least(1.0, list_reduce(list_transform({srt}, "
            f"lambda s, i: CAST(s AS DOUBLE) * {w}[i]), lambda a, b: a + b)) END)")


def status(x: str, warn: float, block: float) -> str:
    return f"(CASE WHEN {x} >= {block} THEN 'block' WHEN {x} >= {warn} THEN 'warn' ELSE 'pass' END)"


def signature_list(x: str) -> str:
    from ..functions.patterns import INPUT_SIGNATURES
    items = ", ".join(f"CASE WHEN {matches(x, re2(p, 'input'))} THEN {{'pattern_id': {i}, 'score': {dbl(s)}, "
                      f"'category': '{c}'}} END" for i, (p, s, c) in enumerate(INPUT_SIGNATURES))
    return f"list_filter([{items}], lambda m: m IS NOT NULL)"


def tokens_bucket_ctes(src: str, key: str, text: str, prefix: str) -> list[str]:
    """(key, b, n) token counts per hashed bucket and (key, qn) squared norms."""
    return [
        f"{prefix}_tok AS (SELECT {key} AS k, unnest(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), "
        f"lambda x: x <> '')) AS tok FROM {src})",
        f"{prefix}_b AS (SELECT k, ('0x' || substr(md5(tok), 7, 2))::INTEGER % 64 AS b, count(*) AS n "
        f"FROM {prefix}_tok GROUP BY 1, 2)",
        f"{prefix}_n AS (SELECT k, sum(n * n) AS qn FROM {prefix}_b GROUP BY 1)",
    ]


def semantic_ctes(src: str, key: str, text: str, out: str = "sem") -> list[str]:
    """CTE ``out``(k, sem_score, sem_category, sem_example) for every row of src."""
    from ..functions.patterns import ATTACK_SEEDS
    from ..functions.vectors import py_hashed_counts
    seed_rows, seed_list = [], []
    for j, (cat, phrase) in enumerate(ATTACK_SEEDS):
        cnt = py_hashed_counts(phrase)
        seed_list.append(f"({j}, '{cat}', {lit(phrase)}, {sum(v * v for v in cnt)})")
        seed_rows += [f"({j}, {b}, {v})" for b, v in enumerate(cnt) if v]
    return tokens_bucket_ctes(src, key, text, out) + [
        f"{out}_seedb(j, b, cnt) AS (VALUES {', '.join(seed_rows)})",
        f"{out}_seeds(j, cat, phrase, sn) AS (VALUES {', '.join(seed_list)})",
        f"{out}_dot AS (SELECT q.k, s.j, sum(q.n * s.cnt) AS d FROM {out}_b q JOIN {out}_seedb s ON q.b = s.b GROUP BY 1, 2)",
        f"{out}_sims AS (SELECT r.{key} AS k, s.j, s.cat, s.phrase, CASE WHEN coalesce(nn.qn, 0) > 0 THEN "
        f"CAST(coalesce(d.d, 0) AS DOUBLE) / sqrt(CAST(nn.qn * s.sn AS DOUBLE)) ELSE 0.0 END AS sim, "
        f"{py_strip(text)} = '' OR {text} IS NULL AS blank "
        f"FROM {src} r CROSS JOIN {out}_seeds s LEFT JOIN {out}_dot d ON d.k = r.{key} AND d.j = s.j "
        f"LEFT JOIN {out}_n nn ON nn.k = r.{key})",
        f"{out} AS (SELECT k, CASE WHEN blank THEN 0.0 ELSE greatest(0.0, sim) END AS sem_score, "
        f"CASE WHEN blank THEN '' ELSE cat END AS sem_category, CASE WHEN blank THEN '' ELSE phrase END AS sem_example "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sim DESC, j) AS rn FROM {out}_sims) WHERE rn = 1)",
        f"{out}_cats AS (SELECT k, string_agg(cat, ',' ORDER BY cat) AS cats, round(sum(m), 6) AS cat_sum FROM "
        f"(SELECT k, cat, max(sim) AS m FROM {out}_sims WHERE NOT blank GROUP BY 1, 2 HAVING max(sim) > 0) GROUP BY 1)",
    ]


def judge_parse_cols(raw: str) -> dict[str, str]:
    cleaned = f"regexp_replace({raw}, '(?is)<think>.*?</think>', '', 'g')"
    blob = f"regexp_extract({cleaned}, '(?s)\\{{.*\\}}', 0)"
    ok = f"(coalesce({raw}, '') <> '' AND {blob} <> '' AND coalesce(json_valid({blob}), false))"
    v_raw = f"coalesce(json_extract_string({blob}, '$.verdict'), 'unknown')"
    v0 = f"lower({py_strip(v_raw)})"
    verdict = f"(CASE WHEN {v0} IN ('safe', 'suspicious', 'malicious') THEN {v0} ELSE 'unknown' END)"
    s0 = f"greatest(0.0, least(1.0, coalesce(TRY_CAST(json_extract_string({blob}, '$.risk') AS DOUBLE), 0.0)))"
    score = (f"(CASE WHEN {s0} = 0.0 THEN (CASE {verdict} WHEN 'safe' THEN 0.1 WHEN 'suspicious' THEN 0.55 "
             f"WHEN 'malicious' THEN 0.9 ELSE 0.0 END) ELSE {s0} END)")
    return {
        "available": ok,
        "verdict": f"CASE WHEN {ok} THEN {verdict} ELSE 'unknown' END",
        "score": f"CASE WHEN {ok} THEN {score} ELSE 0.0 END",
        "category": f"CASE WHEN {ok} THEN coalesce(json_extract_string({blob}, '$.category'), '') ELSE '' END",
        "rationale": f"CASE WHEN {ok} THEN left(coalesce(json_extract_string({blob}, '$.reason'), ''), 300) ELSE '' END",
    }


def pair_id(a: str, b: str) -> str:
    """SQL of :func:`guardspark.functions.text.pair_id`."""
    return f"CAST('0x' || left(md5(CAST({a} AS VARCHAR) || ':' || CAST({b} AS VARCHAR)), 15) AS BIGINT)"
