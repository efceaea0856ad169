"""Chunk sanitizing and trust scoring.

Sanitizing is a fixed chain of ``regexp_replace`` calls, each staged in its
own projection. The role-play deletion is the one pattern whose literal
form backtracks cubically on long texts; it runs in an equivalent linear
form (see :data:`ROLEPLAY_LINEAR`). Trust is a sum of pattern deltas.

A pattern runs only on texts whose lower case holds one of the strings that
its matches need (the NEEDS of :mod:`patterns`), or letters that fold to ASCII
ones (:data:`FOLDED_LETTERS`).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.regex import FOLDED_LETTERS, holds_one, ident, java, may_match, sql_lit
from ..functions.text import col, in_stages, normalize_homoglyphs, py_strip

# Deletion patterns in Java form. The role-play pattern (8th) always matches
# from the start of the text onward when it matches at all: a lazy dotall
# prefix reaches any later line, so every match begins where the previous
# ended. Anchoring with \G and making the two lazy scans atomic gives the
# same matches in linear time; the trailing lazy scan up to a line end is
# the same as consuming non-newlines. The override pattern gets the same
# trailing rewrite.
ROLEPLAY_LINEAR = (r"\G(?:^|\n)(?>.*?(?:you are|you're|you will be|act as|pretend to be))"
                   r"(?>.*?(?:evil|malicious|unrestricted|unfiltered|uncensored))[^\n]*")
OVERRIDE_LINEAR = r"(?:IGNORE|DISREGARD|FORGET)\s+(?:PREVIOUS|ABOVE|ALL)\s+[^\n]*"


LABELED = "labeled_instruction"


def _java_delete(p: str, category: str) -> str:
    if category == "roleplay_instruction":
        p = ROLEPLAY_LINEAR
    elif category == "override_instruction":
        p = OVERRIDE_LINEAR
    elif category == LABELED:
        # Labels begin with a letter: the blank run before them never needs to give characters back.
        p = p.replace(r"\s*", r"\s*+", 1)
    return java(p, "sanitize")


DELETE_JAVA = [(_java_delete(p, c), c) for p, c in P.SANITIZER_DELETE]
# Patterns of an opener, a lazy scan and a closer. Without a closer every
# opener would scan to the end of the text: so one opener without a closer
# takes all the rest (no later one has a closer either) and puts it back, and
# counts look at the text up to its last closer only.
SPANS = {c: p.split(".*?") for p, c in P.SANITIZER_DELETE
         if c.endswith("_comment") or c in ("bracketed_instruction", "xml_instruction", "code_block_instruction")}


# Every line end of a blank run could start a labelled instruction, and each
# would scan the rest of the run. All of them lead to the same place, so the
# first one takes a run without a label behind it as a whole and puts it back.
BLANK_RUN = r"(\n\s*+)"


def _deletion(jp: str, category: str) -> tuple[str, str]:
    """(pattern, replacement) that deletes the category's matches in one pass."""
    if category == LABELED:
        return f"{jp}|{BLANK_RUN}", "$1"
    if category not in SPANS:
        return jp, ""
    return f"{jp}|({SPANS[category][0]}.*)", "$1"


def _countable(t: Column, category: str) -> Column:
    """The part of the text that the category's matches can lie in."""
    return F.regexp_extract(t, java("^.*", "plain").replace("(?", "(?s", 1) + SPANS[category][1], 0) if category in SPANS else t


REDACT_JAVA = [(java(p), r) for p, r in P.SANITIZER_REDACT]


def sanitize_text(df: DataFrame, text_col: str, out_col: str = "sanitized") -> DataFrame:
    """Homoglyphs -> delete instruction patterns in order -> redact three
    markers -> collapse 3+ newlines -> strip. Null and empty stay as they are."""
    # Deletions can join what is left, so needs are looked for in each step's own text; no step adds odd letters.
    steps = [("_sz0", normalize_homoglyphs(text_col)), ("_lw0", F.expr("lower(_sz0)")),
             ("_odd", F.expr(holds_one("_lw0", FOLDED_LETTERS)))]
    chain = [(*_deletion(jp, c), P.SANITIZER_DELETE_NEEDS.get(c)) for jp, c in DELETE_JAVA]
    chain += [(jp, repl, needs) for (jp, repl), needs in zip(REDACT_JAVA, P.SANITIZER_REDACT_NEEDS)]
    for i, (jp, repl, needs) in enumerate(chain, 1):
        was, low = f"_sz{i - 1}", f"_lw{i - 1}"
        steps.append((f"_sz{i}", F.expr(f"IF({may_match(low, '_odd', needs)}, regexp_replace({was}, {sql_lit(jp)}, {sql_lit(repl)}), {was})")))
        steps.append((f"_lw{i}", F.expr(f"IF(_sz{i} = {was}, {low}, lower(_sz{i}))")))
    done = F.col(f"_sz{len(chain)}")
    out = py_strip(F.when(F.contains(done, F.lit("\n\n\n")), F.regexp_replace(done, r"\n{3,}", "\n\n")).otherwise(done))
    src = F.col(text_col)
    steps.pop(-1)                # nothing reads the last step's lower case
    return in_stages(df, steps + [(out_col, F.when(src.isNull() | (src == ""), src).otherwise(out))], [out_col])


def sanitize_for_embedding(c) -> Column:
    """Light pass before embedding: homoglyphs, drop HTML and C comments, strip."""
    t = normalize_homoglyphs(c)
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|(<!--.*)", "$1")
    t = F.regexp_replace(t, r"(?s)/\*.*?\*/|(/\*.*)", "$1")
    return py_strip(t)


def _found(t: Column, jp: str, category: str) -> tuple[Column, Column]:
    """(number of matches, their texts) of a deletion pattern."""
    if category == LABELED:
        flags, body = jp.split(")", 1)
        texts = F.filter(F.regexp_extract_all(t, F.lit(f"{flags})({body})|{BLANK_RUN}"), F.lit(1)), lambda m: m != "")
        return F.size(texts), texts
    part = _countable(t, category)
    return F.regexp_count(part, F.lit(jp)), F.regexp_extract_all(part, F.lit(jp), F.lit(0))


def _instruction_items(df: DataFrame, text_col: str, samples: int, sample_chars: int) -> tuple[DataFrame, Column]:
    """``df`` with the columns that the needs are looked for in, and the
    ARRAY<STRUCT<category, n_matches, samples>> of the deletion patterns."""
    t, items = F.col(text_col), []
    for jp, c in DELETE_JAVA:
        n, texts = _found(t, jp, c)
        item = F.struct(F.lit(c).alias("category"), n.cast("bigint").alias("n_matches"),
                        F.transform(F.slice(texts, 1, samples), lambda m: F.substring(m, 1, sample_chars)).alias("samples"))
        none = F.struct(F.lit(c).alias("category"), F.lit(0).cast("bigint").alias("n_matches"),
                        F.array().cast("array<string>").alias("samples"))
        items.append(F.when(F.expr(may_match("_item_low", "_item_odd", P.SANITIZER_DELETE_NEEDS.get(c))), item).otherwise(none))
    steps = [("_item_low", F.lower(t)), ("_item_odd", F.expr(holds_one("_item_low", FOLDED_LETTERS)))]
    return in_stages(df, steps, ["_item_low", "_item_odd"]), F.array(*items)


def detect_instructions(df: DataFrame, key_cols: list[str], text_col: str, samples: int = 3,
                        sample_chars: int = 100) -> DataFrame:
    """Long form: (key, category, n_matches, samples) for each deletion
    pattern that matches the raw text (no homoglyph step)."""
    df, items = _instruction_items(df.select(*key_cols, text_col), text_col, samples, sample_chars)
    return (df.select(*key_cols, F.inline(items)).where(F.col("n_matches") > 0))


def sanitization_report(df: DataFrame, key_cols: list[str], text_col: str, samples: int = 3,
                        sample_chars: int = 100) -> DataFrame:
    """Lengths before/after, characters removed, removal percent, the number
    of instruction kinds found and the list of them."""
    df, items = _instruction_items(df.select(*key_cols, text_col), text_col, samples, sample_chars)
    s = sanitize_text(df.select(*key_cols, text_col, items.alias("_items")), text_col, "_san")
    found = F.filter("_items", lambda i: i["n_matches"] > 0)
    n0, n1 = F.length(text_col), F.length("_san")
    return s.select(*key_cols, n0.cast("bigint").alias("original_length"),
                    n1.cast("bigint").alias("sanitized_length"),
                    (n0 - n1).cast("bigint").alias("characters_removed"),
                    F.round(F.when(n0 > 0, (n0 - n1) / n0 * 100.0).otherwise(F.lit(0.0)), 6).alias("removal_percentage"),
                    F.coalesce(F.size(found), F.lit(0)).cast("bigint").alias("instruction_kinds"),
                    found.alias("instructions"))


def trust_score(content: str, retrieval_score: str | None = None, verified: str | None = None,
                fresh: str | None = None) -> Column:
    """Trust in 0..1: base, retrieval term, each pattern delta once, length
    penalties, metadata bonuses, clamped. Terms are added in that order
    (one parsed expression over column names)."""
    c = ident(content)
    r = "0.5D" if retrieval_score is None else f"CAST({ident(retrieval_score)} AS DOUBLE)"
    t = f"(CAST({P.TRUST_BASE!r} AS DOUBLE) + ({r} - 0.5D) * CAST({P.TRUST_RETRIEVAL_WEIGHT!r} AS DOUBLE))"
    for p, delta, cat in P.TRUST_NEGATIVE + P.TRUST_POSITIVE:
        found = f"{may_match('low', 'odd', P.TRUST_NEEDS.get(cat))} AND {c} RLIKE {sql_lit(java(p))}"
        t = f"({t} + IF({found}, CAST({delta!r} AS DOUBLE), 0.0D))"
    t = (f"({t} + CASE WHEN length({c}) < {P.TRUST_SHORT_CHARS} THEN CAST({P.TRUST_SHORT_PENALTY!r} AS DOUBLE) "
         f"WHEN length({c}) > {P.TRUST_LONG_CHARS} THEN CAST({P.TRUST_LONG_PENALTY!r} AS DOUBLE) ELSE 0.0D END)")
    if verified is not None:
        t = f"({t} + IF(coalesce({ident(verified)}, false), CAST({P.TRUST_VERIFIED_BONUS!r} AS DOUBLE), 0.0D))"
    if fresh is not None:
        t = f"({t} + IF(coalesce({ident(fresh)}, false), CAST({P.TRUST_FRESH_BONUS!r} AS DOUBLE), 0.0D))"
    # The lambdas name the lower case and its odd letters, worked out once a text.
    t = f"transform(array({holds_one('low', FOLDED_LETTERS)}), odd -> greatest(0.0D, least(1.0D, {t})))[0]"
    return F.expr(f"transform(array(lower({c})), low -> {t})[0]")


def max_context_length(avg_trust) -> Column:
    """Context cap: high trust gets the full budget, else linear in trust."""
    a = col(avg_trust)
    low, high = P.CONTEXT_LOW_TRUST, P.CONTEXT_HIGH_TRUST
    return F.when(a >= P.TRUST_THRESHOLD, F.lit(high)).otherwise(
        (F.lit(float(low)) + F.lit(float(high - low)) * (a / F.lit(P.TRUST_THRESHOLD))).cast("int"))


def trusted(trust) -> Column:
    return col(trust) >= P.TRUST_THRESHOLD


def trust_report(df: DataFrame, key_cols: list[str], content_col: str, retrieval_col: str | None = None) -> DataFrame:
    """Score, the patterns that moved it (category, impact, number of
    matches) and a recommendation."""
    c = F.col(content_col)

    def hits(bank):
        items = F.array(*[F.struct(F.lit(cat).alias("category"), F.lit(float(delta)).alias("impact"),
                                   F.regexp_count(c, F.lit(java(p))).cast("bigint").alias("count")) for p, delta, cat in bank])
        return F.filter(items, lambda x: x["count"] > 0)

    retrieval = F.lit(0.5) if retrieval_col is None else F.col(retrieval_col).cast("double")
    return (df.select(*key_cols, trust_score(content_col, retrieval_col).alias("trust_score"),
                      retrieval.alias("retrieval_score"),
                      hits(P.TRUST_NEGATIVE).alias("suspicious_patterns"),
                      hits(P.TRUST_POSITIVE).alias("trust_patterns"),
                      F.length(c).cast("bigint").alias("content_length"))
              .withColumn("max_context_allowed", max_context_length("trust_score"))
              .withColumn("recommendation", F.when(trusted("trust_score"), "include").otherwise("limit")))
