"""Text column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import HOMOGLYPHS
from .regex import PY_WHITESPACE, WS_NO_NL_CLASS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_stages(df: DataFrame, steps: list[tuple[str, Column]], keep: list[str]) -> DataFrame:
    """``df`` with the ``keep`` ones of columns that build on one another.

    The steps are lateral aliases of one projection, so that a chain of
    stages is analysed once and not once a stage; the analyser makes a
    projection of each stage, which keeps it from being copied into the next.
    A step whose name is taken replaces that column; steps that read the name
    read the column."""
    made = {name for name, _ in steps}
    old = [F.col(f"`{c}`") for c in df.columns if c not in made]
    out = df.select(*old, *(c.alias(name) for name, c in steps))
    return out.drop(*(name for name in made if name not in keep))


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop Unicode whitespace at both ends."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def is_blank(c) -> Column:
    """Null, empty or whitespace only."""
    return F.coalesce(py_strip(c) == F.lit(""), F.lit(True))


def clean_text(c) -> Column:
    """Collapse 3+ newlines, collapse runs of spaces, strip every line, strip.

    Stripping each line and re-joining equals deleting non-newline whitespace
    next to every newline; the outer strip covers the first and last line.
    Each step runs only on texts that need it: no earlier step makes or takes
    away what a later one looks for. Whitespace before a newline is matched
    from where it begins, so that no run of it is scanned more than once.
    """
    c = col(c)

    def step(t, needed, pattern, into):
        return F.when(needed, F.regexp_replace(t, pattern, into)).otherwise(t)

    t = step(c, F.contains(c, F.lit("\n\n\n")), r"\n{3,}", "\n\n")
    t = step(t, F.contains(c, F.lit("  ")), r" {2,}", " ")
    t = step(t, c.rlike(rf"\n{WS_NO_NL_CLASS}"), rf"\n{WS_NO_NL_CLASS}+", "\n")
    t = step(t, c.rlike(rf"\n(?<={WS_NO_NL_CLASS}\n)"), rf"(?<!{WS_NO_NL_CLASS}){WS_NO_NL_CLASS}+\n", "\n")
    return py_strip(t)


def normalize_homoglyphs(c) -> Column:
    """Map look-alike letters to ASCII with one ``translate``, which goes letter
    by letter: texts without any of them are left alone."""
    src = "".join(a for a, _ in HOMOGLYPHS)
    dst = "".join(b for _, b in HOMOGLYPHS)
    c = col(c)
    plain = (F.octet_length(c) == F.char_length(c)) | ~c.rlike(f"[{src}]")
    return F.when(plain, c).otherwise(F.translate(c, src, dst))


def preview(c, n: int) -> Column:
    """First ``n`` characters, plus ``...`` when the text was longer."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)



def pair_id(a, b) -> Column:
    """60-bit id of a pair of numbers, from the md5 of ``a:b``: no part has a
    range that it must stay in."""
    text = F.concat_ws(":", col(a).cast("string"), col(b).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
