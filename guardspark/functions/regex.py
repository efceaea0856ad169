"""Regex dialects.

Patterns are kept in Python ``re`` syntax (see :mod:`patterns`). Spark runs
Java regex; the flags below make Java agree with Python 3 on ``str`` input:
``d`` (only ``\\n`` ends a line), ``U`` (Unicode ``\\w \\d \\s \\b`` and
Unicode case folding). DuckDB oracles run RE2, which lacks lookaheads, so
the few patterns using them get an equivalent RE2 form.
"""
from __future__ import annotations

# Flag sets by bank: input signatures are multiline; sanitizer deletions are
# dotall + multiline; everything else is just case-insensitive.
JAVA_FLAGS = {"input": "imdU", "sanitize": "ismdU", "plain": "idU"}
RE2_FLAGS = {"input": "im", "sanitize": "ims", "plain": "i"}


def java(p: str, bank: str = "plain") -> str:
    """Python pattern -> Java pattern with the bank's flags."""
    return f"(?{JAVA_FLAGS[bank]})" + p.replace(r"\Z", r"\z")


def re2(p: str, bank: str = "plain") -> str:
    """Python pattern -> RE2 pattern (lookahead-free patterns only)."""
    if "(?=" in p:
        raise ValueError("pattern needs an explicit RE2 rewrite: " + p)
    return f"(?{RE2_FLAGS[bank]})" + p.replace(r"\Z", r"\z")


# Characters Python's str.strip() removes (str.isspace), listed explicitly so
# Spark's btrim and DuckDB's trim strip exactly the same set.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000")
# Same set as a regex class without the newline (for per-line stripping).
WS_NO_NL_CLASS = (r"[\t\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                  r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def sql_lit(s: str) -> str:
    """Spark SQL string literal for any text (backslash escapes)."""
    return "'" + (s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
                  .replace("\r", "\\r").replace("\t", "\\t")) + "'"


def ident(name: str) -> str:
    """Back-quoted column reference."""
    return "`" + name.replace("`", "``") + "`"


# What the lower case of a text holds when letters beyond ASCII in it match
# ASCII ones in Java's Unicode case folding (dotless i, long s, and the dot of
# a capital I; the Kelvin sign becomes k). All code points were compared.
FOLDED_LETTERS = ("\u0131", "\u017f", "\u0307")


def holds_one(low: str, strings) -> str:
    """SQL: whether the text ``low`` holds one of the strings."""
    return "(" + " OR ".join(f"contains({low}, {sql_lit(x)})" for x in strings) + ")"


def may_match(low: str, odd: str, needs) -> str:
    """SQL: whether a pattern that needs one of the strings can match a text
    with the lower case ``low``; ``odd``: it holds FOLDED_LETTERS. Without
    needs, any text may match."""
    return f"({odd} OR {holds_one(low, needs)})" if needs else "true"
