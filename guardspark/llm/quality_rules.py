"""Quality rules as a short-circuit cascade.

A rule is a condition that rejects a document. The cascade measures on a
sample what each step of a rule reads (characters, words, windows, lines of
the sampled texts, weighted by kind of work) and which sampled documents each
rule rejects. It then picks the rules one by one: next comes the rule that
rejects the most documents still kept per cost that it still adds, where
steps that an earlier rule has built cost nothing more. All rules are
evaluated in that order as one chain: a document rejected by one rule never
pays for the next. The order changes the work and the reported
``first_failed`` rule, never the verdict: a document is kept if no rule rejects
it. Built-in functions only.

Statistics (words are runs without separators, whole text, null: none):
n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words lying in
8-word windows found twice or more; windows are compared by a 64-bit hash).

The rules beyond the base test reject texts of symbols, of shouted or
list-like junk, and of repeated lines; their limits are well outside what
clean prose reaches.

Edge cases: null and empty texts have no words, so the base test rejects
them; a null doc_id passes through; repeated rows are judged alike; other
columns, whatever their names, are kept by :func:`apply_rules`.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_least_slots

WORD_SEPARATORS = "[ \\t\\n\\x0B\\f\\r]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
MIN_DUP_LINES = 5        # a short text may well say a line twice
SAMPLE_ROWS = 2000


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_SEPARATORS), "")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(w: Column, k: int = WINDOW) -> Column:
    """Hash of every k-word window, from per-word hashes."""
    n = F.size(w) - (k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, F.lit(k)))))


def repeated_at(marked: Column) -> Column:
    """Start positions of the windows that occur twice or more, ascending;
    ``marked``: (hash, position) sorted, a plain column."""
    def repeats(x, j):
        before = F.when(j > 0, F.get(marked, j - 1)["h"] == x["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(marked, j + 1)["h"] == x["h"], F.lit(False))

    return F.sort_array(F.transform(F.filter(marked, repeats), lambda x: x["i"]))


def covered_words(at: Column, k: int = WINDOW) -> Column:
    """Words covered by k-word windows that start at the ascending positions."""
    return F.aggregate(at, F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n")),
                       lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(k), i - a["last"])).alias("n")),
                       lambda a: a["n"])


@dataclass(frozen=True)
class Step:
    """A column that rules build on: how it is built, and how much it reads
    per document (measured on the sample, in characters' worth of work)."""
    name: str
    make: Callable[[], Column]
    reads: Callable[[], Column]


@dataclass(frozen=True)
class Rule:
    """``steps``: columns to build first, in order; ``reject``: builder of the
    condition on them."""
    name: str
    steps: tuple[Step, ...]
    reject: Callable[[], Column]
    base: bool = False


def _chars(weight: float = 1.0):
    return lambda: F.char_length("_t") * weight


def _size(array: str, weight: float):
    return lambda: F.coalesce(F.greatest(F.size(array), F.lit(0)), F.lit(0)) * weight


def _counted(name: str, pattern: str) -> Step:
    return Step(name, lambda: F.regexp_count("_t", F.lit(pattern)).cast("long"), _chars())


WORDS = Step("_w", lambda: words(F.col("_t")), _chars(2))
N_WORDS = Step("n_words", lambda: F.size("_w").cast("long"), lambda: F.lit(0.0))
WORD_CHARS = Step("word_chars", lambda: F.char_length(F.array_join("_w", "")).cast("long"), _chars())
N_SYMBOLS = _counted("n_symbols", "[#*$%&|<>]")
N_UPPER = _counted("_upper", "[A-Z]")
N_EXCLAIM = _counted("_exclaim", "!")
N_LINE_ENDS = _counted("_ends", "\n")
N_DUP_LINES = Step("n_dup_lines", lambda: n_dup_lines(F.col("_t")), lambda: F.char_length("_t") + F.regexp_count("_t", F.lit("\n")) * 20)
HASHES = Step("_hs", lambda: window_hashes(F.col("_w")), _size("_w", 8 * WINDOW))
MARKED = Step("_m", lambda: F.when(F.size(F.array_distinct("_hs")) < F.size("_hs"), F.sort_array(
    F.transform("_hs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))), _size("_hs", 10))
N_REPEAT = Step("n_repeat_words", lambda: F.when(F.col("_m").isNull(), 0)
                .otherwise(covered_words(repeated_at(F.col("_m")))).cast("long"), _size("_m", 20))

RULES = (
    Rule("few_words", (WORDS, N_WORDS), lambda: F.col("n_words") < MIN_WORDS, base=True),
    Rule("repetition", (WORDS, N_WORDS, HASHES, MARKED, N_REPEAT),
         lambda: 100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"), base=True),
    Rule("symbols", (WORDS, N_WORDS, N_SYMBOLS), lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("word_length", (WORDS, N_WORDS, WORD_CHARS),
         lambda: ~F.col("word_chars").between(2 * F.col("n_words"), 15 * F.col("n_words"))),
    Rule("shouting", (WORDS, WORD_CHARS, N_UPPER), lambda: 2 * F.col("_upper") > F.col("word_chars")),
    Rule("exclaiming", (WORDS, N_WORDS, N_EXCLAIM), lambda: 2 * F.col("_exclaim") > F.col("n_words")),
    Rule("repeated_lines", (N_DUP_LINES, N_LINE_ENDS),
         lambda: (F.col("n_dup_lines") >= MIN_DUP_LINES) & (10 * F.col("n_dup_lines") > 3 * (F.col("_ends") + 1))),
)

#: What every document is described by, whether it is kept or not.
STATISTICS = (WORDS, N_WORDS, WORD_CHARS, N_SYMBOLS, N_DUP_LINES, HASHES, MARKED, N_REPEAT)


def _wrapped(docs: DataFrame, text_col: str) -> DataFrame:
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    return docs.select(row, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))


def _build(df: DataFrame, steps, done: set, guard: Column | None = None) -> DataFrame:
    # One projection per step: a column that the next one reads several times
    # is then kept as it is, and each array is built once.
    for step in steps:
        if step.name not in done:
            done.add(step.name)
            df = df.withColumn(step.name, step.make() if guard is None else F.when(guard, step.make()))
    return df


def greedy_order(rules, judged: list[tuple[str, int]], cost: dict[str, float], built=()) -> list[Rule]:
    """Rules by documents newly rejected per cost newly added, one by one.
    ``judged``: (a 0 or 1 per rule, number of sampled documents it holds for);
    ``cost``: of each step; ``built``: steps that are paid for anyway."""
    left, order, done = list(range(len(rules))), [], set(built)
    while left:
        def gain(i):
            new = sum(n for flags, n in judged if flags[i] == "1")
            return new / (1.0 + sum(cost[s.name] for s in rules[i].steps if s.name not in done))

        best = max(left, key=lambda i: (gain(i), -i))                  # ties stay in the given order
        left.remove(best)
        order.append(rules[best])
        done |= {s.name for s in rules[best].steps}
        judged = [x for x in judged if x[0][best] != "1"]
    return order


def rule_order(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules=RULES,
               sample_rows: int = SAMPLE_ROWS, built=()) -> list[Rule]:
    """The rules in the order of :func:`greedy_order`, as measured on the
    ``sample_rows`` documents of smallest hashed id."""
    ids = docs.select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    sample = rows.join(F.broadcast(ids), F.col("_key").eqNullSafe(F.col("_id")), "left_semi")      # sample_rows ids
    done: set = set()
    for r in rules:
        sample = _build(sample, r.steps, done)
    steps = list({s.name: s for r in rules for s in r.steps}.values())
    flags = F.concat(*(F.coalesce(r.reject(), F.lit(False)).cast("int").cast("string") for r in rules))
    got = sample.groupBy(flags.alias("flags")).agg(                    # at most one row per set of failed rules
        F.count(F.lit(1)).alias("n"), *(F.sum(s.reads().cast("double")).alias(f"s{i}") for i, s in enumerate(steps))).collect()
    n = max(1, sum(r["n"] for r in got))
    cost = {s.name: sum(r[f"s{i}"] or 0.0 for r in got) / n for i, s in enumerate(steps)}
    return greedy_order(rules, [(r["flags"], r["n"]) for r in got], cost, built)


def cascade(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules=RULES,
            sample_rows: int = SAMPLE_ROWS, statistics: bool = False) -> DataFrame:
    """``_row`` (struct of all columns), ``first_failed`` (null: kept) and, on
    request, the statistics of every document and ``base_failed``.

    A rejected document skips all later rules and the columns that only they
    need. The statistics, where asked for, are built for every document, so
    they cost the cascade nothing and its order takes that into account.
    """
    docs = at_least_slots(docs)
    own = STATISTICS if statistics else ()
    order = rule_order(docs, text_col, id_col, rules, sample_rows, {s.name for s in own})
    done: set = set()
    df = _build(_wrapped(docs, text_col), own, done)
    asked = [s.name for s in own if not s.name.startswith("_")]
    if statistics:
        base = [r for r in rules if r.base]
        df = df.withColumn("base_failed", F.coalesce(*(F.when(r.reject(), True) for r in base), F.lit(False)))
        asked.append("base_failed")
    df = df.withColumn("first_failed", F.lit(None).cast("string"))
    for r in order:
        df = _build(df, r.steps, done, guard=F.col("first_failed").isNull())
        df = df.withColumn("first_failed", F.coalesce("first_failed", F.when(r.reject(), F.lit(r.name))))
    # The partition number is not deterministic, so a filter that reads it
    # stays above the cascade. Pushed below, it would put every step's
    # expression into one condition.
    return df.select("_row", "first_failed", *asked, F.spark_partition_id().alias("_at"))


def apply_rules(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules=RULES) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    judged = cascade(docs, text_col, id_col, rules)
    return judged.where(F.col("first_failed").isNull() & (F.col("_at") >= 0)).select("_row.*")
