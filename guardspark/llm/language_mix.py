"""Language ID by multilingual mixture inference.

Every text is a bag of byte n-grams (words framed by spaces, letters folded
to lower case, digits and punctuation blanked), hashed to BUCKETS cells. Each
language has a smoothed distribution over the cells, from the counts of all
training rows. A text is explained as a mixture of languages: expectation-
maximisation estimates the proportions, and the set of languages is chosen by
penalised likelihood: starting from the single best one, the language whose
proportion is largest in a mixture of all joins as long as the gain exceeds the
penalty (half the logarithm of the n-gram count times PENALTY). The
prediction is the largest proportion of the chosen set.

Of the values of the language column, the MAX_LANGUAGES with the most training
rows are learnt, so a dirty column cannot make the model grow without bound.

Edge cases: null texts and texts without a letter give ``und`` and score 0;
rows with a null language are not learnt from; with nothing to learn from,
every text is ``und``; a null id is an id like any other (its fold is that of
the empty text); repeated rows are predicted alike; other columns are
ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_least_slots, crc32_mod, flat, prepare, slices, text_column

BUCKETS = 8192
ORDERS = (1, 2, 3)
FOLDS, HELD_OUT = 4, 2
ROUNDS = 12
PENALTY = 6.0
SMOOTH = 0.5
MAX_ROWS = 256          # texts explained at once
MAX_LANGUAGES = 256

_FOLD = np.full(256, 32, np.uint8)
for _c in range(26):
    _FOLD[65 + _c] = _FOLD[97 + _c] = 97 + _c
_FOLD[128:] = np.arange(128, 256)


def cells(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of every n-gram: n bytes that do not begin and end with a
    blank and lie in one text."""
    data, off = flat(arr)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _FOLD[data]
    text = np.repeat(np.arange(len(arr), dtype=np.int32), np.diff(off))
    texts, found = [], []
    for n in ORDERS:
        if len(b) < n:
            continue
        code = np.zeros(len(b) - n + 1, np.uint32)
        for i in range(n):
            code = code * np.uint32(257) + b[i:len(b) - n + 1 + i]
        ok = (text[:len(text) - n + 1] == text[n - 1:]) & ((b[:len(b) - n + 1] != 32) | (b[n - 1:] != 32))
        code = (code[ok] + np.uint32(n)) * np.uint32(2654435761)
        texts.append(text[:len(text) - n + 1][ok])
        found.append(code >> np.uint32(32 - (BUCKETS.bit_length() - 1)))
    return np.concatenate(texts), np.concatenate(found).astype(np.int64)


def count_matrix(arr: pa.Array) -> np.ndarray:
    text, cell = cells(arr)
    return np.bincount(text * BUCKETS + cell, minlength=len(arr) * BUCKETS).reshape(len(arr), BUCKETS).astype(np.float32)


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and their cell distributions, from all training rows."""
    rows = (docs.where(F.col(lang_col).isNotNull() & (crc32_mod(id_col, FOLDS) != HELD_OUT))
                .select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text")))
    named = rows.groupBy("_lang").count().orderBy(F.col("count").desc(), "_lang").limit(MAX_LANGUAGES).select("_lang")
    rows = rows.join(F.broadcast(named), "_lang", "left_semi")                     # MAX_LANGUAGES names

    def tally(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            lang = np.array(b.column(0).to_pylist(), object)
            texts = text_column(b, "_text")
            for name in set(lang):
                own = texts.filter(pa.array(lang == name))
                for lo, hi in slices(own, 1 << 20):
                    _, cell = cells(own.slice(lo, hi - lo))
                    sums[name] = sums.get(name, 0) + np.bincount(cell, minlength=BUCKETS)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                             names=["lang", "cell", "n"])

    # One row per language and cell.
    got = rows.mapInArrow(tally, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.full((len(langs), BUCKETS), SMOOTH)
    np.add.at(counts, (got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), got["cell"].to_numpy(int)), got["n"].to_numpy(float))
    return langs, (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def proportions(c: np.ndarray, p: np.ndarray, use: np.ndarray, rounds: int = ROUNDS):
    """EM for each text (row of ``c``) over its languages (``use``: texts x
    languages): (proportions, log-likelihood)."""
    total = np.maximum(c.sum(axis=1, keepdims=True), 1)
    pi = use / np.maximum(use.sum(axis=1, keepdims=True), 1)
    for _ in range(rounds):
        pi = pi * ((c / np.maximum(pi @ p, 1e-30)) @ p.T) / total
    return pi, (c * np.log(np.maximum(pi @ p, 1e-30))).sum(axis=1)


def infer(c: np.ndarray, p: np.ndarray):
    """(proportions, number of languages) of each text by penalised likelihood."""
    n, k = len(c), len(p)
    ll = c @ np.log(p).T
    best = ll.argmax(axis=1)
    use = np.zeros((n, k), np.float32)
    use[np.arange(n), best] = 1
    pi, value = use.copy(), ll.max(axis=1)
    cost = PENALTY * 0.5 * np.log(np.maximum(c.sum(axis=1), 2))
    # The likelihood is concave in the proportions, so its slope towards each
    # language bounds what any mixture can gain over the single best one.
    slope = np.zeros(n, np.float32)
    for i in np.unique(best):
        own = best == i
        slope[own] = (c[own] @ (p / p[i]).T).max(axis=1)
    open_ = np.flatnonzero(slope - c.sum(axis=1) > cost)
    while len(open_) and k > 1:
        full, _ = proportions(c[open_], p, np.ones((len(open_), k), np.float32))
        full[use[open_] > 0] = -1
        add = full.argmax(axis=1)
        wider = use[open_].copy()
        wider[np.arange(len(open_)), add] = 1
        new, got = proportions(c[open_], p, wider)
        better = got - value[open_] > cost[open_]
        open_, wider, new, got = open_[better], wider[better], new[better], got[better]
        use[open_], pi[open_], value[open_] = wider, new, got
        more = use[open_].sum(axis=1) < k
        open_ = open_[more]
    return pi, use.sum(axis=1)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score (its proportion), languages (how
    many the text is explained by)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = at_least_slots(docs)
    shared = spark.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col))

    def run(batches):
        langs, p = shared.value
        names = np.array([*langs, "und"], object)
        for b in batches:
            texts, letter = text_column(b, "_text"), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            pred, score, many = np.full(len(texts), len(langs)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            if langs:
                for lo, hi in slices(texts, 1 << 20):
                    for i in range(lo, hi, MAX_ROWS):
                        j = min(i + MAX_ROWS, hi)
                        pi, n = infer(count_matrix(texts.slice(i, j - i)), p)
                        pred[i:j], score[i:j], many[i:j] = pi.argmax(axis=1), np.clip(pi.max(axis=1), 0, 1), n
                pred[~letter], score[~letter], many[~letter] = len(langs), 0, 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[pred].tolist(), pa.string()), pa.array(score), pa.array(many)],
                                             names=["doc_id", "lang_pred", "score", "languages"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("_text"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    found = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages long")
    return found.select("doc_id", (crc32_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "languages")
