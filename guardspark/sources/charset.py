"""Charset detection by byte bigrams.

A model holds, for every candidate charset, how likely each pair of
neighbouring bytes is in text of that charset, apart for even and odd places
(which tells the two byte orders of UTF-16). It is counted from texts that
are known (the valid part of the corpus): every task encodes its texts in each
candidate and sums byte pairs, Spark adds the sums up, and what reaches the
driver is one count per charset and pair of bytes (at most 131,072 a charset).

A file is decoded by its byte-order mark, else as UTF-8 when it is valid and
has no zero bytes, else in the candidate that can decode it and whose model
gives its bytes the highest mean log-likelihood. UTF-8 is a candidate too, so
that a UTF-8 file with a few broken bytes is told from a single-byte file; it
and any file that no candidate decodes get U+FFFD for what is invalid. Only
rows that need the model send their bytes to Python.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATES = ("utf-8", "cp1252", "cp850", "mac_roman", "utf-16-le", "utf-16-be")
PAIRS = 1 << 17
FALLBACK = 50.0                  # weight of single bytes, in pairs
BLOCK = 1 << 20                  # bytes looked up at once (an even number)


def byte_pairs(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    pair = b[:-1] << 8 | b[1:]
    pair[1::2] |= 1 << 16
    return pair


@dataclass(frozen=True)
class CharsetModel:
    """Log-likelihood of every byte pair per candidate charset."""
    charsets: tuple[str, ...]
    log_p: np.ndarray

    def scores(self, data: bytes) -> dict[str, float]:
        """Mean log-likelihood of the bytes under each charset that can
        decode them (UTF-8 always can, with replacements)."""
        out = {}
        for i, name in enumerate(self.charsets):
            if name != "utf-8":
                try:
                    data.decode(name)
                except UnicodeDecodeError:
                    continue
            total = sum(float(self.log_p[i][byte_pairs(data[lo:lo + BLOCK + 1])].sum()) for lo in range(0, max(len(data) - 1, 1), BLOCK))
            out[name] = total / max(len(data) - 1, 1)
        return out

    def detect(self, data: bytes) -> tuple[str, float]:
        """(charset, its probability among the candidates, given equal priors
        and the whole text)."""
        s = self.scores(data)
        if not s:
            return "utf-8", 0.0
        best = max(s, key=lambda c: (s[c], -self.charsets.index(c)))
        rest = sum(np.exp((v - s[best]) * max(len(data) - 1, 1)) for v in s.values())
        return best, 1.0 / rest


def fit(texts: DataFrame, text_col: str = "text", charsets: tuple[str, ...] = CANDIDATES) -> CharsetModel:
    """Model of the charsets from all texts of ``texts``. A text that a
    charset cannot express is left out of that charset's counts."""
    def run(batches):
        counts = np.zeros((len(charsets), PAIRS), np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                for i, name in enumerate(charsets):
                    try:
                        data = (t or "").encode(name)
                    except UnicodeEncodeError:
                        continue
                    for lo in range(0, len(data), BLOCK):
                        counts[i] += np.bincount(byte_pairs(data[lo:lo + BLOCK + 1]), minlength=PAIRS)
        charset, pair = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(charset.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(counts[charset, pair])],
                                         names=["charset", "pair", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "charset int, pair int, n long") \
                .groupBy("charset", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(charsets), PAIRS))
    for r in rows:
        counts[r["charset"], r["pair"]] = r["n"]
    return CharsetModel(charsets, log_likelihoods(counts))


def log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """Of pairs, by their counts; pairs that were not seen fall back on how
    often their two bytes were."""
    c = counts.reshape(len(counts), 2, 256, 256)
    total = c.sum(axis=(1, 2, 3), keepdims=True)
    first, second = (c.sum(axis=axis, keepdims=True) + 0.01 for axis in (3, 2))
    apart = first * second / (first.sum(axis=2, keepdims=True) * second.sum(axis=3, keepdims=True))
    return np.log((c + FALLBACK * apart) / (total + 2 * FALLBACK)).reshape(len(counts), PAIRS)


def decode_detected(df: DataFrame, model: CharsetModel, content_col: str = "content", out_col: str = "text") -> DataFrame:
    """``df`` with the text, its ``charset`` and the detection's ``confidence``
    (1 where a byte-order mark or valid UTF-8 decides). Null content: all null."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("charset string, confidence double, text string")
    def guess(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            if data is None:
                rows.append((None, None, None))
                continue
            data = bytes(data)
            name, sure = shared.value.detect(data)
            rows.append((name, sure, data.decode(name, errors="replace")))
        return pd.DataFrame(rows, columns=["charset", "confidence", "text"])

    @F.pandas_udf("string")
    def utf16(content: pd.Series) -> pd.Series:
        return content.map(lambda data: None if data is None else bytes(data).decode("utf-16", errors="replace"))

    b = F.col(content_col)
    marked = F.hex(F.substring(b, 1, 2)).isin("FFFE", "FEFF")
    utf8_mark = F.hex(F.substring(b, 1, 3)) == "EFBBBF"
    plain = F.is_valid_utf8(b.cast("string")) & ~F.contains(b, F.lit(b"\x00"))
    d = df.withColumn("_plain", F.when(marked, "utf-16").when(plain & utf8_mark, "utf-8-sig").when(plain, "utf-8"))
    d = (d.withColumn("_guess", guess(F.when(F.col("_plain").isNull(), b)))
          .withColumn("_wide", utf16(F.when(F.col("_plain") == "utf-16", b))))
    body = F.when(F.col("_plain") == "utf-8-sig", F.substring(b, 4, 2**31 - 1)).otherwise(b)
    return (d.withColumn(out_col, F.when(F.col("_plain") == "utf-16", F.col("_wide"))
                         .when(F.col("_plain").isNotNull(), body.cast("string")).otherwise(F.col("_guess.text")))
             .withColumn("charset", F.coalesce("_plain", "_guess.charset"))
             .withColumn("confidence", F.when(F.col("_plain").isNotNull(), F.lit(1.0)).otherwise(F.col("_guess.confidence")))
             .drop("_plain", "_guess", "_wide"))
