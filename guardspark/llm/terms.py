"""Terms of a text: maximal runs of digits, ASCII letters and all characters
from U+0080 on, with only A-Z lower-cased. A UTF-8 text needs no decoding for
that: every byte of a character from U+0080 on is a term byte."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, word_hashes

TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
TERM_BYTE[128:] = True


def term_spans(data: np.ndarray, off: np.ndarray):
    """Byte spans of the terms: (starts, ends, first), where text i owns terms
    first[i]:first[i+1]."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = np.zeros(n + 1, bool)
    inside[:n] = TERM_BYTE[data]
    border = np.zeros(n + 1, bool)
    border[off] = True
    starts = np.flatnonzero(inside[:n] & np.concatenate([[True], ~inside[:n - 1] | border[1:n]]))
    ends = np.flatnonzero(inside[:n] & (~inside[1:] | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def text_terms(texts: pa.Array):
    """(hashes, starts, ends, first): 64-bit hash and byte span per term."""
    data, off = flat(texts)
    starts, ends, first = term_spans(data, off)
    return word_hashes(data, starts, ends), starts, ends, first


def lookup(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the sorted ``vocabulary``, -1 where it is not in it."""
    if not len(vocabulary):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def item_blocks(spark: SparkSession, items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """The items as lists of (id, text), each of about ``block_bytes`` of text
    (a longer item makes a block of its own). Rows that share an id are in one
    block. One block at a time is on the driver."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == b)
        block = [(r["id"], r["text"]) for r in part.collect()]
        if block or b == 0:
            yield block
