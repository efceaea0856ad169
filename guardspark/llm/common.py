"""Helpers shared by the training-data operators: table access, staged
tables on the shared folder, and flat numpy views of Arrow text columns."""
from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package
from ..sources.tables import read_table

SLICE_BYTES = 4 << 20          # text bytes handled at once inside a task
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_BYTES = b" \t\n\x0b\x0c\r"  # the separators of every word definition here


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and make sure a checkpoint folder is set."""
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", spread=True)


def at_least_slots(df: DataFrame) -> DataFrame:
    """Spread the rows when the scan has fewer splits than the task slots."""
    from ..sources.tables import spread_rows
    return spread_rows(df)


class Stage:
    """Intermediate tables of one operator run, as parquet below the shared
    checkpoint folder. A lost executor re-reads them; lineage ends there."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        root = ensure_checkpoint_dir(spark).rstrip("/")
        self.base = f"{root}/guardspark-llm/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def path(self, name: str) -> str:
        self.paths.append(f"{self.base}/{len(self.paths):02d}-{name}")
        return self.paths[-1]

    def put(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` once and return a reader of the written table."""
        path, conf = self.path(name), self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")      # once the table stands, the shuffle behind it is of no use
        try:
            self._write(df, path, options)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    @staticmethod
    def _write(df: DataFrame, path: str, options: dict) -> None:
        w = df.write.option("compression", "zstd")
        for k, v in options.items():
            w = w.option(k, v)
        w.parquet(path)

    def drop_all_but(self, table: DataFrame) -> None:
        """Delete every staged table of this run except ``table``."""
        self.drop(*(p for p in self.paths if p != table._stage_path))

    def drop(self, *tables) -> None:
        """Delete staged tables that no later step reads."""
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._stage_path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def crc32_mod(col, n: int):
    """crc32 of an id written as text, modulo ``n`` (fold assignment)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


# --- flat views of text -------------------------------------------------------

def text_column(batch, name: str) -> pa.Array:
    """The batch's text column as a StringArray without nulls (null: empty)."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.string():
        col = col.cast(pa.string())
    return col.fill_null("") if col.null_count else col


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a StringArray: text i is ``bytes[off[i]:off[i+1]]``."""
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(arr: pa.Array, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) holding about ``limit`` bytes of text each (one
    longer text makes a range of its own)."""
    n = len(arr)
    if n == 0:
        return
    _, off = flat(arr)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[list(WORD_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def word_spans(data: np.ndarray, off: np.ndarray):
    """Byte spans of words (runs without separators, cut at text borders):
    (starts, ends, first) where text i owns words first[i]:first[i+1]."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MULT = 0x9E3779B97F4A7C15 | 1
_MULT_INV = pow(_MULT, -1, 1 << 64)
_BYTE64 = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POW: list[np.ndarray] = []


def _powers(n: int):
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 18)
        for base in (_MULT, _MULT_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW.append(np.cumprod(p, dtype=np.uint64))
        del _POW[:-2]
    return _POW[0], _POW[1]


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0, window: int = 1 << 16) -> np.ndarray:
    """64-bit hash of every byte segment (ascending, disjoint), by prefix sums
    over byte windows, so that memory does not follow the longest text."""
    table = _BYTE64 if salt == 0 else mix64(_BYTE64 + np.uint64(salt))
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + window, side="right")), i + 1)
        a, b = starts[i], ends[j - 1]
        pw, inv = _powers(int(b - a) + 1)
        c = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * pw[:b - a], out=c[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix64((c[e] - c[s]) * inv[s])
        i = j
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash per word with A-Z lower-cased."""
    return segment_hash(_LOWER[data], starts, ends)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5):
    """Hashes of the k-word shingles of each text (fewer words: the whole
    sequence as one): (hashes, first) with text i owning first[i]:first[i+1].
    Repeats are kept."""
    count = np.diff(first)
    m = len(words)
    acc = np.zeros(m, np.uint64)
    mult = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(_MULT)) | np.uint64(1)
    for j in range(k):                      # texts are padded virtually: masked below
        acc[:m - j] += words[j:] * mult[j] if j < m else 0
    n_sh = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_first = np.concatenate([[0], np.cumsum(n_sh)])
    idx = np.repeat(first[:-1] - out_first[:-1], n_sh) + np.arange(out_first[-1])
    out = mix64(acc[idx])
    for i in np.flatnonzero((count > 0) & (count < k)):
        w = words[first[i]:first[i + 1]]
        out[out_first[i]] = mix64(np.sum(w * mult[:len(w)], dtype=np.uint64, keepdims=True) + np.uint64(len(w)))[0]
    return out, out_first
