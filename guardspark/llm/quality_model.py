"""Quality classifier: histogram gradient-boosted trees over document
statistics.

Statistics are computed for every whole text, in numpy over flat byte
arrays. Trees are grown level by level on statistics binned to BINS values:
gradients and Hessians are summed per (node, feature, bin), the best split of
each node is read from the cumulative sums. The grown trees are flattened
into arrays (feature, bin threshold, left child, leaf value) and all rows of
a batch walk all trees by array indexing.

Training uses a bounded sample: the TRAIN_ROWS labelled rows of smallest
hashed id (a parameter); statistics of those rows only reach the driver.
Scores are for all rows. Label, language, source and id are no statistics.

Edge cases: null and empty texts have all statistics 0 and a score like any
other; rows without a label, or with a null id, are not learnt from; with no
labelled row the score is 0.5; repeated rows score alike; other columns are
ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_least_slots, crc32_mod, flat, prepare, shingle_hashes, slices, text_column, word_hashes, word_spans

TRAIN_ROWS = 20_000
FOLDS = 5
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, L2, MIN_HESSIAN = 60, 4, 0.15, 64, 1.0, 2.0

#: Byte classes counted per text.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "newline": b"\n",
           "end": b".?", "comma": b",;:", "bang": b"!", "bar": b"|", "symbol": b"#*$%&@^~=+\\_/", "bracket": b"<>{}[]()",
           "high": bytes(range(128, 256))}
NAMES = ["log_bytes", "log_words", *(f"share_{c}" for c in CLASSES), "mean_word", "max_word", "distinct_words",
         "repeat_next", "repeat_8", "top_word", "mean_line", "dup_lines", "bar_words", "one_byte_words"]


def _segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments first[i]:first[i+1] (may be empty)."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def statistics(arr: pa.Array) -> np.ndarray:
    """One row of NAMES per text."""
    data, off = flat(arr)
    n, size = len(arr), np.diff(off)
    starts, ends, first = word_spans(data, off)
    words = np.diff(first)
    h = word_hashes(data, starts, ends)
    length = ends - starts
    out = np.zeros((n, len(NAMES)))
    col = dict(zip(NAMES, out.T))
    one, w1 = np.maximum(size, 1), np.maximum(words, 1)
    col["log_bytes"][:], col["log_words"][:] = np.log1p(size), np.log1p(words)
    for name, chars in CLASSES.items():
        member = np.zeros(256, np.int64)
        member[list(chars)] = 1
        col[f"share_{name}"][:] = _segment_sum(member[data], off) / one
    col["mean_word"][:] = _segment_sum(length, first) / w1
    col["one_byte_words"][:] = _segment_sum((length == 1).astype(np.int64), first) / w1
    last = data[ends - 1] if len(ends) else data
    col["bar_words"][:] = _segment_sum((~np.isin(last, _WORD_END)).astype(np.int64), first) / w1
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    col["repeat_next"][:] = _segment_sum(same, first) / w1
    w8, f8 = shingle_hashes(h, first, 8)
    lines, fl = _line_hashes(data, off, h, starts, first)
    for i in np.flatnonzero(words):
        col["max_word"][i] = min(64, length[first[i]:first[i + 1]].max())
        w = np.sort(h[first[i]:first[i + 1]])
        runs = np.diff(np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]])))
        col["distinct_words"][i], col["top_word"][i] = len(runs) / len(w), runs.max() / len(w)
        g = w8[f8[i]:f8[i + 1]]
        col["repeat_8"][i] = 1 - len(np.unique(g)) / len(g)
        ln = lines[fl[i]:fl[i + 1]]
        col["dup_lines"][i] = 1 - len(np.unique(ln)) / len(ln)
        col["mean_line"][i] = np.log1p(words[i] / len(ln))
    return out


_WORD_END = np.frombuffer(bytes(c for c in range(256) if chr(c).isalnum() and c < 128 or c >= 128) + b".,;:?", np.uint8)


def _line_hashes(data, off, h, starts, first):
    """One hash per line that has a word, flat, with text borders."""
    if not len(h):
        return h, first
    line = np.concatenate([[0], np.cumsum(data == 10)])[starts]       # line feeds before the word
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    new = np.ones(len(h), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    place = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    mixed = h * (np.uint64(2) * place.astype(np.uint64) + np.uint64(1))
    return np.add.reduceat(mixed, begin), np.searchsorted(begin, first)


class Trees:
    """Boosted trees as flat arrays over binned statistics."""

    def __init__(self, edges, feature, cut, value, prior):
        self.edges, self.feature, self.cut, self.value, self.prior = edges, feature, cut, value, prior

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        b = self.bins(x)
        trees = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)          # heap position in every tree
        for _ in range(DEPTH):
            f = self.feature[trees, at]
            right = b[np.arange(len(x))[:, None], f] > self.cut[trees, at]
            at = 2 * at + 1 + right
        raw = self.prior + self.value[trees, at].sum(axis=1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    inner, nodes = 2 ** DEPTH - 1, 2 ** (DEPTH + 1) - 1
    model = Trees(edges, np.zeros((0, nodes), np.int64), np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    n_feat = x.shape[1]
    raw = np.full(len(y), model.prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        feature, cut, value = np.zeros(nodes, np.int64), np.full(nodes, 255, np.int64), np.zeros(nodes)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            base, width = 2 ** level - 1, 2 ** level
            cell = ((at - base)[:, None] * n_feat + np.arange(n_feat)[None, :]) * (BINS + 1) + b
            shape = (width, n_feat, BINS + 1)
            g = np.bincount(cell.ravel(), np.repeat(grad, n_feat), np.prod(shape)).reshape(shape).cumsum(axis=2)
            s = np.bincount(cell.ravel(), np.repeat(hess, n_feat), np.prod(shape)).reshape(shape).cumsum(axis=2)
            gt, st = g[:, :, -1:], s[:, :, -1:]
            gain = g ** 2 / (s + L2) + (gt - g) ** 2 / (st - s + L2) - gt ** 2 / (st + L2)
            gain[(s < MIN_HESSIAN) | (st - s < MIN_HESSIAN)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            feature[base:base + width] = np.where(good, best // (BINS + 1), 0)
            cut[base:base + width] = np.where(good, best % (BINS + 1), 255)   # 255: all rows go left
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        gs, ss = np.bincount(at, grad, nodes), np.bincount(at, hess, nodes)
        value[inner:] = -RATE * gs[inner:] / (ss[inner:] + L2)
        raw += value[at]
        model.feature = np.vstack([model.feature, feature])
        model.cut = np.vstack([model.cut, cut])
        model.value = np.vstack([model.value, value])
    return model


def statistics_of(docs: DataFrame, extra: list[str], text_col: str) -> DataFrame:
    """The columns ``extra`` and the statistics as an array."""
    def run(batches):
        for b in batches:
            texts = text_column(b, "_text")
            for lo, hi in slices(texts):
                x = statistics(texts.slice(lo, hi - lo))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in extra), lists], names=[*extra, "x"])

    rows = docs.select(*extra, F.col(text_col).cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``train_rows`` labelled rows outside the held-out fold."""
    usable = (labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y"))
                    .where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (crc32_mod("_id", FOLDS) != 0)))
    chosen = usable.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_body"))
    rows = rows.join(F.broadcast(chosen), "_id")                                            # train_rows ids at most
    got = statistics_of(rows, ["_id", "_y"], "_body").toPandas().sort_values("_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(NAMES))
    return fit(x, (got["_y"].to_numpy(float) > 0).astype(float))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    spark = docs.sparkSession
    prepare(spark)
    docs = at_least_slots(docs)
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col, train_rows))

    def run(batches):
        for b in batches:
            texts = text_column(b, "_text")
            for lo, hi in slices(texts):
                p = model.value.score(statistics(texts.slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(p)], names=["doc_id", "score"])

    scored = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
                  .mapInArrow(run, "doc_id long, score double"))
    return scored.select("doc_id", (crc32_mod("doc_id", FOLDS) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
