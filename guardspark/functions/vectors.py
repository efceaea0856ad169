"""Vector helpers: L2 normalisation, dot products and the built-in hashed
bag-of-words embedder.

Whole corpora are embedded in Arrow batches; screening, which compares short
prompts with a few constant phrases, needs no vector and runs on built-in
functions. No sentence model ships with this package. The default embedder lower-cases
a text, splits it on ``[^a-z0-9]+`` and counts tokens into ``dim`` buckets
chosen by the first 8 hex digits of the token's md5. Vectors are kept as
integer counts, so a cosine is ``dot / sqrt(|a|^2 |b|^2)`` with an exact
integer dot: every engine computes the same double, and ties are real ties.
It is lexical, so paraphrases are not caught; a real model plugs in as an
embedding column instead.
"""
from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import ident, sql_lit
from .slices import runs
from .text import col

DIM = 64
TOKEN_SPLIT = "[^a-z0-9]+"


def hashed_counts(text, dim: int = DIM) -> Column:
    """ARRAY<INT> of token counts per bucket (all zeros for no tokens).

    Arrow-batched: tokenising and hashing run once per row in their own
    plan node, so later filters on derived scores cannot copy the work into
    their predicates, and the cost is linear in the number of tokens. About
    SLICE_BYTES of text are held as Python objects at a time.
    """
    return _hashed_counts_udf(dim)(col(text))


_UDFS: dict[int, object] = {}


def _hashed_counts_udf(dim: int):
    if dim not in _UDFS:
        import pyarrow as pa
        from pyspark.sql import types as T

        def counts(texts):
            return arrow_hashed_counts(texts, dim)

        # Real types (this module postpones annotations) for the UDF signature.
        counts.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        _UDFS[dim] = F.arrow_udf(counts, T.ArrayType(T.IntegerType()))
    return _UDFS[dim]


def token_buckets(text, dim: int = DIM) -> Column:
    """ARRAY<INT>: the bucket of every token, by built-in functions alone."""
    words = F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), TOKEN_SPLIT), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int"))


def bucket_counts(buckets, dim: int = DIM) -> Column:
    """Token counts per bucket from :func:`token_buckets`."""
    b = col(buckets)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(b) - F.size(F.array_remove(b, k)))


def sq_norm(counts) -> Column:
    """Sum of squares as BIGINT (exact for integer counts)."""
    return F.aggregate(col(counts), F.lit(0).cast("bigint"), lambda a, x: a + (x * x).cast("bigint"))


def dot(a, b) -> Column:
    """Inner product of two numeric arrays, accumulated left to right in DOUBLE."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v) -> Column:
    """Unit-length copy of a vector; a zero vector stays zero."""
    v = col(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def hashed_embedding(text, dim: int = DIM) -> Column:
    """Normalised float embedding of the hashed counts."""
    return l2_normalize(hashed_counts(text, dim)).cast("array<float>")


# --- The helpers behind the Arrow function and the seed bank.
SLICE_BYTES = 4 << 20            # of text held as Python objects at a time, or one text
_BUCKET_CACHE_MAX = 1 << 18      # tokens, about 30 MB a worker
_IN_TOKEN = bytes(chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789" for i in range(256))
_SPLIT = re.compile(TOKEN_SPLIT)
ODD = ("\u0130".encode(), "\u212a".encode())     # their lower case begins with an ASCII letter; all code points were compared


class _Buckets(dict):
    """md5 bucket of a token, memoised per worker (vocabularies repeat)."""

    def __missing__(self, tok: bytes) -> int:
        h = int.from_bytes(hashlib.md5(tok).digest()[:4], "big")
        if len(self) < _BUCKET_CACHE_MAX:
            self[tok] = h
        return h


_BUCKETS = _Buckets()


def py_hashed_counts(text: str, dim: int = DIM) -> list[int]:
    """Counts per bucket: lower-case, split on non-[a-z0-9], md5 bucket."""
    counts = [0] * dim
    for tok in _SPLIT.split(text.lower()):
        if tok:
            counts[_BUCKETS[tok.encode("utf-8")] % dim] += 1
    return counts


def _lowered(texts):
    """(bytes, bounds of the rows) of the lower-cased texts, in UTF-8. Only
    ASCII letters are lowered, with their bytes: others never are part of a
    token, but for the two that fold to ASCII ones (ODD)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    rows = pc.fill_null(texts, "").cast(pa.large_binary())
    _, places, values = rows.buffers()
    bounds = np.frombuffer(places, np.int64)[rows.offset:rows.offset + len(rows) + 1]
    data = memoryview(values)[bounds[0]:bounds[-1]].tobytes() if values is not None else b""
    if any(c in data for c in ODD):
        low = [t.lower().encode("utf-8") for t in pc.fill_null(texts, "").to_pylist()]
        return b"".join(low), np.cumsum([0, *map(len, low)])
    return data.lower(), bounds - bounds[0]


def arrow_hashed_counts(texts, dim: int = DIM):
    """:func:`py_hashed_counts` of an Arrow array of texts (null: no tokens).
    Tokens are runs of bytes in the lower-cased slice, which end where a row
    does; each distinct one is hashed once a slice."""
    import numpy as np
    import pyarrow as pa
    counts = np.zeros(len(texts) * dim, np.int32)
    for lo, hi in runs(texts, SLICE_BYTES):
        low, bounds = _lowered(texts.slice(lo, hi - lo))
        if not low:
            continue
        inside = np.frombuffer(low.translate(_IN_TOKEN), bool)
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = bounds[:-1] < bounds[1:]
        at = bounds[:-1][full]
        starts[at] = inside[at]
        at = bounds[1:][full] - 1
        ends[at] = inside[at]
        begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        places = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(np.frombuffer(low, np.uint8)[inside])])
        words = words.dictionary_encode()
        bucket = np.fromiter(map(_BUCKETS.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), np.int64) % dim
        n_words = np.diff(np.searchsorted(begin, bounds))
        at = np.repeat(np.arange(hi - lo) * dim, n_words) + bucket[words.indices.to_numpy()]
        counts[lo * dim:hi * dim] = np.bincount(at, minlength=(hi - lo) * dim)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(counts))


def cosines_to_constants(buckets: str, qnorm: str, vectors: list[list[int]]) -> Column:
    """ARRAY<DOUBLE>: cosines of a text's token buckets (with the squared norm
    ``qnorm`` of its counts) to constant count vectors, linear in its tokens."""
    bank = json.dumps([{"v": v, "n": sum(x * x for x in v)} for v in vectors])
    b, qn = ident(buckets), ident(qnorm)
    return F.expr(f"transform(from_json({sql_lit(bank)}, 'array<struct<v:array<int>,n:bigint>>'), s -> IF({qn} > 0 AND s.n > 0, "
                  f"CAST(aggregate({b}, 0L, (a, x) -> a + s.v[x]) AS DOUBLE) / sqrt(CAST({qn} * s.n AS DOUBLE)), 0.0D))")


def _model_id(load_model) -> str:
    """Digest of the serialised loader: what it closes over is part of it."""
    from pyspark import cloudpickle
    return hashlib.sha256(cloudpickle.dumps(load_model)).hexdigest()


def model_embeddings(text, load_model, dim: int, batch_rows: int = 256, model_id: str | None = None) -> Column:
    """Embed with a user model: ``load_model()`` returns an object with
    ``embed(list[str]) -> array (n, dim)``; it is called once per Python
    worker process (iterator pandas UDF, cached across tasks), and texts go
    through it in Arrow batches of ``batch_rows``. Rows are L2-normalised;
    a zero vector stays zero. Models are told apart by ``model_id``, by
    default a digest of the serialised loader."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    key = model_id if model_id is not None else _model_id(load_model)

    def embed(batches):
        model = _model_cache(key, load_model)
        for texts in batches:
            out = []
            vals = texts.fillna("").tolist()
            for i in range(0, len(vals), batch_rows):
                m = np.asarray(model.embed(vals[i:i + batch_rows]), dtype=np.float64).reshape(-1, dim)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                out.extend(np.where(n > 0, m / np.where(n > 0, n, 1.0), 0.0).astype(np.float32).tolist())
            yield pd.Series(out)

    from typing import Iterator
    embed.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(embed, T.ArrayType(T.FloatType()))(col(text))


class HashedEmbedder:
    """The built-in embedder: integer counts, cosines exact in every engine."""

    def column(self, text) -> Column:
        return hashed_counts(text)

    def with_similarities(self, df, text_col: str, phrases: list[str], out: str):
        """``df`` with ``out``: the cosine of the text to every phrase."""
        df = df.withColumn("_qb", token_buckets(text_col)).withColumn("_qn", sq_norm(bucket_counts("_qb")))
        return df.withColumn(out, cosines_to_constants("_qb", "_qn", [py_hashed_counts(p) for p in phrases])).drop("_qb", "_qn")


class ModelEmbedder:
    """A user model (see :func:`model_embeddings`) for ingest, retrieval and
    screening alike; the few constant phrases are embedded on the driver."""

    def __init__(self, load_model, dim: int, model_id: str | None = None, batch_rows: int = 256):
        self.load_model, self.dim, self.model_id, self.batch_rows = load_model, dim, model_id, batch_rows

    def column(self, text) -> Column:
        return model_embeddings(text, self.load_model, self.dim, self.batch_rows, self.model_id)

    def with_similarities(self, df, text_col: str, phrases: list[str], out: str):
        import numpy as np
        m = np.asarray(self.load_model().embed(list(phrases)), dtype=np.float64).reshape(-1, self.dim)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        unit = np.where(n > 0, m / np.where(n > 0, n, 1.0), 0.0)
        seeds = [F.lit([float(x) for x in row]) for row in unit]
        df = df.withColumn("_qv", self.column(text_col))
        return df.withColumn(out, F.array(*(dot("_qv", seed) for seed in seeds))).drop("_qv")


HASHED = HashedEmbedder()


_MODELS: dict = {}


def _model_cache(model_id: str, load_model):
    if model_id not in _MODELS:
        _MODELS[model_id] = load_model()
    return _MODELS[model_id]
