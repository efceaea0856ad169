"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string is put to the proof: it is
one pre-token and the library encodes it alone as its single id. Those
strings (at most the vocabulary) are broadcast; a pre-token among them
counts one, and only the others are merged, each distinct one once per
worker.

Edge cases: null and empty texts have 0 bytes and 0 tokens; special strings
inside a text count as the library's default has it (one id each); rows are
counted one by one, so repeated rows and null ids keep theirs; other columns
are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_least_slots, flat, prepare, slices, text_column
from .tokens import Pretokens, read_tokenizer

LIMIT = 512
SLICE = 1 << 20


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; ``tokenizer``: path of a file
    of the tokenizers library."""
    spark = docs.sparkSession
    prepare(spark)
    spec = read_tokenizer(tokenizer)
    shared = spark.sparkContext.broadcast((spec, Pretokens.of(spec).whole_tokens()))

    def run(batches):
        spec, proven = shared.value
        enc = Pretokens.of(spec)
        for b in batches:
            texts = text_column(b, "_text")
            _, off = flat(texts)
            n = np.zeros(len(texts), np.int64)
            for lo, hi in slices(texts, SLICE):
                n[lo:hi] = enc.count(texts.slice(lo, hi - lo), proven)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = at_least_slots(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
