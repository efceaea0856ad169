"""Token-id files coded by a static range asymmetric numeral system (rANS).

Format (two Parquet tables below one folder; every row stands alone):

* ``table``: one row - scale bits and the frequency of every id, summing to
  2**scale_bits. One table is shared by all blocks of the corpus.
* ``blocks``: one row per block of whole documents in ascending document
  order - first id's position, number of ids, number of interleaved lanes,
  the 32-bit words, the lane states at every checkpoint with the word where
  each begins, a crc32 per checkpoint segment, and the documents' ids and
  lengths.

Id i of a block belongs to lane i mod lanes and step i div lanes. A lane is
a 64-bit rANS state (lower bound 2**31, 32-bit renormalisation); all lanes
of a step are coded by one vector operation. The coder runs from the last
step to the first and notes the lane states every CHECKPOINT_STEPS steps:
a decoder can begin at any checkpoint, so blocks, and segments within a
block, decode independently (here all segments of a block at once).

Documents are range-partitioned by id, so a task writes consecutive
documents, and positions follow from one total per task. Texts are encoded
once; frequencies come from all ids of the written blocks.

Edge cases: null and empty texts hold the end id alone; a null doc_id sorts
first; repeated doc_ids stay apart, in the order of their texts; an empty
table gives no blocks and an empty result; other columns are ignored.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, slices, text_column
from .tokens import Pretokens, read_tokenizer

END_ID = 0
SCALE_BITS = 18             # tables of a size that caches hold
BLOCK_IDS = 1 << 20         # a block closes at the document that reaches this
LANES = 1024
CHECKPOINT_STEPS = 256
LOW = 1 << 31

RAW = "part int, local long, n_ids long, ids binary, doc_ids array<long>, lens array<long>"
CODED = ("start long, n_ids long, lanes int, words binary, states binary, word_at array<long>, crcs array<long>, "
         "doc_ids array<long>, lens array<long>")


def normalised(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies summing to 2**bits, at least 1 for every id that occurs."""
    total = 1 << bits
    used = np.flatnonzero(counts)
    if not len(used):
        return np.zeros(len(counts), np.int64)
    if len(used) > total:
        raise ValueError("more different ids than the scale has slots")
    freq = np.zeros(len(counts), np.int64)
    share = counts[used] * (total / counts[used].sum())
    freq[used] = np.maximum(1, np.floor(share)).astype(np.int64)
    over = int(freq.sum()) - total
    by_size = used[np.argsort(-freq[used], kind="stable")]
    while over > 0:                                  # take from the most frequent, keep each at 1 or more
        room = freq[by_size] - 1
        take = np.minimum(room, np.maximum(1, room * over // max(1, int(room.sum()))))
        take = np.minimum(take, np.maximum(0, over - np.concatenate([[0], np.cumsum(take)[:-1]])))
        freq[by_size] -= take
        over -= int(take.sum())
    if over < 0:
        freq[by_size[0]] -= over
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        cum = np.concatenate([[0], np.cumsum(freq)])
        self.start = cum[:-1].astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)      # a state below it can take the id without a word
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray, lanes: int, every: int = CHECKPOINT_STEPS):
        """(words, states[checkpoint, lane], word_at[checkpoint])."""
        n = len(ids)
        steps = -(-n // lanes)
        x = np.full(lanes, LOW, np.uint64)
        words, states = [None] * steps, []
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes:(t + 1) * lanes]
            y = x[:len(s)]                                  # the last step may leave lanes idle
            f = self.freq[s]
            full = y >= self.limit[s]
            words[t] = y[full].astype("<u4")
            y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[:len(s)] = (q << self.bits) + (y - q * f) + self.start[s]
            if t % every == 0:
                states.append(x.copy())
        at = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        return (np.concatenate(words) if words else np.zeros(0, "<u4"),
                np.array(states[::-1], np.uint64).reshape(-1, lanes), at[0:steps:every].astype(np.int64))

    def decode(self, words: np.ndarray, states: np.ndarray, word_at: np.ndarray, n: int, lanes: int,
               every: int = CHECKPOINT_STEPS) -> np.ndarray:
        """All ids, every checkpoint segment advancing in the same step."""
        steps, segs = -(-n // lanes), len(states)
        out = np.zeros((segs, every * lanes), np.uint32)
        x, at = states.copy(), word_at.copy()
        size = np.minimum(n - np.arange(segs) * every * lanes, every * lanes)
        mask = np.uint64((1 << int(self.bits)) - 1)
        for t in range(min(every, steps)):
            live = np.arange(t * lanes, (t + 1) * lanes)[None, :] < size[:, None]
            slot = x & mask
            s = self.slots[slot]
            y = self.freq[s] * (x >> self.bits) + slot - self.start[s]
            need = live & (y < LOW)
            order = np.cumsum(need, axis=1)
            word = words[np.where(need, at[:, None] + order - 1, 0)] if len(words) else np.zeros_like(s)
            x = np.where(live, np.where(need, (y << np.uint64(32)) | word, y), x)
            at = at + order[:, -1]
            out[:, t * lanes:(t + 1) * lanes] = np.where(live, s, 0)
        return np.concatenate([out[i, :size[i]] for i in range(segs)]) if segs else np.zeros(0, np.uint32)


def lanes_for(n: int) -> int:
    """Fewer lanes for short blocks, so that their states stay a small part."""
    lanes = LANES
    while lanes > 1 and lanes * 64 > n:
        lanes //= 2
    return lanes


def raw_blocks(docs: DataFrame, spec: str, id_col: str, text_col: str) -> DataFrame:
    """Consecutive documents in ascending order, encoded and cut into blocks."""
    rows = (docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
                .repartitionByRange("_id").sortWithinPartitions("_id", "_text"))
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        enc = Pretokens.of(shared.value)
        local, raw, ids, lens, held = 0, [], [], [], 0

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([local], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([_narrow(np.concatenate(raw))], pa.binary()), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([lens], pa.list_(pa.int64()))], names=["part", "local", "n_ids", "ids", "doc_ids", "lens"])

        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), text_column(b, "_text")
            for lo, hi in slices(texts, 2 << 20):
                got, borders = with_end(*enc.encode(texts.slice(lo, hi - lo)))
                begin = 0                                   # first text that no block has yet
                for i in range(hi - lo):
                    if held + borders[i + 1] - borders[begin] >= BLOCK_IDS or i == hi - lo - 1:
                        raw.append(got[borders[begin]:borders[i + 1]])
                        ids += doc_ids[lo + begin:lo + i + 1]
                        lens += np.diff(borders[begin:i + 2]).tolist()
                        held += int(borders[i + 1] - borders[begin])
                        begin = i + 1
                        if held >= BLOCK_IDS:
                            yield close()
                            local, raw, ids, lens, held = local + held, [], [], [], 0
        if ids:
            yield close()

    return rows.mapInArrow(run, RAW)


def with_end(ids: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids followed by the end id."""
    n = len(borders) - 1
    out = np.full(len(ids) + n, END_ID, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(borders))] = ids
    return out, borders + np.arange(n + 1)


def _narrow(ids: np.ndarray) -> bytes:
    """A width byte, then the ids in 16 bits each where they fit."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def _widen(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype(np.uint32)


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents' ids, each with the end id, to ``path``."""
    spark = docs.sparkSession
    stage = Stage(spark, "token-codec")
    raw = stage.put(raw_blocks(docs, read_tokenizer(tokenizer), id_col, text_col), "raw")

    def tally(batches):
        n = np.zeros(0, np.int64)
        for b in batches:
            for r in b.column(0):
                c = np.bincount(_widen(r.as_py()))
                n = np.pad(n, (0, max(0, len(c) - len(n))))
                n[:len(c)] += c
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["id", "n"])

    # At most one row per id of the vocabulary, and one total per task.
    per_id = raw.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(per_id["id"].max()) + 1 if len(per_id) else 0, np.int64)
    counts[per_id["id"].to_numpy(np.int64)] = per_id["n"].to_numpy(np.int64)
    freq = normalised(counts)
    before, at = {}, 0
    for r in raw.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[r["part"]], at = at, at + r["n"]
    spark.createDataFrame([(SCALE_BITS, bytearray(freq.astype("<u4").tobytes()))], "scale_bits int, freq binary") \
         .write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast((freq, before))

    def code(batches):
        freq, before = shared.value
        coder = Coder(freq)
        for b in batches:
            for r in b.to_pylist():
                ids = _widen(r["ids"])
                lanes = lanes_for(len(ids))
                words, states, word_at = coder.encode(ids, lanes)
                seg = CHECKPOINT_STEPS * lanes
                crcs = [zlib.crc32(ids[i:i + seg].astype("<u4").tobytes()) for i in range(0, len(ids), seg)]
                yield pa.RecordBatch.from_pylist([{
                    "start": before[r["part"]] + r["local"], "n_ids": len(ids), "lanes": lanes,
                    "words": words.astype("<u4").tobytes(), "states": states.astype("<u8").tobytes(),
                    "word_at": word_at.tolist(), "crcs": crcs, "doc_ids": r["doc_ids"], "lens": r["lens"]}],
                    schema=_CODED_ARROW)

    raw.mapInArrow(code, CODED).write.option("compression", "none").parquet(f"{path}/blocks")
    stage.drop(raw)


_CODED_ARROW = pa.schema([("start", pa.int64()), ("n_ids", pa.int64()), ("lanes", pa.int32()), ("words", pa.binary()),
                          ("states", pa.binary()), ("word_at", pa.list_(pa.int64())), ("crcs", pa.list_(pa.int64())),
                          ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64()))])


def read_ids(spark: SparkSession, path: str, make, schema) -> DataFrame:
    """Decode every block, check its checksums, and map each to rows:
    ``make(doc_ids, starts, lens, ids)`` returns a RecordBatch of ``schema``."""
    row = spark.read.parquet(f"{path}/table").first()        # one row, as large as the vocabulary
    shared = spark.sparkContext.broadcast((np.frombuffer(bytes(row["freq"]), "<u4").astype(np.int64), row["scale_bits"]))

    def run(batches):
        freq, bits = shared.value
        coder = Coder(freq, bits)
        for b in batches:
            for r in b.to_pylist():
                ids = decode_block(coder, r)
                lens = np.asarray(r["lens"], np.int64)
                yield make(r["doc_ids"], r["start"] + np.concatenate([[0], np.cumsum(lens)[:-1]]), lens, ids)

    return spark.read.schema(CODED).parquet(f"{path}/blocks").mapInArrow(run, schema)


def decode_block(coder: Coder, r: dict) -> np.ndarray:
    lanes, n = r["lanes"], r["n_ids"]
    words, states = np.frombuffer(r["words"], "<u4"), np.frombuffer(r["states"], "<u8").reshape(-1, lanes)
    ids = coder.decode(words, states, np.asarray(r["word_at"], np.int64), n, lanes)
    seg = CHECKPOINT_STEPS * lanes
    for i, want in enumerate(r["crcs"]):
        if zlib.crc32(ids[i * seg:(i + 1) * seg].astype("<u4").tobytes()) != want:
            raise ValueError(f"checksum of segment {i} in the block at {r['start']} does not fit")
    return ids


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per document, from the files."""
    def digest(doc_ids, starts, lens, ids):
        raw = ids.astype("<u4").tobytes()
        begin = (np.concatenate([[0], np.cumsum(lens)]) * 4).tolist()
        crc = [zlib.crc32(raw[b:e]) for b, e in zip(begin, begin[1:])]
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()),
                                           pa.array(lens, pa.int64()), pa.array(crc, pa.int64())],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_ids(spark, path, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
