"""Queries over files: scanning with rejects, decoding, charset detection, and
logs of other services. Each writes its files from the given tables first."""
from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.slices import runs
from ..sources import charset as CS
from ..sources import corpus as C
from ..sources import events as E
from ..sources.tables import read_table
from ..streaming.streams import work_dir
from .registry import register

_MAX_BYTES = 4_000


@register("scan_text_corpus", lambda: (
    "SELECT doc_id, n AS n_bytes, CASE WHEN doc_id % 10 = 3 THEN 'unsupported type \".json\"' WHEN n > 4000 THEN "
    "'larger than 4000 bytes' ELSE '' END AS reason, CASE WHEN doc_id % 10 <> 3 AND n <= 4000 THEN sha256(t) ELSE '' END AS text_sha256 "
    "FROM (SELECT doc_id, t, CASE WHEN doc_id % 10 = 3 THEN CAST(11 + length(CAST(doc_id AS VARCHAR)) AS BIGINT) ELSE CAST(strlen(t) AS BIGINT) END AS n "
    "FROM (SELECT doc_id, text || chr(10) AS t FROM documents))"))
def scan_text_corpus_q(spark, sf):
    """One file per document, some of a type that is not taken; accepted files
    with their decoded text and rejected ones with the reason, from one
    listing."""
    d = work_dir(spark, "scan")
    docs = read_table(spark, sf, "documents").where("doc_id is not null").select("doc_id", "text")
    # One line per row; rows of one id share a file.
    about = F.concat(F.lit('{"about":'), F.col("doc_id"), F.lit("}"))
    line = F.concat(F.when(F.col("_other"), about).otherwise(F.coalesce("text", F.lit(""))), F.lit("\n"))
    name = F.concat(F.lit("doc_id="), F.col("doc_id"), F.when(F.col("_other"), F.lit(".json")).otherwise(F.lit(".txt")))
    files = (docs.withColumn("_other", F.pmod("doc_id", F.lit(10)) == 3).select(name.alias("name"), line.alias("line"))
                 .groupBy("name").agg(F.array_join(F.collect_list("line"), "").cast("binary").alias("content")))
    C.write_files(files, d)
    accepted, rejected = C.scan_with_rejects(spark, d, max_bytes=_MAX_BYTES)
    doc = F.regexp_extract("path", "doc_id=(-?[0-9]+)", 1).cast("bigint").alias("doc_id")
    taken = C.decode_text(accepted).select(doc, F.col("length").alias("n_bytes"), F.lit("").alias("reason"), F.sha2("text", 256).alias("text_sha256"))
    left = rejected.select(doc, F.col("length").alias("n_bytes"), "reason", F.lit("").alias("text_sha256"))
    return taken.unionByName(left)


# --- bytes made from documents ---------------------------------------------------

def _encoded():
    def encode(batches):
        """Stand-in file contents: the text in a charset, or damaged UTF-8."""
        def one(t, h):
            if t is None:
                return None
            if h == "malformed" or h == "broken" and not t.isascii():
                return t.encode("utf-8") + b"\xff\xc3"
            return t.encode("utf-8" if h in (None, "broken") else h)
        for text, how in batches:
            for lo, hi in runs(text):
                n = hi - lo
                yield pa.array([one(t, h) for t, h in zip(text.slice(lo, n).to_pylist(), how.slice(lo, n).to_pylist())], pa.binary())
    encode.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "binary")("text", "how")


def _bytes(spark, sf, names):
    d = read_table(spark, sf, "documents", spread=True).select("doc_id", "text")
    how = F.element_at(F.array(*(F.lit(n) for n in names)), F.pmod("doc_id", F.lit(len(names))).cast("int") + 1)
    return d.withColumn("how", how).withColumn("content", _encoded())


_SURE = ["utf-8", "utf-8-sig", "utf-16", "malformed"]


@register("decode_text", lambda: (
    "SELECT doc_id, sha256(text || CASE WHEN doc_id % 4 = 3 THEN chr(65533) || chr(65533) ELSE '' END) AS text_sha256 FROM documents"))
def decode_text_q(spark, sf):
    """Documents as UTF-8, UTF-8 with a mark, UTF-16 with a mark, and UTF-8
    with malformed bytes at the end (U+FFFD each), decoded again."""
    return C.decode_text(_bytes(spark, sf, _SURE)).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


_GUESSED = ["utf-8", "cp1252", "cp850", "mac_roman", "utf-16-le", "utf-16-be", "broken"]
_RATE = 0.98


@register("detect_charset", lambda: (
    "SELECT how, CAST(count(*) AS BIGINT) AS n_docs, true AS found FROM (SELECT CASE WHEN strlen(text) = length(text) AND "
    "doc_id % 7 IN (1, 2, 3, 6) THEN 'utf-8' ELSE ['utf-8', 'cp1252', 'cp850', 'mac_roman', 'utf-16-le', 'utf-16-be', 'utf-8 damaged'][doc_id % 7 + 1] "
    "END AS how FROM documents WHERE doc_id % 4 <> 0) GROUP BY how"))
def detect_charset_q(spark, sf):
    """Charsets of documents in six encodings without any mark, and of UTF-8
    with damage in texts beyond ASCII, by a model of the documents whose id is divisible by four: per
    charset the number of other documents, and whether at least 98 % of them
    were recognised and decoded to the letter."""
    model = CS.fit(read_table(spark, sf, "documents", spread=True).where("doc_id % 4 = 0"))
    d = CS.decode_detected(_bytes(spark, sf, _GUESSED).where("doc_id % 4 <> 0").withColumnRenamed("text", "was"), model)
    plain = F.octet_length("was") == F.char_length("was")
    expected = F.when(plain & F.col("how").isin("cp1252", "cp850", "mac_roman", "broken"), "utf-8").otherwise(F.col("how"))
    damaged = expected == "broken"
    right = F.when(damaged, (F.col("charset") == "utf-8") & (F.col("text") == F.concat("was", F.lit("��")))) \
        .otherwise((F.col("charset") == expected) & (F.col("text") == F.col("was")))
    return (d.groupBy(F.when(damaged, "utf-8 damaged").otherwise(expected).alias("how"))
             .agg(F.count(F.lit(1)).alias("n_docs"), (F.count_if(right) >= F.lit(_RATE) * F.count(F.lit(1))).alias("found")))


@register("load_foreign_events", lambda: (
    "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'node-' || CAST(event_id % 9 AS VARCHAR) END AS host, CASE WHEN event_id % 4 = 1 THEN "
    "CAST(event_id % 5 AS BIGINT) END AS retries, CASE WHEN event_id % 4 = 2 THEN 'b' END AS second_tag, event_id % 4 <> 3 AS has_details FROM events"))
def load_foreign_events_q(spark, sf):
    """A log with detail fields that no schema knows (nested, numbers, lists,
    none), loaded, appended to the log table and read back."""
    d = work_dir(spark, "foreign")
    i = F.col("event_id")
    details = (F.when(i % 4 == 0, F.concat(F.lit('{"origin": {"host": "node-'), i % 9, F.lit('"}}')))
                .when(i % 4 == 1, F.concat(F.lit('{"retries": '), i % 5, F.lit("}")))
                .when(i % 4 == 2, F.lit('{"tags": ["a", "b"]}')).otherwise(F.lit("null")))
    line = F.concat(F.lit('{"timestamp": "2024-03-01T00:00:00", "event_type": "X", "session_id": "'), i, F.lit('", "details": '), details, F.lit("}"))
    read_table(spark, sf, "events").select(line.alias("value")).write.text(f"{d}/json")
    E.append_foreign_events(E.load_foreign_events(spark, f"{d}/json").drop("_corrupt_record"), f"{d}/log")
    t = E.load_foreign_log(spark, f"{d}/log")

    def field(path, kind):
        return F.try_variant_get("details", path, kind)

    return t.select(F.col("session_id").cast("bigint").alias("event_id"), field("$.origin.host", "string").alias("host"),
                    field("$.retries", "bigint").alias("retries"), field("$.tags[1]", "string").alias("second_tag"),
                    F.col("details").isNotNull().alias("has_details"))
