"""Queries over text preparation: cleaning and chunking."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import chunking as CH
from ..sources.tables import read_table
from . import sqlgen as S
from .registry import register

_CLEAN_SRC = f"SELECT doc_id, source AS source_file, {S.clean_text('text')} AS t FROM documents"


def clean_docs(spark, sf):
    d = read_table(spark, sf, "documents", spread=True)
    return d.select("doc_id", F.col("source").alias("source_file"), TX.clean_text("text").alias("text"))


@register("clean_text", lambda: f"SELECT doc_id, t AS cleaned, CAST(length(t) AS BIGINT) AS n_chars FROM ({_CLEAN_SRC})")
def clean_text_q(spark, sf):
    """Whitespace-normalised documents."""
    return clean_docs(spark, sf).select("doc_id", F.col("text").alias("cleaned"),
                                        F.length("text").cast("bigint").alias("n_chars"))


@register("reject_empty_docs", lambda: f"SELECT doc_id, source_file FROM ({_CLEAN_SRC}) WHERE {S.py_strip('t')} = ''")
def reject_empty_docs_q(spark, sf):
    """Documents whose cleaned text is blank (they yield no chunks)."""
    return clean_docs(spark, sf).where(TX.is_blank("text")).select("doc_id", "source_file")


@register("chunk_documents", lambda: S.with_ctes(S.chunk_ctes(_CLEAN_SRC),
          "SELECT doc_id, source_file, chunk_index, start_index, end_index, content FROM chunks"))
def chunk_documents_q(spark, sf):
    """500/50 overlapping chunks of every cleaned document."""
    return CH.chunk_documents(clean_docs(spark, sf), "text", ["doc_id", "source_file"])


def _ctx_sql() -> str:
    prev = ("CASE WHEN chunk_index > 0 THEN '[Previous: ...' || right(lag(content) OVER w, 100) || ']' END")
    nxt = ("CASE WHEN lead(content) OVER w IS NOT NULL THEN '[Next: ' || left(lead(content) OVER w, 100) || '...]' END")
    return S.with_ctes(S.chunk_ctes(_CLEAN_SRC),
                       f"SELECT doc_id, source_file, chunk_index, start_index, end_index, "
                       f"concat_ws(chr(10), {prev}, content, {nxt}) AS content FROM chunks "
                       f"WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)")


@register("chunk_with_context", _ctx_sql)
def chunk_with_context_q(spark, sf):
    """Chunks wrapped with previews of their neighbours."""
    return CH.chunk_with_context(clean_docs(spark, sf), "text", ["doc_id", "source_file"])


def _chunk_stats_sql() -> str:
    return S.with_ctes(S.chunk_ctes(_CLEAN_SRC),
                       "SELECT source_file, CAST(count(*) AS BIGINT) AS n_chunks, "
                       "CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(sum(length(content)) AS BIGINT) AS n_chars "
                       "FROM chunks GROUP BY source_file")


@register("corpus_status", _chunk_stats_sql)
def corpus_status_q(spark, sf):
    """Chunk table status per source: chunks, documents, characters."""
    from ..sources.corpus import corpus_status
    return corpus_status(CH.chunk_documents(clean_docs(spark, sf), "text", ["doc_id", "source_file"]))


def _ingest_sql() -> str:
    return S.with_ctes(S.chunk_ctes(_CLEAN_SRC) + S.tokens_bucket_ctes(
        f"(SELECT *, {S.pair_id('doc_id', 'chunk_index')} AS id FROM chunks)", "id", "content", "cv"),
        f"SELECT {S.pair_id('c.doc_id', 'c.chunk_index')} AS id, c.doc_id, c.source_file, c.chunk_index, "
        f"CAST(coalesce(n.qn, 0) AS BIGINT) AS sq_norm FROM chunks c LEFT JOIN cv_n n ON n.k = {S.pair_id('c.doc_id', 'c.chunk_index')}")


@register("ingest_corpus", _ingest_sql)
def ingest_corpus_q(spark, sf):
    """Documents cleaned, chunked, id'd and embedded into chunk-table rows."""
    from ..functions.vectors import sq_norm
    from ..sources.corpus import ingest_corpus
    d = read_table(spark, sf, "documents", spread=True).withColumnRenamed("source", "source_file")
    c = ingest_corpus(d)
    return c.select("id", "doc_id", "source_file", "chunk_index", sq_norm("vector").alias("sq_norm"))


@register("delete_by_source", lambda: S.with_ctes(S.chunk_ctes(_CLEAN_SRC),
          "SELECT source_file, CAST(count(*) AS BIGINT) AS n_chunks FROM chunks WHERE source_file <> 'src0' "
          "GROUP BY source_file"))
def delete_by_source_q(spark, sf):
    """Chunk counts per source left after deleting one source's chunks."""
    from ..sources import corpus as C
    from ..streaming.streams import work_dir
    d = work_dir(spark, "delete")
    C.save_chunks(CH.chunk_documents(clean_docs(spark, sf), "text", ["doc_id", "source_file"]), f"{d}/t")
    C.delete_by_source(spark, f"{d}/t", "src0", f"{d}/left")
    return C.corpus_status(C.load_chunks(spark, f"{d}/left")).select("source_file", "n_chunks")
