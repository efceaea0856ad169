"""Queries over retrieval: exact top-k, context formatting, source lists."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import pair_id
from ..operators import chunking as CH
from ..operators import retrieval as R
from ..session import stored
from ..sources import fixtures as FX
from ..sources.corpus import ingest_corpus
from ..sources.tables import read_table, spread_rows
from . import sqlgen as S
from .fixture_sql import prompt_ctes
from .registry import register
from .text_queries import _CLEAN_SRC, clean_docs


def chunk_table(spark, sf):
    """Chunks of the cleaned corpus with ids and hashed token counts."""
    ch = CH.chunk_documents(clean_docs(spark, sf), "text", ["doc_id", "source_file"])
    return (ch.withColumn("id", pair_id("doc_id", "chunk_index"))
              .withColumn("vector", V.hashed_counts("content")))


def prompt_vectors(spark, sf, prompts=None):
    p = prompts if prompts is not None else FX.prompts(spark, sf)
    return p.withColumn("vector", V.hashed_counts("query"))


# --- embeddings table: every vector against every vector -------------------
def _knn_sql(k: int, threshold: float, extra: str = "") -> str:
    return ("WITH q AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v, "
            "list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS n FROM embeddings), "
            "pairs AS (SELECT a.id AS query_id, b.id, b.label, CASE WHEN a.n * b.n > 0 THEN "
            "list_dot_product(a.v, b.v) / sqrt(a.n * b.n) ELSE 0.0 END AS score FROM q a, q b), "
            "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank FROM pairs) "
            f"SELECT query_id, id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score{extra} FROM ranked "
            f"WHERE rank < {k} AND score >= {threshold}")


def _knn(spark, sf, k, threshold):
    e = spread_rows(read_table(spark, sf, "embeddings"))
    hits = R.cosine_topk(e, e, k=k, threshold=threshold, query_id="vec_id", query_vec="embedding",
                         corpus_id="vec_id", corpus_vec="embedding")
    return hits, e


@register("cosine_topk", lambda: _knn_sql(10, 0.3))
def cosine_topk_q(spark, sf):
    """Exact 10 nearest neighbours (cosine >= 0.3) of every embedding."""
    hits, _ = _knn(spark, sf, 10, 0.3)
    return hits.withColumn("score", F.round("score", 6))


@register("retrieve_with_scores", lambda: _knn_sql(10, 0.0, ", label"))
def retrieve_with_scores_q(spark, sf):
    """Same search with threshold 0 and the neighbour's label attached."""
    e = spread_rows(read_table(spark, sf, "embeddings"))
    hits = R.cosine_topk(e, e, k=10, threshold=0.0, query_id="vec_id", query_vec="embedding",
                         corpus_id="vec_id", corpus_vec="embedding", payload=["label"])
    return hits.select("query_id", "id", "rank", F.round("score", 6).alias("score"), "label")


@register("l2_normalize", lambda: (
    "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm_before, "
    "round(sqrt(list_dot_product(nv, nv)), 6) AS norm_after FROM (SELECT *, CASE WHEN list_dot_product("
    "CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0 THEN list_transform(CAST(embedding AS DOUBLE[]), "
    "lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) ELSE "
    "CAST(embedding AS DOUBLE[]) END AS nv FROM embeddings)"))
def l2_normalize_q(spark, sf):
    """Vector norms before and after L2 normalisation."""
    e = read_table(spark, sf, "embeddings")
    n = e.withColumn("nv", V.l2_normalize("embedding"))
    return n.select("vec_id", F.round(F.sqrt(V.dot("embedding", "embedding")), 6).alias("norm_before"),
                    F.round(F.sqrt(V.dot("nv", "nv")), 6).alias("norm_after"))


# --- prompts against the chunk corpus (hashed vectors) ---------------------
def _retrieve_ctes(k: int = 5, threshold: float = 0.3) -> list[str]:
    return (prompt_ctes() + S.chunk_ctes(_CLEAN_SRC)
            + [f"ch AS (SELECT *, {S.pair_id('doc_id', 'chunk_index')} AS id FROM chunks)"]
            + S.tokens_bucket_ctes("ch", "id", "content", "cv")
            + S.tokens_bucket_ctes("prompts", "prompt_id", "query", "pv")
            + ["dots AS (SELECT p.k AS query_id, c.k AS id, sum(p.n * c.n) AS d FROM pv_b p JOIN cv_b c ON p.b = c.b "
               "GROUP BY 1, 2)",
               "sc AS (SELECT d.query_id, d.id, CAST(d.d AS DOUBLE) / sqrt(CAST(pn.qn * cn.qn AS DOUBLE)) AS score "
               "FROM dots d JOIN pv_n pn ON pn.k = d.query_id JOIN cv_n cn ON cn.k = d.id)",
               f"hits AS (SELECT h.query_id, h.id, CAST(h.rank AS BIGINT) AS rank, h.score, ch.source_file, "
               f"ch.chunk_index, ch.content FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "
               f"id) - 1 AS rank FROM sc) h JOIN ch ON ch.id = h.id WHERE h.rank < {k} AND h.score >= {threshold})"])


def retrieve_hits(spark, sf, prompts=None, k=5, threshold=0.3):
    # The chunk table feeds the vector side and the payload side.
    chunks = stored(chunk_table(spark, sf), "chunks")
    pv = prompt_vectors(spark, sf, prompts)
    return R.cosine_topk(pv, chunks, k=k, threshold=threshold, query_id="prompt_id", query_vec="vector",
                         corpus_id="id", corpus_vec="vector",
                         payload=["source_file", "chunk_index", "content"])


@register("retrieve", lambda: S.with_ctes(_retrieve_ctes(),
          "SELECT query_id, id, rank, round(score, 6) AS score, source_file, chunk_index FROM hits"))
def retrieve_q(spark, sf):
    """Top-5 chunks (cosine >= 0.3) for every prompt, chat defaults."""
    h = retrieve_hits(spark, sf)
    return h.select("query_id", "id", "rank", F.round("score", 6).alias("score"), "source_file", "chunk_index")


def _fmt_sql(max_length: int | None) -> str:
    blk = "'[Source: ' || source_file || ', Chunk ' || CAST(chunk_index AS VARCHAR) || ']' || chr(10) || content"
    if max_length is None:
        kept = f"SELECT query_id, rank, {blk} AS blk FROM hits"
    else:
        kept = (f"SELECT query_id, rank, CASE WHEN ff IS NULL OR rank < ff THEN blk WHEN rank = ff AND "
                f"{max_length} - before > 100 THEN left(blk, CAST({max_length} - before AS BIGINT)) || '...' END AS blk "
                f"FROM (SELECT *, min(CASE WHEN before + length(blk) > {max_length} THEN rank END) OVER "
                f"(PARTITION BY query_id) AS ff FROM (SELECT *, coalesce(sum(length(blk) + 2) OVER (PARTITION BY query_id "
                f"ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM "
                f"(SELECT query_id, rank, {blk} AS blk FROM hits)))")
    return S.with_ctes(_retrieve_ctes() + [f"kept AS ({kept})"],
                       "SELECT p.prompt_id AS query_id, coalesce(c.context, 'No relevant documents found.') AS context "
                       "FROM prompts p LEFT JOIN (SELECT query_id, string_agg(blk, chr(10) || chr(10) ORDER BY rank) "
                       "AS context FROM kept WHERE blk IS NOT NULL GROUP BY 1) c ON c.query_id = p.prompt_id")


@register("format_context", lambda: _fmt_sql(None))
def format_context_q(spark, sf):
    """Context text per prompt from its hits (no length cap)."""
    p = FX.prompts(spark, sf)
    h = retrieve_hits(spark, sf, p)
    return R.format_context(h, p.select(F.col("prompt_id").alias("query_id")))


@register("format_context_capped", lambda: _fmt_sql(1200))
def format_context_capped_q(spark, sf):
    """Context per prompt capped at 1,200 characters (cut block + ...)."""
    p = FX.prompts(spark, sf)
    h = retrieve_hits(spark, sf, p)
    return R.format_context(h, p.select(F.col("prompt_id").alias("query_id")), max_length=1200)


@register("source_preview", lambda: S.with_ctes(_retrieve_ctes(),
          f"SELECT query_id, source_file AS file, chunk_index AS chunk, round(score, 6) AS score, "
          f"{S.preview('content', 200)} AS preview, CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.4 THEN 'medium' "
          f"ELSE 'low' END AS band FROM hits"))
def source_preview_q(spark, sf):
    """Sources list per prompt: file, chunk, score, preview, score band."""
    h = R.source_previews(retrieve_hits(spark, sf))
    return h.select("query_id", F.col("source_file").alias("file"), F.col("chunk_index").alias("chunk"),
                    F.round("score", 6).alias("score"), "preview", R.score_band("score").alias("band"))


def _model_sql() -> str:
    letters = ", ".join(f"length(content) - length(replace(replace(content, '{c}', ''), '{c.upper()}', ''))" for c in FX.LetterModel.LETTERS)
    return S.with_ctes(S.chunk_ctes(_CLEAN_SRC) + [
        f"n AS (SELECT doc_id, chunk_index, CAST([{letters}] AS DOUBLE[]) AS v FROM chunks)",
        "u AS (SELECT doc_id, chunk_index, sqrt(list_dot_product(v, v)) AS norm, v FROM n)"],
        "SELECT doc_id, chunk_index, " + ", ".join(f"round(CAST(CAST(CASE WHEN norm > 0 THEN v[{i + 1}] / norm ELSE 0.0 END AS FLOAT) AS DOUBLE), 4) AS {c}"
                                                   for i, c in ((4, "e"), (13, "n"), (18, "s"))) + ", "
        "CASE WHEN norm > 0 THEN 1.0 ELSE 0.0 END AS length FROM u")


@register("embed_with_model", _model_sql)
def embed_with_model_q(spark, sf):
    """Every chunk embedded by a user's model (an object with ``embed``, made
    once per Python worker), L2-normalised; some components and the length."""
    model = V.ModelEmbedder(FX.LetterModel, len(FX.LetterModel.LETTERS), model_id="letters")
    docs = read_table(spark, sf, "documents", spread=True).withColumnRenamed("source", "source_file")
    c = ingest_corpus(docs, embedder=model)
    part = {x: F.round(F.col("vector")[i].cast("double"), 4).alias(x) for i, x in ((4, "e"), (13, "n"), (18, "s"))}
    return c.select("doc_id", "chunk_index", *part.values(), F.round(F.sqrt(V.dot("vector", "vector")), 4).alias("length"))


@register("embed_text", lambda: S.with_ctes(S.chunk_ctes(_CLEAN_SRC) + [
    f"ch AS (SELECT *, {S.pair_id('doc_id', 'chunk_index')} AS id FROM chunks)"]
    + S.tokens_bucket_ctes("ch", "id", "content", "cv"),
    "SELECT ch.id, CAST(coalesce(n.qn, 0) AS BIGINT) AS sq_norm, CAST(coalesce(b.nb, 0) AS BIGINT) AS buckets_used "
    "FROM ch LEFT JOIN cv_n n ON n.k = ch.id LEFT JOIN (SELECT k, count(*) AS nb FROM cv_b GROUP BY 1) b ON b.k = ch.id"))
def embed_text_q(spark, sf):
    """Hashed embedding of every chunk: squared norm and buckets used."""
    c = chunk_table(spark, sf)
    return c.select("id", V.sq_norm("vector").alias("sq_norm"),
                    F.size(F.filter("vector", lambda x: x > 0)).cast("bigint").alias("buckets_used"))
