"""The registered queries of the training-data operators (whole tables,
production parameters) and their SQL where SQL can express them."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (cover_tree, fm_index, language_mix, line_dedup, mixing, near_dedup, nra_search, packing, quality_model,
               quality_rules, token_codec, token_counts, whitening)
from .common import Stage, at_least_slots, documents

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def bpe_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


# Separators are one character class in every query; DuckDB strings carry
# them by escape.
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_RULES_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM w),
win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM s WHERE len(w) >= 8))),
rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM win, (SELECT unnest(range(0, 8)) AS j) WHERE c > 1 GROUP BY doc_id),
f AS (
  SELECT s.doc_id, t, n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM s LEFT JOIN rep ON s.doc_id = rep.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
            OR NOT (word_chars BETWEEN 2 * n_words AND 15 * n_words)
            OR 2 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > word_chars
            OR 2 * (length(t) - length(replace(t, '!', ''))) > n_words
            OR (n_dup_lines >= 5 AND 10 * n_dup_lines > 3 * (length(t) - length(replace(t, chr(10), '')) + 1))) AS kept
FROM f
"""


@query("op3_quality_rules", _RULES_SQL)
def op3(spark, sf_dir):
    df = quality_rules.cascade(documents(spark, sf_dir), statistics=True)
    return df.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     "base_failed", F.col("first_failed").isNull().alias("kept"))


_LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
d AS (SELECT k.*, (hot.key IS NOT NULL) AS dropped FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


@query("op10_line_dedup", _LINES_SQL)
def op10(spark, sf_dir):
    df = line_dedup.dedup_lines(documents(spark, sf_dir))
    return df.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                     F.sha2("_kept_text", 256).alias("kept_sha256"))


_NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
  WHERE 100 * c >= 75 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, (d.doc_id = c.component_id) AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""


@query("op9_minhash_near_dedup", _NEAR_SQL)
def op9(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir))


@query("op1_token_ids_rans")
def op1(spark, sf_dir):
    path = Stage(spark, "token-files").path("ids")
    token_codec.write_ids(documents(spark, sf_dir), path, bpe_path())
    return token_codec.document_digests(spark, path)


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), bpe_path())


_TOPK_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op5_cover_tree_topk", _TOPK_SQL)
def op5(spark, sf_dir):
    return cover_tree.exact_topk(at_least_slots(read_table(spark, sf_dir, "embeddings")))


@query("op6_token_counts")
def op6(spark, sf_dir):
    return token_counts.token_counts(documents(spark, sf_dir), bpe_path())


@query("op2_quality_model")
def op2(spark, sf_dir):
    return quality_model.classify(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


@query("op8_language_mix")
def op8(spark, sf_dir):
    return language_mix.detect(documents(spark, sf_dir))


def mixing_levels():
    return [mixing.domain_of(F.col("source")), F.col("lang"), F.col("source")]


@query("op7_hierarchical_mixing")
def op7(spark, sf_dir):
    df = mixing.mix(documents(spark, sf_dir), mixing_levels(), mixing.word_tokens(F.col("text")))
    return df.select("_row.doc_id", F.col("path")[0].alias("domain"), F.col("path")[1].alias("lang"),
                     F.col("path")[2].alias("source"), "n_tokens", "epoch")


def _terms_sql(table: str, key: str) -> str:
    """(key, w): the terms of every text, as a list."""
    return (f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
            r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w " f"FROM {table}")


_NRA_SQL = f"""
WITH d AS ({_terms_sql("documents", "doc_id")}),
i AS ({_terms_sql("benchmark", "item_id")}),
total AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d),
asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(w) AS t FROM i) GROUP BY 1, 2),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY 1, 2, 3),
weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total WHERE t IN (SELECT t FROM asked) GROUP BY t, big_n),
scored AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l)))) AS score
  FROM asked JOIN weight USING (t) JOIN tf USING (t), total GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 10
"""


@query("op11_nra_search", _NRA_SQL)
def op11(spark, sf_dir):
    return nra_search.ranked_search(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    return whitening.whiten(at_least_slots(read_table(spark, sf_dir, "embeddings")))


_FM_SQL = f"""
WITH d AS ({_terms_sql("documents", "doc_id")}),
i AS ({_terms_sql("benchmark", "item_id")}),
win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS p
        FROM (SELECT item_id, w, least(10, len(w)) AS m FROM i WHERE len(w) > 0 AND item_id IS NOT NULL))),
spot AS (
  SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p
        FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT DISTINCT doc_id, p, m, item_id FROM spot JOIN win USING (m, g)),
words AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM hit) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN named ON d.doc_id = named.doc_id
"""


@query("op13_fm_index_decontamination", _FM_SQL)
def op13(spark, sf_dir):
    df = fm_index.contamination(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                     F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
