"""The stored chunk table: dense ids, deletes in place, metadata."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from guardspark.operators import scrub as SC
from guardspark.sources import chunk_table as CT
from guardspark.sources import corpus as C


def _tmp():
    return tempfile.mkdtemp(prefix="guardspark-test-", dir="/tmp")


def _chunks(spark, rows):
    return spark.createDataFrame([(s, d, i, f"{s}-{d}-{i}", [1, 2]) for s, d, i in rows],
                                 "source_file string, doc_id long, chunk_index long, content string, vector array<int>")


def _key(r):
    return (r["source_file"] is not None, r["source_file"] or "", r["doc_id"], r["chunk_index"])


def test_ids_are_dense_over_appends_and_a_hot_source(spark):
    path = _tmp() + "/t"
    first = [("hot", 1, i) for i in range(3000)] + [(f"f{i % 40}", i, 0) for i in range(500)] + [(None, 7, i) for i in range(50)]
    CT.append_numbered(_chunks(spark, first).repartition(7), path)
    again = [("hot", 1, i) for i in range(3000)] + [("g", 1, 0)] * 2       # ingested again; a repeated row
    CT.append_numbered(_chunks(spark, again).repartition(3), path)
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["id"])
    assert [r["id"] for r in rows] == list(range(len(first) + len(again)))
    for part in (rows[:len(first)], rows[len(first):]):
        assert [_key(r) for r in part] == sorted(_key(r) for r in part)
    assert all(r["content"] == f"{r['source_file']}-{r['doc_id']}-{r['chunk_index']}" for r in rows)


def test_a_chunk_without_a_vector_fails_and_an_empty_append_adds_nothing(spark):
    path = _tmp() + "/t"
    bad = _chunks(spark, [("a", 1, 0)]).withColumn("vector", F.lit(None).cast("array<int>"))
    with pytest.raises(Exception, match="chunk without a vector"):
        CT.append_numbered(bad, path)
    CT.append_numbered(_chunks(spark, [("a", 1, 0)]), path)
    CT.append_numbered(_chunks(spark, []), path)
    assert CT.next_id(spark, path) == 1 and CT.next_id(spark, path + "-none") == 0


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_deletes_rewrite_only_the_buckets_that_lose_rows(spark):
    path = _tmp() + "/t"
    rows = [(f"s{i % 30}", i, 0) for i in range(600)] + [(None, 1, i) for i in range(20)]
    CT.append_numbered(_chunks(spark, rows), path)
    before = _files(path)
    lost = spark.read.parquet(path).where("source_file in ('s3', 's4')").select("source_bucket").distinct()
    touched = {r[0] for r in lost.collect()}
    gone = spark.createDataFrame([("s3",), ("s4",), ("s4",), ("other",), (None,)], "name string")
    assert CT.delete_sources(spark, path, gone, col="name") == 40
    left = spark.read.parquet(path)
    assert left.count() == 580 and left.where("source_file is null").count() == 20
    assert left.where("source_file in ('s3', 's4')").count() == 0
    same = {f for f in before if int(f.split("source_bucket=")[1].split("/")[0]) not in touched}
    assert same and {f: t for f, t in _files(path).items() if f in same} == {f: before[f] for f in same}
    assert CT.delete_sources(spark, path, gone, col="name") == 0


def test_a_bucket_that_loses_all_its_rows_goes(spark):
    path = _tmp() + "/t"
    CT.append_numbered(_chunks(spark, [("only", 1, 0), ("x", 2, 0)]), path, buckets=5000)
    assert CT.delete_sources(spark, path, spark.createDataFrame([("only",)], "source_file string"), buckets=5000) == 1
    assert [r["source_file"] for r in spark.read.parquet(path).collect()] == ["x"]


def test_delete_to_a_new_path_keeps_rows_without_a_source(spark):
    d = _tmp()
    C.save_chunks(_chunks(spark, [("a", 1, 0), ("b", 2, 0), (None, 3, 0)]), f"{d}/t")
    assert C.delete_by_source(spark, f"{d}/t", "a", f"{d}/left") == 1
    assert {r["source_file"] for r in spark.read.parquet(f"{d}/left").collect()} == {"b", None}


def test_metadata_travels_and_moves_trust(spark):
    docs = spark.createDataFrame(
        [(1, "a", "plain words only " * 8, "yes", "2025-01-01", None), (2, "a", "plain words only " * 8, "no", "2024-01-01", None),
         (3, "a", "plain words only " * 8, None, "junk", "1"), (4, "a", "plain words only " * 8, " TRUE ", "2025-02-01", None)],
        "doc_id long, source_file string, text string, verified_source string, modified string, fresh_content string")
    ch = C.ingest_corpus(docs, metadata_cols=["verified_source", "modified", "fresh_content"])
    t = CT.provenance(ch, "2025-01-31", 60).withColumn("t", SC.trust_score("content", None, "verified", "fresh"))
    got = {r["doc_id"]: r for r in t.collect()}
    assert got[3]["metadata"] == {"modified": "junk", "fresh_content": "1"}
    assert {i: (r["verified"], r["fresh"]) for i, r in got.items()} == {1: (True, True), 2: (False, False), 3: (False, True), 4: (True, False)}
    base = got[2]["t"]
    assert [round(got[i]["t"] - base, 9) for i in (1, 3, 4)] == [0.15, 0.05, 0.1]


def test_guarded_answers_count_provenance_and_own_top_k(spark):
    from guardspark.plans import guarded as G
    docs = spark.createDataFrame([(i, f"f{i}", f"Document {i} about rivers and stones. " * 3, "yes" if i % 2 else None) for i in range(8)],
                                 "doc_id long, source_file string, text string, verified_source string")
    plain, told = C.ingest_corpus(docs).cache(), C.ingest_corpus(docs, metadata_cols=["verified_source"]).cache()
    prompts = spark.createDataFrame([(1, "Document about rivers and stones", None, 6), (2, "rivers and stones", None, None), (3, "stones", None, 0)],
                                    "prompt_id long, query string, system_prompt string, top_k int")
    answers = spark.createDataFrame([(1, "Rivers.")], "prompt_id long, raw_answer string")
    a = {r["prompt_id"]: r for r in G.guarded_batch(prompts, plain, answers, k_col="top_k").collect()}
    b = {r["prompt_id"]: r for r in G.guarded_batch(prompts, told, answers, k_col="top_k").collect()}
    assert [a[i]["n_sources"] for i in (1, 2, 3)] == [6, 5, 0]
    verified = sum(s["file"] in ("f1", "f3", "f5", "f7") for s in b[1]["sources"])
    assert b[1]["avg_trust"] - a[1]["avg_trust"] == pytest.approx(0.1 * verified / 6)
    u = {r["prompt_id"]: r["n_sources"] for r in G.unguarded_batch(prompts, plain, answers, k_col="top_k").collect()}
    assert u == {1: 6, 2: 5, 3: 0}


def test_an_append_works_its_rows_out_once(spark, tmp_path):
    from pyspark.sql import functions as F
    seen = spark.sparkContext.accumulator(0)

    def vectors(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(500).select("id", F.lit("f").alias("source_file"), F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("chunk_index"),
                                   F.lit("t").alias("content"), F.array(F.lit(1)).alias("vector"))
    CT.append_numbered(rows.mapInArrow(vectors, rows.schema), str(tmp_path / "t"))
    assert seen.value == 500
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(500))
