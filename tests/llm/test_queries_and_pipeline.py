"""The registered queries against their SQL, and the pipeline's stages."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from guardspark.llm import near_dedup, packing
from guardspark.llm.common import documents
from guardspark.llm.queries import ORACLES, QUERIES, bpe_path
from guardspark.plans.registry import Query
from tools.oracle_check import compare, duck

from .conftest import SF
from .test_text_operators import py_components, py_lines, py_rules


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    ok, msg, _, _ = compare(spark, duck(SF), Query(name, QUERIES[name], lambda: ORACLES[name]), SF)
    assert ok, msg


def test_one_query_per_operator_and_the_pipeline():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and set(QUERIES) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_matches_plain_python(spark):
    docs = documents(spark, SF)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = []
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF).cache()
        seen.append((name, docs))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for _, d in seen[:-1]]
    want = {i: t for i, t in rows.items() if py_rules(t)[-1]}
    assert texts[0] == want
    ids = list(want)
    want = dict(zip(ids, (x[0] for x in py_lines([want[i] for i in ids]))))
    assert texts[1] == want
    component = py_components(list(want.items()))
    want = {i: t for i, t in want.items() if component[i] == i}
    assert texts[2] == want
    assert set(texts[3].items()) <= set(want.items()) and len(texts[3]) > 0.7 * len(want)
    places = seen[-1][1].collect()
    assert {r["doc_id"] for r in places} == set(texts[3])
    assert sum(r["length"] for r in places if r["piece"] == 0) > 0
    spark.catalog.clearCache()


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    docs = documents(spark, SF)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))


def test_pipeline_on_odd_and_empty_documents(spark, odd, none):
    for table in (odd, none):
        docs = table
        for _, step in corpus_pipeline.STAGES:
            docs = step(spark, docs, SF)
        n = docs.count()
        assert n == 0 or table is odd
