"""Physical plan checks: pushdown, pruning, top-k limits, no Python rows."""
from guardspark.operators import audit as A
from guardspark.operators import retrieval as R
from guardspark.plans.registry import load_all

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_event_scan_prunes_columns(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    plan = _plan(ev.where("event_type = 'error'").groupBy("user_id").count())
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan


def test_timeline_is_one_aggregate(spark):
    q = load_all()["activity_timeline"].build(spark, SF_SMALL)
    plan = _plan(q)
    assert plan.count("HashAggregate") == 2 and "Python" not in plan


def test_topk_uses_group_limit(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    hits = R.cosine_topk(e, e, k=5, query_id="vec_id", query_vec="embedding", corpus_id="vec_id",
                         corpus_vec="embedding", shards=2)
    assert "WindowGroupLimit" in _plan(hits)
    assert "CartesianProduct" not in _plan(hits) and "BroadcastNestedLoopJoin" not in _plan(hits)


def test_screening_has_no_python_node(spark):
    q = load_all()["screen_prompts"].build(spark, SF_SMALL)
    plan = _plan(q)
    assert "Python" not in plan and "Arrow" not in plan
    assert "BatchEvalPython" not in plan
