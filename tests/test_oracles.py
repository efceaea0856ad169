"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""
import pytest

from guardspark.plans.registry import load_all
from tools.oracle_check import compare, duck

from .conftest import SF_SMALL

QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.oracle is not None))
def test_query_matches_oracle(spark, con, name):
    ok, msg, _, _ = compare(spark, con, QUERIES[name], SF_SMALL)
    assert ok, msg


def test_every_query_has_an_oracle():
    assert all(q.oracle is not None for q in QUERIES.values())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["source", "category", "n_rows", "n_matches"]
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["stream_timeline", "activity_timeline", "recent_high_threat"])
def test_time_panels_in_half_hour_zone(spark, con, name):
    """Hour labels are wall-clock hours in any session zone (epoch-aligned
    stream windows are split by local hour and summed back)."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        ok, msg, _, _ = compare(spark, con, QUERIES[name], SF_SMALL)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ok, msg
