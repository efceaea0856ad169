"""Registry of the named queries exposed to the driver and the benchmark.

A query is a Spark job over the given tables (``build(spark, sf_dir)``)
plus, when one exists, the DuckDB SQL that computes the same rows from the
same parquet files (the correctness oracle).
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: Callable[[], str] | None
    doc: str = ""


QUERIES: dict[str, Query] = {}


def register(name: str, oracle: Callable[[], str] | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, oracle, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every query module (registration happens on import)."""
    from . import (event_queries, guard_queries, output_queries, retrieval_queries,  # noqa: F401
                   screen_queries, scrub_queries, text_queries)
    from . import chunk_queries, file_queries, io_queries, stream_queries  # noqa: F401  (reuse batch oracles)
    return QUERIES
