"""Registry of queries with their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from incidentry.session import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor can reach."""
    return f"{checkpoint_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"


def load_all() -> None:
    """Import every module that registers queries."""
    from incidentry.plans import (  # noqa: F401
        evaluation_queries,
        matching_queries,
        report_queries,
        text_queries,
        wrangle_queries,
    )
