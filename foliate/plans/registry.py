"""The queries of the document operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, **tables: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of tables as query ``name``; ``tables`` maps its parameters to table names."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(**{p: spark.read.parquet(f"{sf_dir}/{t}.parquet") for p, t in tables.items()})

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def load() -> None:
    from foliate.plans import acceptance, analysis, chunking, embeddings, identities, matching, retrieval, rosters, tree, volumes  # noqa: F401


load()
