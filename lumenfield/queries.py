"""Registry of the analytics queries: name -> (spark, sf_dir) -> DataFrame, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.adapter import GENES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def per_gene(sql: str) -> str:
    """The rows of sql, which is of the gene @GENE@, for every gene, with the gene as a column."""
    return " UNION ALL ".join(f"SELECT '{g}' AS gene, q.* FROM ({sql.replace('@GENE@', g)}) q" for g in GENES)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle SQL if there is one; SQL of one gene is run for each."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = per_gene(sql) if "@GENE@" in sql else sql
        return f

    return add


from .plans import cohort_queries, decision_queries, footprint_queries, full_queries, rebuild_queries, scenario_queries, spatial_queries  # noqa: E402, F401
