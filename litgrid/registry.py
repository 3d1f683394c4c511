"""Queries of the engine's own operators, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from litgrid.plans import more_oracles, more_queries, oracles
from litgrid.plans import queries as own


def queries() -> dict:
    return own.queries() | more_queries.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | more_oracles.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level precision, recall and F1 of perturbed records against clean ones."""
    return own.row_match_prf(spark, sf_dir)
