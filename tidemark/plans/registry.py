"""The registered queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.domain import Domain
from tidemark.plans.oracle_domain import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _flat(df: DataFrame) -> DataFrame:
    """Lists as text joined by |, so that both engines' results compare."""
    lists = {f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    return df.select(*(F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if c in lists else c for c in df.columns))


def query(name: str, oracle: str | None = None, lists: str = "") -> Callable:
    """Registers a function of a Domain under a name, with the DuckDB query that gives the same rows.

    lists names the oracle's list columns.
    """

    def add(function: Callable[[Domain], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: _flat(function(Domain(spark, sf_dir)))
        if oracle:
            texts = ", ".join(f"array_to_string({c}, '|') AS {c}" for c in lists.split())
            ORACLES[name] = f"SELECT * REPLACE ({texts}) FROM ({sql(oracle)})" if lists else sql(oracle)
        return function

    return add
