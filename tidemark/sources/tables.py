"""Typed scans of tables: projections with embedded rows, validation, catalog reads."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowType:
    """Columns of a row, and embedded lists: name -> (table, its key, our key, its columns)."""

    columns: Sequence[str]
    embedded: Mapping[str, tuple[str, str, str, Sequence[str]]] = field(default_factory=dict)


def select(df: DataFrame, row: RowType, table: Callable[[str], DataFrame]) -> DataFrame:
    """df's columns of a row type; each embedded list holds a table's rows with the same key, sorted."""
    out = df.select(*row.columns)
    for name, (other, theirs, ours, columns) in row.embedded.items():
        lists = table(other).groupBy(F.col(theirs).alias(ours)).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        kind = lists.schema[name].dataType.simpleString()
        out = out.join(lists, ours, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def validated(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with a JSON column parsed by a schema; a row that does not fit it is an error, not a null."""
    return df.withColumn(column, F.from_json(column, schema, {"mode": "FAILFAST"}))


def columns_like(spark: SparkSession, tables: Mapping[str, DataFrame], ending: str) -> DataFrame:
    """(table, column) of the tables' columns whose names end so; plan metadata, no rows are read."""
    rows = sorted((t, c) for t, df in tables.items() for c in df.columns if c.endswith(ending))
    return spark.createDataFrame(rows, "table string, column string")
