"""Upserts, merges of keys, undo, and account merges, as DataFrame rewrites.

Parquet has no MERGE: each operator returns the new state of a table, which the caller writes as a new
version. Undo reads the snapshot that the merge returns beside its result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New values win where they are neither null nor empty; other rows stay. New keys should be unique."""
    values = [c for c in old.columns if c not in keys]

    def given(c: str) -> Column:
        text = dict(new.dtypes)[c] == "string"
        return F.nullif(F.col(f"n.{c}"), F.lit("")) if text else F.col(f"n.{c}")

    joined = old.alias("o").join(new.alias("n"), keys, "full")
    return joined.select(*keys, *(F.coalesce(given(c), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in values)).select(*old.columns)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """First wins: new rows only where their key is not there yet."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_owned(old: DataFrame, new: DataFrame, owner: str, kept: Column) -> DataFrame:
    """The rows of owners that new mentions are replaced, but for the rows that `kept` marks."""
    owners = new.select(owner).distinct()
    stay = old.where(kept).unionByName(old.where(~kept).join(owners, owner, "left_anti"))
    return stay.unionByName(new)


def latest_version(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by an order that ends in a unique column."""
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return last.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in others)).select(*rows.columns)


def cascade(children: DataFrame, foreign: str, deleted: DataFrame, key: str) -> DataFrame:
    """Children without those whose parent was deleted."""
    return children.join(deleted.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti")


def remap(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The column with keys replaced by mapping (old, new); unmapped keys stay."""
    kept = df.columns
    moved = df.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    return moved.withColumn(column, F.coalesce("_new", column)).select(*kept)


def merge_keys(df: DataFrame, column: str, mapping: DataFrame, unique: list[str], prefer: list) -> tuple[DataFrame, DataFrame]:
    """df after merging keys, and the snapshot: every row that was moved or that lost a collision, as it was, with `lost`.

    Of rows that collide on `unique` (which has the column), those not moved stay first, then by prefer.
    """
    old = mapping.select(F.col("old").alias(column), F.lit(True).alias("_moved"))
    marked = df.join(old, column, "left").withColumn("_moved", F.coalesce("_moved", F.lit(False))).withColumn("_before", F.col(column))
    moved = remap(marked, column, mapping)
    rank = F.row_number().over(Window.partitionBy(*unique).orderBy("_moved", *prefer))
    ranked = moved.withColumn("_rank", rank)
    snapshot = ranked.where("_moved OR _rank > 1").withColumn(column, F.col("_before")).select(*df.columns, (F.col("_rank") > 1).alias("lost"))
    return ranked.where("_rank = 1").select(*df.columns), snapshot


def unmerge_keys(merged: DataFrame, snapshot: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """The table before merge_keys: rows that came from the snapshot go, the snapshot's rows come back."""
    moved = remap(snapshot.where("NOT lost"), column, mapping)
    came = moved.select(*merged.columns).distinct()
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in merged.columns]
    return merged.alias("m").join(came.alias("c"), same, "left_anti").unionByName(snapshot.drop("lost"))


def drop_self_loops(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a) != F.col(b))


@dataclass(frozen=True)
class OwnedColumn:
    """How one column that names an account is treated when accounts merge."""

    table: str
    column: str
    strategy: str  # move, drop or add
    unique: tuple[str, ...] = ()
    amount: str = ""


def merge_accounts(tables: dict[str, DataFrame], owned: list[OwnedColumn], source: int, target: int) -> dict[str, DataFrame]:
    """All tables after the source account's rows went to the target, driven by metadata.

    move: rows go over, the target's own win on conflict keys; drop: the source's rows go; add: amounts are summed.
    """
    out = dict(tables)
    for item in owned:
        df = out[item.table]
        is_source = F.col(item.column) == source
        if item.strategy == "drop":
            out[item.table] = df.where(~is_source)
            continue
        moved = df.withColumn("_was", is_source.cast("int")).withColumn(item.column, F.when(is_source, F.lit(target)).otherwise(F.col(item.column)).cast(dict(df.dtypes)[item.column]))
        if item.strategy == "add":
            keys = [c for c in df.columns if c != item.amount]
            out[item.table] = moved.groupBy(*keys).agg(F.sum(item.amount).alias(item.amount)).select(*df.columns)
        elif item.unique:
            first = F.row_number().over(Window.partitionBy(*item.unique).orderBy("_was", *item.unique))
            out[item.table] = moved.withColumn("_n", first).where("_n = 1").select(*df.columns)
        else:
            out[item.table] = moved.select(*df.columns)
    return out
