"""A snapshot index with a change log: diffs past a watermark answer the present state of touched keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A reader that is this far behind gets a new snapshot; the log keeps this many rows; readers ask this far below their watermark.
MOST_BEHIND, KEPT, OVERLAP = 2000, 10_000, 500


def deltas(sorted_ids: Column) -> Column:
    """v[0], then the differences of neighbours."""
    return F.transform(sorted_ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.element_at(sorted_ids, i.cast("int"))))


def undeltas(differences: Column) -> Column:
    """The inverse: running sums."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(differences, empty, lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0)))))


def snapshot(pairs: DataFrame, group: str, member: str) -> DataFrame:
    """(group, members): the sorted members of each group, delta-coded."""
    rows = pairs.groupBy(group).agg(F.sort_array(F.collect_set(F.col(member).cast("long"))).alias("members"))
    return rows.select(group, deltas(F.col("members")).alias("members"))


def changed_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of rows in which two versions differ, from either side."""
    columns = old.columns
    gone, come = old.select(*columns).exceptAll(new.select(*columns)), new.select(*columns).exceptAll(old.select(*columns))
    return gone.select(*keys).union(come.select(*keys)).distinct()


def diff(log: DataFrame, present: DataFrame, keys: list[str], watermark: int) -> DataFrame:
    """(keys, there): for each key that the log (keys, seq) touched past the watermark, less the overlap, whether it is there now."""
    touched = log.where(F.col("seq") > watermark - OVERLAP).select(*keys).distinct()
    now = present.select(*keys).distinct().withColumn("there", F.lit(True))
    return touched.join(now, keys, "left").withColumn("there", F.coalesce("there", F.lit(False)))


def apply_diff(state: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The state (keys) after a diff; applying it again changes nothing."""
    kept = state.select(*keys).join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes.where("there").select(*keys))


def must_reload(log: DataFrame, watermark: int) -> Column:
    """Over the log's rows: whether a reader at the watermark is too far behind or the log no longer reaches it."""
    behind = F.count_if(F.col("seq") > watermark) > MOST_BEHIND
    return behind | F.coalesce(F.min("seq") > watermark + 1, F.lit(False))


def retained(log: DataFrame) -> DataFrame:
    """The newest rows of a log whose seq has no gaps by more than the rows it lost."""
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_top"))
    return log.join(F.broadcast(top), F.col("seq") > F.col("_top") - KEPT).drop("_top")  # one row
