"""Trees as dotted paths: ancestors, containment, nearest scored ancestor, re-rooting.

Containment joins explode a path into its prefixes and join on equality, so that they hash-partition
by path; no nested loop is needed. A path has few labels, so the explosion has a small factor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def depth(path: Column) -> Column:
    """Number of labels."""
    return F.size(F.split(path, "[.]"))


def parent(path: Column) -> Column:
    """All labels but the last; null at a root."""
    return F.nullif(F.regexp_extract(path, r"^(.*)[.][^.]+$", 1), F.lit(""))


def label(path: Column) -> Column:
    """The last label."""
    return F.element_at(F.split(path, "[.]"), -1)


def prefixes(path: Column) -> Column:
    """Every ancestor-or-self, roots first."""
    parts = F.split(path, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def within(path: Column, ancestor: Column | str) -> Column:
    """Whether a path is at or below another."""
    ancestor = F.lit(ancestor) if isinstance(ancestor, str) else ancestor
    return (path == ancestor) | path.startswith(F.concat(ancestor, F.lit(".")))


def with_ancestors(df: DataFrame, path_col: str, ancestor_col: str = "ancestor") -> DataFrame:
    """One row for each row and ancestor-or-self of its path."""
    return df.withColumn(ancestor_col, F.explode(prefixes(F.col(path_col))))


def descendants_join(df: DataFrame, path_col: str, roots: DataFrame, root_col: str) -> DataFrame:
    """Rows of df with every root at or above their path."""
    return with_ancestors(df, path_col, "_at").join(roots, F.col("_at") == F.col(root_col)).drop("_at")


def nearest_ancestor(df: DataFrame, key_cols: list[str], path_col: str, scores: DataFrame, topic_col: str, score_col: str, default: float) -> DataFrame:
    """df with the score of the deepest scored ancestor-or-self of its path, else the default.

    key_cols with path_col identify a row of df.
    """
    exploded = with_ancestors(df.select(*key_cols, path_col).distinct(), path_col, "_at")
    found = exploded.join(scores.select(F.col(topic_col).alias("_at"), F.col(score_col).alias("_score")), "_at")
    best = found.groupBy(*key_cols, path_col).agg(F.max_by("_score", depth(F.col("_at"))).alias("_score"))
    return df.join(best, [*key_cols, path_col], "left").withColumn(score_col, F.coalesce("_score", F.lit(default))).drop("_score")


def children(paths: DataFrame, path_col: str) -> DataFrame:
    """(path, parent, n_children) of every path."""
    rows = paths.select(F.col(path_col).alias("path")).distinct().withColumn("parent", parent(F.col("path")))
    counts = rows.where("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("n_children"))
    return rows.join(counts, "path", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def reroot(path: Column, old: str, new: str) -> Column:
    """Paths at or below old moved below new, the subtree's own labels kept."""
    moved = F.concat(F.lit(new + "."), F.element_at(F.split(F.lit(old), "[.]"), -1), F.substring(path, len(old) + 1, 2147483647))
    return F.when(within(path, old), moved).otherwise(path)


def inconsistent(paths: DataFrame, path_col: str) -> DataFrame:
    """Paths that have an ancestor which is no path of the table: (path, missing)."""
    rows = paths.select(F.col(path_col).alias("path")).distinct()
    exploded = with_ancestors(rows, "path", "missing")
    return exploded.join(rows.select(F.col("path").alias("missing")), "missing", "left_anti").select("path", "missing")


def common_path(paths: Column) -> Column:
    """The longest common prefix of whole labels of an array of paths; empty if there is none."""
    split = F.transform(paths, lambda p: F.split(p, "[.]"))
    shared = F.aggregate(
        split,
        F.element_at(split, 1),
        lambda a, b: F.slice(
            a,
            F.lit(1),
            F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, same: F.struct(F.when(s["go"] & same, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["go"] & same).alias("go")), lambda s: s["n"]),
        ),
    )
    return F.array_join(shared, ".")


def rollup(df: DataFrame, path_col: str, *aggregates: Column) -> DataFrame:
    """Aggregates for every ancestor-or-self: each row counts toward each prefix of its path."""
    return with_ancestors(df, path_col, "ancestor").groupBy("ancestor").agg(*aggregates)


def first_per_group(df: DataFrame, keys: list[str], order: list, n: int = 1, rank_col: str = "rank") -> DataFrame:
    """The first n rows of each group by a total order, with their rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= n)


def judged_moves(places: DataFrame, moves: DataFrame) -> DataFrame:
    """moves (node, parent) with refusal and the node's new path, each judged by the places (node, path, is_place) as they are stored.

    Refused, in this order: a node that is not there, a parent that is no place, a parent inside the node's own subtree (or the node itself).
    """
    nodes = places.select("node", F.col("path").alias("_own"))
    parents = places.select(F.col("node").alias("parent"), F.col("path").alias("_up"), "is_place")
    met = moves.join(nodes, "node", "left").join(parents, "parent", "left")
    inside = (F.col("_up") == F.col("_own")) | F.col("_up").startswith(F.concat("_own", F.lit(".")))
    refusal = F.when(F.col("_own").isNull(), "no such node").when(~F.coalesce("is_place", F.lit(False)), "parent is not a place").when(inside, "a cycle")
    label = F.element_at(F.split("_own", r"\."), -1)
    return met.select("node", "parent", refusal.alias("refusal"), F.when(refusal.isNull(), F.concat("_up", F.lit("."), label)).alias("path"))


def after_move(places: DataFrame, node: str, path: str) -> DataFrame:
    """places after an accepted move of a node to a new path: the node's whole subtree goes with it."""
    own = places.where(F.col("node") == node).select(F.col("path").alias("_old")).limit(1)  # one row
    met = places.crossJoin(F.broadcast(own))
    below = (F.col("path") == F.col("_old")) | F.col("path").startswith(F.concat("_old", F.lit(".")))
    moved = F.concat(F.lit(path), F.substring(F.col("path"), F.length("_old") + 1, F.length("path")))
    return met.select(*[F.when(below, moved).otherwise(F.col("path")).alias("path") if c == "path" else c for c in places.columns])


#: Where each flat kind stands in the tree.
KIND_PATHS = {
    "person": "entity.agent.person",
    "company": "entity.agent.org.company",
    "nonprofit": "entity.agent.org.nonprofit",
    "public_body": "entity.agent.org.public_body",
    "cooperative": "entity.agent.org",
    "product": "entity.artifact.product",
    "work": "entity.artifact.work",
    "place": "entity.place",
    "event": "entity.event",
    "source": "entity.source",
}


def kind_to_path(kind: Column) -> Column:
    """The path of a flat kind; other kinds, and none, are just entities."""
    paths = F.create_map(*[F.lit(x) for pair in KIND_PATHS.items() for x in pair])
    return F.coalesce(F.try_element_at(paths, F.coalesce(kind, F.lit(""))), F.lit("entity"))
