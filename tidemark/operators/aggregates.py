"""Aggregate expressions, all with partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shared_folder, staged


def noisy_or(p: Column, most: float = 0.999) -> Column:
    """The probability that at least one piece of evidence holds; p is cut so that the logarithm is finite."""
    return 1 - F.exp(F.sum(F.ln(1 - F.least(p, F.lit(most)))))


def beta_mean(likes: Column, dislikes: Column) -> Column:
    """Mean of a Beta posterior with a uniform prior."""
    return (1 + likes) / (2 + likes + dislikes)


def latest(value: str, *order: str) -> Column:
    """The value of the last row by an order that ends in a unique column."""
    return F.max_by(value, F.struct(*order))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def sum_where(condition: Column, value: Column) -> Column:
    """A filtered sum, 0 without rows."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


def top_labels(df: DataFrame, key: str, weight: str, name: str, k: int) -> DataFrame:
    """(key, names): each key's names by weight descending, then name; only the first k of a group are ever gathered."""
    order = Window.partitionBy(key).orderBy(F.desc(weight), name)
    first = df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
    names = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(name).alias("name")))), lambda x: x["name"])
    return first.groupBy(key).agg(names.alias("names"))


def set_of(value: Column) -> Column:
    """Sorted distinct values without nulls; empty rather than null."""
    return F.sort_array(F.collect_set(value))


def geometric_mean(p: Column) -> Column:
    return F.exp(F.avg(F.ln(p)))


def revision(strength: str, confidence: str, k: float) -> tuple[Column, Column]:
    """Strength and confidence of merged evidence: counts n = k c / (1 - c) weigh the strengths."""
    n = k * F.col(confidence) / (1 - F.col(confidence))
    return F.sum(n * F.col(strength)) / F.sum(n), F.sum(n) / (F.sum(n) + k)


def inverse_document_frequency(tokens: DataFrame, doc_col: str, token_col: str, docs: DataFrame) -> DataFrame:
    """(token, df, idf): ln((n + 1) / (df + 1)) + 1 over documents that hold the token; n, the rows of docs, is counted in the same job."""
    counts = tokens.select(doc_col, token_col).distinct().groupBy(token_col).agg(F.count(F.lit(1)).alias("df"))
    rows = counts.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("_n"))))  # one row
    return rows.select(token_col, "df", (F.ln((F.col("_n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))


def unique_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key that has exactly one distinct value; ambiguous keys give no row."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_most")).where(F.col(value) == F.col("_most")).drop("_most")


def clusters(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, cluster): the smallest id reachable over undirected edges.

    Minimum labels spread to neighbours and jump to their label's label, so that the rounds grow with
    the logarithm of a chain's length. Each round is checkpointed, which cuts its lineage.
    """
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    ends = edges.select(F.col(a).alias("id"), F.col(b).alias("other")).union(edges.select(b, a)).distinct().checkpoint()
    labels = ends.groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("cluster")).checkpoint()
    for _ in range(most_rounds):
        offered = ends.join(labels.select(F.col("id").alias("other"), "cluster"), "other").select("id", "cluster")
        better = offered.union(labels).groupBy("id").agg(F.min("cluster").alias("cluster")).checkpoint()
        roots = better.select(F.col("id").alias("cluster"), F.col("cluster").alias("root"))
        following = better.join(roots, "cluster").select("id", F.least("cluster", "root").alias("cluster")).checkpoint()
        if following.join(labels.withColumnRenamed("cluster", "before"), "id").where("cluster <> before").isEmpty():
            return following
        labels = following
    raise RuntimeError(f"no convergence in {most_rounds} rounds")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with running numbers from 1 in the order of a unique column: a range sort, then each partition's offset.

    The numbers of rows by partition are all that reaches the driver.
    """
    rows = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    rows = rows.withColumn("_row", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33))
    rows = staged(rows, "numbered")
    totals = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, so_far = [], 0
    for part, n in totals:
        offsets.append((part, so_far))
        so_far += n
    places = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return rows.join(F.broadcast(places), "_part").withColumn(name, F.col("_offset") + F.col("_row") + 1).drop("_part", "_row", "_offset")  # a row for each partition
