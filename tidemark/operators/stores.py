"""Stored rows that a batch of requests meets: upserts of one status only, counters with a limit, refunds, presence both ways.

Each function takes the stored table and the requests and returns the table as it is then, or what each request is told. Requests
are settled by windows over their key in the order that the caller names, so that a batch gives what one request after another would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_pending(stored: DataFrame, requests: DataFrame, keys: list[str], at: str, pending: str = "pending") -> DataFrame:
    """stored (keys, status, at, requests) after requests (keys, at): one pending row for each key, renewed or new.

    Rows of another status never meet a request: a key may have a settled row and a pending one.
    """
    asked = requests.groupBy(*keys).agg(F.max(at).alias("_at"), F.count(F.lit(1)).alias("_n"))
    settled, open_rows = stored.where(~F.col("status").eqNullSafe(pending)), stored.where(F.col("status") == pending)
    met = open_rows.join(asked, keys, "full")
    renewed = met.select(*keys, F.coalesce("status", F.lit(pending)).alias("status"), F.greatest(at, "_at").alias(at), (F.coalesce("requests", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("requests"))
    return settled.select(*keys, "status", at, F.col("requests").cast("long").alias("requests")).unionByName(renewed)


def spend(stored: DataFrame, asks: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    """asks with remaining: what the limit leaves after each ask in its order, null where it is refused. A key that is not stored has used 0."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = asks.withColumn("_place", place).join(stored.select(key, F.col("used").alias("_used")), key, "left")
    left = F.lit(limit) - F.coalesce("_used", F.lit(0)) - F.col("_place")
    return rows.withColumn("remaining", F.when(left >= 0, left).cast("long")).drop("_place", "_used")


def after_spending(stored: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """stored (key, used) with the asks of `told` that were granted."""
    granted = told.groupBy(key).agg(F.count("remaining").alias("_n"))
    met = stored.select(key, "used").join(granted, key, "full")
    return met.select(key, (F.coalesce("used", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("used"))


def refund(stored: DataFrame, refunds: DataFrame, key: str) -> DataFrame:
    """stored (key, used) with one less for each refund, never below 0; refunds of keys that are not stored do nothing."""
    back = refunds.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return stored.select(key, "used").join(back, key, "left").select(key, F.greatest(F.col("used") - F.coalesce("_n", F.lit(0)), F.lit(0)).cast("long").alias("used"))


def presence(touched: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, there, n): each touched key, whether and how often it is there; and, the other way, keys that are there though never touched (touched false)."""
    asked = touched.select(*keys).distinct().withColumn("touched", F.lit(True))
    counts = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = asked.join(counts, keys, "full")
    return both.select(*keys, F.coalesce("touched", F.lit(False)).alias("touched"), F.col("n").isNotNull().alias("there"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
