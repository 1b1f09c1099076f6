"""Which source a link comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates


def link_sources(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(link_id, source): a stated source, else the author's handle, else a host that only one source has.

    links (link_id, source_id, handle, host), sources (source_id, handle, host).
    """
    by_handle = aggregates.unique_value(sources.where("handle IS NOT NULL").select(F.lower("handle").alias("_handle"), F.col("source_id").alias("_by_handle")), "_handle", "_by_handle")
    by_host = aggregates.unique_value(sources.where("host IS NOT NULL").select(F.lower("host").alias("_host"), F.col("source_id").alias("_by_host")), "_host", "_by_host")
    rows = links.withColumn("_handle", F.lower("handle")).withColumn("_host", F.lower("host")).join(by_handle, "_handle", "left").join(by_host, "_host", "left")
    return rows.select("link_id", F.coalesce("source_id", "_by_handle", "_by_host").alias("source"))
