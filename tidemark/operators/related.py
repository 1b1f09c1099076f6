"""Related links by shared entities and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def related(mentions: DataFrame, topics: DataFrame, link: int) -> DataFrame:
    """(link_id, score, names): 2 x the sum of p p' over shared entities and the sum over shared topics.

    mentions (link_id, entity_id, p, name) hold title mentions only; names go by contribution. The
    link's own rows are few and meet the others by an equi-join.
    """
    here = mentions.where(F.col("link_id") == link).select("entity_id", F.col("p").alias("own_p"))
    other = mentions.where(F.col("link_id") != link).join(here, "entity_id")
    gain = F.col("p") * F.col("own_p")
    by_entity = other.groupBy("link_id").agg((2 * F.sum(gain)).alias("by_entity"), F.array_sort(F.collect_list(F.struct((-gain).alias("w"), "name"))).alias("named"))
    here_topics = topics.where(F.col("link_id") == link).select("topic", F.col("p").alias("own_p"))
    by_topic = topics.where(F.col("link_id") != link).join(here_topics, "topic").groupBy("link_id").agg(F.sum(gain).alias("by_topic"))
    rows = by_entity.join(by_topic, "link_id", "full")
    names = F.coalesce(F.transform("named", lambda x: x["name"]), F.array().cast("array<string>"))
    return rows.select("link_id", (F.coalesce("by_entity", F.lit(0.0)) + F.coalesce("by_topic", F.lit(0.0))).alias("score"), names.alias("names"))
