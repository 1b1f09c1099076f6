"""Personal preferences over a topic tree and the ranked feed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates, hierarchy


def effective_labels(labels: DataFrame, suggestions: DataFrame, viewer: int) -> DataFrame:
    """(link_id, topic, p): shared labels that the viewer has not labelled, and the viewer's own."""
    own = suggestions.where(F.col("suggested_by") == viewer).select("link_id", "topic", "p")
    return labels.select("link_id", "topic", "p").join(own.select("link_id", "topic"), ["link_id", "topic"], "left_anti").unionByName(own)


def preferences(votes: DataFrame, labels: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Per voter and topic prefix: likes, dislikes, alpha, beta and distinct vote counts.

    A vote reaches the shared labels of its link that its voter has not labelled, and the voter's own.
    """
    own = suggestions.select("link_id", "topic", "p", F.col("suggested_by").alias("voter"))
    shared = votes.join(labels, "link_id").join(own.select("voter", "link_id", "topic"), ["voter", "link_id", "topic"], "left_anti")
    mine = votes.join(own, ["voter", "link_id"])
    columns = ["voter", "link_id", "value", "topic", "p"]
    rows = hierarchy.with_ancestors(shared.select(*columns).unionByName(mine.select(*columns)), "topic", "topic_id")
    # A voter has one vote on a link: once its labels under a topic are summed, plain counts are distinct ones.
    links = rows.groupBy("voter", "topic_id", "link_id", "value").agg(F.sum("p").alias("p"))
    liked, disliked = F.col("value") == 1, F.col("value") == -1
    out = links.groupBy("voter", "topic_id").agg(
        aggregates.sum_where(liked, F.col("p")).alias("likes"),
        aggregates.sum_where(disliked, F.col("p")).alias("dislikes"),
        F.count(F.lit(1)).alias("n_votes"),
        F.count_if(liked).alias("n_up"),
        F.count_if(disliked).alias("n_down"),
    )
    return out.withColumn("alpha", 1 + F.col("likes")).withColumn("beta", 1 + F.col("dislikes"))


def viewer_scores(prefs: DataFrame, overrides: DataFrame, viewer: int) -> DataFrame:
    """(topic_id, score): the viewer's overrides, and preferences of topics without one."""
    chosen = overrides.where(F.col("user_id") == viewer).select("topic_id", "score")
    derived = prefs.where(F.col("voter") == viewer).select("topic_id", (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("score"))
    return chosen.unionByName(derived.join(chosen, "topic_id", "left_anti"))


def vote_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("link_id").agg(F.count_if(F.col("value") == 1).alias("ups"), F.count_if(F.col("value") == -1).alias("downs"))


def decay(created: Column, as_of: datetime, half_life_days: float, most: float = 1000.0) -> Column:
    """Halves with every half life of age."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000.0
    return F.pow(F.lit(0.5), F.least(age / half_life_days, F.lit(most)))


def ranked_feed(
    links: DataFrame, labels: DataFrame, suggestions: DataFrame, votes: DataFrame, overrides: DataFrame, viewer: int, as_of: datetime, half_life_days: float = 1.0
) -> DataFrame:
    """(link_id, created_at, rank) of links up to as_of: taste x smoothed vote share x time decay; unordered."""
    own_votes = votes.where(F.col("voter") == viewer)  # preferences of others are not needed
    own = suggestions.where(F.col("suggested_by") == viewer)
    scores = viewer_scores(preferences(own_votes, labels, own), overrides, viewer)
    effective = effective_labels(labels, suggestions, viewer)
    # One score for each distinct topic, then one sum for each link.
    topics = hierarchy.nearest_ancestor(effective.select("topic").distinct(), [], "topic", scores, "topic_id", "score", 0.5)
    taste = effective.join(topics, "topic").groupBy("link_id").agg(aggregates.weighted_mean(F.col("score"), F.col("p")).alias("taste"))
    rows = links.where(F.col("created_at") <= F.lit(as_of)).join(taste, "link_id", "left").join(vote_counts(votes), "link_id", "left")
    ups, downs = F.coalesce("ups", F.lit(0)), F.coalesce("downs", F.lit(0))
    rank = F.coalesce("taste", F.lit(0.5)) * (1 + ups) / (2 + ups + downs) * decay(F.col("created_at"), as_of, half_life_days)
    return rows.select("link_id", "created_at", rank.alias("rank"))


def page(df: DataFrame, order: list, offset: int, size: int, most: int = 100) -> DataFrame:
    """A page of an order that ends in a unique column; offset and size are clamped."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(max(1, min(size, most)))
