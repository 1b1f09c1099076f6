"""Links between terms and between entities, from given probabilities.

A judged pair is a row with a, b and the probabilities same, a_member, b_member (the one is a member of the other), a_inherits,
b_inherits (the one is a kind of the other), overlap; with a_in_b and b_in_a (how much of the one is in the other), a_individual and
b_individual (that a side is one thing and no kind), and confidence. A probability that is null counts as 0. Links are rows
(keys, link, a, b, strength, confidence).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates

#: What share each answer stands for.
SHARES = {"none": 0.0, "tiny": 0.01, "few": 0.15, "about_half": 0.5, "most": 0.85, "all": 1.0}
#: A membership worth telling; from where a side is an individual; pairs that are one; pairs of one entity that contradict it.
LEAST_MEMBER, INDIVIDUAL, SAME, CONFLICT = 0.05, 0.5, 0.7, 0.3
#: Shared properties, and evidence, that make a confidence of one half; the most confidence that one piece of evidence has.
HALF_PROPERTIES, HALF_EVIDENCE, MOST_CONFIDENCE = 10, 1.0, 0.99
SYMMETRIC = ("identical", "similarity")


def expected_share(answers: Column) -> Column:
    """The expected share of a map from answers to probabilities; other answers count nothing."""
    out = F.lit(0.0)
    for answer, share in SHARES.items():
        out = out + F.coalesce(F.try_element_at(answers, F.lit(answer)), F.lit(0.0)) * share
    return out


def settled(pairs: DataFrame) -> DataFrame:
    """The pairs after the rule of kinds: of what a side is in the other by membership or inheritance, an individual is a member and a kind inherits."""
    known = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    out = {}
    for side in "ab":
        held = known(f"{side}_member") + known(f"{side}_inherits")
        out[f"{side}_member"] = held * known(f"{side}_individual")
        out[f"{side}_inherits"] = held * (1 - known(f"{side}_individual"))
    return pairs.withColumns(out)


def _link(name: str, a: str, b: str, strength: Column) -> Column:
    return F.struct(F.lit(name).alias("link"), F.col(a).alias("a"), F.col(b).alias("b"), strength.alias("strength"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def term_links(pairs: DataFrame, keys: Sequence[str] = (), typed: bool = True) -> DataFrame:
    """The links of judged pairs, a projection.

    Typed: two individuals are identical or not, an individual is a member of a kind or not, two kinds have both subset links and a
    similarity (weak ones too: they say that something is not so). Untyped: both subset links and the similarity of every pair, and the
    memberships that are stronger than LEAST_MEMBER.
    """
    known = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    rows = settled(pairs)
    a_in_b = known("same") + known("a_inherits") + (known("overlap") + known("b_inherits")) * known("a_in_b")
    b_in_a = known("same") + known("b_inherits") + (known("overlap") + known("a_inherits")) * known("b_in_a")
    alike = F.when(F.least(a_in_b, b_in_a) > 0, 1 / (1 / a_in_b + 1 / b_in_a - 1)).otherwise(0.0)
    kinds = [_link("subset", "a", "b", a_in_b), _link("subset", "b", "a", b_in_a), _link("similarity", "a", "b", alike)]
    members = [_link("member", "a", "b", known("a_member")), _link("member", "b", "a", known("b_member"))]
    if typed:
        a, b = (known(f"{side}_individual") > INDIVIDUAL for side in "ab")
        found = F.when(a & b, F.array(_link("identical", "a", "b", known("same")))).when(a, F.array(members[0])).when(b, F.array(members[1])).otherwise(F.array(*kinds))
    else:
        found = F.filter(F.array(*kinds, *members), lambda x: (x["link"] != "member") | (x["strength"] > LEAST_MEMBER))
    return rows.select(*keys, F.inline(found))


def intension_links(pairs: DataFrame, properties: DataFrame) -> DataFrame:
    """Links of pairs (a, b) by the properties (term, property, p) that both were asked about; pairs that share none have no link.

    Sets are fuzzy: what both have by the lesser p, what either has by the greater. Pairs meet a's properties, then b's by term and property,
    so that terms without a pair never meet.
    """
    asked = pairs.select("a", "b").distinct()
    mine = asked.join(properties.select(F.col("term").alias("a"), "property", F.col("p").alias("x")), "a")
    rows = mine.join(properties.select(F.col("term").alias("b"), "property", F.col("p").alias("y")), ["b", "property"])
    sums = rows.groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("both"), F.sum(F.greatest("x", "y")).alias("either"), F.sum("x").alias("in_a"), F.sum("y").alias("in_b"), F.count(F.lit(1)).alias("n"))
    sums = sums.withColumn("confidence", F.col("n") / (F.col("n") + HALF_PROPERTIES))
    part = lambda of: F.when(F.col(of) > 0, F.col("both") / F.col(of)).otherwise(0.0)
    found = [_link("intensional_inheritance", "a", "b", part("in_b")), _link("intensional_inheritance", "b", "a", part("in_a")), _link("intensional_similarity", "a", "b", part("either"))]
    return sums.select(F.inline(F.array(*found)))


def revised(links: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One link for each (keys, link, a, b): strengths weighted by their evidence, whose sum gives the confidence. Symmetric links are turned to a <= b."""
    turned = F.col("link").isin(*SYMMETRIC) & (F.col("a") > F.col("b"))
    sure = F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(MOST_CONFIDENCE))
    rows = links.select(*keys, "link", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), "strength", (HALF_EVIDENCE * sure / (1 - sure)).alias("n"))
    sums = rows.groupBy(*keys, "link", "a", "b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("strength")).alias("weighted"))
    return sums.select(*keys, "link", "a", "b", F.when(F.col("n") > 0, F.col("weighted") / F.col("n")).otherwise(0.0).alias("strength"), (F.col("n") / (F.col("n") + HALF_EVIDENCE)).alias("confidence"))


@dataclass(frozen=True)
class EntityGraph:
    """entities (text, entity, label, individual, confidence); mentions (text, mention, entity, strength, confidence); conflicts
    (text, a, b, same); links (text, link, a, b, strength, confidence) between entities."""

    entities: DataFrame
    mentions: DataFrame
    conflicts: DataFrame
    links: DataFrame


def entity_graph(mentions: DataFrame, pairs: DataFrame) -> EntityGraph:
    """Mentions (text, mention, surface, individual, confidence) of texts, merged by judged pairs (text, a, b, ... without individuals).

    Ids of mentions are unique over all texts and rise with their place. Pairs that are the same with SAME at least are one entity, chains
    included; an entity is named by its first mention, by its longest where another entity of the text begins alike. A pair of one entity
    whose own probability is below CONFLICT is a conflict. Means of individuals are rounded to 12 digits, so that the order in which rows are
    added does not decide about a threshold. Pairs between entities are evidence for the links of these.
    """
    joined = pairs.where(F.col("same") >= SAME).select("a", "b")
    placed = mentions.join(aggregates.clusters(joined).withColumnRenamed("id", "mention"), "mention", "left").withColumn("entity", F.coalesce("cluster", "mention")).drop("cluster")

    first, longest = F.min_by("surface", "mention"), F.max_by("surface", F.struct(F.length("surface"), -F.col("mention")))
    entities = placed.groupBy("text", "entity").agg(first.alias("first"), longest.alias("longest"), F.round(F.avg("individual"), 12).alias("individual"), F.avg("confidence").alias("confidence"))
    alike = F.count(F.lit(1)).over(Window.partitionBy("text", F.lower("first")))
    entities = entities.withColumn("label", F.when(alike > 1, F.col("longest")).otherwise(F.col("first"))).select("text", "entity", "label", "individual", "confidence")

    where = placed.select("mention", "entity")
    rows = pairs.join(where.select(F.col("mention").alias("a"), F.col("entity").alias("ea")), "a").join(where.select(F.col("mention").alias("b"), F.col("entity").alias("eb")), "b")
    inside = rows.where("ea = eb")
    both = inside.select("a", "same", "confidence").union(inside.select("b", "same", "confidence"))
    held = both.groupBy(F.col("a").alias("mention")).agg(F.avg("same").alias("strength"), F.avg("confidence").alias("sure"))
    said = placed.join(held, "mention", "left").select("text", "mention", "entity", F.coalesce("strength", F.lit(1.0)).alias("strength"), F.coalesce("sure", F.lit(1.0)).alias("confidence"))

    kinds = entities.select("entity", "individual")
    across = rows.where("ea <> eb").drop("a", "b").withColumnsRenamed({"ea": "a", "eb": "b"})
    for side in "ab":
        across = across.join(kinds.select(F.col("entity").alias(side), F.col("individual").alias(f"{side}_individual")), side)
    links = revised(term_links(across, ["text"]), ["text"])
    return EntityGraph(entities, said, inside.where(F.col("same") < CONFLICT).select("text", "a", "b", "same"), links)
