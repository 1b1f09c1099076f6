"""Links between terms and the entity graph as queries: an order is a text, its line numbers are its mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import terms
from tidemark.plans.domain import Domain
from tidemark.plans.registry import query

MENTIONS = """ment AS (SELECT l_orderkey AS text, l_orderkey * 10 + l_linenumber AS mention, min(l_returnflag || repeat('x', (l_suppkey % 3)::INTEGER)) AS surface,
    (min(l_suppkey) * 7 % 20) / 20.0::DOUBLE + 0.013::DOUBLE AS individual, 0.5::DOUBLE + (min(l_partkey) % 50) / 100.0::DOUBLE AS confidence FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
PAIRS = f"""{MENTIONS}, weighed AS (SELECT a.text AS text, a.mention AS a, b.mention AS b, a.individual AS ia, b.individual AS ib, a.mention * 3 + b.mention * 5 AS k,
      CASE WHEN left(a.surface, 1) = left(b.surface, 1) AND (a.mention * 3 + b.mention * 5) % 4 <> 0 THEN 120 ELSE 1 END AS w0 FROM ment a JOIN ment b ON a.text = b.text AND a.mention < b.mention),
    total AS (SELECT *, (2 + w0 + 1 + k % 7 + 1 + k % 5 + 1 + k % 11 + 1 + k % 3 + 1 + k % 13)::DOUBLE AS t FROM weighed),
    judged AS (SELECT text, a, b, ia, ib, w0 / t AS same, (1 + k % 7) / t AS am, (1 + k % 5) / t AS bm, (1 + k % 11) / t AS ai, (1 + k % 3) / t AS bi, (1 + k % 13) / t AS ov,
      0.5::DOUBLE + (k % 45) / 100.0::DOUBLE AS c, (k % 10) / 10.0::DOUBLE * 0.15::DOUBLE + (1 - (k % 10) / 10.0::DOUBLE) * 0.85::DOUBLE AS sab, ((k + 3) % 10) / 10.0::DOUBLE * 0.15::DOUBLE + (1 - ((k + 3) % 10) / 10.0::DOUBLE) * 0.85::DOUBLE AS sba FROM total)"""


def links_sql(judged: str, name: str) -> str:
    """The links of judged pairs as common table expressions: mass of each side moved by kind, and all five strengths."""
    return f"""{name}_moved AS (SELECT *, (am + ai) * ia AS m1, (bm + bi) * ib AS m2, same + (am + ai) * (1 - ia) + (ov + (bm + bi) * (1 - ib)) * sab AS x, same + (bm + bi) * (1 - ib) + (ov + (am + ai) * (1 - ia)) * sba AS y FROM {judged}),
    {name} AS (SELECT text, ia, ib, 'subset' AS link, a, b, x AS strength, c AS confidence FROM {name}_moved UNION ALL SELECT text, ia, ib, 'subset', b, a, y, c FROM {name}_moved
      UNION ALL SELECT text, ia, ib, 'similarity', a, b, x * y / (x + y - x * y), c FROM {name}_moved UNION ALL SELECT text, ia, ib, 'member', a, b, m1, c FROM {name}_moved UNION ALL SELECT text, ia, ib, 'memberback', b, a, m2, c FROM {name}_moved
      UNION ALL SELECT text, ia, ib, 'identical', a, b, same, c FROM {name}_moved),
    {name}_typed AS (SELECT text, replace(link, 'back', '') AS link, a, b, strength, confidence FROM {name} WHERE link = CASE WHEN ia > 0.5 AND ib > 0.5 THEN 'identical' WHEN ia > 0.5 THEN 'member' WHEN ib > 0.5 THEN 'memberback' END
      OR (ia <= 0.5 AND ib <= 0.5 AND link IN ('subset', 'similarity')))"""


def mentions(d: Domain) -> DataFrame:
    """(text, mention, surface, individual, confidence): at most seven to an order; no mean of so few is at the threshold of individuals."""
    rows = d.raw("lineitem").groupBy(F.col("l_orderkey").alias("text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention"))
    surface = F.concat("l_returnflag", F.repeat(F.lit("x"), (F.col("l_suppkey") % 3).cast("int")))
    return rows.agg(F.min(surface).alias("surface"), (F.min("l_suppkey") * 7 % 20 / 20.0 + 0.013).alias("individual"), (0.5 + F.min("l_partkey") % 50 / 100.0).alias("confidence"))


def pairs(d: Domain) -> DataFrame:
    """Judged pairs of an order's mentions; answers are a given table, here made from ids."""
    a, b = (mentions(d).select("text", F.col("mention").alias(s), F.substring("surface", 1, 1).alias(f"{s}_kind"), F.col("individual").alias(f"{s}_individual")) for s in "ab")
    k = F.col("k")
    rows = a.join(b, "text").where("a < b").withColumn("k", F.col("a") * 3 + F.col("b") * 5)
    weights = {"same": F.when((F.col("a_kind") == F.col("b_kind")) & (k % 4 != 0), 120).otherwise(1), "a_member": 1 + k % 7, "b_member": 1 + k % 5, "a_inherits": 1 + k % 11, "b_inherits": 1 + k % 3, "overlap": 1 + k % 13}
    total = sum(weights.values(), F.lit(2.0))
    answers = lambda n: F.create_map(F.lit("few"), (k + n) % 10 / 10.0, F.lit("most"), 1 - (k + n) % 10 / 10.0)
    shares = [terms.expected_share(answers(0)).alias("a_in_b"), terms.expected_share(answers(3)).alias("b_in_a")]
    return rows.select("text", "a", "b", "a_individual", "b_individual", *[(w / total).alias(n) for n, w in weights.items()], *shares, (0.5 + k % 45 / 100.0).alias("confidence"))


def rounded(name: str) -> Column:
    """A number to eight digits; what is added takes exact halves, which the two engines could round apart, off the edge."""
    return F.round(F.col(name) + 1e-11, 8)


def told(links: DataFrame, *keys: str) -> DataFrame:
    return links.select(*keys, "link", "a", "b", rounded("strength").alias("strength"), rounded("confidence").alias("confidence"))


TOLD = "link, a, b, round(strength + 1e-11, 8) AS strength, round(confidence + 1e-11, 8) AS confidence"


@query("vec_18_typed_links", f"WITH {PAIRS}, {links_sql('judged', 'l')} SELECT text, {TOLD} FROM l_typed")
def typed_links(d: Domain) -> DataFrame:
    return told(terms.term_links(pairs(d), ["text"]), "text")


@query("vec_18_extension_links", f"WITH {PAIRS}, {links_sql('judged', 'l')} SELECT text, {TOLD} FROM (SELECT * REPLACE (replace(link, 'back', '') AS link) FROM l) WHERE link IN ('subset', 'similarity') OR (link = 'member' AND strength > 0.05)")
def extension_links(d: Domain) -> DataFrame:
    return told(terms.term_links(pairs(d), ["text"], typed=False), "text")


@query(
    "vec_18_intension_links",
    f"""WITH props AS (SELECT s_suppkey AS term, l_linestatus || l_returnflag || l_linenumber AS property, avg(l_discount) * 10 AS p FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
    sums AS (SELECT x.term AS a, y.term AS b, sum(least(x.p, y.p)) AS both_p, sum(greatest(x.p, y.p)) AS either, sum(x.p) AS ina, sum(y.p) AS inb, count(*) / (count(*) + 10.0::DOUBLE) AS confidence
      FROM supplier s JOIN supplier t ON s.s_suppkey + 1 = t.s_suppkey JOIN props x ON x.term = s.s_suppkey JOIN props y ON y.term = t.s_suppkey AND x.property = y.property GROUP BY 1, 2),
    told AS (SELECT 'intensional_inheritance' AS link, a, b, CASE WHEN inb > 0 THEN both_p / inb ELSE 0 END AS strength, confidence FROM sums UNION ALL SELECT 'intensional_inheritance', b, a, CASE WHEN ina > 0 THEN both_p / ina ELSE 0 END, confidence FROM sums
      UNION ALL SELECT 'intensional_similarity', a, b, CASE WHEN either > 0 THEN both_p / either ELSE 0 END, confidence FROM sums)
    SELECT {TOLD} FROM told""",
)
def intension_links(d: Domain) -> DataFrame:
    """Suppliers and the next one, by what their order lines are like."""
    ids = d.raw("supplier").select(F.col("s_suppkey").alias("term"))
    name = F.concat("l_linestatus", "l_returnflag", F.col("l_linenumber").cast("string"))
    properties = d.raw("lineitem").groupBy(F.col("l_suppkey").alias("term"), name.alias("property")).agg((F.avg("l_discount") * 10).alias("p")).join(ids, "term", "left_semi")
    following = ids.select((F.col("term") - 1).alias("a"), F.col("term").alias("b")).join(ids.select(F.col("term").alias("a")), "a", "left_semi")
    return told(terms.intension_links(following, properties))


GRAPH = f"""RECURSIVE {PAIRS}, ends AS (SELECT text, a, b FROM judged WHERE same >= 0.7 UNION ALL SELECT text, b, a FROM judged WHERE same >= 0.7),
    reach AS (SELECT text, mention AS a, mention AS b FROM ment UNION SELECT r.text, r.a, e.b FROM reach r JOIN ends e ON e.text = r.text AND e.a = r.b),
    ent AS (SELECT text, a AS mention, min(b) AS entity FROM reach GROUP BY 1, 2),
    placed AS (SELECT j.*, x.entity AS ea, y.entity AS eb FROM judged j JOIN ent x ON x.mention = j.a JOIN ent y ON y.mention = j.b),
    nodes AS (SELECT text, entity, arg_min(surface, mention) AS f, arg_max(surface, (length(surface), -mention)) AS l, avg(individual) AS individual FROM ment JOIN ent USING (text, mention) GROUP BY 1, 2),
    across AS (SELECT p.* EXCLUDE (a, b, ia, ib), ea AS a, eb AS b, x.individual AS ia, y.individual AS ib FROM placed p JOIN nodes x ON x.entity = ea JOIN nodes y ON y.entity = eb WHERE ea <> eb)"""


@query("vec_19_entities", f"WITH {GRAPH} SELECT text, entity, CASE WHEN count(*) OVER (PARTITION BY text, lower(f)) > 1 THEN l ELSE f END AS label, round(individual + 1e-11, 8) AS individual FROM nodes")
def entities(d: Domain) -> DataFrame:
    return terms.entity_graph(mentions(d), pairs(d).drop("a_individual", "b_individual")).entities.select("text", "entity", "label", rounded("individual").alias("individual"))


@query(
    "vec_19_mentions",
    f"WITH {GRAPH}, inside AS (SELECT a AS mention, same, c FROM placed WHERE ea = eb UNION ALL SELECT b, same, c FROM placed WHERE ea = eb), held AS (SELECT mention, avg(same) AS s, avg(c) AS c FROM inside GROUP BY 1) "
    "SELECT mention, entity, round(coalesce(s, 1) + 1e-11, 8) AS strength, round(coalesce(c, 1) + 1e-11, 8) AS confidence FROM ent LEFT JOIN held USING (mention)",
)
def entity_mentions(d: Domain) -> DataFrame:
    rows = terms.entity_graph(mentions(d), pairs(d).drop("a_individual", "b_individual")).mentions
    return rows.select("mention", "entity", rounded("strength").alias("strength"), rounded("confidence").alias("confidence"))


@query("vec_19_conflicts", f"WITH {GRAPH} SELECT a, b, round(same + 1e-11, 8) AS same FROM placed WHERE ea = eb AND same < 0.3")
def conflicts(d: Domain) -> DataFrame:
    rows = terms.entity_graph(mentions(d), pairs(d).drop("a_individual", "b_individual")).conflicts
    return rows.select("a", "b", rounded("same").alias("same"))


@query(
    "vec_19_revised_links",
    f"WITH {GRAPH}, {links_sql('across', 'l')}, turned AS (SELECT link, CASE WHEN link IN ('identical', 'similarity') THEN least(a, b) ELSE a END AS a, CASE WHEN link IN ('identical', 'similarity') THEN greatest(a, b) ELSE b END AS b, strength, least(confidence, 0.99) / (1 - least(confidence, 0.99)) AS n FROM l_typed) "
    "SELECT link, a, b, round(sum(n * strength) / sum(n) + 1e-11, 8) AS strength, round(sum(n) / (sum(n) + 1) + 1e-11, 8) AS confidence FROM turned GROUP BY 1, 2, 3",
)
def revised_links(d: Domain) -> DataFrame:
    return told(terms.entity_graph(mentions(d), pairs(d).drop("a_individual", "b_individual")).links)
