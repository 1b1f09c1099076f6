"""Readings as queries: dates in texts, event rows, typed names, topic beams, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import readings
from tidemark.plans.domain import Domain
from tidemark.plans.registry import query

NEAREST = "(SELECT arg_min(c, (abs(c - ref), CASE WHEN c >= ref THEN 0 ELSE 1 END)) FROM (VALUES (make_date(year(ref)::BIGINT, m, dd)), (make_date(year(ref)::BIGINT + 1, m, dd)), (make_date(year(ref)::BIGINT - 1, m, dd))) t(c))"


@query(
    "txt_15_date_candidates",
    f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ref, (o_orderkey % 12 + 1)::BIGINT AS m, (o_orderkey % 28 + 1)::BIGINT AS dd FROM orders),
    c AS (SELECT o_orderkey, {NEAREST} AS day, 0 AS origin FROM o UNION ALL SELECT o_orderkey, ref, 1 FROM o UNION ALL SELECT o_orderkey, make_date(year(ref)::BIGINT, m, dd), 2 FROM o UNION ALL SELECT o_orderkey, DATE '2001-03-05', 2 FROM o)
    SELECT o_orderkey, day, min(origin)::INTEGER AS origin FROM c GROUP BY 1, 2""",
)
def date_candidates(d: Domain) -> DataFrame:
    """A title with day and month, a description with numbers, and a page with a French date and a month first, made from each order."""
    names = F.array(*[F.lit(x) for x in list(readings.MONTHS)])
    month, day, ref = (F.col("o_orderkey") % 12).cast("int"), F.col("o_orderkey") % 28 + 1, F.to_date("o_orderdate")
    title = F.concat(F.lit("Opens "), F.get(names, month), F.lit(" "), day, F.lit("th, with friends"))
    description = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(ref, "dd.MM.yyyy")).otherwise(F.date_format(ref, "yyyy-MM-dd"))
    page = F.concat(F.lit("Le "), day, F.lit(" "), F.initcap(F.get(names, month + 12)), F.lit(" "), F.year(ref), F.lit(" à midi; then March 5th, 2001."))
    texts = F.array(*[F.struct(F.lit(k).alias("origin"), t.alias("text")) for k, t in enumerate((title, description, page))])
    sources = d.raw("orders").select("o_orderkey", ref.alias("reference"), F.inline(texts))
    return readings.date_candidates(sources, "o_orderkey")


ROLES = "SELECT l_orderkey AS unit, CASE l_linenumber WHEN 1 THEN CASE WHEN l_orderkey % 4 = 0 THEN 'period' ELSE 'start' END WHEN 2 THEN CASE WHEN l_orderkey % 4 = 1 THEN 'end' ELSE 'on' END ELSE 'on' END AS role, CAST(l_shipdate AS DATE) AS day, CAST(l_shipdate AS DATE) + l_linenumber AS until, l_discount::DOUBLE AS p FROM lineitem WHERE NOT (l_orderkey % 4 = 2 AND l_linenumber = 1)"


def judged(d: Domain) -> DataFrame:
    """Order lines as judged dates of units, the orders."""
    key, n = F.col("l_orderkey") % 4, F.col("l_linenumber")
    role = F.when((n == 1) & (key == 0), "period").when(n == 1, "start").when((n == 2) & (key == 1), "end").otherwise("on")
    day = F.to_date("l_shipdate")
    return d.raw("lineitem").where(~((key == 2) & (n == 1))).select(F.col("l_orderkey").alias("unit"), role.alias("role"), day.alias("day"), F.date_add(day, n).alias("until"), F.col("l_discount").alias("p"))


UNITS = f"""j AS ({ROLES}), u AS (SELECT unit, max(CASE WHEN role = 'period' THEN (p, day, until) END) AS pe, max(CASE WHEN role = 'start' THEN (p, day, until) END) AS st, max(CASE WHEN role = 'end' THEN (p, day, until) END) AS en FROM j GROUP BY 1),
    f AS (SELECT unit, pe, st, en, st[2] AS s, en[2] AS e FROM u), g AS (SELECT *, CASE WHEN s > e THEN CASE WHEN CAST(s - INTERVAL 1 YEAR AS DATE) <= e THEN CAST(s - INTERVAL 1 YEAR AS DATE) END ELSE s END AS s2 FROM f),
    units AS (SELECT unit, pe[2] AS starts, pe[3] AS ends, pe[1] AS p FROM g WHERE pe IS NOT NULL
    UNION ALL SELECT unit, s2, CASE WHEN s IS NULL OR e > coalesce(s2, DATE '0001-01-01') THEN e END, least(coalesce(st[1], 1), coalesce(en[1], 1)) FROM g WHERE pe IS NULL AND (st IS NOT NULL OR en IS NOT NULL)
    UNION ALL SELECT j.unit, day, NULL, p FROM j JOIN g USING (unit) WHERE role = 'on' AND pe IS NULL AND st IS NULL AND en IS NULL)"""


@query("txt_16_unit_rows", f"WITH {UNITS} SELECT * FROM units")
def unit_rows(d: Domain) -> DataFrame:
    return readings.unit_rows(judged(d), "unit")


@query("txt_17_recent_events", f"WITH {UNITS} SELECT units.* FROM units JOIN orders ON o_orderkey = unit WHERE coalesce(ends, starts) >= CAST(o_orderdate AS DATE) - 1")
def recent_events(d: Domain) -> DataFrame:
    """Events that are not over a day before their order's date."""
    seen = d.raw("orders").select(F.col("o_orderkey").alias("unit"), F.to_date("o_orderdate").alias("published"))
    rows = readings.unit_rows(judged(d), "unit").join(seen, "unit")
    return rows.where(F.coalesce("ends", "starts") >= F.date_sub("published", 1)).drop("published")


@query(
    "txt_18_declared_events",
    "SELECT 'Event ' || event_id AS name, CASE event_type WHEN 'view' THEN 'exhibition' WHEN 'click' THEN 'concert' WHEN 'signup' THEN 'conference' ELSE 'other' END AS kind, CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) END AS starts_on, CASE WHEN event_id % 5 = 0 OR event_id % 3 <> 0 THEN CAST(ts AS DATE) + CASE WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN 0 ELSE 2 END END AS ends_on, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%H:%M') END AS start_time FROM events WHERE event_id % 7 <> 0 OR event_id % 5 <> 0",
)
def declared_events(d: Domain) -> DataFrame:
    """Structured data of pages made from events; some without a start, some without any date, some that end on the day they start."""
    types = F.create_map(*[F.lit(x) for x in ("view", "VisualArtsEvent", "click", "MusicEvent", "signup", "BusinessEvent")])
    n, at = F.col("event_id"), F.col("ts").cast("timestamp")
    start = F.when(n % 5 != 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    last = F.when((n % 7 == 0) & (n % 5 == 0), F.lit(None)).otherwise(F.date_add(F.to_date(at), F.when(n % 3 == 0, 0).otherwise(2)).cast("string"))
    rows = d.raw("events").select(F.concat(F.lit("Event "), n).alias("name"), F.coalesce(F.try_element_at(types, F.col("event_type")), F.lit("Event")).alias("type"), start.alias("start"), last.alias("end"))
    return readings.declared_events(rows)


@query(
    "txt_20_claimed_names",
    """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), two AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 10), one AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part WHERE p_size < 30)
    SELECT p_partkey, array_to_string(w, ' ') AS name FROM t WHERE array_to_string(w, ' ') IN (SELECT name FROM two) OR (len(w) = 1 AND w[1] IN (SELECT name FROM one))
    UNION ALL SELECT p_partkey, x FROM (SELECT p_partkey, w, unnest(list_distinct(w)) AS x FROM t) WHERE len(w) > 1 AND array_to_string(w, ' ') NOT IN (SELECT name FROM two) AND array_to_string(list_reverse(w), ' ') NOT IN (SELECT name FROM two) AND x IN (SELECT name FROM one)
    UNION ALL SELECT p_partkey, array_to_string(list_reverse(w), ' ') FROM t WHERE len(w) > 1 AND w[1] <> w[2] AND array_to_string(list_reverse(w), ' ') IN (SELECT name FROM two) AND array_to_string(w, ' ') NOT IN (SELECT name FROM two)""",
)
def claimed_names(d: Domain) -> DataFrame:
    parts = d.raw("part")
    typed = parts.select("p_partkey", F.split("p_name", " ").alias("words"))
    two = parts.where("p_size > 10").select(F.col("p_name").alias("name")).distinct()
    one = parts.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).union(parts.where("p_size < 30").select(F.split_part("p_name", F.lit(" "), F.lit(1)))).distinct()
    return readings.claimed_names(typed, two.union(one).withColumn("words", F.split("name", " ")), "p_partkey")


@query(
    "txt_20_completed_names",
    """WITH two AS (SELECT DISTINCT p_name AS name FROM part WHERE p_size > 40), one AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part WHERE p_size < 2),
    names AS (SELECT name, string_split(name, ' ') AS w FROM two UNION SELECT name, [name] FROM one),
    t AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS whole, left(split_part(p_name, ' ', 2), 1 + p_partkey % 2) AS part, split_part(p_name, ' ', 1) IN (SELECT name FROM one) AS claimed FROM part),
    whole AS (SELECT p_partkey, whole AS name FROM t WHERE whole IN (SELECT name FROM names) UNION SELECT p_partkey, part FROM t WHERE part IN (SELECT name FROM names)),
    fits AS (SELECT p_partkey, name FROM t, names n WHERE part NOT IN (SELECT name FROM names) AND len(list_filter(n.w, lambda x: starts_with(x, part))) > 0
      AND len(list_filter(n.w, lambda x: NOT starts_with(x, part) AND (x <> whole OR claimed))) = 0)
    SELECT * FROM whole UNION ALL SELECT p_partkey, min(name) FROM fits GROUP BY 1 HAVING count(*) = 1""",
)
def completed_names(d: Domain) -> DataFrame:
    """Names whose last word is still being typed, after one or two letters of it."""
    parts = d.raw("part")
    last = F.substring(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(1), (1 + F.col("p_partkey") % 2).cast("int"))
    typed = parts.select("p_partkey", F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), last).alias("words"), last.alias("partial"))
    two = parts.where("p_size > 40").select(F.col("p_name").alias("name")).distinct()
    one = parts.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).union(parts.where("p_size < 2").select(F.split_part("p_name", F.lit(" "), F.lit(1)))).distinct()
    return readings.completed_names(typed, two.union(one).distinct().withColumn("words", F.split("name", " ")), "p_partkey")


@query("txt_21_filter_monoid", "SELECT link_id FROM labelled WHERE starts_with(topic, 'ECONOMY') AND p > 0.6")
def filter_monoid(d: Domain) -> DataFrame:
    a, b = readings.Filter(("startswith(topic, 'ECONOMY')",), ("economy",)), readings.Filter(("p > 0.6",), None)
    assert (a + b).local is None and (a + a).local == ("economy", "economy") and a + readings.Filter() == a and (readings.Filter() + b.last()).seen_last
    return (a + b).rows(d.labels()).select("link_id")


PATHS = """paths AS (SELECT DISTINCT split_part(topic, '.', 1) AS a, split_part(topic, '.', 1) || '.' || split_part(topic, '.', 2) AS b FROM labelled),
    edges AS (SELECT DISTINCT '' AS parent, a AS node FROM paths UNION SELECT DISTINCT a, b FROM paths WHERE a <> 'PROMO' OR b LIKE '%1'),
    probs AS (SELECT link_id, parent, node, (1 + (link_id + length(node) * 7 + ascii(right(node, 1)) * 5) % 50) / 50.0::DOUBLE AS p, count(*) OVER (PARTITION BY link_id, parent) AS n FROM links, edges)"""


@query(
    "txt_23_topic_beam",
    f"""WITH {PATHS}, one AS (SELECT link_id, node, ln(p) AS logs, 1 AS decisions, exp(ln(p)) AS score FROM probs WHERE parent = '' QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY exp(ln(p)) DESC, node) <= 3),
    grown AS (SELECT o.link_id, coalesce(e.node, o.node) AS node, o.logs + CASE WHEN e.n > 1 THEN ln(e.p) ELSE 0 END AS logs, decisions + CASE WHEN e.n > 1 THEN 1 ELSE 0 END AS decisions FROM one o LEFT JOIN probs e ON e.link_id = o.link_id AND e.parent = o.node),
    two AS (SELECT link_id, node, exp(logs / decisions) AS score FROM grown QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY exp(logs / decisions) DESC, node) <= 3)
    SELECT link_id, node, round(score, 3) AS score FROM two WHERE score >= 0.5""",
)
def topic_beam(d: Domain) -> DataFrame:
    """Probabilities are a given table, here made from ids and names."""
    parts = F.split("topic", r"\.")
    paths = d.labels().select(F.get(parts, F.lit(0)).alias("a"), F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).alias("b")).distinct()
    edges = paths.select(F.lit("").alias("parent"), F.col("a").alias("node")).union(paths.where("a <> 'PROMO' or b like '%1'").select("a", "b")).distinct()
    answer = lambda link, node: (1 + (link + F.length(node) * 7 + F.ascii(F.right(node, F.lit(1))) * 5) % 50) / 50.0
    return readings.beam_over_tree(d.links(), edges, "link_id", 2, answer)


KINDS = "CASE entity_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'place' ELSE 'organisation' END"


@query(
    "txt_24_claims",
    f"""WITH m AS (SELECT link_id, entity_id, {KINDS} AS kind, row_number() OVER (PARTITION BY link_id ORDER BY p DESC, entity_id) AS n FROM mentions WHERE in_title QUALIFY n <= 5),
    r(k, name, sn, obn, so, oo, sym) AS (VALUES (0, 'acquires', ['person', 'place'], ['person', 'place'], NULL, NULL, false), (1, 'invests_in', ['place'], ['person', 'place'], NULL, NULL, false), (2, 'customer_of', [], ['person', 'place'], NULL, NULL, false),
      (3, 'part_of', ['person'], ['person'], NULL, NULL, false), (4, 'makes', ['place'], ['person', 'place'], NULL, NULL, false), (5, 'leads', [], ['person', 'place'], 'person', NULL, false),
      (6, 'works_for', [], ['place'], 'person', NULL, false), (7, 'sues', [], [], NULL, NULL, false), (8, 'regulates', ['person'], [], NULL, NULL, false),
      (9, 'criticizes', [], [], NULL, NULL, false), (10, 'located_in', [], [], NULL, 'place', false), (11, 'partners_with', ['person', 'place'], ['person', 'place'], NULL, NULL, true),
      (12, 'competes_with', ['place'], ['place'], NULL, NULL, true)),
    pairs AS (SELECT a.link_id, a.entity_id AS s, a.kind AS sk, b.entity_id AS o, b.kind AS ok, a.n < b.n AS forward FROM m a JOIN m b ON a.link_id = b.link_id AND a.n <> b.n),
    options AS (SELECT link_id, least(s, o) AS lo, greatest(s, o) AS hi, ((s * 7 + o * 3 + length(name) * 11) % 100) / 100.0::DOUBLE AS p, -k AS ord, CASE WHEN sym THEN least(s, o) ELSE s END AS subject, name AS relation, CASE WHEN sym THEN greatest(s, o) ELSE o END AS object
      FROM pairs, r WHERE (forward OR NOT sym) AND NOT list_contains(sn, sk) AND NOT list_contains(obn, ok) AND (so IS NULL OR so = sk) AND (oo IS NULL OR oo = ok) AND (NOT sym OR (NOT list_contains(sn, ok) AND NOT list_contains(obn, sk))))
    SELECT link_id, subject, relation, object, p FROM options QUALIFY row_number() OVER (PARTITION BY link_id, lo, hi ORDER BY p DESC, ord DESC, subject DESC) = 1 AND p >= 0.5""",
)
def claims(d: Domain) -> DataFrame:
    kind = F.when(F.col("entity_id") % 3 == 0, "person").when(F.col("entity_id") % 3 == 1, "place").otherwise("organisation")
    mentions = d.mentions().where("in_title").withColumn("kind", kind)
    return readings.claims(mentions, lambda s, o, name: ((s * 7 + o * 3 + len(name) * 11) % 100) / 100.0)
