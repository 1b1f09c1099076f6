"""Work queues, source precedence, proposals, spans, and the remaining joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import hierarchy, names, ranking, sources_of, spans
from tidemark.plans.domain import Domain
from tidemark.plans.registry import query


@query("q_23_links_to_enrich", "SELECT link_id, created_at FROM links WHERE link_id NOT IN (SELECT link_id FROM mentions WHERE in_title AND p > 0.58) ORDER BY created_at DESC, link_id DESC LIMIT 25")
def links_to_enrich(d: Domain) -> DataFrame:
    done = d.mentions().where("in_title AND p > 0.58")
    return d.links().join(done, "link_id", "left_anti").orderBy(F.desc("created_at"), F.desc("link_id")).limit(25).select("link_id", "created_at")


@query("q_24_places_to_resolve", "SELECT entity_id, count(link_id) AS n FROM entities LEFT JOIN mentions USING (entity_id) WHERE NOT starts_with(kind_path, 'EUROPE') GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 25")
def places_to_resolve(d: Domain) -> DataFrame:
    rows = d.entities().where(~F.col("kind_path").startswith("EUROPE")).join(d.mentions().select("entity_id", "link_id"), "entity_id", "left")
    return rows.groupBy("entity_id").agg(F.count("link_id").alias("n")).orderBy(F.desc("n"), "entity_id").limit(25)


@query(
    "q_32_link_source",
    "WITH s AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 'H' || (s_suppkey % 40) END AS handle, 'h' || (s_suppkey % 60) AS host FROM supplier), "
    "hs AS (SELECT lower(handle) AS k, min(source_id) AS s FROM s WHERE handle IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_id) = 1), ho AS (SELECT lower(host) AS k, min(source_id) AS s FROM s GROUP BY 1 HAVING count(DISTINCT source_id) = 1) "
    "SELECT p_partkey AS link_id, coalesce(CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 100 END, hs.s, ho.s) AS source FROM part LEFT JOIN hs ON hs.k = lower('h' || (p_partkey % 50)) LEFT JOIN ho ON ho.k = 'h' || (p_partkey % 70)",
)
def link_source(d: Domain) -> DataFrame:
    key = F.col("s_suppkey")
    sources = d.raw("supplier").select(key.alias("source_id"), F.when(key % 2 == 0, F.concat(F.lit("H"), (key % 40).cast("string"))).alias("handle"), F.concat(F.lit("h"), (key % 60).cast("string")).alias("host"))
    part = F.col("p_partkey")
    links = d.raw("part").select(part.alias("link_id"), F.when(part % 7 == 0, part % 100).alias("source_id"), F.concat(F.lit("h"), (part % 50).cast("string")).alias("handle"), F.concat(F.lit("h"), (part % 70).cast("string")).alias("host"))
    return sources_of.link_sources(links, sources)


@query("q_36_proposal_checks", "SELECT suggested_by, count(*) AS n_open FROM suggestions WHERE topic IN (SELECT DISTINCT array_to_string(string_split(topic, '.')[1:2], '.') FROM labelled UNION SELECT 'ECONOMY.Own') GROUP BY 1 HAVING count(*) > 1")
def proposal_checks(d: Domain) -> DataFrame:
    inner = d.labels().select(hierarchy.parent(F.col("topic")).alias("topic")).union(d.spark.createDataFrame([("ECONOMY.Own",)], "topic string")).distinct()
    bad = d.suggestions().join(inner, "topic", "left_semi")
    return bad.groupBy("suggested_by").agg(F.count(F.lit(1)).alias("n_open")).where("n_open > 1")


@query("q_44_outbox_page", "SELECT o_orderkey AS id, o_orderdate AS sent_at FROM orders WHERE o_custkey = 7 ORDER BY sent_at DESC, id DESC LIMIT 10")
def outbox_page(d: Domain) -> DataFrame:
    rows = d.raw("orders").where("o_custkey = 7").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("sent_at"))
    return ranking.page(rows, [F.desc("sent_at"), F.desc("id")], 0, 10)


@query("join_18_keyset_predicate", "SELECT link_id FROM links WHERE (created_at, link_id) < (TIMESTAMP '1995-03-01', 500)")
def keyset_predicate(d: Domain) -> DataFrame:
    key = F.struct(F.col("created_at"), F.col("link_id"))
    cursor = F.struct(F.to_timestamp_ntz(F.lit("1995-03-01 00:00:00")).alias("created_at"), F.lit(500).cast("long").alias("link_id"))
    return d.links().where(key < cursor).select("link_id")


@query("join_19_marked_branches", "SELECT link_id, list_sort(list(DISTINCT mark)) AS marks FROM (SELECT link_id, 'topic' AS mark FROM labelled WHERE starts_with(topic, 'PROMO') UNION ALL SELECT link_id, 'entity' FROM mentions WHERE entity_id = 9 UNION ALL SELECT link_id, 'down' FROM votes WHERE value = -1) GROUP BY 1", lists="marks")
def marked_branches(d: Domain) -> DataFrame:
    branches = [
        d.labels().where(F.col("topic").startswith("PROMO")).select("link_id", F.lit("topic").alias("mark")),
        d.mentions().where("entity_id = 9").select("link_id", F.lit("entity").alias("mark")),
        d.votes().where("value = -1").select("link_id", F.lit("down").alias("mark")),
    ]
    rows = branches[0].unionByName(branches[1]).unionByName(branches[2])
    return rows.groupBy("link_id").agg(F.sort_array(F.collect_set("mark")).alias("marks"))


@query("join_26_presence", "SELECT k AS link_id, k IN (SELECT link_id FROM mentions WHERE entity_id = 9) AS there FROM range(0, 400, 3) t(k)")
def presence(d: Domain) -> DataFrame:
    asked = d.spark.range(0, 400, 3).select(F.col("id").alias("link_id"))
    there = d.mentions().where("entity_id = 9").select("link_id").distinct().withColumn("there", F.lit(True))
    return asked.join(there, "link_id", "left").withColumn("there", F.coalesce("there", F.lit(False)))


@query("agg_12_best_per_entity", "SELECT entity_id, round(max(p), 9) AS p, arg_max(link_id, (p, -link_id)) AS link_id FROM mentions GROUP BY 1")
def best_per_entity(d: Domain) -> DataFrame:
    best = F.max_by("link_id", F.struct("p", -F.col("link_id")))
    return d.mentions().groupBy("entity_id").agg(F.round(F.max("p"), 9).alias("p"), best.alias("link_id"))


@query("agg_13_nested_json", "SELECT conv_id, len(list(role)) AS n, string_agg(turn || ':' || role, ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1")
def nested_json(d: Domain) -> DataFrame:
    rows = d.raw("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    turns = F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["turn"], r["role"])), ",")
    return rows.select("conv_id", F.size("x").cast("long").alias("n"), turns.alias("turns"))


@query(
    "txt_11_fragments",
    "WITH t AS (SELECT p_partkey AS text_id, string_split(p_name, ' ') AS w FROM part), n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part WHERE p_partkey % 2 = 0) "
    "SELECT text_id, name FROM t JOIN n ON name = w[2] WHERE len(w) = 2",
)
def fragments(d: Domain) -> DataFrame:
    texts = d.raw("part").select(F.col("p_partkey").alias("text_id"), F.split("p_name", " ").alias("words"))
    whole = d.raw("part").select(F.col("p_name").alias("name")).distinct()
    second = d.raw("part").where("p_partkey % 2 = 0").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).distinct()
    names = whole.union(second).distinct().withColumn("parts", F.split("name", " "))
    return spans.fragments(spans.occurrences(texts, names))


@query(
    "txt_29_longer_names",
    """WITH n AS (SELECT DISTINCT unnest([p_name, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), upper(p_name), 'the ' || p_name || ' ' || lower(p_type)]) AS surface FROM part), w AS (SELECT surface, string_split(lower(surface), ' ') AS words FROM n)
    SELECT a.surface, b.surface AS longer, row_number() OVER (PARTITION BY a.surface ORDER BY len(b.words), b.surface)::INTEGER AS place FROM w a JOIN w b
      ON (len(b.words) > len(a.words) AND contains(' ' || lower(b.surface) || ' ', ' ' || lower(a.surface) || ' ')) OR (a.words = b.words AND b.surface > a.surface) QUALIFY place <= 4""",
)
def longer_names(d: Domain) -> DataFrame:
    """Names of parts, their words, other spellings, and longer ones around them."""
    word = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    around = F.concat_ws(" ", F.lit("the"), "p_name", F.lower("p_type"))
    surfaces = F.array("p_name", word(1), word(2), F.upper("p_name"), around)
    return names.longer_names(d.raw("part").select(F.explode(surfaces).alias("surface")))


@query("snk_05_guarded_counter", "SELECT o_custkey AS account, least(count(*), 12)::BIGINT AS used, greatest(12 - count(*), 0)::BIGINT AS left_over FROM orders GROUP BY 1")
def guarded_counter(d: Domain) -> DataFrame:
    n = F.count(F.lit(1))
    return d.raw("orders").groupBy(F.col("o_custkey").alias("account")).agg(F.least(n, F.lit(12)).cast("long").alias("used"), F.greatest(12 - n, F.lit(0)).cast("long").alias("left_over"))


@query("src_16_first_listing", "SELECT l_partkey AS url, min(l_suppkey) AS feed FROM lineitem GROUP BY 1")
def first_listing(d: Domain) -> DataFrame:
    from tidemark.sources.feeds import first_listing as first

    rows = d.raw("lineitem").select(F.col("l_partkey").alias("url"), F.col("l_suppkey").alias("feed")).distinct()
    return first(rows, "url", "feed")


@query("src_06_first_by_group", "SELECT kind_path, min(name) AS name FROM entities GROUP BY 1")
def first_by_group(d: Domain) -> DataFrame:
    return hierarchy.first_per_group(d.entities(), ["kind_path"], ["name", "entity_id"]).select("kind_path", "name")
