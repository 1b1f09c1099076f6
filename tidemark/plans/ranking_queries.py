"""Trees, preferences, ranking, summaries and related links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates, hierarchy, ranking
from tidemark.plans.domain import AS_OF, HALF_LIFE_DAYS, VIEWER, Domain
from tidemark.plans.registry import query


def feed(d: Domain) -> DataFrame:
    d = d.with_facts()
    return ranking.ranked_feed(d.links(), d.labels(), d.suggestions(), d.votes(), d.overrides(), VIEWER, AS_OF, HALF_LIFE_DAYS)


@query("q_02_ranked_feed", "SELECT link_id, round(rank, 9) AS rank FROM ranked")
def ranked_feed(d: Domain) -> DataFrame:
    return feed(d).select("link_id", F.round("rank", 9).alias("rank"))


@query("srt_01_ranked_page", "SELECT link_id, round(rank, 9) AS rank FROM (SELECT link_id, rank FROM ranked ORDER BY round(rank, 9) DESC, link_id DESC LIMIT 30 OFFSET 30)")
def ranked_page(d: Domain) -> DataFrame:
    return ranking.page(ranked_feed(d), [F.desc("rank"), F.desc("link_id")], 30, 30)


@query(
    "q_01_topic_preferences",
    "SELECT voter, topic_id, round(likes, 6) AS likes, round(dislikes, 6) AS dislikes, round(1 + likes, 6) AS alpha, round(1 + dislikes, 6) AS beta, n_votes, n_up, n_down FROM preferences",
)
def topic_preferences(d: Domain) -> DataFrame:
    d = d.with_facts()
    rows = ranking.preferences(d.votes(), d.labels(), d.suggestions())
    return rows.select("voter", "topic_id", *(F.round(c, 6).alias(c) for c in ("likes", "dislikes", "alpha", "beta")), "n_votes", "n_up", "n_down")


@query("join_06_effective_labels", "SELECT * FROM seen_labels")
def effective_labels(d: Domain) -> DataFrame:
    return ranking.effective_labels(d.labels(), d.suggestions(), VIEWER)


@query(
    "join_09_nearest_ancestor",
    "SELECT topic, coalesce((SELECT arg_max(n, len(t)) FROM (SELECT topic_id AS t, round(score, 9) AS n FROM mine) WHERE topic = t OR starts_with(topic, t || '.')), 0.5) AS score FROM (SELECT DISTINCT topic FROM labelled)",
)
def nearest_ancestor(d: Domain) -> DataFrame:
    own = d.suggestions().where(F.col("suggested_by") == VIEWER)
    scores = ranking.viewer_scores(ranking.preferences(d.votes().where(F.col("voter") == VIEWER), d.labels(), own), d.overrides(), VIEWER)
    topics = d.labels().select("topic").distinct()
    return hierarchy.nearest_ancestor(topics, [], "topic", scores, "topic_id", "score", 0.5).select("topic", F.round("score", 9).alias("score"))


@query(
    "agg_17_hierarchy_rollup",
    "SELECT array_to_string(string_split(topic, '.')[1:n], '.') AS ancestor, count(*) AS n_links, round(sum(p), 6) AS weight FROM labelled, unnest(range(1, len(string_split(topic, '.')) + 1)) t(n) GROUP BY 1",
)
def hierarchy_rollup(d: Domain) -> DataFrame:
    return hierarchy.rollup(d.labels(), "topic", F.count(F.lit(1)).alias("n_links"), F.round(F.sum("p"), 6).alias("weight"))


@query(
    "join_08_ancestor_series",
    "SELECT entity_id, array_to_string(string_split(kind_path, '.')[1:n], '.') AS ancestor FROM entities, unnest(range(1, len(string_split(kind_path, '.')) + 1)) t(n)",
)
def ancestor_series(d: Domain) -> DataFrame:
    return hierarchy.with_ancestors(d.entities(), "kind_path").select("entity_id", "ancestor")


@query("prj_03_path_parent", "SELECT DISTINCT topic, array_to_string(string_split(topic, '.')[1:-2], '.') AS parent, string_split(topic, '.')[-1] AS label, len(string_split(topic, '.'))::INTEGER AS depth FROM labelled")
def path_parent(d: Domain) -> DataFrame:
    topic = F.col("topic")
    return d.labels().select("topic", hierarchy.parent(topic).alias("parent"), hierarchy.label(topic).alias("label"), hierarchy.depth(topic).alias("depth")).distinct()


TOPIC_PATHS = "SELECT DISTINCT array_to_string(string_split(topic, '.')[1:n], '.') AS path FROM labelled, unnest(range(1, len(string_split(topic, '.')) + 1)) t(n)"


@query(
    "q_09_topic_children",
    f"WITH paths AS ({TOPIC_PATHS}), parents AS (SELECT path, CASE WHEN contains(path, '.') THEN regexp_extract(path, '^(.*)[.][^.]+$', 1) END AS parent FROM paths) "
    "SELECT path, parent, (SELECT count(*) FROM parents c WHERE c.parent = p.path) AS n_children FROM parents p",
)
def topic_children(d: Domain) -> DataFrame:
    return hierarchy.children(hierarchy.with_ancestors(d.labels(), "topic", "path"), "path")


@query("join_11_direct_children", f"WITH paths AS ({TOPIC_PATHS}) SELECT p.path AS parent, c.path AS child FROM paths p JOIN paths c ON starts_with(c.path, p.path || '.') AND len(string_split(c.path, '.')) = len(string_split(p.path, '.')) + 1")
def direct_children(d: Domain) -> DataFrame:
    paths = hierarchy.with_ancestors(d.labels(), "topic", "path").select("path").distinct()
    return paths.select(hierarchy.parent(F.col("path")).alias("parent"), F.col("path").alias("child")).where("parent is not null")


@query("q_10_topic_links", "SELECT link_id, created_at, topic FROM labelled JOIN links USING (link_id) WHERE topic = 'ECONOMY' OR starts_with(topic, 'ECONOMY.')")
def topic_links(d: Domain) -> DataFrame:
    return d.labels().where(hierarchy.within(F.col("topic"), "ECONOMY")).join(d.links(), "link_id").select("link_id", "created_at", "topic")


@query(
    "q_10_topic_link_count",
    f"WITH paths AS ({TOPIC_PATHS}) SELECT path, count(DISTINCT link_id) AS n_links FROM paths JOIN labelled ON topic = path OR starts_with(topic, path || '.') GROUP BY 1",
)
def topic_link_count(d: Domain) -> DataFrame:
    return hierarchy.rollup(d.labels(), "topic", F.countDistinct("link_id").alias("n_links")).withColumnRenamed("ancestor", "path")


@query(
    "q_12_kind_counts",
    "WITH kinds AS (SELECT DISTINCT array_to_string(string_split(kind_path, '.')[1:n], '.') AS kind FROM entities, unnest(range(1, len(string_split(kind_path, '.')) + 1)) t(n)) "
    "SELECT kind, count(DISTINCT e.entity_id) AS n_entities, count(DISTINCT link_id) AS n_links FROM kinds JOIN entities e ON kind_path = kind OR starts_with(kind_path, kind || '.') LEFT JOIN mentions USING (entity_id) GROUP BY 1",
)
def kind_counts(d: Domain) -> DataFrame:
    """Entities are unique by path, so that they are counted before any join; links go up at once and are told apart in one shuffle."""
    entities = hierarchy.rollup(d.entities(), "kind_path", F.count(F.lit(1)).alias("n_entities")).withColumnRenamed("ancestor", "kind")
    links = d.mentioned().join(d.entities().select("entity_id", "kind_path"), "entity_id").select("kind_path", "link_id")
    above = hierarchy.with_ancestors(links, "kind_path", "kind").select("kind", "link_id").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n_links"))
    return entities.join(above, "kind", "left").select("kind", "n_entities", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query(
    "q_12_kind_entities",
    "SELECT e.entity_id, name, count(link_id) AS n_links FROM entities e LEFT JOIN mentions USING (entity_id) WHERE kind_path = 'ASIA' OR starts_with(kind_path, 'ASIA.') GROUP BY 1, 2 ORDER BY n_links DESC, name, entity_id LIMIT 20",
)
def kind_entities(d: Domain) -> DataFrame:
    rows = d.entities().where(hierarchy.within(F.col("kind_path"), "ASIA")).join(d.mentions().select("entity_id", "link_id"), "entity_id", "left")
    return rows.groupBy("entity_id", "name").agg(F.count("link_id").alias("n_links")).orderBy(F.desc("n_links"), "name", "entity_id").limit(20)


@query(
    "q_12_kind_links",
    "SELECT link_id, list_sort(list(DISTINCT name)) AS names FROM mentions JOIN entities USING (entity_id) WHERE kind_path = 'ASIA' OR starts_with(kind_path, 'ASIA.') GROUP BY 1",
    lists="names",
)
def kind_links(d: Domain) -> DataFrame:
    rows = d.entities().where(hierarchy.within(F.col("kind_path"), "ASIA")).join(d.mentioned(), "entity_id")
    return rows.groupBy("link_id").agg(aggregates.set_of(F.col("name")).alias("names"))


PLACES = """places AS (SELECT 'R' || r_regionkey AS node, 'R' || r_regionkey AS path, true AS is_place FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey || '.N' || n_nationkey, true FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'R' || n_regionkey || '.N' || n_nationkey || '.S' || s_suppkey, s_suppkey % 2 = 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  moves AS (SELECT 'S' || s_suppkey AS node, CASE s_suppkey % 4 WHEN 0 THEN 'N' || (s_suppkey % 25) WHEN 1 THEN 'S' || (s_suppkey + 1) WHEN 2 THEN 'S' || s_suppkey ELSE 'X' END AS parent FROM supplier UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation UNION ALL SELECT 'N' || n_nationkey, 'R' || ((n_regionkey + 1) % 5) FROM nation UNION ALL SELECT 'Y', 'R0')"""


def places(d: Domain) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and suppliers as places, of which every other supplier is none; and moves between them."""
    text_of = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    region, nation, supplier = d.raw("region"), d.raw("nation"), d.raw("supplier")
    of_nation = F.concat(text_of("R", "n_regionkey"), F.lit("."), text_of("N", "n_nationkey"))
    low = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    known = region.select(text_of("R", "r_regionkey").alias("node"), text_of("R", "r_regionkey").alias("path"), F.lit(True).alias("is_place"))
    known = known.union(nation.select(text_of("N", "n_nationkey"), of_nation, F.lit(True)))
    known = known.union(low.select(text_of("S", "s_suppkey"), F.concat(of_nation, F.lit("."), text_of("S", "s_suppkey")), F.col("s_suppkey") % 2 == 0))
    n = F.col("s_suppkey")
    parent = F.when(n % 4 == 0, F.concat(F.lit("N"), n % 25)).when(n % 4 == 1, F.concat(F.lit("S"), n + 1)).when(n % 4 == 2, F.concat(F.lit("S"), n)).otherwise("X")
    moves = supplier.select(text_of("S", "s_suppkey").alias("node"), parent.alias("parent"))
    moves = moves.union(nation.select(text_of("R", "n_regionkey"), text_of("N", "n_nationkey"))).union(nation.select(text_of("N", "n_nationkey"), F.concat(F.lit("R"), (F.col("n_regionkey") + 1) % 5)))
    return known, moves.union(d.spark.createDataFrame([("Y", "R0")], "node string, parent string"))


@query(
    "q_26_judged_moves",
    f"WITH {PLACES}, met AS (SELECT m.node, m.parent, a.path AS own, b.path AS up, b.is_place FROM moves m LEFT JOIN places a ON a.node = m.node LEFT JOIN places b ON b.node = m.parent), "
    "told AS (SELECT *, CASE WHEN own IS NULL THEN 'no such node' WHEN is_place IS NOT TRUE THEN 'parent is not a place' WHEN list_contains(string_split(up, '.'), node) THEN 'a cycle' END AS refusal FROM met) "
    "SELECT node, parent, refusal, CASE WHEN refusal IS NULL THEN up || '.' || node END AS path FROM told",
)
def judged_moves(d: Domain) -> DataFrame:
    """Moves of places: which are refused and why, and where the others lead."""
    return hierarchy.judged_moves(*places(d))


@query("q_26_moved_subtree", f"WITH {PLACES} SELECT node, CASE WHEN list_contains(string_split(path, '.'), 'N7') THEN 'R0.N0' || substr(path, strpos(path, '.N7')) ELSE path END AS path FROM places")
def moved_subtree(d: Domain) -> DataFrame:
    """A nation moved under another: its suppliers go with it."""
    return hierarchy.after_move(places(d)[0].select("node", "path"), "N7", "R0.N0.N7")


@query("q_26_set_parent", "SELECT entity_id, CASE WHEN kind_path = 'ASIA' OR starts_with(kind_path, 'ASIA.') THEN 'EUROPE.ASIA' || substring(kind_path, 5) ELSE kind_path END AS kind_path FROM entities")
def set_parent(d: Domain) -> DataFrame:
    return d.entities().select("entity_id", hierarchy.reroot(F.col("kind_path"), "ASIA", "EUROPE").alias("kind_path"))


@query(
    "q_27_path_consistent",
    "WITH own AS (SELECT DISTINCT topic AS path FROM labelled WHERE link_id % 3 = 0 UNION SELECT DISTINCT split_part(topic, '.', 1) FROM labelled), "
    "up AS (SELECT path, array_to_string(string_split(path, '.')[1:n], '.') AS missing FROM own, unnest(range(1, len(string_split(path, '.')) + 1)) t(n)) SELECT path, missing FROM up WHERE missing NOT IN (SELECT path FROM own)",
)
def path_consistent(d: Domain) -> DataFrame:
    some = d.labels().where("link_id % 3 = 0").select("topic")  # a table with gaps is what the check is for
    roots = d.labels().select(F.split_part("topic", F.lit("."), F.lit(1)).alias("topic"))
    return hierarchy.inconsistent(some.union(roots), "topic")


@query(
    "fn_34_common_path",
    "WITH each AS (SELECT brand, list(DISTINCT topic) AS topics FROM labelled JOIN links USING (link_id) GROUP BY 1) SELECT brand, CASE WHEN len(list_distinct(list_transform(topics, lambda t: split_part(t, '.', 1)))) > 1 THEN '' "
    "WHEN len(list_distinct(list_transform(topics, lambda t: array_to_string(string_split(t, '.')[1:2], '.')))) > 1 THEN split_part(topics[1], '.', 1) WHEN len(topics) > 1 THEN array_to_string(string_split(topics[1], '.')[1:2], '.') ELSE topics[1] END AS shared FROM each",
)
def common_path(d: Domain) -> DataFrame:
    rows = d.labels().join(d.links().select("link_id", "brand"), "link_id").groupBy("brand").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    return rows.select("brand", hierarchy.common_path(F.col("topics")).alias("shared"))


@query("agg_03_beta_mean", "SELECT link_id, round((1 + ups) / (2 + ups + downs), 9) AS share FROM counted")
def beta_mean(d: Domain) -> DataFrame:
    return ranking.vote_counts(d.votes()).select("link_id", F.round(aggregates.beta_mean(F.col("ups"), F.col("downs")), 9).alias("share"))


@query("agg_05_vote_counts", "SELECT * FROM counted")
def vote_counts(d: Domain) -> DataFrame:
    return ranking.vote_counts(d.votes())


@query("agg_04_weighted_mean", "SELECT link_id, round(taste, 9) AS taste FROM taste")
def weighted_mean(d: Domain) -> DataFrame:
    labels = ranking.effective_labels(d.labels(), d.suggestions(), VIEWER)
    own = d.suggestions().where(F.col("suggested_by") == VIEWER)
    scores = ranking.viewer_scores(ranking.preferences(d.votes().where(F.col("voter") == VIEWER), d.labels(), own), d.overrides(), VIEWER)
    topics = hierarchy.nearest_ancestor(labels.select("topic").distinct(), [], "topic", scores, "topic_id", "score", 0.5)
    return labels.join(topics, "topic").groupBy("link_id").agg(F.round(aggregates.weighted_mean(F.col("score"), F.col("p")), 9).alias("taste"))


@query(
    "q_16_relation_summary",
    "SELECT subject, object, relation, count(*) AS n_links, round(1 - exp(sum(ln(1 - least(p, 0.999)))), 9) AS p, arg_max(status, (created_at, seq)) AS status, min(created_at) AS first_seen, max(created_at) AS last_seen FROM evidence GROUP BY 1, 2, 3",
)
def relation_summary(d: Domain) -> DataFrame:
    return d.evidence().groupBy("subject", "object", "relation").agg(
        F.count(F.lit(1)).alias("n_links"),
        F.round(aggregates.noisy_or(F.col("p")), 9).alias("p"),
        aggregates.latest("status", "created_at", "seq").alias("status"),
        F.min("created_at").alias("first_seen"),
        F.max("created_at").alias("last_seen"),
    )


@query("agg_06_noisy_or", "SELECT subject, round(1 - exp(sum(ln(1 - least(p, 0.999)))), 9) AS p FROM evidence GROUP BY 1")
def noisy_or(d: Domain) -> DataFrame:
    return d.evidence().groupBy("subject").agg(F.round(aggregates.noisy_or(F.col("p")), 9).alias("p"))


@query("agg_07_latest_value", "SELECT object, arg_max(status, (created_at, seq)) AS status FROM evidence GROUP BY 1")
def latest_value(d: Domain) -> DataFrame:
    return d.evidence().groupBy("object").agg(aggregates.latest("status", "created_at", "seq").alias("status"))


@query("agg_08_first_last_seen", "SELECT object, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) AS n FROM evidence GROUP BY 1")
def first_last_seen(d: Domain) -> DataFrame:
    return d.evidence().groupBy("object").agg(F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.count(F.lit(1)).alias("n"))


@query(
    "q_17_property_summary",
    "SELECT subject, relation AS facet, arg_max(object, (p, -seq)) AS best_object, arg_max(status = 'R', (created_at, seq)) AS former, count(*) AS n, round(1 - exp(sum(ln(1 - least(p, 0.999)))), 9) AS p FROM evidence GROUP BY 1, 2",
)
def property_summary(d: Domain) -> DataFrame:
    rows = d.evidence().withColumn("is_former", F.col("status") == "R").withColumn("back", -F.col("seq"))
    return rows.groupBy("subject", F.col("relation").alias("facet")).agg(
        aggregates.latest("object", "p", "back").alias("best_object"),
        aggregates.latest("is_former", "created_at", "seq").alias("former"),
        F.count(F.lit(1)).alias("n"),
        F.round(aggregates.noisy_or(F.col("p")), 9).alias("p"),
    )


@query("agg_09_ordered_names", "SELECT link_id, list(name ORDER BY p DESC, name) AS names FROM mentions JOIN entities USING (entity_id) WHERE in_title GROUP BY 1", lists="names")
def ordered_names(d: Domain) -> DataFrame:
    rows = d.mentions().where("in_title").join(d.entities(), "entity_id")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("w"), "name")))
    return rows.groupBy("link_id").agg(F.transform(listed, lambda x: x["name"]).alias("names"))


@query("prj_24_top_labels", "SELECT link_id, list(name ORDER BY p DESC, name)[1:3] AS names FROM mentions JOIN entities USING (entity_id) GROUP BY 1", lists="names")
def top_labels(d: Domain) -> DataFrame:
    return aggregates.top_labels(d.mentions().join(d.entities(), "entity_id"), "link_id", "p", "name", 3)


@query("agg_10_distinct_list", "SELECT link_id, list_sort(list(DISTINCT kind_path)) AS kinds FROM mentions JOIN entities USING (entity_id) GROUP BY 1", lists="kinds")
def distinct_list(d: Domain) -> DataFrame:
    return d.mentions().join(d.entities(), "entity_id").groupBy("link_id").agg(aggregates.set_of(F.col("kind_path")).alias("kinds"))


@query("agg_11_any_qualifies", "SELECT link_id, round(sum(p), 6) AS p FROM mentions GROUP BY 1 HAVING bool_or(in_title)")
def any_qualifies(d: Domain) -> DataFrame:
    return d.mentions().groupBy("link_id").agg(F.round(F.sum("p"), 6).alias("p"), F.bool_or("in_title").alias("_ok")).where("_ok").drop("_ok")


@query("agg_14_joined_text", "SELECT subject, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM evidence GROUP BY 1")
def joined_text(d: Domain) -> DataFrame:
    return d.evidence().groupBy("subject").agg(F.array_join(aggregates.set_of(F.col("status")), ",").alias("statuses"))


@query("agg_16_count_with_zero", "SELECT c_custkey AS voter, count(link_id) AS n FROM customer LEFT JOIN votes ON voter = c_custkey AND value = -1 GROUP BY 1")
def count_with_zero(d: Domain) -> DataFrame:
    down = d.votes().where("value = -1").groupBy("voter").agg(F.count(F.lit(1)).alias("n"))
    return d.raw("customer").select(F.col("c_custkey").alias("voter")).join(down, "voter", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("agg_19_watermarks", "SELECT (SELECT coalesce(max(seq), 0) FROM evidence) AS evidence, (SELECT coalesce(max(event_id), 0) FROM events) AS events, (SELECT coalesce(max(o_orderkey), 0) FROM orders) AS orders")
def watermarks(d: Domain) -> DataFrame:
    tops = [d.evidence().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("evidence")), d.raw("events").agg(F.coalesce(F.max("event_id"), F.lit(0)).alias("events")), d.raw("orders").agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).alias("orders"))]
    return tops[0].crossJoin(tops[1]).crossJoin(tops[2])  # one row each


@query("agg_21_group_lists", "SELECT s_nationkey AS nation, list(s_name ORDER BY s_suppkey) AS names FROM supplier GROUP BY 1", lists="names")
def group_lists(d: Domain) -> DataFrame:
    rows = d.raw("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("x"))
    return rows.select("nation", F.transform("x", lambda r: r["s_name"]).alias("names"))


@query("agg_22_histogram", "SELECT relation, status, count(*) AS n FROM evidence GROUP BY 1, 2")
def histogram(d: Domain) -> DataFrame:
    return d.evidence().groupBy("relation", "status").agg(F.count(F.lit(1)).alias("n"))


@query("agg_24_evidence_revision", "SELECT subject, object, round(sum(2 * c / (1 - c) * s) / sum(2 * c / (1 - c)), 9) AS strength, round(sum(2 * c / (1 - c)) / (sum(2 * c / (1 - c)) + 2), 9) AS confidence FROM (SELECT subject, object, p AS s, 0.3 + p / 2 AS c FROM evidence) GROUP BY 1, 2")
def evidence_revision(d: Domain) -> DataFrame:
    rows = d.evidence().select("subject", "object", F.col("p").alias("s"), (0.3 + F.col("p") / 2).alias("c"))
    strength, confidence = aggregates.revision("s", "c", 2.0)
    return rows.groupBy("subject", "object").agg(F.round(strength, 9).alias("strength"), F.round(confidence, 9).alias("confidence"))


@query("agg_25_percentiles", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def percentiles(d: Domain) -> DataFrame:
    return d.raw("events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("agg_28_geometric_mean", "SELECT subject, round(exp(avg(ln(p))), 9) AS score FROM evidence GROUP BY 1")
def geometric_mean(d: Domain) -> DataFrame:
    return d.evidence().groupBy("subject").agg(F.round(aggregates.geometric_mean(F.col("p")), 9).alias("score"))


@query("agg_30_vote_totals", "SELECT n AS place, link_id, coalesce(ups, 0) AS ups, coalesce(downs, 0) AS downs FROM (SELECT link_id, row_number() OVER (ORDER BY created_at DESC, link_id DESC)::INTEGER AS n FROM links QUALIFY n <= 40) LEFT JOIN counted USING (link_id)")
def vote_totals(d: Domain) -> DataFrame:
    listed = d.links().orderBy(F.desc("created_at"), F.desc("link_id")).limit(40)
    listed = listed.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("link_id"))))
    rows = F.broadcast(listed.select("place", "link_id")).join(ranking.vote_counts(d.votes().join(listed.select("link_id"), "link_id", "left_semi")), "link_id", "left")
    return rows.select("place", "link_id", F.coalesce("ups", F.lit(0)).alias("ups"), F.coalesce("downs", F.lit(0)).alias("downs"))


RELATED = """WITH here AS (SELECT entity_id, p FROM mentions WHERE link_id = 7 AND in_title), here_topics AS (SELECT split_part(topic, '.', 1) || '.' || split_part(topic, '.', 2) AS topic, p FROM labelled WHERE link_id = 7),
by_entity AS (SELECT m.link_id, 2 * sum(m.p * h.p) AS score, list(name ORDER BY m.p * h.p DESC, name) AS names FROM mentions m JOIN here h USING (entity_id) JOIN entities USING (entity_id) WHERE m.in_title AND m.link_id <> 7 GROUP BY 1),
by_topic AS (SELECT l.link_id, sum(l.p * h.p) AS score FROM labelled l JOIN here_topics h ON split_part(l.topic, '.', 1) || '.' || split_part(l.topic, '.', 2) = h.topic WHERE l.link_id <> 7 GROUP BY 1)
SELECT link_id, round(coalesce(e.score, 0) + coalesce(t.score, 0), 9) AS score, coalesce(names, []) AS names FROM by_entity e FULL JOIN by_topic t USING (link_id)"""


@query("q_07_related_links", RELATED, lists="names")
def related_links(d: Domain) -> DataFrame:
    from tidemark.operators.related import related

    topics = d.labels().withColumn("topic", hierarchy.parent(F.col("topic")))
    found = related(d.mentions().where("in_title").join(d.entities(), "entity_id"), topics, 7)
    return found.select("link_id", F.round("score", 9).alias("score"), "names")


@query("q_08_related_feed", f"SELECT r.link_id, r.score, l.title, l.created_at, len(r.names)::INTEGER AS n_names FROM ({RELATED}) r JOIN links l USING (link_id) ORDER BY r.score DESC, l.created_at DESC, r.link_id LIMIT 20")
def related_feed(d: Domain) -> DataFrame:
    rows = related_links(d).join(d.links(), "link_id").select("link_id", "score", "title", "created_at", F.size("names").alias("n_names"))
    return rows.orderBy(F.desc("score"), F.desc("created_at"), "link_id").limit(20)


@query("q_11_entity_links", "SELECT link_id, created_at, p FROM mentions JOIN links USING (link_id) WHERE entity_id = 3 ORDER BY created_at DESC, link_id DESC LIMIT 50")
def entity_links(d: Domain) -> DataFrame:
    rows = d.mentions().where("entity_id = 3").join(d.links(), "link_id").select("link_id", "created_at", "p")
    return rows.orderBy(F.desc("created_at"), F.desc("link_id")).limit(50)


@query("q_18_entity_names", "SELECT entity_id, count(*) AS n, round(max(p), 9) AS p FROM mentions WHERE in_title GROUP BY 1")
def entity_names(d: Domain) -> DataFrame:
    return d.mentions().where("in_title").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("p"), 9).alias("p"))
