"""Changing tables and streams of changes as queries, with their DuckDB twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import change_index, edits, filters, hierarchy, intervals, search, sources_of, states, stores
from tidemark.plans.domain import Domain
from tidemark.plans.registry import query
from tidemark.plans.search_queries import GRAMS
from tidemark.streaming import events


def named(d: Domain) -> DataFrame:
    """(entity_id, name): parts as entities with a name and, for every third, an alias."""
    parts = d.raw("part")
    alias = parts.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("entity_id"), F.concat(F.lower("p_type"), F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("name"))
    return parts.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")).union(alias)


@query(
    "q_13_entity_candidates",
    f"""WITH n AS (SELECT p_partkey AS entity_id, p_name AS name FROM part UNION ALL SELECT p_partkey, lower(p_type) || ' ' || split_part(p_name, ' ', 2) FROM part WHERE p_partkey % 3 = 0),
    g AS (SELECT entity_id, list_transform([name], {GRAMS})[1] AS grams, list_transform(['smal rings'], {GRAMS})[1] AS want FROM n),
    s AS (SELECT entity_id, max(len(list_intersect(grams, want)) / (len(grams) + len(want) - len(list_intersect(grams, want)))) AS sim FROM g GROUP BY 1)
    SELECT entity_id, round(sim, 9) AS similarity FROM s WHERE sim >= 0.3 ORDER BY round(sim, 9) DESC, entity_id LIMIT 8""",
)
def entity_candidates(d: Domain) -> DataFrame:
    """The best name or alias of each entity; the phrase's trigrams select before anything is scored."""
    want = search.trigrams(F.lit("smal rings"))
    grams = named(d).withColumn("grams", search.trigrams(F.col("name"))).where(F.arrays_overlap("grams", want))
    rows = grams.groupBy("entity_id").agg(F.max(search.similarity(F.col("grams"), want)).alias("sim")).where("sim >= 0.3")
    return rows.select("entity_id", F.round("sim", 9).alias("similarity")).orderBy(F.desc("similarity"), "entity_id").limit(8)


@query(
    "q_14_match_entities",
    """WITH w AS (SELECT link_id, title, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM links WHERE brand <> 'Brand#5'), h AS (SELECT link_id, title, len(ws) AS n, len(list_filter(ws, lambda x: x IN ('rings', 'ringss', 'ringses', 'ring') OR starts_with(x, 'sma'))) AS hits FROM w),
    p AS (SELECT link_id, count(*) AS posts FROM mentions GROUP BY 1) SELECT link_id, title, n::INTEGER AS n, hits::INTEGER AS hits FROM h LEFT JOIN p USING (link_id) WHERE n > 0 AND 2 * hits >= n ORDER BY hits::DOUBLE / n DESC, coalesce(posts, 0) DESC, length(title), link_id LIMIT 10""",
)
def match_entities(d: Domain) -> DataFrame:
    """Names hit by half of their words at least; one brand is left out; the most hit, most posted, shortest ten."""
    rows = search.match_names(d.links().where("brand <> 'Brand#5'").select("link_id", F.col("title").alias("name")), ["Rings"], "sma")
    posts = d.mentions().groupBy("link_id").agg(F.count(F.lit(1)).alias("posts"))
    rows = rows.join(posts, "link_id", "left").orderBy(F.desc(F.col("hits") / F.col("n")), F.desc(F.coalesce("posts", F.lit(0))), F.length("name"), "link_id").limit(10)
    return rows.select("link_id", F.col("name").alias("title"), "n", "hits")


SENSES = """CASE o_orderkey % 9 WHEN 0 THEN 'topic' WHEN 1 THEN 'time' WHEN 2 THEN 'time' WHEN 3 THEN 'entity' WHEN 4 THEN 'period' WHEN 5 THEN 'period' WHEN 6 THEN 'kind' WHEN 7 THEN NULL ELSE 'topic' END"""


@query(
    "q_22_filter_sense",
    f"""WITH g AS (SELECT o_orderkey AS id, o_orderdate + to_hours((o_orderkey % 24)::BIGINT) AS moment, {SENSES} AS key FROM orders),
    t AS (SELECT *, id % 9 AS m, CASE WHEN hour(moment) < 4 THEN CAST(moment AS DATE) - 1 ELSE CAST(moment AS DATE) END AS day FROM g)
    SELECT id, CASE WHEN m IN (2, 5, 7, 8) OR (m = 3 AND id % 2 = 0) OR (m = 6 AND id % 2 = 0) THEN NULL WHEN m = 1 THEN 'period' ELSE key END AS key,
      CASE m WHEN 0 THEN 'ECONOMY.B' || id WHEN 1 THEN strftime(day + INTERVAL 18 HOUR, '%Y-%m-%d %H:%M:%S') || '|' || strftime(day + INTERVAL 28 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 3 THEN CASE WHEN id % 2 = 1 THEN id::VARCHAR END
        WHEN 4 THEN strftime(moment, '%Y-%m-%d %H:%M:%S') || '|' || strftime(moment + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 6 THEN CASE WHEN id % 2 = 1 THEN 'EUROPE.FRANCE' END END AS value,
      CASE WHEN m IN (7, 8) THEN 'exactly one of entity, kind, topic and period' WHEN m = 2 THEN 'unknown time: someday' WHEN m = 5 THEN 'a period ends after it starts' WHEN m = 3 AND id % 2 = 0 THEN 'an entity is a number' WHEN m = 6 AND id % 2 = 0 THEN 'bad path: a b' END AS error FROM t""",
)
def filter_sense(d: Domain) -> DataFrame:
    """Stored filters, one to an order: one key each, a named time as said at the order's moment, errors by fixed messages."""
    key, m = F.col("o_orderkey"), F.col("o_orderkey") % 9
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(key % 24).cast("int"))
    hour = F.make_dt_interval(hours=F.lit(1))
    said = lambda a, b: F.concat_ws("|", F.date_format(a, "yyyy-MM-dd HH:mm:ss"), F.date_format(b, "yyyy-MM-dd HH:mm:ss"))
    one = lambda name, value: F.create_map(F.lit(name), value)
    given = F.when(m == 0, one("topic", F.concat(F.lit("ECONOMY.B"), key.cast("string")))).when(m == 1, one("time", F.lit("tonight"))).when(m == 2, one("time", F.lit("someday")))
    given = given.when(m == 3, one("entity", F.when(key % 2 == 1, key.cast("string")).otherwise("x"))).when(m == 4, one("period", said(at, at + hour))).when(m == 5, one("period", said(at, at)))
    given = given.when(m == 6, one("kind", F.when(key % 2 == 1, "EUROPE.FRANCE").otherwise("a b"))).when(m == 8, F.create_map(F.lit("topic"), F.lit("a"), F.lit("kind"), F.lit("b")))
    sense = filters.read_senses(given, at)
    return d.raw("orders").select(key.alias("id"), sense["key"].alias("key"), sense["value"].alias("value"), sense["error"].alias("error"))


@query("q_25_place_paths", "SELECT entity_id, split_part(kind_path, '.', 2) AS label, split_part(kind_path, '.', 1) AS parent, starts_with(kind_path || '.', 'ASIA.') AS in_asia, split_part(kind_path, '.', 1) || '|' || kind_path AS ancestors FROM entities")
def place_paths(d: Domain) -> DataFrame:
    path = F.col("kind_path")
    return d.entities().select("entity_id", hierarchy.label(path).alias("label"), hierarchy.parent(path).alias("parent"), hierarchy.within(path, "ASIA").alias("in_asia"), F.array_join(hierarchy.prefixes(path), "|").alias("ancestors"))


@query("q_25_place_subtree", "SELECT entity_id, name FROM entities WHERE kind_path = 'EUROPE' OR starts_with(kind_path, 'EUROPE.')")
def place_subtree(d: Domain) -> DataFrame:
    roots = d.raw("region").where("r_name = 'EUROPE'").select(F.col("r_name").alias("root"))
    return hierarchy.descendants_join(d.entities(), "kind_path", roots, "root").select("entity_id", "name")


DROPS = "drops AS (SELECT o_orderkey AS edit_id, 1 + o_orderkey % 200 AS link_id, o_custkey % 10 AS entity_id, CASE WHEN o_orderkey % 4 = 0 THEN 'applied' ELSE 'staged' END AS status FROM orders)"


def drops(d: Domain) -> DataFrame:
    """Staged and applied drops of mentions, made from orders."""
    key = F.col("o_orderkey")
    return d.raw("orders").select(key.alias("edit_id"), (1 + key % 200).alias("link_id"), (F.col("o_custkey") % 10).alias("entity_id"), F.when(key % 4 == 0, "applied").otherwise("staged").alias("status"))


@query("q_29_dropped_mentions", f"WITH {DROPS} SELECT link_id, entity_id, p FROM mentions WHERE (link_id, entity_id) NOT IN (SELECT (link_id, entity_id) FROM drops WHERE status = 'staged')")
def dropped_mentions(d: Domain) -> DataFrame:
    return states.drop_mentions(d.mentions(), drops(d))[0].select("link_id", "entity_id", "p")


@query("q_29_edit_states", f"WITH {DROPS} SELECT edit_id, CASE WHEN status = 'staged' AND there THEN 'applied' ELSE status END AS status, CASE WHEN status <> 'staged' THEN 'not staged' WHEN NOT there THEN 'no such mention' END AS refusal FROM (SELECT *, (link_id, entity_id) IN (SELECT (link_id, entity_id) FROM mentions) AS there FROM drops)")
def edit_states(d: Domain) -> DataFrame:
    return states.drop_mentions(d.mentions(), drops(d))[2].select("edit_id", "status", "refusal")


@query("q_30_undo_refusals", f"WITH {DROPS}, t AS (SELECT edit_id, unnest([link_id, 100000 + entity_id]) AS id FROM drops WHERE status = 'applied'), l AS (SELECT id, max(edit_id) AS last FROM t GROUP BY 1) SELECT edit_id, CASE WHEN max(last) > edit_id THEN 'undo edit ' || max(last) || ' first' END AS refusal FROM t JOIN l USING (id) GROUP BY 1")
def undo_refusals(d: Domain) -> DataFrame:
    applied = drops(d).where("status = 'applied'").select("edit_id", F.array("link_id", 100000 + F.col("entity_id")).alias("touched"))
    return states.undo_order(applied)


LINKED = "t AS (SELECT DISTINCT link_id, entity_id % 7 AS source FROM mentions WHERE link_id % 2 = 0), s AS (SELECT link_id, link_id % 7 AS source FROM links WHERE link_id % 5 <> 0)"


@query("q_33_retagged_links", f"WITH {LINKED} SELECT coalesce(t.link_id, s.link_id) AS link_id, coalesce(t.source, s.source) AS source, CASE WHEN s.link_id IS NULL THEN 'remove' ELSE 'add' END AS change FROM t FULL JOIN s ON t.link_id = s.link_id AND t.source = s.source WHERE t.link_id IS NULL OR s.link_id IS NULL")
def retagged_links(d: Domain) -> DataFrame:
    tags = d.mentions().where("link_id % 2 = 0").select("link_id", (F.col("entity_id") % 7).alias("source"))
    links = d.links().select("link_id", F.when(F.col("link_id") % 5 != 0, F.col("link_id") % 7).alias("source_id"), F.lit(None).cast("string").alias("handle"), F.lit(None).cast("string").alias("host"))
    sources = d.spark.createDataFrame([], "source_id long, handle string, host string")
    return states.retagged(tags, sources_of.link_sources(links, sources))


@query("q_35_mark_read", "SELECT count(*) FILTER (conv_id = 3 AND turn % 2 = 0 AND turn > 0) AS n FROM conversations")
def mark_read(d: Domain) -> DataFrame:
    """Of the notes asked for, one recipient's own unread ones."""
    notes = d.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), F.col("conv_id").alias("recipient"), (F.col("turn") % 2 == 1).alias("read"))
    return states.mark_read(notes, 3, notes.where("note_id % 1000 > 0"))[1]


PROPOSED = "p AS (SELECT o_orderkey AS id, o_custkey AS person, CASE o_orderkey % 4 WHEN 0 THEN 'ECONOMY.New' || o_orderkey WHEN 1 THEN 'ECONOMY' WHEN 2 THEN 'Nowhere.x' ELSE (SELECT min(topic) FROM labelled) END AS topic FROM orders)"


@query(
    "q_36_proposals",
    f"""WITH {PROPOSED}, inn AS (SELECT DISTINCT split_part(topic, '.', 1) || '.' || split_part(topic, '.', 2) AS topic FROM labelled), up AS (SELECT topic FROM inn UNION SELECT split_part(topic, '.', 1) FROM inn)
    SELECT id AS proposal_id, person, topic, CASE WHEN row_number() OVER (PARTITION BY person ORDER BY id) > 5 THEN 'too many open proposals' WHEN topic IN (SELECT topic FROM inn UNION SELECT split_part(topic, '.', 1) FROM inn) THEN 'not a leaf' WHEN topic IN (SELECT topic FROM labelled) THEN 'already a topic'
      WHEN array_to_string(string_split(topic, '.')[1:-2], '.') NOT IN (SELECT topic FROM up UNION SELECT topic FROM labelled) THEN 'no such parent' END AS refusal FROM p""",
)
def proposals(d: Domain) -> DataFrame:
    least = d.labels().agg(F.min("topic").alias("least"))
    key = F.col("o_orderkey")
    rows = d.raw("orders").crossJoin(F.broadcast(least))  # one row
    topic = F.when(key % 4 == 0, F.concat(F.lit("ECONOMY.New"), key)).when(key % 4 == 1, "ECONOMY").when(key % 4 == 2, "Nowhere.x").otherwise(F.col("least"))
    tree = hierarchy.with_ancestors(d.labels().select("topic").distinct(), "topic", "at").select(F.col("at").alias("topic")).distinct()
    return states.proposal_refusals(rows.select(key.alias("proposal_id"), F.col("o_custkey").alias("person"), topic.alias("topic")), tree)


DECIDED = """pr AS (SELECT o_orderkey AS id, o_custkey AS person, CASE WHEN o_orderkey % 7 = 0 THEN (SELECT min(topic) FROM labelled) ELSE 'ECONOMY.New' || (o_orderkey // 4) END AS topic, CASE WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'open' END AS status FROM orders),
    de AS (SELECT o_orderkey + (o_orderkey % 5 = 0)::BIGINT AS id, o_orderkey % 3 = 0 AS accept, o_orderkey AS moment FROM orders WHERE o_orderkey % 3 <> 2),
    turns AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY moment, accept DESC) AS turn FROM de),
    makers AS (SELECT topic, min(id) AS maker FROM pr JOIN turns USING (id) WHERE accept AND status = 'open' AND turn = 1 GROUP BY 1),
    judged AS (SELECT id, accept, person, topic, CASE WHEN status IS NULL OR status <> 'open' THEN 'no open proposal' WHEN turn > 1 THEN 'decided already' WHEN accept AND (topic IN (SELECT topic FROM labelled) OR id <> maker) THEN 'already a topic' END AS refusal
      FROM turns LEFT JOIN pr USING (id) LEFT JOIN makers USING (topic))"""


def decided_proposals(d: Domain) -> states.Proposals:
    """Orders as proposals, four neighbours for one topic; two decisions in three orders, some of them on the next one."""
    key = F.col("o_orderkey")
    orders, least = d.raw("orders"), d.labels().agg(F.min("topic").alias("least"))
    topic = F.when(key % 7 == 0, F.col("least")).otherwise(F.concat(F.lit("ECONOMY.New"), F.floor(key / 4).cast("string")))
    proposals = orders.crossJoin(F.broadcast(least)).select(key.alias("proposal_id"), F.col("o_custkey").alias("person"), topic.alias("topic"), F.concat(F.lit(" New "), key).alias("name"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("open").alias("status"))  # one row
    decisions = orders.where(key % 3 != 2).select((key + (key % 5 == 0).cast("long")).alias("proposal_id"), (key % 3 == 0).alias("accept"), key.alias("at"))
    examples = d.raw("lineitem").select(F.col("l_orderkey").alias("proposal_id"), F.col("l_partkey").alias("link_id"), (0.5 + F.col("l_discount")).alias("p"))
    return states.decide_proposals(proposals, decisions, d.labels().select("topic"), examples, d.labels())


@query("q_36_decisions", f"WITH {DECIDED} SELECT id AS proposal_id, accept, refusal FROM judged")
def proposal_decisions(d: Domain) -> DataFrame:
    return decided_proposals(d).decisions


@query("q_36_decided_proposals", f"WITH {DECIDED} SELECT pr.id AS proposal_id, CASE WHEN accept THEN 'accepted' WHEN NOT accept THEN 'rejected' ELSE status END AS status FROM pr LEFT JOIN (SELECT * FROM judged WHERE refusal IS NULL) j ON j.id = pr.id")
def proposals_after(d: Domain) -> DataFrame:
    return decided_proposals(d).proposals.select("proposal_id", "status")


@query("q_36_accepted_topics", f"WITH {DECIDED} SELECT topic, 'New ' || id AS name, person AS proposed_by FROM judged WHERE accept AND refusal IS NULL")
def accepted_topics(d: Domain) -> DataFrame:
    return decided_proposals(d).topics


@query("q_36_accepted_labels", f"WITH {DECIDED} SELECT l_partkey AS link_id, topic, max(0.5::DOUBLE + l_discount) AS p, 'manual' AS labeled_by FROM lineitem JOIN judged ON id = l_orderkey WHERE accept AND refusal IS NULL GROUP BY 1, 2")
def accepted_labels(d: Domain) -> DataFrame:
    return decided_proposals(d).labels


@query(
    "q_38_federated_claims",
    "SELECT event_id, CASE WHEN user_id % 4 <> 0 AND user_id <> 7 AND (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts >= a.ts - INTERVAL 1 HOUR AND b.ts < a.ts) < 2 THEN 'sent' ELSE 'refused' END AS status FROM events a WHERE event_type IN ('purchase', 'view')",
)
def federated_claims(d: Domain) -> DataFrame:
    """Replies are sent where the handle is valid and not reserved, and their author wrote few in the last hour."""
    window = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, -1)
    rows = d.raw("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("before", F.count(F.lit(1)).over(window))
    handle = F.when(F.col("user_id") % 4 == 0, "no handle!").when(F.col("user_id") == 7, "admin").otherwise(F.concat(F.lit("u"), "user_id"))
    queue = rows.withColumn("handle", handle).withColumn("status", F.when(F.col("event_type").isin("purchase", "view"), "pending").otherwise("sent"))
    allowed = F.col("handle").rlike("^[a-z0-9_]+$") & ~F.col("handle").isin("admin", "root") & (F.col("before") < states.MOST_HOURLY)
    return states.decided(queue, allowed).select("event_id", "status")


@query("q_43_token_states", "WITH c AS (SELECT event_id, sha256('t' || (event_id % 97)) AS token, user_id AS owner, CASE event_type WHEN 'signup' THEN 'request' WHEN 'click' THEN 'approve' WHEN 'error' THEN CASE WHEN event_id % 9 = 0 THEN 'revoke' ELSE 'look' END ELSE 'look' END AS action FROM events), k AS (SELECT token, arg_min(owner, event_id) AS owner, min(event_id) FILTER (action = 'request') AS r, max(event_id) FILTER (action = 'approve') AS a, bool_or(action = 'revoke') AS x FROM c WHERE action <> 'look' GROUP BY 1) SELECT token, owner, CASE WHEN x THEN 'revoked' WHEN a > r THEN 'active' ELSE 'pending' END AS state FROM k WHERE r IS NOT NULL")
def token_states(d: Domain) -> DataFrame:
    action = F.when(F.col("event_type") == "signup", "request").when(F.col("event_type") == "click", "approve").when((F.col("event_type") == "error") & (F.col("event_id") % 9 == 0), "revoke").otherwise("look")
    changes = d.raw("events").select("event_id", F.sha2(F.concat(F.lit("t"), F.col("event_id") % 97), 256).alias("token"), F.col("user_id").alias("owner"), action.alias("action"))
    return states.token_states(changes, "token", "event_id")


@query("q_44_outboxes", "SELECT o_custkey AS author, o_orderkey AS post, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders QUALIFY place <= 10")
def outboxes(d: Domain) -> DataFrame:
    """Every author's first page: the ten newest posts."""
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = d.raw("orders").withColumn("place", F.row_number().over(newest)).where("place <= 10")
    return rows.select(F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("post"), F.col("place").cast("long").alias("place"))


SOURCES = "src AS (SELECT c_custkey AS source_id, CASE WHEN c_custkey % 3 = 0 THEN 'SUPPLIER#' || lpad((c_custkey % 12)::VARCHAR, 9, '0') ELSE 'Feed ' || (c_custkey % 20) END AS name, 'source' AS kind FROM customer), ent AS (SELECT lower(s_name) AS key, min(s_suppkey) AS id FROM supplier GROUP BY 1)"


def sources(d: Domain) -> tuple[DataFrame, DataFrame]:
    key = F.col("c_custkey")
    name = F.when(key % 3 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad((key % 12).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("Feed "), key % 20))
    given = d.raw("customer").select(key.alias("source_id"), name.alias("name"), F.lit("source").alias("kind"))
    return given, d.raw("supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.lit("source").alias("kind"))


@query("q_45_source_entities", f"WITH {SOURCES}, f AS (SELECT lower(name) AS key, -min(source_id) AS id FROM src WHERE lower(name) NOT IN (SELECT key FROM ent) GROUP BY 1) SELECT source_id, coalesce(ent.id, f.id) AS entity_id FROM src LEFT JOIN ent ON ent.key = lower(name) LEFT JOIN f ON f.key = lower(name)")
def source_entities(d: Domain) -> DataFrame:
    return states.source_entities(*sources(d))[0]


@query("q_45_created_entities", f"WITH {SOURCES} SELECT -min(source_id) AS entity_id, arg_min(name, source_id) AS name, 'source' AS kind FROM src WHERE lower(name) NOT IN (SELECT key FROM ent) GROUP BY lower(name)")
def created_entities(d: Domain) -> DataFrame:
    return states.source_entities(*sources(d))[1]


@query("q_46_merge_refusals", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'sign in before merging' WHEN o_orderkey % 3 = 0 THEN 'only an anonymous session can be merged' WHEN o_orderkey % 5 = 0 THEN 'that session is already this account' END AS refusal FROM orders")
def merge_refusals(d: Domain) -> DataFrame:
    key = F.col("o_orderkey")
    pairs = d.raw("orders").select(key.alias("id"), key.alias("session"), (key % 3 != 0).alias("session_anonymous"), F.when(key % 5 == 0, key).otherwise(-key).alias("account"), F.when(key % 2 != 0, F.lit(False)).alias("account_anonymous"))
    return states.merge_plans(pairs).select("id", "refusal")


@query("str_02_fan_out", "SELECT event_id, recipient FROM (SELECT event_id, unnest([user_id, (user_id + 1) % 15]) AS recipient FROM events WHERE event_type = 'click') WHERE recipient % 2 = 0")
def fan_out(d: Domain) -> DataFrame:
    """Every click of a stream notifies its user and the next one, who must be followers (a static table)."""
    followers = d.raw("events").select(F.col("user_id").alias("recipient")).where("recipient % 2 = 0").union(d.spark.range(0, 16, 2).select(F.col("id").alias("recipient"))).distinct()
    clicks = events.read_events(d.spark, d.sf_dir).where("event_type = 'click'")
    sent = clicks.select("event_id", F.explode(F.array("user_id", (F.col("user_id") + 1) % 15)).alias("recipient"))
    return events.finished(sent.join(followers, "recipient").select("event_id", "recipient"))


VERSIONS = "o AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0)"


@query("str_03_transitions", f"WITH {VERSIONS} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS change FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.s <> n.s")
def transitions(d: Domain) -> DataFrame:
    return states.changes_of(*versions(d), ["id"])


def versions(d: Domain) -> tuple[DataFrame, DataFrame]:
    rows = d.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    return rows.where("id % 7 <> 0"), rows.where("id % 11 <> 0").withColumn("s", F.when(F.col("id") % 5 == 0, "X").otherwise(F.col("s")))


@query("str_05_backfill", "SELECT user_id, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def backfill(d: Domain) -> DataFrame:
    """The batch aggregate that an incremental one must equal."""
    return d.raw("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("str_06_change_log", f"WITH {VERSIONS} SELECT coalesce(o.id, n.id) AS id, row_number() OVER (ORDER BY coalesce(o.id, n.id)) AS seq FROM o FULL JOIN n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR o.s <> n.s")
def change_log(d: Domain) -> DataFrame:
    """Touched keys numbered in their order, deleted ones too; numbers come from a range sort, not from one task."""
    from tidemark.operators.aggregates import numbered

    return numbered(states.changes_of(*versions(d), ["id"]).select("id"), "id", "seq")


@query("str_07_watermarks", "SELECT 'events' AS source, max(event_id) AS seq FROM events UNION ALL SELECT 'orders', max(o_orderkey) FROM orders UNION ALL SELECT 'lines', max(l_orderkey * 10 + l_linenumber) FROM lineitem")
def watermarks(d: Domain) -> DataFrame:
    tops = (("events", d.raw("events"), F.col("event_id")), ("orders", d.raw("orders"), F.col("o_orderkey")), ("lines", d.raw("lineitem"), F.col("l_orderkey") * 10 + F.col("l_linenumber")))
    parts = [rows.agg(F.max(seq).alias("seq")).select(F.lit(name).alias("source"), "seq") for name, rows, seq in tops]
    return parts[0].union(parts[1]).union(parts[2])


@query("str_12_generations", "SELECT user_id, 3 + bool_or(event_type = 'error')::INTEGER AS gen FROM events GROUP BY 1")
def generations(d: Domain) -> DataFrame:
    kinds = d.raw("events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.select("user_id", states.generation(F.col("kinds"), ("view", "click", "purchase", "signup"), F.lit(3)).alias("gen"))


@query("str_13_snapshot_policy", "SELECT o_orderkey, o_orderkey % 10 = 0 OR (o_orderkey % 2 = 0 AND (o_orderkey % 5000 >= 3600 OR o_orderkey % 1300 >= 1000)) AS rebuild FROM orders")
def snapshot_policy(d: Domain) -> DataFrame:
    key = F.col("o_orderkey")
    return d.raw("orders").select("o_orderkey", states.must_rebuild(key % 10 == 0, key % 2 == 0, key % 5000, key % 1300).alias("rebuild"))


@query("str_16_decay", "SELECT event_id, value * power(0.5, greatest(date_diff('microsecond', ts, TIMESTAMP '2024-02-01'), 0) / 86400000000.0) AS score FROM events")
def decay(d: Domain) -> DataFrame:
    from tidemark.operators import ranking

    return d.raw("events").select("event_id", (F.col("value") * ranking.decay(F.col("ts"), datetime(2024, 2, 1), 1.0, 1e6)).alias("score"))


@query("str_17_stream_intervals", "SELECT event_id, CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'afternoon' END AS period FROM events WHERE day(ts) IN (3, 4)")
def stream_intervals(d: Domain) -> DataFrame:
    """Events of a stream with the named periods that they fall in: an equi-join on the day, then the bounds."""
    periods = [(day, name, a, b) for day in (3, 4) for name, a, b in (("morning", 0, 12), ("afternoon", 12, 24))]
    named_periods = d.spark.createDataFrame(periods, "day int, period string, a int, b int")
    rows = events.read_events(d.spark, d.sf_dir).withColumn("day", F.dayofmonth("ts")).join(F.broadcast(named_periods), "day")
    return events.finished(rows.where((F.hour("ts") >= F.col("a")) & (F.hour("ts") < F.col("b"))).select("event_id", "period"))


@query("str_18_work_queue", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def work_queue(d: Domain) -> DataFrame:
    done = d.raw("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return states.work(d.raw("orders").where("o_orderstatus <> 'F'"), done, "o_orderkey", "o_orderdate", 25).select("o_orderkey")


@query("str_20_delivered_once", "SELECT event_id, 1 AS deliveries FROM events WHERE event_type = 'purchase'")
def delivered_once(d: Domain) -> DataFrame:
    """A batch that is run again replaces its own delivery: the sink's folders are named by batch."""
    import uuid

    from tidemark.session import shared_folder

    folder = f"{shared_folder(d.spark)}/deliveries-{uuid.uuid4().hex}"
    rows = events.read_events(d.spark, d.sf_dir).where("event_type = 'purchase'").select("event_id")

    def deliver(batch: DataFrame, number: int) -> None:
        for _ in range(2):  # as after a failure between delivery and commit
            batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    events.finished(rows, each=deliver)
    return d.spark.read.schema("event_id long").parquet(folder).groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("deliveries"))


@query("str_25_new_profiles", "SELECT DISTINCT user_id, 'user' || user_id AS handle FROM events")
def new_profiles(d: Domain) -> DataFrame:
    """A profile for each user, when their first event comes; later batches find it there."""
    import uuid

    from tidemark.session import shared_folder

    folder = f"{shared_folder(d.spark)}/profiles-{uuid.uuid4().hex}"
    schema = "user_id long, handle string"

    def create(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(schema).parquet(*[f"{folder}/{k}" for k in range(number)]) if number else spark.createDataFrame([], schema)
        new = batch.select("user_id", F.concat(F.lit("user"), "user_id").alias("handle")).distinct()
        new.join(old, "user_id", "left_anti").write.mode("overwrite").parquet(f"{folder}/{number}")

    from tidemark.plans.streaming_queries import thirds

    events.finished(events.staged_stream(d.spark, thirds(d)), each=create)
    return d.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


@query("str_26_published", "SELECT 'gen4-9.json.gz' AS path, 4 AS gen, 9::BIGINT AS l, (SELECT max(event_id) FROM events) AS e")
def published(d: Domain) -> DataFrame:
    top = d.raw("events").agg(F.max("event_id").alias("e")).first()["e"]  # one number
    state = d.spark.createDataFrame([("gen3-1.json.gz",)], "path string")
    return states.published(state, "gen4-9.json.gz", 4, {"l": 9, "e": top})


@query("snk_04_pending_upsert", "SELECT user_id AS owner, event_type AS page, max(ts) AS renewed, 'pending' AS status, count(*) AS requests FROM events GROUP BY 1, 2")
def pending_upsert(d: Domain) -> DataFrame:
    """One pending row for each owner and page: a new request renews its time."""
    rows = d.raw("events").groupBy(F.col("user_id").alias("owner"), F.col("event_type").alias("page"))
    return rows.agg(F.max("ts").alias("renewed"), F.lit("pending").alias("status"), F.count(F.lit(1)).alias("requests"))


@query("snk_06_bounded_decrement", "SELECT o_custkey AS account, greatest(count(*) - count(*) FILTER (o_orderstatus = 'F') - 8, 0)::BIGINT AS used FROM orders GROUP BY 1")
def bounded_decrement(d: Domain) -> DataFrame:
    used = F.count(F.lit(1)) - F.count_if(F.col("o_orderstatus") == "F") - 8
    return d.raw("orders").groupBy(F.col("o_custkey").alias("account")).agg(F.greatest(used, F.lit(0)).cast("long").alias("used"))


@query(
    "snk_04_merged_pending",
    """WITH stored AS (SELECT user_id AS owner, event_type AS page, CASE WHEN user_id % 3 = 0 THEN 'active' ELSE 'pending' END AS status, max(ts) AS renewed, count(*) AS requests FROM events WHERE day(ts) <= 10 AND user_id % 7 <> 0 GROUP BY 1, 2, 3),
    asked AS (SELECT user_id AS owner, event_type AS page, max(ts) AS renewed, count(*) AS n FROM events WHERE day(ts) > 20 AND user_id % 5 <> 0 GROUP BY 1, 2)
    SELECT * FROM stored WHERE status = 'active' UNION ALL
    SELECT coalesce(s.owner, a.owner), coalesce(s.page, a.page), 'pending', greatest(s.renewed, a.renewed), coalesce(s.requests, 0) + coalesce(n, 0) FROM (SELECT * FROM stored WHERE status = 'pending') s FULL JOIN asked a ON s.owner = a.owner AND s.page = a.page""",
)
def merged_pending(d: Domain) -> DataFrame:
    """Requests of the last days meet stored rows of the first ones: pending rows are renewed or made, active ones stay as they are."""
    rows = d.raw("events").select(F.col("user_id").alias("owner"), F.col("event_type").alias("page"), F.col("ts").alias("renewed"), F.dayofmonth("ts").alias("day"))
    status = F.when(F.col("owner") % 3 == 0, "active").otherwise("pending")
    stored = rows.where("day <= 10 and owner % 7 <> 0").groupBy("owner", "page", status.alias("status")).agg(F.max("renewed").alias("renewed"), F.count(F.lit(1)).alias("requests"))
    return stores.merge_pending(stored, rows.where("day > 20 and owner % 5 <> 0").select("owner", "page", "renewed"), ["owner", "page"], "renewed")


def used(d: Domain) -> DataFrame:
    """(account, used): what accounts have used before."""
    rows = d.raw("orders").where("o_orderstatus = 'F' and o_custkey % 4 <> 0").groupBy(F.col("o_custkey").alias("account"))
    return rows.agg(F.least(F.count(F.lit(1)), F.lit(10)).alias("used"))


def spending(d: Domain) -> DataFrame:
    asks = d.raw("orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("ask"))
    return stores.spend(used(d), asks, "account", "ask", 12)


USED = "used AS (SELECT o_custkey AS account, least(count(*), 10) AS used FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 <> 0 GROUP BY 1), asks AS (SELECT o_custkey AS account, o_orderkey AS ask, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O')"


@query("snk_05_spent_credit", f"WITH {USED} SELECT account, ask, CASE WHEN coalesce(used, 0) + place <= 12 THEN 12 - coalesce(used, 0) - place END AS remaining FROM asks LEFT JOIN used USING (account)")
def spent_credit(d: Domain) -> DataFrame:
    """What each ask is told: how much the limit leaves, nothing where it is used up."""
    return spending(d)


@query(
    "snk_06_refunded_credit",
    f"WITH {USED}, total AS (SELECT coalesce(u.account, a.account) AS account, coalesce(used, 0) + least(coalesce(n, 0), 12 - coalesce(used, 0)) AS used FROM used u FULL JOIN (SELECT account, count(*) AS n FROM asks GROUP BY 1) a ON a.account = u.account) "
    "SELECT account, greatest(used - coalesce(n, 0), 0)::BIGINT AS used FROM total LEFT JOIN (SELECT o_custkey AS account, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) USING (account)",
)
def refunded_credit(d: Domain) -> DataFrame:
    """Counters after the asks, less what is given back."""
    refunds = d.raw("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("account"))
    return stores.refund(stores.after_spending(used(d), spending(d), "account"), refunds, "account")


@query(
    "join_26_both_ways",
    "WITH touched AS (SELECT DISTINCT l_partkey AS link_id, l_suppkey AS entity_id FROM lineitem WHERE l_orderkey % 3 = 0), present AS (SELECT l_partkey AS link_id, l_suppkey AS entity_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) "
    "SELECT coalesce(t.link_id, p.link_id) AS link_id, coalesce(t.entity_id, p.entity_id) AS entity_id, t.link_id IS NOT NULL AS touched, p.n IS NOT NULL AS there, coalesce(p.n, 0) AS n FROM touched t FULL JOIN present p ON t.link_id = p.link_id AND t.entity_id = p.entity_id",
)
def both_ways(d: Domain) -> DataFrame:
    """Keys of the change log and of the table: which touched ones are there, and which are there untouched."""
    rows = d.raw("lineitem").select(F.col("l_partkey").alias("link_id"), F.col("l_suppkey").alias("entity_id"), "l_orderkey", "l_returnflag")
    return stores.presence(rows.where("l_orderkey % 3 = 0"), rows.where("l_returnflag = 'R'"), ["link_id", "entity_id"])


@query("snk_07_claimed_rows", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'sent' ELSE 'refused' END AS status FROM orders WHERE o_orderstatus = 'P' OR o_orderstatus = 'O'")
def claimed_rows(d: Domain) -> DataFrame:
    queue = d.raw("orders").withColumn("status", F.when(F.col("o_orderstatus").isin("P", "O"), "pending").otherwise("sent"))
    return states.decided(queue, F.col("o_totalprice") > 100000).select("o_orderkey", "status")


@query("snk_08_snapshot_files", "SELECT (SELECT count(*) FROM mentions) AS rows, 'gen2-40.json.gz|gen2-39.json.gz|gen2-8.json.gz' AS kept")
def snapshot_files(d: Domain) -> DataFrame:
    """A snapshot written as compressed JSON and read back; of the files there are, the newest three stay."""
    import uuid

    from tidemark.session import shared_folder

    path = f"{shared_folder(d.spark)}/snapshot-{uuid.uuid4().hex}"
    d.mentions().select("link_id", "entity_id").write.option("compression", "gzip").json(path)
    back = d.spark.read.schema("link_id long, entity_id long").json(path).agg(F.count(F.lit(1)).alias("rows"))
    files = d.spark.createDataFrame([(f"gen{g}-{s}.json.gz", g, s) for g, s in ((1, 90), (2, 8), (2, 40), (2, 39), (1, 7))], "name string, gen int, seq int")
    kept = states.newest_snapshots(files).where("kept").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("gen", "seq", "name")))), lambda x: x["name"]), "|").alias("kept"))
    return back.crossJoin(kept)  # one row each


@query("snk_09_delta_round_trip", "SELECT entity_id, count(DISTINCT link_id) AS n, true AS same FROM mentions GROUP BY 1")
def delta_round_trip(d: Domain) -> DataFrame:
    rows = d.mentions().groupBy("entity_id").agg(F.sort_array(F.collect_set("link_id")).alias("ids"))
    back = change_index.undeltas(change_index.deltas(F.col("ids")))
    return rows.select("entity_id", F.size("ids").cast("long").alias("n"), (back == F.col("ids")).alias("same"))


@query("snk_11_audit_log", "SELECT event_type, count(*) AS calls, sum(length(props))::BIGINT AS tokens FROM events GROUP BY 1")
def audit_log(d: Domain) -> DataFrame:
    """Calls appended batch by batch, counted over the whole log."""
    import uuid

    from tidemark.session import shared_folder
    from tidemark.plans.streaming_queries import thirds

    path = f"{shared_folder(d.spark)}/calls-{uuid.uuid4().hex}"
    for part in thirds(d):
        part.select("event_id", "event_type", F.length("props").alias("tokens")).write.mode("append").parquet(path)
    log = d.spark.read.schema("event_id long, event_type string, tokens int").parquet(path)
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))


@query("join_07_lateral", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)")
def lateral(d: Domain) -> DataFrame:
    """The two largest orders of each customer: a lateral join as a ranked one."""
    best = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = d.raw("orders").withColumn("n", F.row_number().over(best)).where("n <= 2")
    return d.raw("customer").join(top, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("join_10_containment", "SELECT t.topic, count(*) AS n FROM labelled l JOIN (SELECT DISTINCT split_part(topic, '.', 1) || '.' || split_part(topic, '.', 2) AS topic FROM labelled) t ON l.topic = t.topic OR starts_with(l.topic, t.topic || '.') GROUP BY 1")
def containment(d: Domain) -> DataFrame:
    roots = d.labels().select(F.array_join(F.slice(F.split("topic", r"\."), 1, 2), ".").alias("root")).distinct()
    return hierarchy.descendants_join(d.labels(), "topic", roots, "root").groupBy(F.col("root").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@query("join_20_one_row_parameters", "SELECT event_id, value / (SELECT max(value) FROM events) AS share FROM events")
def one_row_parameters(d: Domain) -> DataFrame:
    top = d.raw("events").agg(F.max("value").alias("top"))
    return d.raw("events").crossJoin(F.broadcast(top)).select("event_id", (F.col("value") / F.col("top")).alias("share"))  # one row


@query("join_28_unlisted_columns", "SELECT 'supplier' AS \"table\", 's_nationkey' AS \"column\"")
def unlisted_columns(d: Domain) -> DataFrame:
    """Reference columns that the list of owned columns forgot."""
    from tidemark.sources import tables

    found = tables.columns_like(d.spark, {t: d.raw(t) for t in ("customer", "supplier", "nation")}, "nationkey")
    owned = d.spark.createDataFrame([("customer", "c_nationkey"), ("nation", "n_nationkey")], "table string, column string")
    return found.join(owned, ["table", "column"], "left_anti")


@query("agg_01_filtered_sums", "SELECT user_id, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS bought, coalesce(sum(value) FILTER (event_type = 'error'), 0) AS failed FROM events GROUP BY 1")
def filtered_sums(d: Domain) -> DataFrame:
    def of(kind: str) -> object:
        return F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))

    return d.raw("events").groupBy("user_id").agg(of("purchase").alias("bought"), of("error").alias("failed"))


@query("agg_02_distinct_counts", "SELECT o_custkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS returned FROM sold GROUP BY 1")
def distinct_counts(d: Domain) -> DataFrame:
    """One pass to distinct pairs with a mark, then plain counts: no row is expanded for each distinct count."""
    pairs = d._sold().groupBy("o_custkey", "l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("back"))
    return pairs.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("parts"), F.count_if("back").alias("returned"))


@query("agg_15_hierarchy_counts", "SELECT place, count(*) AS n FROM (SELECT unnest([split_part(kind_path, '.', 1), kind_path]) AS place FROM entities) GROUP BY 1")
def hierarchy_counts(d: Domain) -> DataFrame:
    return hierarchy.with_ancestors(d.entities(), "kind_path", "place").groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query("agg_29_approximate_distinct", "SELECT event_type, true AS near FROM events GROUP BY 1")
def approximate_distinct(d: Domain) -> DataFrame:
    """A sketch's count beside the exact one: within 5 %."""
    rows = d.raw("events").groupBy("event_type").agg(F.approx_count_distinct("event_id", 0.01).alias("about"), F.count(F.lit(1)).alias("n"))
    return rows.select("event_type", (F.abs(F.col("about") - F.col("n")) <= 0.05 * F.col("n") + 1).alias("near"))


@query("win_03_first_per_group", "SELECT p_brand, arg_min(p_partkey, (p_name, p_partkey)) AS p_partkey FROM part GROUP BY 1")
def first_per_group(d: Domain) -> DataFrame:
    return hierarchy.first_per_group(d.raw("part"), ["p_brand"], ["p_name", "p_partkey"]).select("p_brand", "p_partkey")


@query("set_03_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)")
def difference(d: Domain) -> DataFrame:
    return d.raw("customer").select("c_custkey").join(d.raw("orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("srt_04_clamped_page", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def clamped_page(d: Domain) -> DataFrame:
    """A page asked for with a negative offset and too many rows."""
    from tidemark.operators import ranking

    return ranking.page(d.raw("orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], -5, 5000).select("o_orderkey")


@query("srt_06_beam_step", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) <= 3")
def beam_step(d: Domain) -> DataFrame:
    """A beam's step: the three best continuations of each."""
    best = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_partkey")
    return d.raw("lineitem").withColumn("n", F.row_number().over(best)).where("n <= 3").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("agg_18_unique_value", "SELECT p_partkey // 2 AS pair, min(p_type) AS kind FROM part GROUP BY 1 HAVING count(DISTINCT p_type) = 1 AND count(*) = 2")
def unique_value(d: Domain) -> DataFrame:
    from tidemark.operators import aggregates

    rows = d.raw("part").select(F.floor(F.col("p_partkey") / 2).cast("long").alias("pair"), F.col("p_type").alias("kind"))
    both = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
    return aggregates.unique_value(rows, "pair", "kind").join(both, "pair", "left_semi")
