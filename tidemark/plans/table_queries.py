"""Joins, set operations, windows, edits, the change index, and text expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import aggregates, change_index, edits, hierarchy, search
from tidemark.plans.domain import Domain
from tidemark.plans.registry import query


@query("join_01_inner", "SELECT voter, topic, count(*) AS n FROM votes JOIN labelled USING (link_id) GROUP BY 1, 2")
def inner_join(d: Domain) -> DataFrame:
    return d.votes().join(d.labels(), "link_id").groupBy("voter", "topic").agg(F.count(F.lit(1)).alias("n"))


@query("join_02_left_outer", "SELECT p_partkey AS link_id, coalesce(ups, 0) AS ups FROM part LEFT JOIN counted ON link_id = p_partkey")
def left_join(d: Domain) -> DataFrame:
    from tidemark.operators.ranking import vote_counts

    rows = d.raw("part").select(F.col("p_partkey").alias("link_id")).join(vote_counts(d.votes()), "link_id", "left")
    return rows.select("link_id", F.coalesce("ups", F.lit(0)).alias("ups"))


@query("join_03_full_outer", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS suppliers, coalesce(b.n, 0) AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) b ON a.k = b.k")
def full_join(d: Domain) -> DataFrame:
    a = d.raw("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    b = d.raw("customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return a.join(b, "k", "full").select("k", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


@query("join_04_shared_key", "SELECT o.link_id, count(*) AS n_shared FROM mentions h JOIN mentions o USING (entity_id) WHERE h.link_id = 7 AND o.link_id <> 7 GROUP BY 1")
def shared_key(d: Domain) -> DataFrame:
    here = d.mentions().where("link_id = 7").select("entity_id")
    return d.mentions().where("link_id <> 7").join(here, "entity_id").groupBy("link_id").agg(F.count(F.lit(1)).alias("n_shared"))


@query("join_13_array_membership", "SELECT link_id, entity_id FROM mentions WHERE list_contains([2, 4, 8], entity_id)")
def array_membership(d: Domain) -> DataFrame:
    ids = d.spark.sql("SELECT explode(array(2L, 4L, 8L)) AS entity_id")
    return d.mentions().join(F.broadcast(ids), "entity_id").select("link_id", "entity_id")


@query("join_17_prefix_words", "SELECT DISTINCT p_name AS name FROM part WHERE contains(p_name, 'ring') OR p_name = 'red' OR starts_with(p_name, 'red ')")
def prefix_words(d: Domain) -> DataFrame:
    name = F.col("p_name")
    return d.raw("part").where(name.contains("ring") | (name == "red") | name.startswith("red ")).select(name.alias("name")).distinct()


@query("join_21_version_pairs", "SELECT a.o_orderkey AS id, a.o_orderstatus AS before, CASE WHEN a.o_orderkey % 5 = 0 THEN 'F' ELSE a.o_orderstatus END AS after FROM orders a WHERE a.o_orderkey % 5 = 0 AND a.o_orderstatus <> 'F'")
def version_pairs(d: Domain) -> DataFrame:
    old = d.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("before"))
    new = old.select("id", F.when(F.col("id") % 5 == 0, "F").otherwise(F.col("before")).alias("after"))
    return old.join(new, "id").where(~F.col("before").eqNullSafe(F.col("after")))


@query("join_22_scalar_subquery", "SELECT n_nationkey AS nation, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers, (SELECT arg_min(c_name, (c_acctbal, c_custkey)) FROM customer WHERE c_nationkey = n_nationkey) AS poorest FROM nation")
def scalar_subquery(d: Domain) -> DataFrame:
    suppliers = d.raw("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    poorest = d.raw("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min_by("c_name", F.struct("c_acctbal", "c_custkey")).alias("poorest"))
    rows = d.raw("nation").select(F.col("n_nationkey").alias("nation")).join(suppliers, "nation", "left").join(poorest, "nation", "left")
    return rows.withColumn("suppliers", F.coalesce("suppliers", F.lit(0)))


@query("join_23_first_title", "SELECT entity_id, arg_min(title, (created_at, link_id)) AS title FROM mentions JOIN links USING (link_id) GROUP BY 1")
def first_title(d: Domain) -> DataFrame:
    rows = d.mentions().select("link_id", "entity_id").join(d.links(), "link_id")
    return rows.groupBy("entity_id").agg(F.min_by("title", F.struct("created_at", "link_id")).alias("title"))


@query("join_25_case_insensitive", "SELECT s_suppkey AS id FROM supplier JOIN (SELECT upper(s_name) AS n FROM supplier WHERE s_suppkey % 7 = 0) ON lower(n) = lower(s_name)")
def case_insensitive(d: Domain) -> DataFrame:
    shouted = d.raw("supplier").where("s_suppkey % 7 = 0").select(F.lower(F.upper("s_name")).alias("key"))
    return d.raw("supplier").withColumn("key", F.lower("s_name")).join(shouted, "key").select(F.col("s_suppkey").alias("id"))


@query("join_27_path_ancestors", "SELECT entity_id, array_to_string(string_split(kind_path, '.')[1:n], '.') AS ancestor, n::INTEGER AS depth FROM entities, unnest(range(1, len(string_split(kind_path, '.')) + 1)) t(n)")
def path_ancestors(d: Domain) -> DataFrame:
    rows = d.entities().select("entity_id", F.posexplode(hierarchy.prefixes(F.col("kind_path"))).alias("depth", "ancestor"))
    return rows.select("entity_id", "ancestor", (F.col("depth") + 1).alias("depth"))


@query("win_02_first_per_group", "SELECT link_id, entity_id, rank FROM (SELECT link_id, entity_id, row_number() OVER (PARTITION BY link_id ORDER BY p DESC, entity_id)::INTEGER AS rank FROM mentions) WHERE rank <= 5")
def first_per_group(d: Domain) -> DataFrame:
    return hierarchy.first_per_group(d.mentions(), ["link_id"], [F.desc("p"), "entity_id"], 5).select("link_id", "entity_id", "rank")


@query("win_04_ordinality", "SELECT p_partkey AS id, (n - 1)::INTEGER AS place, string_split(p_name, ' ')[n] AS word FROM part, unnest(range(1, len(string_split(p_name, ' ')) + 1)) t(n)")
def ordinality(d: Domain) -> DataFrame:
    return d.raw("part").select(F.col("p_partkey").alias("id"), F.posexplode(F.split("p_name", " ")).alias("place", "word"))


@query("srt_05_top_k", "SELECT p_partkey AS id, p_retailprice AS score FROM part WHERE p_partkey <> 5 ORDER BY score DESC, id LIMIT 10")
def top_k(d: Domain) -> DataFrame:
    return d.raw("part").where("p_partkey <> 5").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("srt_07_round_robin", "SELECT user_id, event_id, (row_number() OVER (ORDER BY r, user_id))::INTEGER AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) QUALIFY place <= 40")
def round_robin(d: Domain) -> DataFrame:
    rows = hierarchy.first_per_group(d.raw("events"), ["user_id"], [F.desc("value"), "event_id"], 40)
    picked = rows.orderBy("rank", "user_id").limit(40)
    return picked.withColumn("place", F.row_number().over(Window.orderBy("rank", "user_id"))).select("user_id", "event_id", "place")


@query("set_01_union_all", "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def union_all(d: Domain) -> DataFrame:
    return d.raw("supplier").select(F.col("s_nationkey").alias("k")).unionByName(d.raw("customer").select(F.col("c_nationkey").alias("k")))


@query("set_02_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(d: Domain) -> DataFrame:
    return union_all(d).distinct()


@query("set_04_intersect_except", "(SELECT voter FROM votes WHERE value = 1 INTERSECT SELECT voter FROM votes WHERE value = -1) EXCEPT SELECT user_id FROM overrides")
def intersect_except(d: Domain) -> DataFrame:
    up, down = d.votes().where("value = 1").select("voter"), d.votes().where("value = -1").select("voter")
    return up.intersect(down).subtract(d.overrides().select(F.col("user_id").alias("voter")))


@query("set_05_canonical_key", "SELECT l_partkey AS link_id, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS key FROM lineitem GROUP BY 1")
def canonical_key(d: Domain) -> DataFrame:
    return d.raw("lineitem").groupBy(F.col("l_partkey").alias("link_id")).agg(text.canonical_key(F.collect_set("l_returnflag")).alias("key"))


@query("snk_01_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'changed' ELSE o_orderpriority END AS priority FROM orders UNION ALL SELECT 1000000000 + o_orderkey, 'new' FROM orders WHERE o_orderkey % 50 = 0")
def upsert(d: Domain) -> DataFrame:
    old = d.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    new = old.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 1, "changed").otherwise("").alias("priority"))
    more = old.where("id % 50 = 0").select((1000000000 + F.col("id")).alias("id"), F.lit("new").alias("priority"))
    return edits.upsert(old, new.unionByName(more), ["id"])


@query("snk_02_insert_missing", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT o_custkey + 1000000, 'x' FROM orders GROUP BY 1")
def insert_missing(d: Domain) -> DataFrame:
    old = d.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    buyers = d.raw("orders").select("o_custkey").distinct()
    new = buyers.select(F.col("o_custkey").alias("id"), F.lit("y").alias("name")).unionByName(buyers.select((F.col("o_custkey") + 1000000).alias("id"), F.lit("x").alias("name")))
    return edits.insert_missing(old, new, ["id"])


@query("snk_03_replace_owned", "SELECT link_id, entity_id FROM mentions WHERE in_title OR link_id % 4 <> 0 UNION ALL SELECT link_id, 999 FROM links WHERE link_id % 4 = 0")
def replace_owned(d: Domain) -> DataFrame:
    old = d.mentions().select("link_id", "entity_id", "in_title")
    new = d.links().where("link_id % 4 = 0").select("link_id", F.lit(999).cast("long").alias("entity_id"), F.lit(False).alias("in_title"))
    return edits.replace_owned(old, new, "link_id", F.col("in_title")).select("link_id", "entity_id")


@query("snk_12_cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(d: Domain) -> DataFrame:
    return edits.cascade(d.raw("lineitem"), "l_orderkey", d.raw("orders").where("o_orderstatus = 'P'"), "o_orderkey").select("l_orderkey", "l_linenumber")


MAPPING = "CASE WHEN entity_id % 10 = 3 THEN entity_id - 1 ELSE entity_id END"


@query("q_28_merge_entities", f"SELECT link_id, entity_id, p FROM (SELECT link_id, {MAPPING} AS entity_id, p, row_number() OVER (PARTITION BY link_id, {MAPPING} ORDER BY entity_id % 10 = 3, p DESC) AS r FROM mentions) WHERE r = 1")
def merge_entities(d: Domain) -> DataFrame:
    mapping = d.entities().where("entity_id % 10 = 3").select(F.col("entity_id").alias("old"), (F.col("entity_id") - 1).alias("new"))
    merged, _ = edits.merge_keys(d.mentions(), "entity_id", mapping, ["link_id", "entity_id"], [F.desc("p")])
    return merged.select("link_id", "entity_id", "p")


@query("q_30_undo_merge", "SELECT link_id, entity_id, p FROM mentions")
def undo_merge(d: Domain) -> DataFrame:
    mapping = d.entities().where("entity_id % 10 = 3").select(F.col("entity_id").alias("old"), (F.col("entity_id") - 1).alias("new"))
    mentions = d.mentions()
    merged, snapshot = edits.merge_keys(mentions, "entity_id", mapping, ["link_id", "entity_id"], [F.desc("p")])
    return edits.unmerge_keys(merged, snapshot, "entity_id", mapping).select("link_id", "entity_id", "p")


@query("q_31_merge_accounts", "SELECT CASE WHEN voter = 4 THEN 7 ELSE voter END AS voter, link_id, value FROM votes WHERE voter <> 4 OR link_id NOT IN (SELECT link_id FROM votes WHERE voter = 7)")
def merge_accounts(d: Domain) -> DataFrame:
    owned = [edits.OwnedColumn("votes", "voter", "move", ("voter", "link_id"))]
    return edits.merge_accounts({"votes": d.votes()}, owned, 4, 7)["votes"]


@query("q_34_notify_reply", "SELECT conv_id AS recipient, turn AS reply, CASE WHEN role = 'assistant' THEN 'reply_to_you' ELSE 'reply_on_thread' END AS kind FROM conversations WHERE turn > 0")
def notify_reply(d: Domain) -> DataFrame:
    rows = d.raw("conversations").where("turn > 0").withColumn("recipient", F.col("conv_id"))
    to_you = rows.where("role = 'assistant'").select("recipient", F.col("turn").alias("reply"), F.lit("reply_to_you").alias("kind"), F.lit(0).alias("order"))
    thread = rows.select("recipient", F.col("turn").alias("reply"), F.lit("reply_on_thread").alias("kind"), F.lit(1).alias("order"))
    return hierarchy.first_per_group(to_you.unionByName(thread), ["recipient", "reply"], ["order"]).select("recipient", "reply", "kind")


@query("q_37_credits_left", "SELECT c_custkey AS account, (CASE WHEN c_mktsegment = 'BUILDING' THEN 10000 ELSE 1000 END - least(coalesce(n, 0), 1000))::BIGINT AS left_over FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def credits_left(d: Domain) -> DataFrame:
    used = d.raw("orders").groupBy(F.col("o_custkey").alias("account")).agg(F.count(F.lit(1)).alias("n"))
    most = F.when(F.col("c_mktsegment") == "BUILDING", 10000).otherwise(1000)
    rows = d.raw("customer").withColumnRenamed("c_custkey", "account").join(used, "account", "left")
    return rows.select("account", (most - F.least(F.coalesce("n", F.lit(0)), F.lit(1000))).cast("long").alias("left_over"))


@query("q_38_rate_limited_claims", "SELECT event_id, user_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts > a.ts - INTERVAL 1 HOUR AND b.ts < a.ts) < 2 AS sent FROM events a WHERE event_type = 'purchase'")
def rate_limited_claims(d: Domain) -> DataFrame:
    second = F.unix_micros("ts")
    window = Window.partitionBy("user_id").orderBy(second).rangeBetween(-3_599_999_999, -1)
    rows = d.raw("events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("before", F.count(F.lit(1)).over(window))
    return rows.where("event_type = 'purchase'").select("event_id", "user_id", (F.col("before") < 2).alias("sent"))


@query("q_39_index_snapshot", "SELECT entity_id, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = 1 THEN m[1] ELSE m[i] - m[i - 1] END) AS members FROM (SELECT entity_id, list_sort(list(DISTINCT link_id)) AS m FROM mentions GROUP BY 1)", lists="members")
def index_snapshot(d: Domain) -> DataFrame:
    return change_index.snapshot(d.mentions(), "entity_id", "link_id")


def change_log(d: Domain) -> DataFrame:
    rows = d.raw("lineitem").select(F.col("l_partkey").alias("link_id"), F.col("l_suppkey").alias("entity_id"), "l_orderkey", "l_linenumber")
    return rows.withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber")).drop("l_orderkey", "l_linenumber")


@query("q_40_index_diff", "SELECT DISTINCT l_partkey AS link_id, l_suppkey AS entity_id, (l_partkey, l_suppkey) IN (SELECT (link_id, entity_id) FROM mentions WHERE in_title) AS there FROM lineitem WHERE l_orderkey * 10 + l_linenumber > (SELECT max(seq) // 2 FROM evidence) - 500")
def index_diff(d: Domain) -> DataFrame:
    """What a reader who stopped half-way is told."""
    half = change_log(d).agg(F.max("seq").alias("seq")).first()["seq"] // 2  # one number
    return change_index.diff(change_log(d), d.mentions().where("in_title"), ["link_id", "entity_id"], half)


@query("str_09_apply_diff", "SELECT link_id, entity_id FROM mentions WHERE in_title OR (link_id, entity_id) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_orderkey * 10 + l_linenumber > (SELECT max(seq) // 2 FROM evidence) - 500)")
def apply_diff(d: Domain) -> DataFrame:
    return change_index.apply_diff(d.mentions(), index_diff(d), ["link_id", "entity_id"])


@query("str_10_reload_policy", "SELECT count(*) FILTER (seq > 140000) > 2000 OR min(seq) > 140001 AS reload FROM evidence")
def reload_policy(d: Domain) -> DataFrame:
    return change_log(d).agg(change_index.must_reload(change_log(d), 140_000).alias("reload"))


@query("str_11_log_retention", "SELECT count(*) AS n, min(seq) AS least FROM evidence WHERE seq > (SELECT max(seq) FROM evidence) - 10000")
def log_retention(d: Domain) -> DataFrame:
    return change_index.retained(change_log(d)).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("least"))


@query("q_42_inboxes", "SELECT DISTINCT coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, ''), c_name) AS inbox FROM customer WHERE c_custkey IN (SELECT voter FROM votes WHERE link_id = 7 UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def inboxes(d: Domain) -> DataFrame:
    urgent = d.raw("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    people = d.votes().where("link_id = 7").select(F.col("voter").alias("id")).union(urgent).distinct()
    rows = d.raw("customer").join(people, F.col("c_custkey") == F.col("id"), "left_semi")
    return rows.select(F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), F.col("c_name")).alias("inbox")).distinct()


@query("q_43_hashed_tokens", "SELECT c_custkey AS owner, sha256(c_name || ':token') AS token FROM customer WHERE sha256(c_name || ':token') < '2'")
def hashed_tokens(d: Domain) -> DataFrame:
    token = F.sha2(F.concat("c_name", F.lit(":token")), 256)
    return d.raw("customer").select(F.col("c_custkey").alias("owner"), token.alias("token")).where("token < '2'")


@query("agg_23_clusters", "SELECT id, id // 100 * 100 AS cluster FROM (SELECT l_partkey AS id FROM lineitem UNION SELECT l_partkey // 10 * 10 FROM lineitem UNION SELECT l_partkey // 100 * 100 FROM lineitem)")
def clusters(d: Domain) -> DataFrame:
    """Every part is linked with the last multiple of ten, and that with the last hundred."""
    tens = d.raw("lineitem").select(F.col("l_partkey").alias("a"), (F.floor(F.col("l_partkey") / 10) * 10).cast("long").alias("b")).distinct()
    hundreds = tens.select(F.col("b").alias("a"), (F.floor(F.col("b") / 100) * 100).cast("long").alias("b")).distinct()
    return aggregates.clusters(tens.union(hundreds))


@query("agg_26_idf", "WITH t AS (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT token, count(*) AS df, round(ln((n + 1.0) / (count(*) + 1.0)) + 1, 9) AS idf FROM t, n GROUP BY token, n")
def idf(d: Domain) -> DataFrame:
    docs = d.raw("documents")
    tokens = docs.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("token"))
    rows = aggregates.inverse_document_frequency(tokens, "doc_id", "token", docs)
    return rows.select("token", "df", F.round("idf", 9).alias("idf"))


@query("agg_20_word_case", "SELECT lower(w) AS word, count(*) FILTER (w <> lower(w)) AS capital, count(*) AS total FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{2,40}')) AS w FROM documents) GROUP BY 1")
def word_case(d: Domain) -> DataFrame:
    rows = d.raw("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{2,40}"), F.lit(0))).alias("w"))
    return rows.groupBy(F.lower("w").alias("word")).agg(F.count_if(F.col("w") != F.lower("w")).alias("capital"), F.count(F.lit(1)).alias("total"))


@query("prj_09_hosts", "SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '^(www|feeds?|rss)[.]', '') AS host FROM pages")
def hosts(d: Domain) -> DataFrame:
    return d.raw("pages").select("page_id", text.feed_host(F.col("url")).alias("host"))


@query("prj_10_language_key", "SELECT doc_id, coalesce(nullif(lower(split_part(trim(lang || '-X'), '-', 1)), ''), 'und') AS key FROM documents")
def language_key(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", text.language_key(F.concat("lang", F.lit("-X"))).alias("key"))


@query("prj_16_url_checks", "SELECT page_id, regexp_matches(url, '(?i)^https?://[^/\\s]+') AS web FROM pages")
def url_checks(d: Domain) -> DataFrame:
    return d.raw("pages").select("page_id", text.is_web_url(F.col("url")).alias("web"))


@query("fn_08_truncated", "SELECT doc_id, CASE WHEN length(text) > 60 THEN rtrim(left(text, 59), ' ') || '…' ELSE text END AS short FROM documents")
def truncated(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", text.truncated(F.col("text"), 60).alias("short"))


@query("fn_01_fold_text", "SELECT doc_id, md5(replace(replace(replace(replace(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), '’', '''')) AS folded FROM documents")
def fold_text(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", F.md5(search.fold(F.col("text"))).alias("folded"))


@query("src_03_newest", "SELECT link_id, title FROM links ORDER BY created_at DESC, link_id DESC LIMIT 30")
def newest(d: Domain) -> DataFrame:
    return d.links().orderBy(F.desc("created_at"), F.desc("link_id")).limit(30).select("link_id", "title")


@query("str_14_sliding_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def sliding_counts(d: Domain) -> DataFrame:
    last_hour = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return d.raw("events").select("event_id", F.count(F.lit(1)).over(last_hour).alias("n"))


@query("str_19_next_action", "SELECT event_id, lead(event_type) OVER w AS next_action, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) // 1000 AS away_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def next_action(d: Domain) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return d.raw("events").withColumn("at", at).select("event_id", F.lead("event_type").over(w).alias("next_action"), F.floor((F.lead("at").over(w) - F.col("at")) / 1000).cast("long").alias("away_ms"))


@query("txt_14_adjacent_merge", "WITH m AS (SELECT *, event_type <> coalesce(lag(event_type) OVER w, '') AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM m) SELECT user_id, island::BIGINT AS island, event_type, count(*) AS n, min(value) AS least FROM i GROUP BY 1, 2, 3")
def adjacent_merge(d: Domain) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = (F.col("event_type") != F.coalesce(F.lag("event_type").over(w), F.lit(""))).cast("int")
    rows = d.raw("events").withColumn("new", new).withColumn("island", F.sum("new").over(w))
    return rows.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"))
