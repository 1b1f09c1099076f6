"""Decisions, user functions and style types as queries, with their DuckDB twins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import arguments
from tidemark.operators import edits, intervals, judging, spans, styles
from tidemark.plans.domain import Domain
from tidemark.plans.registry import query
from tidemark.streaming import events


@query(
    "txt_10_title_candidates",
    "WITH c AS (SELECT p_partkey, [upper(left(p_name, 1)) || substr(p_name, 2) || ' of macOS', p_brand, CASE WHEN p_name LIKE '% %' THEN upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) ELSE upper(left(p_name, 1)) || substr(p_name, 2) || ' of macOS' END] AS x, split_part(p_brand, '#', 1) AS b, split_part(p_brand, '#', 2) AS n, string_split(upper(left(p_name, 1)) || substr(p_name, 2), ' ') AS w FROM part) "
    "SELECT p_partkey, len(list_distinct(list_concat(list_concat(x, CASE WHEN len(w) > 1 THEN ['macOS'] ELSE []::VARCHAR[] END), list_concat([b], list_concat(['macOS'], list_concat(CASE WHEN len(w) > 1 THEN [w[1] || ' ' || w[2], w[2] || ' of'] ELSE [w[1] || ' of'] END, ['of macOS', 'macOS ' || b, b || ' ' || n])))))) AS n FROM c",
)
def title_candidates(d: Domain) -> DataFrame:
    title = F.concat(F.upper(F.left("p_name", F.lit(1))), F.expr("substr(p_name, 2)"), F.lit(" of macOS - "), "p_brand")
    found = judging.title_candidates(d.raw("part").select("p_partkey", title.alias("title")), "p_partkey", "title")
    return found.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("txt_13_descriptors", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'former ' || lower(c_mktsegment) || ' boss' WHEN 1 THEN 'boss' ELSE 'bright young boss' END AS before, 'spoke' AS after, c_custkey % 3 = 0 AS former FROM customer")
def descriptors(d: Domain) -> DataFrame:
    n = F.col("c_custkey") % 3
    lead = F.when(n == 0, F.concat(F.lit("The former "), F.lower("c_mktsegment"), F.lit(" boss "))).when(n == 1, "The man and boss ").otherwise("The one bright young boss ")
    rows = d.raw("customer").select("c_custkey", F.concat(lead, F.lit("Ann Lee spoke of much")).alias("said"), F.lit("Ann Lee").alias("name"))
    return judging.descriptors(rows, "c_custkey", "said", "name")


@query("txt_22_read_queries", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'latest' ELSE 'ranked' END AS sort, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS topic, replace(lower(p_brand), '#', '') AS search FROM part")
def read_queries(d: Domain) -> DataFrame:
    key = F.col("p_partkey")
    typed = F.concat(F.when(key % 3 == 0, "Show me the best ").when(key % 3 == 1, "Latest ").otherwise(""), F.when(key % 2 == 0, F.concat(F.lower("p_type"), F.lit(" "))).otherwise(""), F.lit("links about "), F.replace("p_brand", F.lit("#"), F.lit("")))
    topics = d.raw("part").select(F.col("p_type").alias("topic"), F.lower("p_type").alias("name")).distinct()
    return judging.read_query(d.raw("part").select("p_partkey", typed.alias("typed")), "p_partkey", "typed", topics)


@query("txt_25_resolved_names", "WITH e AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1), t AS (SELECT DISTINCT split_part(p_name, ' ', 1) || CASE WHEN p_partkey % 2 = 0 THEN ' ' || split_part(p_name, ' ', 2) ELSE '' END AS phrase FROM part), j AS (SELECT split_part(p_name, ' ', 1) AS phrase, p_partkey AS id, (p_size % 10) / 10.0::DOUBLE AS p FROM part WHERE p_size % 10 >= 6), b AS (SELECT phrase, arg_max(id, (p, -id)) AS id FROM j GROUP BY 1) SELECT t.phrase, coalesce(e.id, b.id) AS entity_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN b.id IS NOT NULL THEN 'candidate' ELSE 'new' END AS how FROM t LEFT JOIN e ON e.name = t.phrase LEFT JOIN b ON b.phrase = t.phrase")
def resolved_names(d: Domain) -> DataFrame:
    parts = d.raw("part")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    phrases = parts.select(F.concat(first, F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2)))).otherwise("")).alias("phrase")).distinct()
    judged = parts.select(first.alias("phrase"), F.col("p_partkey").alias("entity_id"), ((F.col("p_size") % 10) / 10.0).alias("p"))
    return judging.resolved(phrases, parts.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name")), judged)


@query("txt_25_same_chains", "SELECT p_partkey AS entity_id, p_partkey // 10 * 10 + CASE WHEN p_partkey % 10 IN (8, 9) THEN 8 ELSE 0 END AS root FROM part WHERE p_partkey >= 10 AND p_partkey // 10 * 10 + 9 <= (SELECT max(p_partkey) FROM part)")
def same_chains(d: Domain) -> DataFrame:
    """Within each ten, every id points at the one before, and the last two at each other, a circle."""
    keys = d.raw("part").select(F.col("p_partkey").alias("entity_id"))
    top = keys.agg(F.max("entity_id").alias("top"))
    tens = keys.crossJoin(F.broadcast(top)).where("entity_id >= 10 and floor(entity_id / 10) * 10 + 9 <= top").select("entity_id")  # one row
    n = F.col("entity_id") % 10
    same = tens.where(n > 0).select("entity_id", F.when(n == 8, F.col("entity_id") + 1).otherwise(F.col("entity_id") - 1).alias("other"))
    return judging.follow_same(tens, same)


@query("txt_26_placed", "WITH p AS (SELECT s_suppkey AS place_id, n_nationkey AS item, ((s_suppkey * 7 + n_nationkey * 11) % 100) / 100.0::DOUBLE AS p FROM supplier JOIN nation ON n_regionkey = s_suppkey % 5), b AS (SELECT place_id, arg_max(item, (p, item)) AS item, max(p) AS p FROM p GROUP BY 1 HAVING max(p) >= 0.6) SELECT place_id, item, r_name || '.' || n_name AS path, nullif(min(place_id) OVER (PARTITION BY item), place_id) AS duplicate_of FROM b JOIN nation ON n_nationkey = item JOIN region ON r_regionkey = n_regionkey")
def placed(d: Domain) -> DataFrame:
    nations = d.raw("nation").join(d.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = d.raw("supplier").join(d.raw("nation"), F.col("n_regionkey") == F.col("s_suppkey") % 5)
    picks = pairs.select(F.col("s_suppkey").alias("place_id"), F.col("n_nationkey").alias("item"), (((F.col("s_suppkey") * 7 + F.col("n_nationkey") * 11) % 100) / 100.0).alias("p"))
    return judging.placed(picks, nations.select(F.col("n_nationkey").alias("item"), F.concat_ws(".", "r_name", "n_name").alias("path")))


@query("txt_27_restaged_drops", "SELECT p_partkey AS link_id, 2::BIGINT AS entity_id FROM part WHERE p_name LIKE '% %' AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0")
def restaged_drops(d: Domain) -> DataFrame:
    """Each part names itself and its second word; the word is a fragment, kept where its entity is named otherwise too, left out where its drop is staged."""
    parts = d.raw("part").where(F.col("p_name").contains(" ")).select(F.col("p_partkey").alias("link_id"), "p_name", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word"))
    texts = parts.select(F.col("link_id").alias("text_id"), F.split("p_name", " ").alias("words"))
    known = parts.select(F.col("p_name").alias("name")).union(parts.select("word")).distinct().withColumn("parts", F.split("name", " "))
    found = spans.fragments(spans.occurrences(texts, known)).withColumnRenamed("text_id", "link_id")
    mentions = parts.select("link_id", F.lit(1).cast("long").alias("entity_id"), F.col("p_name").alias("name")).union(parts.select("link_id", F.lit(2).cast("long"), "word")).union(parts.where("link_id % 3 = 0").select("link_id", F.lit(2).cast("long"), F.lit("else")))
    return judging.restaged(found, mentions, parts.where("link_id % 5 = 0").select("link_id", F.lit(2).cast("long").alias("entity_id")))


@query("txt_28_decoded_events", "WITH k AS (SELECT l_orderkey AS page, CASE l_returnflag WHEN 'N' THEN 'none' WHEN 'R' THEN 'talk' ELSE 'show' END AS kind, max(l_discount * 8) AS p FROM lineitem GROUP BY 1, 2), b AS (SELECT page, max(CASE WHEN kind = 'none' THEN p END) AS none, arg_max(kind, (p, kind)) FILTER (kind <> 'none') AS kind FROM k GROUP BY 1), t AS (SELECT l_orderkey AS page, CASE WHEN l_linenumber > 2 THEN 1 ELSE 0 END AS o, CAST(l_shipdate AS DATE) AS day, l_tax AS p FROM lineitem) SELECT b.page, b.kind, (SELECT arg_min(day, (o, -p, day)) FROM t WHERE t.page = b.page) AS day FROM b WHERE coalesce(none, 0) < 0.5 AND kind IS NOT NULL")
def decoded_events(d: Domain) -> DataFrame:
    rows = d.raw("lineitem")
    kind = F.when(F.col("l_returnflag") == "N", "none").when(F.col("l_returnflag") == "R", "talk").otherwise("show")
    kinds = rows.groupBy(F.col("l_orderkey").alias("page"), kind.alias("kind")).agg(F.max(F.col("l_discount") * 8).alias("p"))
    dates = rows.select(F.col("l_orderkey").alias("page"), F.when(F.col("l_linenumber") > 2, "page").otherwise("title").alias("origin"), F.to_date("l_shipdate").alias("day"), F.col("l_tax").alias("p"))
    return judging.decoded_events(kinds, dates, "page")


@query("udf_01_sql_function", "SELECT p_partkey, upper(p_brand) || ' ' || length(p_name) AS said FROM part")
def sql_function(d: Domain) -> DataFrame:
    """A SQL function is inlined into the plan."""
    d.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tidemark_said(brand STRING, name STRING) RETURNS STRING RETURN concat(upper(brand), ' ', length(name))")
    return d.raw("part").select("p_partkey", F.expr("tidemark_said(p_brand, p_name)").alias("said"))


@query("udf_02_plan_time", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 18:00:00' AND ts < TIMESTAMP '2024-01-06 04:00:00'")
def plan_time(d: Domain) -> DataFrame:
    """A procedure that runs while the plan is built: what `tonight` means."""
    start, end = intervals.PERIODS["tonight"].interval(datetime(2024, 1, 5, 20))
    at = F.col("ts").cast("timestamp")
    return d.raw("events").where((at >= F.lit(start)) & (at < F.lit(end))).select("event_id")


@query("udf_03_table_function", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def table_function(d: Domain) -> DataFrame:
    d.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tidemark_words(name STRING) RETURNS TABLE (word STRING) RETURN SELECT explode(split(name, ' '))")
    return d.spark.sql("SELECT p_partkey, w.word FROM {parts} p, LATERAL tidemark_words(p.p_name) w", parts=d.raw("part"))


@query("udf_04_trigger_function", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def trigger_function(d: Domain) -> DataFrame:
    """A function that every batch of a stream calls: it derives counts and adds them to the version before."""
    import uuid

    from tidemark.plans.streaming_queries import thirds
    from tidemark.session import shared_folder

    folder, schema = f"{shared_folder(d.spark)}/counts-{uuid.uuid4().hex}", "event_type string, n long, last long"
    seen = []

    def each(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
        old = batch.sparkSession.read.schema(schema).parquet(f"{folder}/{number - 1}") if number else batch.sparkSession.createDataFrame([], schema)
        old.union(new).groupBy("event_type").agg(F.sum("n").alias("n"), F.max("last").alias("last")).write.mode("overwrite").parquet(f"{folder}/{number}")
        seen.append(number)

    events.finished(events.staged_stream(d.spark, thirds(d)), each=each)
    return d.spark.read.schema(schema).parquet(f"{folder}/{max(seen)}")


@query("udf_05_grouped_aggregate", "SELECT user_id, round(quantile_cont(value, 0.5), 6) AS middle FROM events GROUP BY 1")
def grouped_aggregate(d: Domain) -> DataFrame:
    """An aggregate over each group's ordered values, here its middle, by the built-in one."""
    return d.raw("events").groupBy("user_id").agg(F.round(F.median("value"), 6).alias("middle"))


@query("udf_06_from_metadata", "SELECT 'votes' AS \"table\", count(*) AS n FROM votes WHERE voter <> 4 OR link_id NOT IN (SELECT link_id FROM votes WHERE voter = 7) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey <> 4 UNION ALL SELECT 'spent', count(DISTINCT CASE WHEN o_custkey = 4 THEN 7 ELSE o_custkey END) FROM orders")
def from_metadata(d: Domain) -> DataFrame:
    """One account merge over several tables, driven by what is said of their columns."""
    spent = d.raw("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    owned = [edits.OwnedColumn("votes", "voter", "move", ("voter", "link_id")), edits.OwnedColumn("orders", "o_custkey", "drop"), edits.OwnedColumn("spent", "o_custkey", "add", amount="total")]
    after = edits.merge_accounts({"votes": d.votes(), "orders": d.raw("orders").select("o_orderkey", "o_custkey"), "spent": spent}, owned, 4, 7)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in after.items()]
    return counts[0].union(counts[1]).union(counts[2])


#: What a call over an event may say.
ARGUMENTS = {
    "k": arguments.integer(0, 80),
    "value": arguments.optional(arguments.number(above=0, maximum=20)),
    "type": arguments.one_of(["click", "view", "purchase"], default="view"),
    "name": arguments.optional(arguments.string(least=2, most=4)),
    "ids": arguments.optional(arguments.array(arguments.integer(minimum=0), 1, 3)),
}


@query(
    "udf_07_typed_arguments",
    """WITH e AS (SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value, event_type AS t, event_id % 6 AS m, user_id AS u FROM events),
    said AS (SELECT *, CASE WHEN k IS NULL OR k NOT BETWEEN 0 AND 80 THEN 'k must be an integer from 0 to 80' WHEN value IS NOT NULL AND NOT (value > 0 AND value <= 20) THEN 'value must be a number in (0, 20]'
      WHEN m <> 1 AND t NOT IN ('click', 'view', 'purchase') THEN 'type must be one of click, view, purchase' WHEN m = 2 AND length('u' || u) NOT BETWEEN 2 AND 4 THEN 'name must be a string of 2 to 4 characters'
      WHEN m = 3 THEN 'ids must list 1-3 items' WHEN m = 4 AND u % 2 = 1 THEN 'ids[1] must be an integer from 0 to 9007199254740991' END AS error FROM e)
    SELECT id, error, CASE WHEN error IS NULL THEN k END AS k, CASE WHEN error IS NULL THEN CASE WHEN m = 1 THEN 'view' ELSE t END END AS type, CASE WHEN error IS NULL AND m = 2 THEN 'u' || u END AS name, CASE WHEN error IS NULL AND m = 4 THEN 2 WHEN error IS NULL AND m = 5 THEN 1 END::INTEGER AS n FROM said""",
)
def typed_arguments(d: Domain) -> DataFrame:
    """A call over each event: its own properties, value and type, some left out, a name, and lists of every length."""
    m, user = F.col("event_id") % 6, F.col("user_id")
    ids = F.when(m == 3, F.array().cast("array<bigint>")).when(m == 4, F.array(user, F.when(user % 2 == 1, -user).otherwise(user))).when(m == 5, F.array(user))
    name = F.when(m == 2, F.concat(F.lit(" u"), user.cast("string")))
    k = F.get_json_object("props", "$.k").cast("long")
    call = F.to_json(F.struct(k.alias("k"), "value", F.when(m != 1, F.col("event_type")).alias("type"), F.trim(name).alias("name"), ids.alias("ids")))
    value, error = arguments.parsed(F.col("call"), ARGUMENTS)
    rows = d.raw("events").select(F.col("event_id").alias("id"), call.alias("call")).select("id", error.alias("error"), value.alias("v"))
    return rows.select("id", "error", "v.k", "v.type", "v.name", F.when(F.col("v.ids").isNotNull(), F.size("v.ids")).alias("n"))


SCHEMA = {"text_color": "color", "gap": "size", "font": "word"}


def style_values(d: Domain) -> DataFrame:
    """(style_id, value): styles as JSON objects made from parts; some with an unknown name, some with a bad value."""
    key = F.col("p_partkey")
    color = F.when(key % 4 == 0, F.concat(F.lit("url("), key, F.lit(")"))).otherwise(F.concat(F.lit("#00"), F.lpad(F.lower(F.hex(key)), 4, "0")))
    extra = F.when(key % 5 == 0, ',"other":"1"').otherwise("")
    return d.raw("part").select(key.alias("style_id"), F.concat(F.lit('{"text_color":"'), color, F.lit('","gap":"'), F.col("p_size"), F.lit('px"'), extra, F.lit("}")).alias("value"))


@query(
    "sty_01_compiled_schema",
    """WITH t AS (SELECT p_partkey AS id, lower(p_type) AS a, ['#[0-9a-f]{6}', '[0-9]{1,3}(px|rem|%)', '[a-z][a-z-]{0,30}'][(p_size % 4 + 1)::INTEGER] AS x, p_size % 4 AS m, p_size % 5 AS f, p_size FROM part)
    SELECT id, CASE WHEN p_size % 9 = 0 THEN 'a type declares 1 to 64 names' WHEN f = 0 THEN 'bad name: Bad Name' WHEN m = 3 THEN 'unknown kind: script' END AS refusal,
      CASE WHEN p_size % 9 <> 0 AND f <> 0 AND m <> 3 THEN '{"type":"object","additionalProperties":false,"properties":{' || CASE WHEN a < 'gap' THEN '"' || a || '":{"type":"string","pattern":"^' || x || '$"},"gap":{"type":"string","pattern":"^[0-9]{1,3}(px|rem|%)$"}' ELSE '"gap":{"type":"string","pattern":"^[0-9]{1,3}(px|rem|%)$"},"' || a || '":{"type":"string","pattern":"^' || x || '$"}' END
        || '},"required":' || CASE WHEN a < 'gap' THEN '["' || a || '","gap"]' ELSE '["gap","' || a || '"]' END || '}' END AS schema FROM t""",
)
def compiled_schema(d: Domain) -> DataFrame:
    """Types declared from parts: one name each of a part's own, some of a kind or by a name that is refused, some without any."""
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "color").when(size % 4 == 1, "size").when(size % 4 == 2, "word").otherwise("script")
    name = F.when(size % 5 == 0, "Bad Name").otherwise(F.lower("p_type"))
    declared = F.when(size % 9 == 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("gap"), F.lit("size"), name, kind))
    schema, refusal = styles.compiled_type(declared)
    return d.raw("part").select(F.col("p_partkey").alias("id"), refusal.alias("refusal"), schema.alias("schema"))


@query("sty_02_style_checks", "SELECT 'value' AS what, p_partkey AS id FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 = 0 UNION ALL SELECT 'quota', p_size FROM part GROUP BY p_size HAVING count(*) > 50 UNION ALL SELECT 'schema', n_nationkey FROM nation WHERE n_nationkey % 6 = 1")
def style_checks(d: Domain) -> DataFrame:
    """Values that do not match, owners over their quota, schemas that changed."""
    bad = style_values(d).where(~styles.matches_schema(F.col("value"), styles.compiled(SCHEMA))).select(F.lit("value").alias("what"), F.col("style_id").alias("id"))
    many = styles.over_quota(d.raw("part").select(F.col("p_size").alias("owner"))).select(F.lit("quota"), F.col("owner").cast("long"))
    old = d.raw("nation").select(F.col("n_nationkey").cast("long").alias("type_id"), F.lit("{}").alias("schema"))
    new = old.withColumn("schema", F.when(F.col("type_id") % 6 == 1, '{"a":1}').otherwise("{}"))
    return bad.union(many).union(styles.changed_schemas(old, new).select(F.lit("schema"), "type_id"))


@query("sty_03_declarations", "SELECT p_partkey AS style_id, 'gap: ' || p_size || 'px' || CASE WHEN p_partkey % 4 <> 0 THEN '; text-color: #00' || lower(lpad(printf('%x', p_partkey), 4, '0')) ELSE '' END AS css FROM part")
def declarations(d: Domain) -> DataFrame:
    rows = style_values(d).select("style_id", F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))
    return styles.declarations(rows, [styles.Declaration(n, k) for n, k in SCHEMA.items()])


@query("sty_05_value_tokens", "SELECT p_partkey AS style_id, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS n FROM part")
def value_tokens(d: Domain) -> DataFrame:
    return style_values(d).select("style_id", F.size(styles.tokens_of(F.col("value"))).alias("n"))


@query("fn_28_schema_match", "SELECT p_partkey AS style_id, p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 AS ok FROM part")
def schema_match(d: Domain) -> DataFrame:
    return style_values(d).select("style_id", styles.matches_schema(F.col("value"), styles.compiled(SCHEMA)).alias("ok"))
