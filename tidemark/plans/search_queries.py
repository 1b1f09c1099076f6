"""Filters over ambiguous terms and periods, search, name matching, feeds."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import filters, fulltext, intervals, ranking, search
from tidemark.plans import oracle_text
from tidemark.plans.domain import AS_OF, VIEWER, Domain
from tidemark.plans.expression_queries import DOCUMENT_FIELDS, DOCUMENT_TEXTS, document_texts
from tidemark.plans.ranking_queries import feed
from tidemark.plans.registry import query
from tidemark.session import staged

RANGES = """ranges AS (SELECT event_id, link_id, starts_on + to_hours(coalesce(start_hour, 6)) AS start,
CASE WHEN start_hour IS NOT NULL AND starts_on IS NOT NULL AND (ends_on IS NULL OR ends_on = starts_on) THEN starts_on + to_hours(start_hour + 3)
ELSE CAST(coalesce(ends_on, starts_on) + 1 AS TIMESTAMP) END AS "end" FROM calendar)"""
OVERLAP = '(start IS NULL OR start < b) AND ("end" IS NULL OR a < "end")'


def ranges(d: Domain) -> DataFrame:
    start, end = intervals.event_range(F.col("starts_on"), F.col("ends_on"), F.col("start_hour"))
    return d.calendar().select("event_id", "link_id", start.alias("start"), end.alias("end"))


@query("q_20_event_range", f'WITH {RANGES} SELECT event_id, start, "end" FROM ranges')
def event_range(d: Domain) -> DataFrame:
    return ranges(d).select("event_id", "start", "end")


@query(
    "join_12_interval_overlap",
    f"WITH {RANGES}, periods AS (SELECT n AS period, TIMESTAMP '1998-01-01' + to_days((n * 7)::INTEGER) AS a, TIMESTAMP '1998-01-08' + to_days((n * 7)::INTEGER) AS b FROM range(30) t(n)) "
    f"SELECT period, count(*) AS n_events, count(DISTINCT link_id) AS n_links FROM periods JOIN ranges ON {OVERLAP} GROUP BY 1",
)
def interval_overlap(d: Domain) -> DataFrame:
    day = F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))
    periods = d.spark.range(30).select(F.col("id").alias("period"), (day + F.make_dt_interval(days=(F.col("id") * 7).cast("int"))).alias("a"), (day + F.make_dt_interval(days=(F.col("id") * 7 + 7).cast("int"))).alias("b"))
    met = intervals.overlap_join(ranges(d), "start", "end", periods, "a", "b")
    return met.groupBy("period").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("link_id").alias("n_links"))


TONIGHT = intervals.PERIODS["tonight"].interval(datetime(1999, 6, 5, 1, 30))


TERMS = "CASE event_id % 4 WHEN 0 THEN 'tonight' WHEN 1 THEN 'tomorrow' WHEN 2 THEN 'today' ELSE 'someday' END"


@query(
    "q_19_named_period",
    f"WITH e AS (SELECT event_id, ts, {TERMS} AS term FROM events), s AS (SELECT *, CASE WHEN term <> 'tomorrow' AND hour(ts) < 4 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS day FROM e) "
    "SELECT event_id, term, CASE term WHEN 'tonight' THEN day + INTERVAL 18 HOUR WHEN 'tomorrow' THEN day + INTERVAL 24 HOUR WHEN 'today' THEN CAST(day AS TIMESTAMP) END AS starts, "
    "CASE term WHEN 'tomorrow' THEN day + INTERVAL 48 HOUR WHEN 'someday' THEN NULL ELSE day + INTERVAL 28 HOUR END AS ends FROM s",
)
def named_period(d: Domain) -> DataFrame:
    """What a term named at the moment of each event; one of four terms names nothing."""
    key = F.col("event_id") % 4
    term = F.when(key == 0, "tonight").when(key == 1, "tomorrow").when(key == 2, "today").otherwise("someday")
    rows = d.raw("events").select("event_id", term.alias("term"), F.col("ts").cast("timestamp_ntz").alias("at"))
    period = intervals.named(F.col("term"), F.col("at"))
    return rows.select("event_id", "term", period["starts"].alias("starts"), period["ends"].alias("ends"))


@query("q_21_period_summary", f"WITH {RANGES}, p AS (SELECT TIMESTAMP '1999-06-04 18:00:00' AS a, TIMESTAMP '1999-06-05 04:00:00' AS b) SELECT a AS starts, b AS ends, count(DISTINCT link_id) AS n_links FROM p, ranges WHERE {OVERLAP} GROUP BY 1, 2")
def period_summary(d: Domain) -> DataFrame:
    a, b = (F.to_timestamp_ntz(F.lit(str(x))) for x in TONIGHT)
    rows = ranges(d).where(intervals.overlaps(F.col("start"), F.col("end"), a, b))
    return rows.agg(F.countDistinct("link_id").alias("n_links")).select(a.alias("starts"), b.alias("ends"), "n_links")


#: Two filters: a nation's suppliers or supplier 3; and a topic or a period.
FILTERS = [
    [filters.Sense(kind="ASIA"), filters.Sense(entity=3)],
    [filters.Sense(topic="ECONOMY"), filters.Sense(period=(datetime(1999, 6, 4, 18), datetime(1999, 6, 5, 4)))],
]
LOG = f"""{RANGES}, log AS (SELECT 0 AS filter, link_id, entity_id FROM mentions JOIN entities USING (entity_id) WHERE kind_path = 'ASIA' OR starts_with(kind_path, 'ASIA.') OR entity_id = 3
UNION ALL SELECT 1, link_id, NULL FROM labelled WHERE topic = 'ECONOMY' OR starts_with(topic, 'ECONOMY.')
UNION ALL SELECT 1, link_id, NULL FROM ranges, (SELECT TIMESTAMP '1999-06-04 18:00:00' AS a, TIMESTAMP '1999-06-05 04:00:00' AS b) WHERE {OVERLAP}),
passed AS (SELECT link_id, list_sort(list(DISTINCT entity_id) FILTER (entity_id IS NOT NULL)) AS entity_ids FROM log GROUP BY 1 HAVING count(DISTINCT filter) = 2),
seen AS (SELECT DISTINCT floor(value)::INTEGER AS link_id FROM events WHERE user_id = 7 AND event_type IN ('view', 'click') AND ts <= TIMESTAMP '2024-01-20'),
listed AS (SELECT p.link_id, entity_ids, created_at, p.link_id IN (SELECT link_id FROM seen) AS seen FROM passed p JOIN links USING (link_id))"""


def seen_links(d: Domain) -> DataFrame:
    """What one reader saw: the whole part of an event's value names the link."""
    rows = d.raw("events").where("user_id = 7 AND event_type IN ('view', 'click')")
    return filters.seen_by(0, datetime(2024, 1, 20), rows.select(F.floor("value").cast("long").alias("link_id"), F.lit(0).alias("viewer"), F.col("ts").alias("at")))


def filtered(d: Domain) -> DataFrame:
    log = filters.matches(FILTERS, d.mentions(), d.entities(), d.labels(), ranges(d))
    seen = seen_links(d).withColumn("seen", F.lit(True))
    rows = filters.passing(log, len(FILTERS)).join(d.links().select("link_id", "created_at"), "link_id")
    return rows.join(seen, "link_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


@query("q_04_filter_links", f"WITH {LOG} SELECT link_id, entity_ids, created_at, seen FROM listed", lists="entity_ids")
def filter_links(d: Domain) -> DataFrame:
    return filtered(d).select("link_id", "entity_ids", "created_at", "seen")


@query("srt_03_keyset_page", f"WITH {LOG} SELECT link_id, created_at, seen FROM listed WHERE seen OR created_at < TIMESTAMP '1996-06-01' ORDER BY seen, created_at DESC, link_id DESC LIMIT 60")
def keyset_page(d: Domain) -> DataFrame:
    return filters.keyset_page(filtered(d).select("link_id", "created_at", "seen"), (False, datetime(1996, 6, 1), 0), 60)


@query("join_15_all_filters", f"WITH {LOG} SELECT link_id FROM passed")
def all_filters(d: Domain) -> DataFrame:
    return filters.passing(filters.matches(FILTERS, d.mentions(), d.entities(), d.labels(), ranges(d)), 2).select("link_id")


@query("join_05_semi_join", "SELECT link_id, title FROM links WHERE EXISTS (SELECT 1 FROM votes v WHERE v.link_id = links.link_id AND value = -1)")
def semi_join(d: Domain) -> DataFrame:
    down = d.votes().where("value = -1")
    return d.links().join(down, "link_id", "left_semi").select("link_id", "title")


@query(
    "join_14_required_groups",
    "WITH groups AS (SELECT * FROM (VALUES (1, [3, 5, 8], ['ring']), (2, [10, 11], ['small'])) t(g, ids, needed)), pairs AS (SELECT link_id, g, bool_or(len(list_filter(needed, lambda w: contains(title, w))) = len(needed)) "
    "OR bool_or(EXISTS (SELECT 1 FROM mentions m WHERE m.link_id = l.link_id AND list_contains(ids, m.entity_id))) AS ok FROM links l, groups GROUP BY 1, 2) SELECT link_id FROM pairs GROUP BY 1 HAVING bool_and(ok)",
)
def required_groups(d: Domain) -> DataFrame:
    groups = [([3, 5, 8], ["ring"]), ([10, 11], ["small"])]
    out = d.links().select("link_id", "title")
    for n, (ids, needed) in enumerate(groups):  # the groups are stated by the query
        named = d.mentions().where(F.col("entity_id").isin(ids)).select("link_id").distinct().withColumn(f"named_{n}", F.lit(True))
        says = F.forall(F.array(*[F.lit(w) for w in needed]), lambda w: F.contains(F.col("title"), w))
        out = out.join(named, "link_id", "left").where(F.coalesce(F.col(f"named_{n}"), F.lit(False)) | says)
    return out.select("link_id")


NET = "SELECT l.link_id, l.created_at, coalesce(ups, 0) - coalesce(downs, 0) AS net FROM links l LEFT JOIN counted USING (link_id)"


@query("q_03_feed_top", f"SELECT link_id, net FROM ({NET}) ORDER BY net DESC, created_at DESC, link_id DESC LIMIT 50")
def feed_top(d: Domain) -> DataFrame:
    rows = d.links().join(ranking.vote_counts(d.votes()), "link_id", "left")
    rows = rows.withColumn("net", F.coalesce("ups", F.lit(0)) - F.coalesce("downs", F.lit(0)))
    return rows.orderBy(F.desc("net"), F.desc("created_at"), F.desc("link_id")).limit(50).select("link_id", "net")


@query("q_03_feed_latest", "WITH seen AS (SELECT DISTINCT floor(value)::INTEGER AS link_id FROM events WHERE user_id = 7 AND event_type IN ('view', 'click') AND ts <= TIMESTAMP '2024-01-20') SELECT link_id, link_id IN (SELECT link_id FROM seen) AS seen FROM links ORDER BY seen, created_at DESC, link_id DESC LIMIT 80")
def feed_latest(d: Domain) -> DataFrame:
    rows = d.links().join(seen_links(d).withColumn("seen", F.lit(True)), "link_id", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return rows.orderBy("seen", F.desc("created_at"), F.desc("link_id")).limit(80).select("link_id", "seen")


@query("q_03_feed_discussed", "SELECT link_id, n_replies FROM links JOIN (SELECT conv_id AS link_id, count(*) AS n_replies FROM conversations GROUP BY 1) USING (link_id) ORDER BY n_replies DESC, created_at DESC, link_id DESC LIMIT 50")
def feed_discussed(d: Domain) -> DataFrame:
    counts = d.raw("conversations").groupBy(F.col("conv_id").alias("link_id")).agg(F.count(F.lit(1)).alias("n_replies"))
    return d.links().join(counts, "link_id").orderBy(F.desc("n_replies"), F.desc("created_at"), F.desc("link_id")).limit(50).select("link_id", "n_replies")


@query("srt_02_feed_order", "SELECT link_id, n_mentions, round(rank, 9) AS rank FROM ranked JOIN (SELECT link_id, count(*) FILTER (entity_id IN (3, 5, 8)) AS n_mentions FROM mentions GROUP BY 1) USING (link_id) ORDER BY n_mentions DESC, round(rank, 9) DESC, created_at DESC, link_id DESC LIMIT 50")
def feed_order(d: Domain) -> DataFrame:
    counts = d.mentions().groupBy("link_id").agg(F.count_if(F.col("entity_id").isin(3, 5, 8)).alias("n_mentions"))
    rows = feed(d).withColumn("rank", F.round("rank", 9)).join(counts, "link_id")
    return rows.orderBy(F.desc("n_mentions"), F.desc("rank"), F.desc("created_at"), F.desc("link_id")).limit(50).select("link_id", "n_mentions", "rank")


TITLES = [fulltext.Field("title", "A")]
SEARCH = f"""WITH {oracle_text.ranks('links', 'link_id', TITLES, [['small', 'ring']])},
found AS (SELECT link_id, rank AS r FROM ranks UNION ALL SELECT link_id, 0.02::DOUBLE FROM links WHERE contains(title, 'small') AND contains(title, 'rings')),
sums AS (SELECT link_id, sum(r) AS r FROM found GROUP BY 1)
SELECT link_id, round(r * (0.75 + 0.25 * power(0.5, date_diff('microsecond', created_at, TIMESTAMP '2001-12-31') / 86400000000.0 / 60)), 9) AS score, created_at FROM sums JOIN links USING (link_id)"""


@query("q_05_search_hits", f"SELECT link_id, score FROM ({SEARCH})")
def search_hits(d: Domain) -> DataFrame:
    found = search.hits(d.links(), d.mentions(), d.entities(), "Small rings", AS_OF)
    return found.select("link_id", F.round("score", 9).alias("score"))


@query("q_06_search_links", f"SELECT link_id, score FROM ({SEARCH}) ORDER BY score DESC, created_at DESC, link_id DESC LIMIT 20")
def search_links(d: Domain) -> DataFrame:
    found = search.hits(d.links(), d.mentions(), d.entities(), "Small rings", AS_OF).withColumn("score", F.round("score", 9))
    return ranking.page(found, [F.desc("score"), F.desc("created_at"), F.desc("link_id")], 0, 20, 50).select("link_id", "score")


@query("q_05_document_hits", f"WITH {DOCUMENT_TEXTS}, {oracle_text.ranks('document_texts', 'doc_id', DOCUMENT_FIELDS, [['apach', 'licens', 'version'], ['apach', 'licensed', 'version'], ['apache', 'licensed', 'versions'], ['gnu', 'licens'], ['gnu', 'licenses']], ['mit'])} SELECT doc_id, round(rank, 9) AS rank FROM ranks")
def document_hits(d: Domain) -> DataFrame:
    """Stems of licensing lines in every document, either of two alternatives, without a word."""
    asked = "licensed apache versions -mit or gnu licenses -mit"
    postings = staged(fulltext.index(document_texts(d), "doc_id", DOCUMENT_FIELDS, only=fulltext.asked(asked)), "document-hits")  # read twice below
    found = fulltext.ranks(postings, "doc_id", asked)
    return found.select("doc_id", F.round("rank", 9).alias("rank"))


GRAMS = """lambda s: list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(s), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""


@query(
    "join_16_trigram_similarity",
    f"WITH a AS (SELECT DISTINCT p_name AS a_name FROM part), g AS (SELECT a_name, list_transform([a_name], {GRAMS})[1] AS grams FROM a), "
    "s AS (SELECT l.a_name AS name, r.a_name AS other, len(list_intersect(l.grams, r.grams)) AS n, len(l.grams) AS x, len(r.grams) AS y FROM g l, g r) SELECT name, other, round(n / (x + y - n), 9) AS similarity FROM s WHERE n / (x + y - n) >= 0.3",
)
def trigram_similarity(d: Domain) -> DataFrame:
    names = d.raw("part").select(F.col("p_name").alias("name")).distinct().withColumn("text", F.col("name"))
    other = names.select(F.col("name").alias("other"), "text")
    return search.similar(names, other, "name", "text", "other", "text").select("name", "other", F.round("similarity", 9).alias("similarity"))


@query(
    "q_14_match_names",
    "WITH w AS (SELECT link_id, title, list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM links), h AS (SELECT link_id, title, len(ws) AS n, len(list_filter(ws, lambda x: x IN ('rings', 'ringss', 'ringses', 'ring') OR starts_with(x, 'sma'))) AS hits FROM w) "
    "SELECT link_id, title, n::INTEGER AS n, hits::INTEGER AS hits FROM h WHERE n > 0 AND 2 * hits >= n",
)
def match_names(d: Domain) -> DataFrame:
    found = search.match_names(d.links().select("link_id", F.col("title").alias("name")), ["Rings"], "sma")
    return found.select("link_id", F.col("name").alias("title"), "n", "hits")


@query("q_15_known_names", "SELECT name, count(*) AS n FROM (SELECT p_name AS name, split_part(lower(p_name), ' ', 1) AS first FROM part) WHERE first IN ('small', 'red') AND length(name) >= 3 GROUP BY 1")
def known_names(d: Domain) -> DataFrame:
    first = F.element_at(search.words(F.col("p_name")), 1)
    return d.raw("part").where(first.isin("small", "red") & (F.length("p_name") >= 3)).groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("join_24_ordered_join", "SELECT t.place, link_id, title FROM (VALUES (1, 9), (2, 4), (3, 17)) t(place, id) JOIN links ON id = link_id")
def ordered_join(d: Domain) -> DataFrame:
    places = d.spark.createDataFrame([(1, 9), (2, 4), (3, 17)], "place int, link_id long")
    return F.broadcast(places).join(d.links(), "link_id").select("place", "link_id", "title")


@query("str_15_as_of", "SELECT count(*) AS n FROM links WHERE created_at <= TIMESTAMP '1996-01-01'")
def as_of(d: Domain) -> DataFrame:
    return d.links().where(F.col("created_at") <= F.lit(datetime(1996, 1, 1))).agg(F.count(F.lit(1)).alias("n"))
