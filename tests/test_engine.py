"""Operators of the engine on small tables, and all registered queries against DuckDB on the smallest data."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates, change_index, edits, filters, hierarchy, intervals, search, vectors


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_hierarchy(spark):
    df = spark.createDataFrame([("a.b.c",), ("a.x",), ("d",)], "path string")
    assert rows(df.select("path", hierarchy.parent(F.col("path")).alias("p")).fillna("-"), "path", "p") == [("a.b.c", "a.b"), ("a.x", "a"), ("d", "-")]
    assert rows(hierarchy.with_ancestors(df, "path"), "ancestor") == [("a",), ("a",), ("a.b",), ("a.b.c",), ("a.x",), ("d",)]
    scores = spark.createDataFrame([("a", 0.2), ("a.b", 0.9)], "t string, score double")
    near = hierarchy.nearest_ancestor(df, [], "path", scores, "t", "score", 0.5)
    assert rows(near, "path", "score") == [("a.b.c", 0.9), ("a.x", 0.2), ("d", 0.5)]
    assert rows(df.select(hierarchy.reroot(F.col("path"), "a.b", "d").alias("p")), "p") == [("a.x",), ("d",), ("d.b.c",)]
    assert rows(hierarchy.inconsistent(df, "path"), "missing") == [("a",), ("a",), ("a.b",)]


def test_periods_keep_the_evening_before():
    tonight = intervals.PERIODS["tonight"]
    assert tonight.interval(datetime(2026, 10, 17, 1, 30)) == (datetime(2026, 10, 16, 18), datetime(2026, 10, 17, 4))
    assert tonight.interval(datetime(2026, 10, 16, 21, 30)) == (datetime(2026, 10, 16, 18), datetime(2026, 10, 17, 4))


@pytest.fixture(scope="module")
def calendar(spark):
    d = date
    listed = [
        ("concert", d(2026, 10, 16), None, 21),
        ("talk", d(2026, 10, 16), None, 10),
        ("exhibition", d(2026, 10, 1), d(2026, 10, 31), None),
        ("club", d(2026, 10, 17), None, 2),
        ("market", d(2026, 10, 17), None, None),
        ("open-ended", None, d(2026, 11, 15), None),
        ("next week", d(2026, 10, 23), None, 19),
    ]
    df = spark.createDataFrame(listed, "link_id string, a date, b date, h int")
    start, end = intervals.event_range(F.col("a"), F.col("b"), F.col("h"))
    return df.select("link_id", start.alias("start"), end.alias("end"))


@pytest.mark.parametrize("term, found", [("tonight", ["club", "concert", "exhibition", "open-ended"]), ("tomorrow", ["club", "exhibition", "market", "open-ended"])])
def test_events_in_periods(spark, calendar, term, found):
    a, b = intervals.PERIODS[term].interval(datetime(2026, 10, 16, 21, 30))
    bounds = [F.to_timestamp_ntz(F.lit(str(x))) for x in (a, b)]
    assert [x for x, in rows(calendar.where(intervals.overlaps(F.col("start"), F.col("end"), *bounds)), "link_id")] == found
    periods = spark.range(1).select(bounds[0].alias("p"), bounds[1].alias("q"))
    assert [x for x, in rows(intervals.overlap_join(calendar, "start", "end", periods, "p", "q", 5), "link_id")] == found


def test_filters_refuse_what_is_no_sense():
    with pytest.raises(ValueError):
        filters.Sense()
    with pytest.raises(ValueError):
        filters.Sense(kind="a", topic="b")
    with pytest.raises(ValueError):
        filters.checked([])
    with pytest.raises(ValueError):
        filters.checked([[]])


def test_keyset_pages_make_the_whole(spark):
    listed = [(i % 3 == 0, datetime(2026, 1, 1 + i % 5), i) for i in range(23)]
    df = spark.createDataFrame(listed, "seen boolean, created_at timestamp, link_id long")
    whole, cursor = [], None
    while page := [tuple(r) for r in filters.keyset_page(df, cursor, 7).collect()]:
        whole += page
        cursor = page[-1]
    assert whole == sorted(listed, key=lambda r: (r[0], -r[1].timestamp(), -r[2]))


def test_undo_restores_every_row(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 11, "c"), (2, 12, "c"), (3, 11, None)], "link long, entity long, v string")
    mapping = spark.createDataFrame([(11, 10)], "old long, new long")
    merged, snapshot = edits.merge_keys(df, "entity", mapping, ["link", "entity"], ["v"])
    assert rows(merged.fillna("-"), "link", "entity", "v") == [(1, 10, "a"), (2, 10, "c"), (2, 12, "c"), (3, 10, "-")]
    back = edits.unmerge_keys(merged, snapshot, "entity", mapping)
    assert rows(back.fillna("-"), *df.columns) == rows(df.fillna("-"), *df.columns)


def test_snapshot_and_diff_make_a_fresh_snapshot(spark):
    keys = ["link", "entity"]
    old = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "link long, entity long")
    new = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "link long, entity long")
    log = change_index.changed_keys(old, new, keys).withColumn("seq", F.lit(5))
    changes = change_index.diff(log, new, keys, 4)
    once = change_index.apply_diff(old, changes, keys)
    assert rows(once, *keys) == rows(change_index.apply_diff(once, changes, keys), *keys) == rows(new, *keys)
    ids = spark.createDataFrame([([3, 7, 20],), ([],)], "ids array<long>")
    assert rows(ids.select(change_index.undeltas(change_index.deltas(F.col("ids"))).alias("x")), "x") == [([],), ([3, 7, 20],)]


def test_upsert_keeps_what_new_rows_leave_out(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, name string, n int")
    new = spark.createDataFrame([(1, "", 6), (3, "c", 7)], "id long, name string, n int")
    assert [tuple(r) for r in edits.upsert(old, new, ["id"]).orderBy("id").collect()] == [(1, "a", 6), (2, "b", None), (3, "c", 7)]


def test_clusters_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a long, b long")
    assert set(rows(aggregates.clusters(chain), "cluster")) == {(0,), (21,)}


def test_names_and_similarity(spark):
    names = spark.createDataFrame([(1, "Palais de Tokyo"), (2, "Tokyo Tower"), (3, "Élysée")], "entity_id long, name string")
    assert rows(search.match_names(names, ["palais"], None), "entity_id") == [(1,)]
    assert rows(search.match_names(names, ["towers"], "tok"), "entity_id") == [(1,), (2,)]
    assert rows(names.where(search.fold(F.col("name")) == "elysee"), "entity_id") == [(3,)]
    found = names.select(search.similarity(search.trigrams(F.col("name")), search.trigrams(F.col("name"))).alias("s"))
    assert {r["s"] for r in found.collect()} == {1.0}


def test_phase_vectors(spark):
    df = spark.createDataFrame([(1, ["ab", "bc"]), (2, ["ab", "bc"]), (3, ["zz"]), (4, [])], "id long, tokens array<string>")
    coded = vectors.encode_phases(df, "tokens", 128)
    a, b = coded.alias("a"), coded.alias("b")
    pairs = a.crossJoin(b).select(F.col("a.id").alias("x"), F.col("b.id").alias("y"), vectors.phase_similarity(F.col("a.re"), F.col("a.im"), F.col("b.re"), F.col("b.im")).alias("s"))
    score = {(r["x"], r["y"]): r["s"] for r in pairs.collect()}
    assert score[1, 2] == pytest.approx(1.0) and abs(score[1, 3]) < 0.3 and score[4, 4] == 0
    re, im = vectors.bind(F.col("re"), F.col("im"), F.col("re"), F.col("im"), inverse=True)
    row = coded.where("id = 3").select(re.alias("re"), im.alias("im")).first()
    assert all(x == pytest.approx(1 / 128) for x in row["re"]) and all(abs(y) < 1e-12 for y in row["im"])


def test_feeds_and_calendars(spark):
    from tidemark.sources import feeds, pages

    rss = "<rss><item><title>One &amp; two</title><link>http://x/1</link><pubDate>d</pubDate><description><![CDATA[<p>t</p>]]></description></item><item><title>no link</title></item></rss>"
    atom = '<feed><entry><title>A</title><link rel="self" href="http://x/s"/><link href="http://x/a"/><updated>u</updated></entry></feed>'
    files = spark.createDataFrame([("r", rss), ("a", atom), ("n", None)], "source string, content string")
    assert rows(feeds.parse_feeds(files), "source", "url", "title") == [("a", "http://x/a", "A"), ("r", "http://x/1", "One & two")]
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long\\, na\r\n me\r\nDTSTART;TZID=Europe/Paris:20261016T210000\r\nBEGIN:VALARM\r\nSUMMARY:x\r\nEND:VALARM\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:no start\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nSUMMARY:Day\r\nDTSTART;VALUE=DATE:20261017\r\nDTEND;VALUE=DATE:20261018\r\nEND:VEVENT\r\nEND:VCALENDAR"
    found = feeds.parse_calendars(spark.createDataFrame([("c", ics)], "source string, content string"))
    at = feeds.wall_clock(F.col("starts"), F.col("starts_zone"), "UTC").cast("string")
    assert rows(found.select("summary", at.alias("at")), "summary", "at") == [("Day", "2026-10-17 00:00:00"), ("Long, name", "2026-10-16 19:00:00")]
    page = '<script type="application/ld+json">{"@type":"Event","name":"E","startDate":"2026","author":{"@type":"Person","name":"P"}}</script>'
    declared = pages.with_declared(spark.createDataFrame([(page,), (None,)], "html string")).collect()
    assert [[x["name"] for x in r["declared"]] for r in declared] == [["E"], []]


def test_stream_upserts_end_like_the_batch(spark, tmp_path):
    from tidemark.streaming import events

    stream = events.read_events(spark, "/root/testdata/sf0.001").select("user_id", "event_type", "event_id")
    events.finished(stream, each=events.upsert_into(spark, str(tmp_path), ["user_id"], ["event_id"]))
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert rows(spark.read.parquet(f"{tmp_path}/version=0"), "user_id", "event_id") == rows(batch, "user_id", "event_id")


def test_stream_results_stay_off_the_driver(spark, tmp_path):
    from tidemark.streaming import events

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(2):  # a batch for each file
        source.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path))
    batch = source.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = events.read_events(spark, str(tmp_path), "*.parquet")
    some = events.finished(stream.select("event_id"))
    assert rows(some, "event_id") == rows(batch, "event_id")
    total = events.finished(events.retracting_counts(stream.withColumn("sign", F.lit(1)), "event_type"), "complete")
    assert rows(total, "event_type", "n") == rows(batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type", "n")
    state = events.finished(events.followed_by_state(stream), "update")
    assert rows(state.groupBy("user_id").agg(F.max("n").alias("n")), "user_id", "n") == rows(batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id", "n")
    assert some.inputFiles() and total.inputFiles() and state.inputFiles()


QUICK = "q_02_ranked_feed q_01_topic_preferences q_04_filter_links q_07_related_links q_16_relation_summary join_12_interval_overlap join_16_trigram_similarity q_28_merge_entities q_30_undo_merge q_40_index_diff".split()


@pytest.mark.parametrize("name", QUICK)
def test_queries_match_duckdb(spark, name):
    import duckdb

    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    mine = __spark_entry__.queries()[name](spark, folder).toPandas()
    other = con.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(other.columns)
    as_rows = lambda df: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[columns].itertuples(index=False))
    assert as_rows(mine) == as_rows(other)


def test_every_query_has_a_name_and_most_an_oracle():
    import __spark_entry__

    names, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(names) and len(oracles) > 100


def test_fragments_and_styles(spark):
    from tidemark.operators import spans, styles

    texts = spark.createDataFrame([(1, "the palais de tokyo in tokyo".split()), (2, "palais de tokyo".split())], "text_id long, words array<string>")
    names = spark.createDataFrame([("palais de tokyo", "palais de tokyo".split()), ("tokyo", ["tokyo"])], "name string, parts array<string>")
    assert rows(spans.fragments(spans.occurrences(texts, names)), "text_id", "name") == [(2, "tokyo")]
    schema = [styles.Declaration("text_color", "color"), styles.Declaration("gap", "size")]
    values = spark.createDataFrame([(1, "text_color", "#00ff00"), (1, "gap", "2px"), (2, "gap", "url(x)"), (2, "other", "1px")], "style_id long, name string, value string")
    assert rows(styles.offending(values, schema), "style_id", "name") == [(2, "gap"), (2, "other")]
    assert rows(styles.declarations(values, schema), "css") == [("gap: 2px; text-color: #00ff00",)]
    with pytest.raises(ValueError):
        styles.Declaration("gap", "script")
