"""Decisions on proposals, senses read from columns, and both ways of the overlap join."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators import filters, intervals, states


def test_accepted_examples_become_labels(spark):
    proposals = spark.createDataFrame([(1, 7, "a.b", " B ", "open"), (2, 8, "a.b", "B2", "open"), (3, 7, "a", "A", "open"), (4, 7, "a.c", "C", "rejected"), (5, 9, "a.d", "D", "open"), (6, 9, "a.e", None, "open")], "proposal_id long, person long, topic string, name string, status string")
    decisions = spark.createDataFrame([(2, True, 1), (1, True, 2), (3, True, 1), (4, True, 1), (5, False, 1), (5, True, 2), (99, True, 1)], "proposal_id long, accept boolean, at long")
    topics = spark.createDataFrame([("a",)], "topic string")
    examples = spark.createDataFrame([(1, 10, 0.9), (1, 10, 0.4), (1, 11, 0.5), (2, 12, 0.5), (5, 13, 0.5)], "proposal_id long, link_id long, p double")
    labels = spark.createDataFrame([(11, "a.b", 0.1)], "link_id long, topic string, p double")
    out = states.decide_proposals(proposals, decisions, topics, examples, labels)
    assert {r["proposal_id"]: r["status"] for r in out.proposals.collect()} == {1: "accepted", 2: "open", 3: "open", 4: "rejected", 5: "rejected", 6: "open"}
    assert [tuple(r) for r in out.topics.collect()] == [("a.b", "B", 7)]
    assert [tuple(r) for r in out.labels.collect()] == [(10, "a.b", 0.9, "manual")]  # the label that is there stays
    refusals = {(r["proposal_id"], r["accept"]): r["refusal"] for r in out.decisions.collect()}
    assert refusals == {(2, True): "already a topic", (1, True): None, (3, True): "already a topic", (4, True): "no open proposal", (5, False): None, (5, True): "decided already", (99, True): "no open proposal"}


def test_senses_of_stored_filters(spark):
    rows = [({"topic": "A.b"}, "topic", "A.b", None), ({"time": "tonight"}, "period", "2001-01-01 18:00:00|2001-01-02 04:00:00", None), ({}, None, None, "exactly one of entity, kind, topic and period"), (None, None, None, "exactly one of entity, kind, topic and period")]
    rows += [({"entity": "x"}, None, None, "an entity is a number"), ({"period": "2001-01-01"}, None, None, "a period has two ends"), ({"period": "2001-01-02|2001-01-01"}, None, None, "a period ends after it starts"), ({"kind": ""}, None, None, "bad path: "), ({"other": "1"}, None, None, "exactly one of entity, kind, topic and period")]
    df = spark.createDataFrame([(n, r[0], datetime(2001, 1, 2, 3)) for n, r in enumerate(rows)], "n int, given map<string,string>, at timestamp_ntz")
    got = df.select("n", filters.read_senses(F.col("given"), F.col("at")).alias("s")).orderBy("n").collect()
    assert [tuple(r["s"]) for r in got] == [r[1:] for r in rows]
    none = spark.range(1).select(filters.read_senses(F.create_map(F.lit("time"), F.lit("today")), F.lit(None).cast("timestamp_ntz")).alias("s")).first()
    assert none["s"]["error"] == "when is today"


def test_named_periods_are_the_driver_side_ones(spark):
    moments = [datetime(2001, 3, 1, h, 30) for h in range(24)]
    df = spark.createDataFrame([(m, t) for m in moments for t in intervals.PERIODS], "at timestamp_ntz, term string")
    for r in df.select("at", "term", intervals.named(F.col("term"), F.col("at")).alias("p")).collect():
        assert tuple(r["p"]) == intervals.PERIODS[r["term"]].interval(r["at"])


def test_both_ways_of_the_overlap_join(spark):
    day = lambda n: None if n is None else datetime(2001, 1, 1 + n)
    spans = [(0, 3), (2, 2), (None, 4), (5, None), (None, None), (9, 20), (3, 3), (6, 7)]
    events = spark.createDataFrame([(n, day(a), day(b)) for n, (a, b) in enumerate(spans)], "id int, s timestamp_ntz, e timestamp_ntz")
    periods = spark.createDataFrame([(n, day(n), day(n + 2)) for n in range(12)], "period int, a timestamp_ntz, b timestamp_ntz")
    pairs = lambda df: sorted((r["id"], r["period"]) for r in df.collect())
    expected = sorted((n, k) for n, (a, b) in enumerate(spans) for k in range(12) if (a is None or a < k + 2) and (b is None or k < b))
    assert pairs(intervals.overlap_join(events, "s", "e", periods, "a", "b")) == expected
    assert pairs(intervals.overlap_join(events, "s", "e", periods, "a", "b", bucket_days=3, most_listed=5)) == expected
    assert pairs(intervals.overlap_join(events, "s", "e", periods.limit(0), "a", "b")) == []
