"""Links between terms and the graph of entities, by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import terms

PAIR = "text long, a long, b long, same double, a_member double, b_member double, a_inherits double, b_inherits double, overlap double, a_in_b double, b_in_a double, confidence double"


def pairs(spark, rows, kinds):
    df = spark.createDataFrame(rows, PAIR)
    for side in "ab":
        table = spark.createDataFrame(list(kinds.items()), f"{side} long, {side}_individual double")
        df = df.join(table, side)
    return df


def by_link(df):
    return {(r["link"], r["a"], r["b"]): (r["strength"], r["confidence"]) for r in df.collect()}


def test_link_types_follow_kinds(spark):
    rows = [(1, 1, 2, 0.6, 0.1, 0.0, 0.1, 0.0, 0.1, 0.5, 0.5, 0.8), (1, 1, 3, 0.1, 0.4, 0.0, 0.2, 0.0, 0.1, 0.5, 0.5, 0.8), (1, 3, 4, 0.2, 0.2, 0.0, 0.2, 0.1, 0.2, 0.85, 0.15, None)]
    found = by_link(terms.term_links(pairs(spark, rows, {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0})))
    assert found[("identical", 1, 2)] == (0.6, 0.8)
    assert found[("member", 1, 3)] == (pytest.approx(0.6), 0.8)  # all that is held by an individual is membership
    x, y = 0.2 + 0.4 + (0.2 + 0.1) * 0.85, 0.2 + 0.1 + (0.2 + 0.4) * 0.15
    assert found[("subset", 3, 4)] == (pytest.approx(x), 0.0) and found[("subset", 4, 3)] == (pytest.approx(y), 0.0)
    assert found[("similarity", 3, 4)] == (pytest.approx(1 / (1 / x + 1 / y - 1)), 0.0)
    assert len(found) == 5


def test_untyped_links_keep_members_worth_telling(spark):
    rows = [(1, 1, 2, 0.0, 0.3, 0.04, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5)]
    found = by_link(terms.term_links(pairs(spark, rows, {1: 1.0, 2: 1.0}), typed=False))
    assert set(found) == {("subset", 1, 2), ("subset", 2, 1), ("similarity", 1, 2), ("member", 1, 2)}
    assert found[("similarity", 1, 2)][0] == 0.0  # nothing shared, told as such


def test_expected_share(spark):
    got = spark.range(1).select(terms.expected_share(F.create_map(F.lit("few"), F.lit(0.4), F.lit("all"), F.lit(0.5), F.lit("other"), F.lit(0.1)))).first()[0]
    assert got == pytest.approx(0.4 * 0.15 + 0.5)


def test_intension_by_shared_properties(spark):
    said = [(1, "x", 0.5), (1, "y", 1.0), (1, "z", 1.0), (2, "x", 0.2), (2, "y", 0.4), (3, "q", 1.0), (4, "x", 0.0)]
    found = by_link(terms.intension_links(spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 2)], "a long, b long"), spark.createDataFrame(said, "term long, property string, p double")))
    assert found[("intensional_inheritance", 1, 2)] == (pytest.approx(1.0), pytest.approx(2 / 12))
    assert found[("intensional_inheritance", 2, 1)][0] == pytest.approx(0.6 / 1.5) and found[("intensional_similarity", 1, 2)][0] == pytest.approx(0.6 / 1.5)
    assert ("intensional_similarity", 1, 3) not in found and found[("intensional_inheritance", 1, 4)][0] == 0.0


def test_revision_weighs_evidence(spark):
    links = spark.createDataFrame([("similarity", 2, 1, 0.2, 0.5), ("similarity", 1, 2, 0.8, 0.75), ("subset", 2, 1, 0.4, 1.0), ("subset", 1, 2, 0.4, None)], "link string, a long, b long, strength double, confidence double")
    found = by_link(terms.revised(links))
    assert found[("similarity", 1, 2)] == (pytest.approx((0.2 + 3 * 0.8) / 4), pytest.approx(0.8))
    assert found[("subset", 2, 1)] == (pytest.approx(0.4), pytest.approx(0.99)) and found[("subset", 1, 2)] == (0.0, 0.0)


def test_chained_mentions_conflict(spark):
    """1 and 2, 2 and 3 are the same, 1 and 3 are not; 4 begins like the first entity; 5 is another text's."""
    mentions = spark.createDataFrame([(1, 1, "Bank", 0.9, 0.8), (1, 2, "the Bank", 0.9, 0.6), (1, 3, "Bank of X", 0.6, 0.7), (1, 4, "bank", 0.1, 0.9), (2, 5, "bank", 1.0, 0.5)], "text long, mention long, surface string, individual double, confidence double")
    judged = [(1, 1, 2, 0.9), (1, 2, 3, 0.7), (1, 1, 3, 0.1), (1, 1, 4, 0.2), (1, 2, 4, 0.1), (1, 3, 4, 0.0)]
    pairs_ = spark.createDataFrame([(t, a, b, s, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5) for t, a, b, s in judged], PAIR)
    graph = terms.entity_graph(mentions, pairs_)
    assert {r["entity"]: r["label"] for r in graph.entities.collect()} == {1: "Bank of X", 4: "bank", 5: "bank"}
    assert {r["entity"]: r["individual"] for r in graph.entities.collect()}[1] == pytest.approx(0.8)
    assert {r["mention"]: r["strength"] for r in graph.mentions.collect()} == {1: pytest.approx(0.5), 2: pytest.approx(0.8), 3: pytest.approx(0.4), 4: 1.0, 5: 1.0}
    assert [(r["a"], r["b"]) for r in graph.conflicts.collect()] == [(1, 3)]
    assert by_link(graph.links) == {("member", 1, 4): (pytest.approx(0.4), pytest.approx(0.75))}  # three pairs, each of one piece of evidence


def test_no_pairs_at_all(spark):
    mentions = spark.createDataFrame([(1, 1, "x", None, None)], "text long, mention long, surface string, individual double, confidence double")
    graph = terms.entity_graph(mentions, spark.createDataFrame([], PAIR))
    assert [(r["entity"], r["label"]) for r in graph.entities.collect()] == [(1, "x")]
    assert graph.mentions.count() == 1 and graph.links.count() == 0 and graph.conflicts.count() == 0
