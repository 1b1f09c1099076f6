"""Sparse cosines without an index, against the index and its SQL."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from tidemark.operators import sparse


@pytest.mark.parametrize(("frequent", "scores", "most"), [(50_000, 1_000_000, 100_000), (3, 30, 100_000), (0, 30, 100_000), (3, 30, 5)])
def test_nearest_sets_are_those_of_the_index(spark, monkeypatch, frequent, scores, most):
    for name, value in (("FREQUENT", frequent), ("MOST_SCORES", scores), ("MOST_ASKED", most)):
        monkeypatch.setattr(sparse, name, value)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    lists = [(k, rng.choices(words, [1 / (n + 1) for n in range(40)], k=rng.randint(0, 12))) for k in range(120)] + [(500, None), (7, ["w1", "w39"])]  # id 7 twice
    queries = [(q, w) for q in range(12) for w in set(rng.choices(words + ["nowhere"], k=5))] + [(99, "nowhere")]
    sets, asked = spark.createDataFrame(lists, "id long, tokens array<string>"), spark.createDataFrame(queries, "query long, token string")
    wanted = sparse.top_k(sparse.index(sets.select("id", F.explode("tokens").alias("token"))), asked, 5)
    columns = ["query", "id", "score", "rank"]
    mine = sparse.nearest(sets, asked, 5).select(*columns)
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, wanted.select(*columns).collect()))


def test_only_rare_tokens_are_staged_by_name(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(sparse, "FREQUENT", 2)
    monkeypatch.setattr(sparse, "staged", lambda df, name: kept.setdefault(name, df))
    sets = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "d"]), (3, ["a", "q"])], "id long, tokens array<string>")
    sparse.nearest(sets, spark.createDataFrame([(1, "q")], "query long, token string"), 2)
    assert set(kept) == {"sparse-terms", "sparse-parts"}
    assert sorted((r["id"], r["rare"]) for r in kept["sparse-parts"].collect()) == [(1, ["c"]), (2, ["d"]), (3, [])]
