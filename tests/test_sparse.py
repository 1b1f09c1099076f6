"""Sparse searches against brute force, and how much of the index they read."""

import math
import random

import pytest

from tidemark.operators import sparse


def brute(sets, queries, k, cosine, own):
    n, df = len(sets), {}
    for s in sets.values():
        for t in s:
            df[t] = df.get(t, 0) + 1
    w = (lambda t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1) if cosine else (lambda t: 1.0)
    out = {}
    for q, a in queries.items():
        scores = []
        for i, b in sets.items():
            if own and i == q or not a & b:
                continue
            if cosine:
                score = sum(w(t) ** 2 for t in a & b) / math.sqrt(sum(w(t) ** 2 for t in a) * sum(w(t) ** 2 for t in b))
            else:
                score = len(a & b) / len(a | b)
            scores.append((-round(score, 9), i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("own", [True, False])
def test_the_best_sets_equal_brute_force(spark, cosine, own):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    draw = lambda n: {words[min(299, int(rng.paretovariate(0.7)) - 1)] for _ in range(n)}  # noqa: E731  a few frequent words
    sets = {k: draw(rng.randint(1, 40)) for k in range(400)}
    sets |= {400 + k: set(sets[7]) for k in range(30)}  # a group of copies
    queries = {k: sets[k] for k in range(0, 430, 9)} if own else {k: draw(12) | {"unknown"} for k in range(40)} | {99: {"nowhere"}}
    table = lambda x, key: spark.createDataFrame([(k, t) for k, s in x.items() for t in s], f"{key} long, token string")
    found = sparse.index(table(sets, "id"), cosine)
    rows = sparse.top_k(found, table(queries, "query"), 5, own).collect()
    got = {q: [] for q in queries}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["query"]].append((r["id"], r["score"]))
    want = brute(sets, queries, 5, cosine, own)
    for q in queries:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=2e-9), q


def test_frequent_lists_are_not_read(spark):
    sets = {k: {"every", "where", f"rare{k}", f"rarer{k}"} for k in range(500)}
    rows = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "id long, token string")
    queries = spark.createDataFrame([(k, t) for k in range(20) for t in sets[k]], "query long, token string")
    found = sparse.index(rows)
    assert sparse.postings_read(found, queries, 1, first=2) == (40, 20 * 1002)
    assert {(r["query"], r["id"]) for r in sparse.top_k(found, queries, 1, first=2).collect()} == {(k, k) for k in range(20)}


def test_sweeps_equal_counting_at_each_threshold(spark):
    rng = random.Random(6)
    tops = [(rng.choice("ab"), rng.choice([None, *(x / 10 for x in range(10))]), rng.random() < 0.6) for _ in range(200)]
    swept = sparse.sweep(spark.createDataFrame(tops, "source string, score double, right boolean"), ["source"])
    rows = swept.collect()
    for r in rows:
        own = [t for t in tops if t[0] == r["source"]]
        at = [t for t in own if t[1] is not None and t[1] >= r["threshold"]]
        assert (r["covered"], r["coverage"], r["precision"]) == (len(at), pytest.approx(len(at) / len(own)), pytest.approx(sum(t[2] for t in at) / len(at)))
    half = {r["source"]: r["threshold"] for r in sparse.at_coverage(swept, ["source"], 0.5).collect()}
    assert half == {s: min(r["threshold"] for r in rows if r["source"] == s and r["coverage"] <= 0.5) for s in "ab"}
