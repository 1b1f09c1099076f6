"""Requests that meet stored rows, against one request after another."""

import random

from tidemark.operators import stores


def test_pending_rows_are_renewed_and_others_left(spark):
    stored = spark.createDataFrame([("a", "p", "pending", 5, 2), ("a", "q", "active", 4, 1), ("b", "p", "pending", 9, 1), ("c", "p", None, 1, 1)], "owner string, page string, status string, at int, requests long")
    asked = spark.createDataFrame([("a", "p", 7), ("a", "q", 6), ("b", "p", 3), ("d", "p", 8), ("d", "p", 2)], "owner string, page string, at int")
    got = {tuple(r) for r in stores.merge_pending(stored, asked, ["owner", "page"], "at").collect()}
    assert got == {("a", "p", "pending", 7, 3), ("a", "q", "active", 4, 1), ("a", "q", "pending", 6, 1), ("b", "p", "pending", 9, 2), ("c", "p", None, 1, 1), ("d", "p", "pending", 8, 2)}


def test_counters_as_if_one_request_followed_another(spark):
    rng = random.Random(9)
    before = {k: rng.randint(0, 6) for k in range(20)}
    asks = [(rng.randint(0, 25), n) for n in range(150)]
    backs = [(rng.randint(0, 25),) for _ in range(60)]
    used, told = dict(before), {}
    for key, n in asks:
        if used.get(key, 0) < 5:
            used[key] = used.get(key, 0) + 1
            told[n] = 5 - used[key]
        else:
            told[n] = None
    stored = spark.createDataFrame(list(before.items()), "account long, used long")
    rows = stores.spend(stored, spark.createDataFrame(asks, "account long, ask long"), "account", "ask", 5)
    assert {r["ask"]: r["remaining"] for r in rows.collect()} == told
    after = stores.after_spending(stored, rows, "account")
    assert {r["account"]: r["used"] for r in after.collect()} == used
    for (key,) in backs:
        if key in used:
            used[key] = max(0, used[key] - 1)
    assert {r["account"]: r["used"] for r in stores.refund(after, spark.createDataFrame(backs, "account long"), "account").collect()} == used


def test_presence_both_ways(spark):
    got = stores.presence(spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(2,), (2,), (3,)], "k int"), ["k"]).collect()
    assert {tuple(r) for r in got} == {(1, True, False, 0), (2, True, True, 2), (3, False, True, 1)}
