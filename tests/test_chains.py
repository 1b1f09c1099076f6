"""Chains and circles of `same` of any length, against walking them."""

import random

from tidemark.operators import judging


def walk(start, other):
    seen, at = {}, start
    while at in other and at not in seen:
        seen[at] = len(seen)
        at = other[at]
    return min(i for i, n in seen.items() if n >= seen[at]) if at in seen else at


def test_chains_and_circles_of_any_length(spark):
    rng, other, ids = random.Random(4), {}, list(range(14_000))
    rng.shuffle(ids)
    take = iter(ids)
    for size in (1, 2, 33, 100, 10_000):  # chains to an end
        chain = [next(take) for _ in range(size + 1)]
        other.update(zip(chain, chain[1:]))
    for size, tail in ((1, 0), (2, 3), (7, 40), (1000, 300)):  # circles, and what leads into them
        circle = [next(take) for _ in range(size)]
        other.update(zip(circle, circle[1:] + circle[:1]))
        lead = [next(take) for _ in range(tail)] + [circle[size // 2]]
        other.update(zip(lead, lead[1:]))
    other[20_000] = 20_001  # an end that is no entity
    entities = spark.createDataFrame([(i,) for i in [*ids, 20_000]], "entity_id long")
    same = spark.createDataFrame(list(other.items()), "entity_id long, other long")
    got = {r["entity_id"]: r["root"] for r in judging.follow_same(entities, same).collect()}
    some = [i for i in ids if i % 37 == 0] + [20_000]
    assert len(got) == len(ids) + 1 and all(got[i] == walk(i, other) for i in some)
    assert judging.follow_same(entities.limit(0), same).count() == 0 and judging.follow_same(entities.where("entity_id < 5"), same.limit(0)).count() == 5
