"""Nearest rows in blocks, against plain loops."""

import random
import tracemalloc

import numpy as np

from tidemark.operators import vectors


def plain(rows, queries, k):
    out = []
    unit = lambda v: np.array(v, float) / max(np.linalg.norm(v), 1e-300)
    for q, v in queries:
        met = sorted(((-round(float(unit(v) @ unit(w)), 9), i) for i, w in rows if i != q))[:k]
        out += [(q, i, -s, n) for n, (s, i) in enumerate(met, 1)]
    return sorted(out)


def test_blocks_give_the_k_best_and_ties_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_SCORES", 40)
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in rng.sample(range(1000), 150)]
    rows += [(2000 + i, [1.0, 1.0, 0.0]) for i in range(9)] + [(3000, [0.0, 0.0, 0.0])]
    queries = rows[:25] + rows[-3:]
    for k in (1, 4, 200):
        found = vectors.nearest(spark.createDataFrame(rows, "id long, vec array<double>").repartition(3), spark.createDataFrame(queries, "query long, q array<double>"), k)
        got = sorted((r["query"], r["candidate"], round(r["score"], 9) + 0.0, r["rank"]) for r in found.collect())
        assert got == [(q, i, round(s, 9) + 0.0, n) for q, i, s, n in plain(rows, queries, k)]


def test_a_batch_is_never_multiplied_at_once(spark, monkeypatch):
    """10,000 queries meet a batch of 10,000 rows in some hundred MB less than all their scores take."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    taken = {}

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            vec = pa.ListArray.from_arrays(np.arange(0, 8 * 10_000 + 1, 8, dtype=np.int32), rng.normal(size=80_000))
            batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), vec], ["id", "vec"])
            tracemalloc.start()
            taken["rows"] = sum(b.num_rows for b in run(iter([batch])))
            taken["peak"] = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            raise StopIteration

    queries = spark.range(0, 10_000).selectExpr("id AS query", "transform(sequence(1, 8), x -> cast((id * x) % 7 - 3 AS double)) AS q")
    try:
        vectors.nearest(Rows(), queries, 1)
    except StopIteration:
        pass
    assert taken["rows"] == 10_000 and taken["peak"] < 200e6  # all scores: 800 MB


def test_a_sweep_multiplies_the_vectors_once(spark, monkeypatch):
    from tidemark.plans import registry

    made, nearest = [], vectors.nearest
    monkeypatch.setattr(vectors, "nearest", lambda *a: made.append(nearest(*a)) or made[-1])
    found = registry.QUERIES["vec_11_matched_coverage"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString() and found.count()
