"""Exact top-k by integer inner product through a pivot-distance index.

Components become floor(scale * x). One more component, sqrt(M^2 - |x|^2) with M the largest length,
gives all vectors the same length, so that the largest inner product with a query (whose own further
component is 0) is the smallest distance: |q - x|^2 = |q|^2 + M^2 - 2 q.x. Each vector is keyed by its
nearest pivot and its distance to it, and the table is range-sorted by that key: a segment is an
annulus round one pivot. By the triangle inequality no vector of an annulus [a, b] is nearer to a query
at distance d from the pivot than max(d - b, a - d, 0), so its inner product has an upper bound.
For each query a task takes the annuli with the best bound first and stops at the first whose bound is
below its k-th best; within an annulus only the rows whose own bound may still count are scored.

The bound is widened by a rounding margin and scores are whole numbers, exact below 2^53; beyond that
Python's integers take over. Whole components of 2^53 or more and scores beyond 64 bits are errors. Rows that repeat an id give that id
once for each of their scores; an empty table gives no rows; other columns are left out,
whatever their names. Vectors that are null or hold null or non-finite components take no part,
nor do vectors whose number of components differs from the query's. Equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vectors

#: Pivots, at most, and vectors in an annulus.
PIVOTS = 32
ANNULUS = 512
EXACT = float(1 << 53)


def choose_pivots(rows: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Rows with the smallest hashes of their id, by vector size."""
    out: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect():  # bounded
        out.setdefault(len(r["vec"]), []).append(r["vec"])
    return {n: np.array(x) for n, x in out.items()}


def distances(vecs: np.ndarray, rest: np.ndarray, pivots: np.ndarray, pivot_rest: np.ndarray) -> np.ndarray:
    """Distances to the pivots, both with their further component."""
    squares = (vecs**2).sum(1) + rest**2
    pivot_squares = (pivots**2).sum(1) + pivot_rest**2
    return np.sqrt(np.maximum(squares[:, None] + pivot_squares - 2 * (vecs @ pivots.T + np.outer(rest, pivot_rest)), 0))


def scores_of(vecs: np.ndarray, query: np.ndarray) -> list[int]:
    if np.abs(vecs).sum(axis=1).max(initial=0) * max(1.0, np.abs(query).max(initial=0)) < EXACT:
        return (vecs @ query).astype(np.int64).tolist()
    q = [int(x) for x in query.tolist()]
    return [sum(int(x) * y for x, y in zip(v, q)) for v in vecs.tolist()]


def search(df: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", n_pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score long): for each row that `queries` (over vec_id) marks, its k best among all other rows."""
    rows = vectors.plain(df, id_col, vec_col)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.when(F.abs(x * float(scale)) < EXACT, F.floor(x * float(scale)).cast("double")).otherwise(EXACT)))
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    found = rows.agg(F.max(square).alias("square"), F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))).alias("most")).first()
    largest = found["square"] or 0.0
    if (found["most"] or 0.0) >= EXACT:
        raise ValueError(f"components of 2^53 / {scale} or more cannot be turned into whole numbers exactly")
    chosen = choose_pivots(rows, n_pivots)
    shared = df.sparkSession.sparkContext.broadcast((chosen, largest))

    def rest_of(vecs: np.ndarray, largest: float) -> np.ndarray:
        return np.sqrt(np.maximum(largest - (vecs**2).sum(1), 0))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, largest = shared.value
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            pivot, distance = np.full(len(sizes), -1, np.int32), np.zeros(len(sizes))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size in chosen:
                    vecs = vectors.matrix(batch.column(1).take(pa.array(at)), size)
                    d = distances(vecs, rest_of(vecs, largest), chosen[size], rest_of(chosen[size], largest))
                    pivot[at], distance[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(distance), *batch.columns], ["pivot", "distance", "vec_id", "vec"])

    keyed = rows.mapInArrow(key, "pivot int, distance double, vec_id bigint, vec array<double>").withColumn("dims", F.size("vec"))
    annuli = keyed.repartitionByRange("dims", "pivot", "distance", "vec_id").sortWithinPartitions("dims", "pivot", "distance", "vec_id")
    index = vectors.pack(annuli, ["pivot"], ANNULUS)
    pairs = vectors.meet(index, vectors.blocks(rows.where(queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, largest = shared.value
        best: dict[tuple, vectors.Best] = {}
        for batch in batches:
            by_block: dict[tuple, list] = {}
            for r in batch.to_pylist():
                by_block.setdefault((r["block"], r["size"], r["q_ids"], r["q_vectors"]), []).append(r)
            for (block, size, q_bytes, q_vectors), found in by_block.items():
                q_ids, q_vecs = np.frombuffer(q_bytes, np.int64), np.frombuffer(q_vectors).reshape(-1, size)
                held = best.setdefault((block, size, q_bytes), vectors.Best(q_ids, k))
                rings = []
                for r in found:
                    vecs, pivot = np.frombuffer(r["vectors"]).reshape(-1, size), r["pivot"]
                    if pivot < 0:
                        d, q_d = np.zeros(len(vecs)), np.full(len(q_vecs), 0.0)
                    else:
                        center = chosen[size][pivot : pivot + 1]
                        center_rest = rest_of(center, largest)
                        d = distances(vecs, rest_of(vecs, largest), center, center_rest)[:, 0]
                        q_d = distances(q_vecs, np.zeros(len(q_vecs)), center, center_rest)[:, 0]
                    rings.append((np.frombuffer(r["ids"], np.int64), vecs, d, q_d))
                q_squares = (q_vecs**2).sum(1)

                def bound(gap: np.ndarray, q: int) -> np.ndarray:
                    """The largest inner product at a distance of at least gap, with a margin for rounding."""
                    top = q_squares[q] + largest
                    return (top - np.maximum(gap, 0) ** 2) / 2 + 1e-6 * top + 1

                low, high = np.array([x[2].min() for x in rings]), np.array([x[2].max() for x in rings])
                to_query = np.stack([x[3] for x in rings], axis=1)
                for q, q_id in enumerate(q_ids.tolist()):
                    bounds = bound(np.maximum(to_query[q] - high, low - to_query[q]), q)
                    for ring in np.argsort(-bounds, kind="stable").tolist():
                        ids, vecs, d, _ = rings[ring]
                        need = held.worst(q)
                        if need is not None and bounds[ring] < need:
                            break
                        near = np.arange(len(ids)) if need is None else np.flatnonzero(bound(np.abs(to_query[q, ring] - d), q) >= need)
                        near = near[ids[near] != q_id]
                        scores = scores_of(vecs[near], q_vecs[q])
                        top = sorted(zip([-s for s in scores], ids[near].tolist()))[:k]
                        held.add(q, [-s for s, _ in top], [i for _, i in top])
        out = [x for b in best.values() for x in b.rows()]
        if any(not -(1 << 63) <= x[2] < 1 << 63 for x in out):
            raise ValueError("an inner product does not fit 64 bits")
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    return vectors.ranked(pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint"), k)
