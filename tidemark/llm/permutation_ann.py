"""Approximate nearest neighbours by cosine through a permutation index.

Pivots are a bounded sample of the vectors, chosen by a hash of the id. Every vector is represented
by its nearest pivots in order. A segment of the index posts its vectors under these pivots with
their places (a pivot inverted file). A query reads the lists of its own nearest pivots, which gives
every vector of the segment its Spearman footrule distance to the query's order; the share of the
segment with the least distance is ranked anew by the exact cosine, in double precision.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do vectors whose
number of components differs from the query's. Rows that repeat an id count as one candidate each;
equal scores go to the smaller id. Fewer candidates than k give fewer rows; no query, no rows. Other columns are
left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import vectors

#: Pivots, at most; places kept of each order; the share of a segment that is ranked anew, and at least how many.
PIVOTS = 256
PLACES = 48
SHARE = 0.25
LEAST = 64


def choose_pivots(rows: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """The unit vectors of the rows with the smallest hashes of their id; of the most common size."""
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()  # bounded
    sizes = [len(r["vec"]) for r in found]
    if not sizes:
        return np.zeros((0, 1))
    size = max(set(sizes), key=sizes.count)
    return unit(np.array([r["vec"] for r in found if len(r["vec"]) == size]))


def unit(vecs: np.ndarray) -> np.ndarray:
    """Scaled to length 1, without overflow."""
    top = np.abs(vecs).max(axis=1, keepdims=True)
    vecs = vecs / np.where(top > 0, top, 1)
    return vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)


def halved(vecs: np.ndarray) -> np.ndarray:
    """Each vector halved or doubled until its largest component is below 1 but not below 1/2: no rounding, no overflow."""
    return np.ascontiguousarray(np.ldexp(vecs, -np.frexp(np.abs(vecs).max(axis=1))[1][:, None]))


def orders(vecs: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    return np.argsort(-(unit(vecs) @ pivots.T), axis=1, kind="stable")[:, :places].astype(np.int16)


class Segment:
    """The inverted file of one segment: under each pivot the vectors that have it in their order, and where."""

    def __init__(self, order: np.ndarray, n_pivots: int):
        self.rows, self.places = order.shape
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.row = (by_pivot // self.places).astype(np.int32)
        self.place = (by_pivot % self.places).astype(np.int32)
        self.starts = np.searchsorted(flat[by_pivot], np.arange(n_pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Each vector's footrule distance to a query's order; a pivot that is missing counts as past the end.

        All vectors start with no pivot in common; each posting read makes up for one.
        """
        rows, gains = [], []
        for place, pivot in enumerate(order.tolist()):
            a, b = self.starts[pivot], self.starts[pivot + 1]
            rows.append(self.row[a:b])
            other = self.place[a:b]
            gains.append(np.abs(other - place) - (self.places - place) - (self.places - other))
        start = self.places * (self.places + 1)
        return start + np.bincount(np.concatenate(rows), np.concatenate(gains), self.rows)


def search(
    df: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    n_pivots: int = PIVOTS,
    places: int = PLACES,
    share: float = SHARE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` (over vec_id) marks, its k nearest found among all other rows."""
    rows = vectors.plain(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    pivots = choose_pivots(rows, n_pivots)
    places = min(places, len(pivots))
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def order_bytes(vecs: np.ndarray) -> list[bytes]:
        pivots = shared.value
        return [orders(vecs, pivots, places).tobytes() if vecs.shape[1] == pivots.shape[1] else b""]

    index = vectors.pack(rows, [], vectors.SEGMENT, order_bytes, ", x0 binary").withColumnRenamed("x0", "orders")
    pairs = vectors.meet(index, vectors.blocks(rows.where(queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, best = shared.value, {}
        for batch in batches:
            for r in batch.to_pylist():
                size = r["size"]
                ids, vecs = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, size)
                q_ids, q_vecs = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vectors"]).reshape(-1, size)
                held = best.setdefault((r["block"], size, r["q_ids"]), vectors.Best(q_ids, k))
                scaled = halved(vecs)
                norms = np.sqrt((scaled * scaled).sum(axis=1))
                most = max(LEAST, k + 1, int(np.ceil(share * len(ids))))
                segment = Segment(np.frombuffer(r["orders"], np.int16).reshape(-1, places), len(pivots)) if r["orders"] and len(ids) > most else None
                q_orders = orders(q_vecs, pivots, places) if segment else None
                by_id = np.argsort(ids, kind="stable")
                for q, q_id in enumerate(q_ids.tolist()):
                    near = np.arange(len(ids))
                    if segment:
                        distance = segment.footrule(q_orders[q])[by_id]
                        near = by_id[np.argsort(distance, kind="stable")[:most]]
                    near = near[ids[near] != q_id]
                    own = halved(q_vecs[q : q + 1])
                    length = np.sqrt((own * own).sum(axis=1))
                    scores = scaled[near] @ own[0] / (norms[near] * length)
                    if len(near) > k:  # what may be among the k best, with a margin for rounding
                        near = near[scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-9]
                    # Row sums of products round alike wherever a row stands, so that equal vectors tie.
                    scores = (scaled[near] * own).sum(axis=1) / (norms[near] * length)
                    first = np.lexsort((ids[near], -scores))[:k]
                    held.add(q, scores[first].tolist(), ids[near][first].tolist())
        out = [x for b in best.values() for x in b.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return vectors.ranked(pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double"), k)
