"""What the two vector searches share: plain vectors, packed segments and query blocks.

Vectors are packed, a few thousand to a row, into segments; queries into blocks. Every block meets
every segment by an equi-join on the block's number, a stated query set against all rows in blocks.
Both sides' rows have a bounded size, and no row is made for a pair of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a segment, queries in a block.
SEGMENT = 4096
BLOCK = 2048
PACKED = "ids binary, vectors binary, size int"


def plain(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>) without vectors that are null, empty or hold null or non-finite components."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(odd, F.lit(True)))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def pack(rows: DataFrame, keys: list[str], most: int, added: Callable[[np.ndarray], list[bytes]] | None = None, extra: str = "") -> DataFrame:
    """Rows (keys, vec_id, vec), as they are ordered, packed by equal keys and vector size, at most `most` to a row."""
    fields = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(len(keys) + 1).offsets))
            marks = [sizes, *(c.to_numpy(zero_copy_only=False) for c in batch.columns[: len(keys)])]
            new = np.zeros(batch.num_rows, bool)
            new[:1] = True
            for m in marks:
                new[1:] |= m[1:] != m[:-1]
            starts = np.flatnonzero(new).tolist() + [batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                for at in range(a, b, most):
                    part = batch.slice(at, min(most, b - at))
                    vecs = matrix(part.column(len(keys) + 1), int(sizes[a]))
                    ids = part.column(len(keys)).to_numpy(zero_copy_only=False).astype(np.int64)
                    values = [[k] for k in (c[0].as_py() for c in part.columns[: len(keys)])]
                    more = [[x] for x in added(vecs)] if added else []
                    arrays = [pa.array(v, batch.schema.field(i).type) for i, v in enumerate(values)]
                    arrays += [pa.array([ids.tobytes()], pa.binary()), pa.array([vecs.tobytes()], pa.binary()), pa.array([int(sizes[a])], pa.int32())]
                    arrays += [pa.array(x, pa.binary()) for x in more]
                    names = [*keys, "ids", "vectors", "size", *(f"x{i}" for i in range(len(more)))]
                    yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.select(*keys, "vec_id", "vec").mapInArrow(run, f"{fields}{PACKED}{extra}")


def blocks(queries: DataFrame) -> DataFrame:
    """(block, ids, vectors, size): the queries in blocks of about BLOCK, by a hash of their id."""
    n = max(1, -(-queries.count() // BLOCK))
    rows = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn("dims", F.size("vec"))
    return pack(rows.repartition("block", "dims").sortWithinPartitions("block", "dims", "vec_id"), ["block"], BLOCK).withColumnRenamed("ids", "q_ids").withColumnRenamed("vectors", "q_vectors")


def meet(segments: DataFrame, query_blocks: DataFrame) -> DataFrame:
    """Every segment with every query block of its vector size.

    With few blocks, segments are dealt out over as many salts as keep the cluster busy, and each
    block goes to every salt.
    """
    query_blocks = query_blocks.withColumnRenamed("size", "q_size")
    n = query_blocks.agg(F.coalesce(F.max("block"), F.lit(-1))).first()[0] + 1
    if n == 0:
        return segments.join(query_blocks, F.lit(False)).drop("q_size")
    salts = -(-4 * segments.sparkSession.sparkContext.defaultParallelism // n)
    spread = segments.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    salted = query_blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(salted, ["block", "salt"]).where("size = q_size").drop("q_size", "salt")


class Best:
    """The k best candidates of each query so far: larger scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.found: list[list[tuple]] = [[] for _ in ids]

    def worst(self, q: int) -> float | None:
        """The score that a candidate must reach; None while any is welcome."""
        return -self.found[q][-1][0] if len(self.found[q]) == self.k else None

    def add(self, q: int, scores, ids) -> None:
        self.found[q] = sorted({*self.found[q], *((-s, i) for s, i in zip(scores, ids))})[: self.k]

    def rows(self) -> Iterator[tuple[int, int, object]]:
        for q, found in zip(self.ids.tolist(), self.found):
            for s, i in found:
                yield q, i, -s


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, from each task's own k best."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
