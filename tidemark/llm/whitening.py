"""Whitening of integer vectors by a tiled covariance.

Vectors are centred by exact means and packed into row-blocks, each cut into column blocks of `TILE` dimensions. Column
blocks are shuffled by their row-block; a task multiplies each pair of a row-block's column blocks and adds the product
to the sum of its tile, whose key is the pair of column blocks. Each task gives its sums cell by cell, and Spark adds
the cells of all tasks. The covariance is assembled and decomposed on the driver: its size is the square of the
number of dimensions, at most `MOST_DIMENSIONS` of them, whatever the number of vectors. The same tiles give the
covariance of the whitened vectors, which says how far it is from the identity.

A row-block holds at most `ROWS` vectors of one task. What is broadcast are means and components. Sums
of long integers are exact at any size (decimals); a mean is held as quotient and remainder, so that differences stay small and exact.

Odd rows: vectors that are null, empty or hold null or non-finite entries take no part, nor do those of another length
than the most frequent one (the longer of two equally frequent). Entries beyond `LARGEST` in size are refused by
name, as no exact integer holds them. A deviation that no long holds is null. Repeated rows are vectors of their own; ids
may be null or of any type. Components without variance can't be whitened and give null there and no part in identity_error; with
no variance at all, explained is null too. Other columns are left out whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions of a column block; vectors of a row-block; dimensions at most.
TILE, ROWS, MOST_DIMENSIONS = 32, 2048, 4096
#: 64 times a component, with 1,000,000 added.
SCALE, SHIFT = 64, 1_000_000
#: Components beyond it have no exact integer.
LARGEST = float(2**46)
COMPONENTS = 32
#: A component counts as one without variance below this share of the largest.
LEAST_SHARE = 1e-12


@dataclass
class Model:
    """n vectors, exact sums by dimension, variances of the components (falling) and the components as columns."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    total: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, by exact differences from the quotient."""
        quotient, rest = zip(*(divmod(s, self.n) for s in self.sums))
        return (x - np.array(quotient, np.int64)).astype(np.float64) - np.array(rest, np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)**2, exact."""
        quotient, rest = zip(*(divmod(s, self.n) for s in self.sums))
        z = x - np.array(quotient, np.int64)
        if x.size and x.shape[1] * (self.n * (float(np.abs(z).max()) + 1)) ** 2 < 2.0**62:
            return ((self.n * z - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        found = [sum((self.n * a - r) ** 2 for a, r in zip(row, rest)) for row in z.tolist()]
        return [d if d < 2**63 else None for d in found]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The centred vectors on each component, over the root of its variance; only components that have variance."""
        k = int((self.variances > LEAST_SHARE * max(self.variances[:1], default=0.0)).sum()) if self.total > 0 else 0
        return self.centred(x) @ self.components[:, :k] / np.sqrt(self.variances[:k])


def integers(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, vec array<bigint>) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).alias("vec_id"), vec.alias("vec")).where(F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(odd, F.lit(True)))
    exact = F.transform("vec", lambda x: F.when(F.abs(x) <= LARGEST, F.floor(x * SCALE) + SHIFT).otherwise(F.raise_error(F.lit("a vector's component is too large for an exact integer")).cast("bigint")))
    sizes = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return rows.select("vec_id", exact.alias("vec"))
    if sizes["dims"] > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {sizes['dims']} dimensions, at most {MOST_DIMENSIONS} are taken")
    return rows.where(F.size("vec") == sizes["dims"]).select("vec_id", exact.alias("vec"))


def matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        n = 0
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):  # halves of the bits, so that no sum of a task leaves a long
                a, b = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
                low, high, n = (a, b, len(x)) if low is None else (low + a, high + b, n + len(x))
        if n:
            dims = np.arange(len(low), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(low), pa.array(high), pa.array(np.full(len(low), n))], ["dim", "low", "high", "n"])

    parts = vectors.select("vec").mapInArrow(run, "dim int, low bigint, high bigint, n bigint")
    whole = parts.groupBy("dim").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")), F.sum("n").alias("n")).orderBy("dim").collect()
    return (int(whole[0]["n"]) if whole else 0), [int(r["low"]) + (int(r["high"]) << 32) for r in whole]


def column_blocks(vectors: DataFrame, centre) -> DataFrame:
    """(row_block, column_block, size, cells): centre(vectors) packed by row-blocks and cut into column blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            x = matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                y = centre(x[at : at + ROWS])
                starts = range(0, y.shape[1], TILE)
                cells = [np.ascontiguousarray(y[:, c : c + TILE]).tobytes() for c in starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task + seen] * len(cells), pa.int64()), pa.array(range(len(cells)), pa.int32()), pa.array([len(y)] * len(cells), pa.int32()), pa.array(cells, pa.binary())],
                    ["row_block", "column_block", "size", "cells"],
                )
                seen += 1

    return vectors.select("vec").mapInArrow(run, "row_block bigint, column_block int, size int, cells binary")


def products(blocks: DataFrame) -> DataFrame:
    """(a, b, value): the sums over all rows of dimension a times dimension b, a <= b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        at, held = None, []
        for batch in batches:
            for row_block, column, size, cells in zip(*(batch.column(k) for k in range(4))):
                if row_block.as_py() != at:
                    at, held = row_block.as_py(), []
                right = np.frombuffer(cells.as_buffer(), np.float64).reshape(size.as_py(), -1).copy()
                held.append((column.as_py(), right))
                for left_column, left in held:
                    key = left_column, column.as_py()
                    product = left.T @ right
                    tiles[key] = tiles[key] + product if key in tiles else product
        for (i, j), tile in tiles.items():
            a, b = (g.ravel() for g in np.meshgrid(np.arange(tile.shape[0]) + i * TILE, np.arange(tile.shape[1]) + j * TILE, indexing="ij"))
            keep = a <= b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep].astype(np.int32)), pa.array(b[keep].astype(np.int32)), pa.array(tile.ravel()[keep])], ["a", "b", "value"])

    met = blocks.repartition("row_block").sortWithinPartitions("row_block", "column_block")
    return met.mapInArrow(run, "a int, b int, value double").groupBy("a", "b").agg(F.sum("value").alias("value"))


def covariance(vectors: DataFrame, centre, n: int, dims: int) -> np.ndarray:
    """The covariance of centre(vectors) with the divisor n."""
    found = products(column_blocks(vectors, centre)).toPandas()  # dims * (dims + 1) / 2 rows
    out = np.zeros((dims, dims))
    out[found["a"], found["b"]] = found["value"] / n
    out[found["b"], found["a"]] = found["value"] / n
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of integer vectors (vec_id, vec) of one length; None without vectors."""
    n, total = sums(vectors)
    if not n:
        return None
    model = Model(n, total, np.zeros(0), np.zeros((len(total), 0)), 0.0)
    spread = covariance(vectors, model.centred, n, len(total))
    values, axes = np.linalg.eigh(spread)
    model.variances, model.components = values[::-1][:components], axes[:, ::-1][:, :components]
    model.total = float(np.trace(spread))
    model.identity_error = whiteness(vectors, model)
    return model


def whiteness(vectors: DataFrame, model: Model) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    size = model.whitened(np.zeros((1, len(model.sums)), np.int64)).shape[1]
    if not size:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            if batch.num_rows:
                part = model.whitened(matrix(batch.column(0))).sum(axis=0)
                found = part if found is None else found + part
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(found)], ["dim", "value"])

    means = vectors.select("vec").mapInArrow(run, "dim int, value double").groupBy("dim").agg(F.sum("value").alias("value")).toPandas()
    mean = np.zeros(size)
    mean[means["dim"]] = means["value"] / model.n
    spread = covariance(vectors, lambda x: model.whitened(x) - mean, model.n, size)
    return float(np.abs(spread - np.eye(size)).max())


def apply(vectors: DataFrame, model: Model) -> DataFrame:
    """(vec_id, deviation, whitened array<double>): a null for each component without variance."""
    id_type = vectors.schema["vec_id"].dataType
    width, shared = len(model.variances), vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                found = model.whitened(x)
                cells = pa.array(np.hstack([found, np.zeros((len(x), width - found.shape[1]))]).ravel(), mask=np.tile(np.arange(width) >= found.shape[1], len(x)))
                whole = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * width + 1, width, dtype=np.int32)), cells)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.deviations(x), pa.int64()), whole], ["vec_id", "deviation", "whitened"])

    return vectors.select("vec_id", "vec").mapInArrow(run, f"vec_id {id_type.simpleString()}, deviation bigint, whitened array<double>")


def by_component(vectors: DataFrame, model: Model | None) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    shares = (model.variances / model.total).tolist() if model.total > 0 else [None] * len(model.variances)
    explained = F.array(*(F.lit(x).cast("double") for x in shares))
    rows = apply(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
