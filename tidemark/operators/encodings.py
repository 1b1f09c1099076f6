"""Composed phase encodings: bags, ordered bigrams, titles and sequences, and the laws that they keep.

A token is a vector of unit phasors. A bag is the normalised weighted sum of its tokens. A pair in order is the first token bound to
the second one shifted by a place, so that the other order gives another vector. A title is its bag of trigrams plus, with
equal weight, the normalised sum of its word pairs. A sequence turns each token by its position before the sum, so that
moving a sequence is turning its encoding. Vectors are columns re and im; encoding runs in Arrow batches, a token's phasors once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.vectors import KEPT, phases

SIZE, BASE = 256, 10_000.0


class Phasors:
    """Unit phasors of tokens, kept for the tokens that come again."""

    def __init__(self, size: int) -> None:
        self.size, self.kept = size, {}

    def __getitem__(self, token: str) -> np.ndarray:
        if token not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[token] = np.exp(1j * phases(token, self.size))
        return self.kept[token]

    def sum(self, weighted: Sequence[tuple[str, float]]) -> np.ndarray:
        out = np.zeros(self.size, complex)
        for token, weight in weighted:
            out += weight * self[token]
        return out


def normalised(v: np.ndarray) -> np.ndarray:
    """Vectors along the last axis, scaled to length 1; zeros stay."""
    length = np.linalg.norm(v, axis=-1, keepdims=True)
    return v / np.where(length > 0, length, 1)


def ordered_pair(table: Phasors, first: str, second: str) -> np.ndarray:
    return table[first] * np.roll(table[second], 1)


def turned(v: np.ndarray, by: float) -> np.ndarray:
    """A vector turned `by` steps: place j by BASE^(-j / size)."""
    size = v.shape[-1]
    return v * np.exp(1j * by * BASE ** (-np.arange(size) / size))


def bag(table: Phasors, weighted: Sequence[tuple[str, float]]) -> np.ndarray:
    return normalised(table.sum(weighted))


def title(table: Phasors, grams: Sequence[str], words: Sequence[str]) -> np.ndarray:
    pairs = np.zeros(table.size, complex)
    for a, b in zip(words, words[1:]):
        pairs += ordered_pair(table, a, b)
    return normalised(bag(table, [(g, 1.0) for g in grams]) + normalised(pairs))


def sequence(table: Phasors, words: Sequence[str], offset: int = 0) -> np.ndarray:
    out = np.zeros(table.size, complex)
    for k, w in enumerate(words):
        out += turned(table[w], k + offset)
    return normalised(out)


def encoded(df: DataFrame, columns: Sequence[str], encode: Callable[..., np.ndarray], size: int = SIZE) -> DataFrame:
    """df with re and im of encode(phasors, *values of the columns); rows with a null value get zeros."""
    at = [df.columns.index(c) for c in columns]
    empty = F.array().cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Phasors(size)
        for batch in batches:
            out = np.zeros((batch.num_rows, size), complex)
            for k, values in enumerate(zip(*(batch.column(c).to_pylist() for c in at))):
                if all(v is not None for v in values):
                    out[k] = encode(table, *values)
            offsets = pa.array(np.arange(batch.num_rows + 1) * size, pa.int32())
            parts = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel())) for x in (out.real, out.imag)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *parts], [*batch.schema.names, "re", "im"])

    return df.mapInArrow(run, df.select("*", empty.alias("re"), empty.alias("im")).schema)


def encode_bags(df: DataFrame, tokens: str, size: int = SIZE) -> DataFrame:
    """Bags of an array of structs (token, weight)."""
    return encoded(df, [tokens], lambda table, x: bag(table, [(t["token"], t["weight"]) for t in x]), size)


def encode_titles(df: DataFrame, grams: str, words: str, size: int = SIZE) -> DataFrame:
    return encoded(df, [grams, words], title, size)


def encode_sequences(df: DataFrame, words: str, size: int = SIZE, offset: int = 0) -> DataFrame:
    return encoded(df, [words], lambda table, x: sequence(table, x, offset), size)


#: Laws of composition over a row's words; each tells how far it is off. The last is none: order does matter.
LAWS: dict[str, Callable[[Phasors, list[str], list[str]], float]] = {
    "bags have length 1": lambda t, g, w: abs(np.linalg.norm(bag(t, [(x, 1.0) for x in g])) - 1),
    "bags are order free": lambda t, g, w: float(np.abs(bag(t, [(x, 1.0) for x in g]) - bag(t, [(x, 1.0) for x in reversed(g)])).max()),
    "binding commutes": lambda t, g, w: float(np.abs(t[w[0]] * t[w[-1]] - t[w[-1]] * t[w[0]]).max()),
    "unbinding gives back": lambda t, g, w: float(np.abs(bag(t, [(x, 1.0) for x in g]) * t[w[0]] * np.conj(t[w[0]]) - bag(t, [(x, 1.0) for x in g])).max()),
    "moving a sequence turns it": lambda t, g, w: float(np.abs(sequence(t, w, 3) - turned(sequence(t, w), 3)).max()),
    "pairs are order free": lambda t, g, w: float(np.abs(ordered_pair(t, w[0], w[-1]) - ordered_pair(t, w[-1], w[0])).max()),
}


def law_breaches(df: DataFrame, grams: str, words: str, tolerance: float = 1e-9, size: int = SIZE) -> DataFrame:
    """(law, tried, broken) over rows with words, of which each law is tried on each."""
    rows = df.select(grams, words).where(F.size(words) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tried, broken = Phasors(size), 0, dict.fromkeys(LAWS, 0)
        for batch in batches:
            for g, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tried += 1
                for law, off in LAWS.items():
                    broken[law] += off(table, g, w) > tolerance
        yield pa.RecordBatch.from_arrays([pa.array(list(broken)), pa.array([tried] * len(broken)), pa.array(list(broken.values()), pa.int64())], ["law", "tried", "broken"])

    parts = rows.mapInArrow(run, "law string, tried bigint, broken bigint")
    return parts.groupBy("law").agg(F.sum("tried").alias("tried"), F.sum("broken").alias("broken"))
