"""Text quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are counts and shares of its own bytes and words and those of the lines before
and after it; the field adds weights for each pair of labels that follow each other. Forward and backward messages are
kept as logarithms of the odds of good, one number a line, and move through all texts of a batch at once. A text's quality is the
mean of its lines' marginals, weighted by length (one more than the line's characters); its score is the probability
of label 1 that a logistic curve, fitted on the same texts, gives to that quality.

Labels are given for whole texts. A first fit without pairs takes a text's label for each of its lines; lines of bad
texts that it finds good are then taken as good (each bad text keeps its worst line as a bad one), and the field is
fitted on these labels.

The fit draws about `SAMPLE` labelled texts by a hash of their id and at most `CHAIN` lines in a row of each, from a place that the
hash chooses; features of these are collected, at most SAMPLE * CHAIN * 16 small numbers at any size of the input, and the ids that
are broadcast are the drawn ones. Scores read every line of every text.

Odd rows: a null text counts as empty, and an empty text is one blank line and gets that line's score. Texts of one line have
no pairs. Repeated rows each give a row; of several labels of an id the largest counts. Existing columns score, quality and
predicted are replaced, others stay whatever their names; an empty table gives an empty one. Where labels
of one kind are missing, every text gets the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Labelled texts drawn for the fit, about, and lines taken of each, at most.
SAMPLE, CHAIN = 4000, 200
#: Texts that score at least this are predicted good.
GOOD = 0.3
#: Steps of the fit and the weight of its penalty on squares.
STEPS, PENALTY = 300, 1e-5
#: Texts whose lines are in memory together.
TEXTS = 256

#: Kinds of bytes; letters beyond ASCII count as small letters.
SMALL, CAPITAL, DIGIT, SPACE, STOP, LOUD, SYMBOL = range(7)
KINDS = np.full(256, SYMBOL, np.uint8)
KINDS[128:] = SMALL
for _kind, _bytes in ((SMALL, range(97, 123)), (CAPITAL, range(65, 91)), (DIGIT, range(48, 58)), (SPACE, common.WHITE), (STOP, b".,;:?'\"()-"), (LOUD, b"!")):
    KINDS[list(_bytes)] = _kind
FEATURES = 16


def features(lines: pa.Array) -> np.ndarray:
    """(lines, FEATURES): each line's own features, about 0 to 1."""
    lines = lines.cast(pa.large_string())
    n = len(lines)
    at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
    whole = lines.buffers()[2]
    kinds = KINDS[np.frombuffer(whole, np.uint8)[at[0] : at[-1]]] if whole is not None and n else np.zeros(0, np.uint8)
    at = at - at[0]

    def count(marks: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(marks, dtype=np.int32)])
        return (run[at[1:]] - run[at[:-1]]).astype(np.float64)

    filled = kinds != SPACE
    edge = np.zeros(len(kinds) + 1, bool)
    edge[at] = True
    begins, ends = filled.copy(), filled.copy()
    begins[1:] &= ~filled[:-1] | edge[1:-1]
    ends[:-1] &= ~filled[1:] | edge[1:-1]
    size, words = count(filled), count(begins)
    by_kind = {k: count(kinds == k) for k in (SMALL, CAPITAL, DIGIT, STOP, LOUD, SYMBOL)}
    letters = by_kind[SMALL] + by_kind[CAPITAL]
    distinct, runs = np.zeros(n), np.zeros(n)
    for k, line in enumerate(lines.cast(pa.large_binary())):
        split = line.as_py().split()
        distinct[k], runs[k] = len(set(split)), sum(map(eq, split, split[1:]))
    share = lambda part, of: part / np.maximum(of, 1)
    last = np.full(n, SPACE)
    full = np.flatnonzero(ends)
    if len(full):
        place = np.searchsorted(full, at[1:]) - 1
        has = (words > 0) & (place >= 0)
        last[has] = kinds[full[place[has]]]
    return np.column_stack(
        [
            np.log1p(size) / 7,
            np.log1p(words) / 5,
            np.minimum(share(size, words) / 12, 2),
            share(by_kind[CAPITAL], letters),
            share(letters, size),
            share(by_kind[DIGIT], size),
            share(by_kind[STOP], size),
            share(by_kind[SYMBOL], size),
            share(count(ends & (kinds == SYMBOL)), words),
            share(count(ends & begins & (kinds == SYMBOL)), words),
            share(count(ends & (kinds == LOUD)), words),
            share(count(begins & (kinds == CAPITAL)), words),
            share(words - distinct, words),
            share(runs, words - 1),
            ((last == STOP) | (last == LOUD)) * 1.0,
            (words == 0) * 1.0,
        ]
    )


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each line's own features, those of the lines before and after it in its text (zeros at the ends), and a one."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first = starts[:-1][starts[:-1] < starts[1:]]
    before[first], after[starts[1:][starts[:-1] < starts[1:]] - 1] = 0, 0
    return np.hstack([own, before, after, np.ones((len(own), 1))])


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lines of texts, where each text's lines start (one more at the end), and the lines' weights."""
    found = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))]).astype(np.int64)
    lines = found.flatten()
    return lines, starts, pc.utf8_length(lines).to_numpy(zero_copy_only=False) + 1.0


def messages(odds: np.ndarray, pairs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log odds of good (with the line's own) and backward ones (without). pairs[y, z]: z follows y; 0 is bad."""
    order = np.argsort(-(starts[1:] - starts[:-1]), kind="stable")
    first, sizes = starts[:-1][order], (starts[1:] - starts[:-1])[order]
    forward, backward = odds.astype(np.float64).copy(), np.zeros(len(odds))
    for k in range(1, int(sizes[0]) if len(sizes) else 0):
        live = first[: np.searchsorted(-sizes, -k)]  # texts with more than k lines
        f = forward[live + k - 1]
        forward[live + k] += np.logaddexp(pairs[0, 1], f + pairs[1, 1]) - np.logaddexp(pairs[0, 0], f + pairs[1, 0])
        last = live + sizes[: len(live)] - 1
        b = backward[last - k + 1] + odds[last - k + 1]
        backward[last - k] = np.logaddexp(pairs[1, 0], b + pairs[1, 1]) - np.logaddexp(pairs[0, 0], b + pairs[0, 1])
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Weights of the features, of pairs of labels, and the curve from quality to score. No weights: score `share`."""

    weights: np.ndarray | None
    pairs: np.ndarray
    curve: tuple[float, float]
    share: float

    def marginals(self, own: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The probability of each line to be good."""
        odds = with_neighbours(own, starts) @ self.weights
        return sigmoid(sum(messages(odds, self.pairs, starts)))

    def quality(self, own: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The mean marginal of each text's lines by weight."""
        if len(starts) < 2:
            return np.zeros(0)
        marginals = self.marginals(own, starts)
        return np.add.reduceat(marginals * weight, starts[:-1]) / np.add.reduceat(weight, starts[:-1])

    def score(self, quality: np.ndarray) -> np.ndarray:
        return sigmoid(self.curve[0] + self.curve[1] * quality)

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Quality and score of each text."""
        if self.weights is None:
            return np.full(len(texts), self.share), np.full(len(texts), self.share)
        lines, starts, weight = split(texts)
        quality = self.quality(features(lines), starts, weight)
        return quality, self.score(quality)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method for a penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + PENALTY * len(x) * np.eye(len(w)), x.T @ (weight * (y - p)) - PENALTY * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(own: np.ndarray, starts: np.ndarray, weight: np.ndarray, good: np.ndarray) -> Model:
    """The field from lines' features and texts' labels."""
    sizes = starts[1:] - starts[:-1]
    text = np.repeat(np.arange(len(sizes)), sizes)
    x = with_neighbours(own, starts)
    each = 1.0 / np.maximum(sizes, 1)[text]  # texts count alike, however long
    w = logistic(x, good[text].astype(float), each * len(x) / len(sizes))
    label = good[text].copy()
    odds = x @ w
    label[(odds > 0) & ~label] = True
    worst = np.lexsort((odds, text))[starts[:-1][sizes > 0]]
    label[worst[~good[text[worst]]]] = False
    pairs, moment, square = np.zeros((2, 2)), np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    inner = np.ones(len(x), bool)
    inner[starts[:-1][sizes > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[at - 1].astype(int), label[at].astype(int)), 1.0)
    y, scale = label.astype(float), 1.0 / len(x)
    for step in range(1, STEPS + 1):
        odds = x @ w
        forward, backward = messages(odds, pairs, starts)
        cells = np.stack([pairs[a, b] + a * forward[at - 1] + b * (odds[at] + backward[at]) for a in (0, 1) for b in (0, 1)])
        cells = np.exp(cells - cells.max(axis=0))
        expected = (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)
        slope = np.concatenate([x.T @ (y - sigmoid(forward + backward)), (seen - expected).ravel()]) * scale - PENALTY * np.concatenate([w, pairs.ravel()])
        moment, square = 0.9 * moment + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, pairs = w + move[:-4], pairs + move[-4:].reshape(2, 2)
    model = Model(w, pairs, (0.0, 1.0), float(good.mean()))
    quality = model.quality(own, starts, weight)
    curve = logistic(np.column_stack([np.ones(len(quality)), quality]), good.astype(float), np.ones(len(quality)))
    model.curve = (float(curve[0]), float(curve[1]))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of labelled texts: labels has an id and a label, 1 for good."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) == 1).alias("_good"))
    n = known.count()
    drawn = known if n <= sample else known.where(F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    texts = common.small_batches(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(drawn), "_id").select("_text", "_good", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)).alias("_place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.freeing(batches):
            if not batch.num_rows:
                continue
            lines, starts, weight = split(batch.column(0))
            own = features(lines).astype(np.float32)
            out: list[tuple] = []
            for k, place in enumerate(batch.column(2).to_pylist()):
                a, b = int(starts[k]), int(starts[k + 1])
                a += place % max(1, b - a - CHAIN + 1)
                b = min(b, a + CHAIN)
                out.append((own[a:b].tobytes(), weight[a:b].astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), batch.column(1)], ["own", "weight", "good"])

    found = sorted(rows.mapInArrow(run, "own binary, weight binary, good boolean").collect(), key=lambda r: (bytes(r["own"]), r["good"]))  # the drawn texts
    good = np.array([r["good"] for r in found], bool)
    if not len(good) or good.all() or not good.any():
        return Model(None, np.zeros((2, 2)), (0.0, 1.0), float(good.mean()) if len(good) else 0.5)
    own = np.concatenate([np.frombuffer(r["own"], np.float32).reshape(-1, FEATURES) for r in found]).astype(np.float64)
    weight = np.concatenate([np.frombuffer(r["weight"], np.float32) for r in found]).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum([len(r["weight"]) // 4 for r in found])]).astype(np.int64)
    return train(own, starts, weight, good)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with quality, score and predicted, from the text alone."""
    others = [c for c in df.columns if c not in ("quality", "score", "predicted")]
    rows = common.small_batches(df).select(*others)
    at_text, shared = others.index(text_col), df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in common.freeing(batches):
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                quality, found = model.of_texts(batch.column(at_text))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quality), pa.array(found), pa.array((found >= GOOD).astype(np.int32))], [*batch.schema.names, "quality", "score", "predicted"])

    return rows.mapInArrow(run, rows.select(*others, F.lit(0.0).alias("quality"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)
