"""Language identification by known words first, then by shorter and shorter character n-grams.

A word of the training texts counts by the logarithm of its frequency in each language. A word that
is not known counts by the mean of its longest known n-grams: those of four characters, if any is
known, else of three, of two, of one. A text's language is the one with the largest sum.

The model is fitted on labelled rows drawn by a hash of their id, about `SAMPLE` of them at any
size of the input, and of a drawn text at most `PASSAGE` characters in a row, from a place that the hash chooses. That bounds what
is counted, collected and sent to tasks; no word or n-gram seen `LEAST_COUNT` times in it is left out, and predictions read whole texts.

Texts: null texts and texts without a letter get `und` and the score 0. Where languages tie, the first by name
wins. Repeated rows each give a row; existing columns lang_pred and score are replaced, others stay whatever
their names; an empty table gives an empty one; without labelled rows every text is `und`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Labelled documents drawn for the fit, about; words seen fewer times than LEAST_COUNT are left to their n-grams.
SAMPLE = 6000
PASSAGE = 10_000
LEAST_COUNT = 3
LONGEST = 4
UNKNOWN = "und"
#: Unseen words whose scores each worker keeps.
KEPT = 80_000


@dataclass
class Model:
    """Log frequencies by language of words and, by their length, of n-grams."""

    langs: list[str]
    words: dict[str, tuple[float, ...]]
    grams: dict[int, dict[str, tuple[float, ...]]]
    kept: dict[str, np.ndarray] = field(default_factory=dict)

    def word(self, word: str) -> Sequence[float]:
        """The log frequency of a word in each language, by backing off where it is not known."""
        if (known := self.words.get(word)) is not None:
            return known
        if (known := self.kept.get(word)) is not None:
            return known
        marked, out = f"<{word}>", None
        for n in range(LONGEST, 0, -1):
            table = self.grams.get(n, {})
            found = [g for i in range(len(marked) - n + 1) if (g := table.get(marked[i : i + n])) is not None]
            if found:
                out = tuple(sum(x) / len(found) for x in zip(*found))
                break
        if out is None:
            out = (0.0,) * len(self.langs)
        if len(self.kept) > KEPT:
            self.kept.clear()
        self.kept[word] = out
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """The language and the score (softmax of the sums) of each text."""
        size = len(self.langs)
        if not size:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        words = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"\P{L}+")
        flat = words.flatten()
        coded = flat.dictionary_encode()
        names = coded.dictionary.to_pylist()
        table = np.array([self.word(w) if w else (0.0,) * size for w in names] or [(0.0,) * size], np.float64).reshape(-1, size)
        place = coded.indices.to_numpy(zero_copy_only=False)
        full = np.array([bool(w) for w in names] or [False])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]).astype(np.int64)
        sums = np.zeros((len(texts), size))
        for k in range(size):
            run = np.concatenate([[0.0], np.cumsum(table[place, k])])
            sums[:, k] = run[ends[1:]] - run[ends[:-1]]
        run = np.concatenate([[0], np.cumsum(full[place])])
        letters = run[ends[1:]] - run[ends[:-1]]
        best = sums.argmax(axis=1)
        score = 1 / np.exp(np.maximum(sums - sums.max(axis=1, keepdims=True), -700)).sum(axis=1)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, letters)], np.where(letters > 0, score, 0.0).tolist()


def drawn(labelled: DataFrame, id_col: str, sample: int) -> DataFrame:
    """About `sample` rows, chosen by a hash of the id."""
    n = labelled.count()
    if n <= sample:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000)) < int(1_000_000 * sample / n))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Counts words and n-grams of the drawn rows by language."""
    rows = drawn(labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), id_col, sample)
    place = 1 + F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.greatest(F.length(text_col) - PASSAGE + 1, F.lit(1)))
    passage = F.substring(F.col(text_col), place.cast("int"), F.lit(PASSAGE))
    words = rows.select(F.col(lang_col).cast("string").alias("lang"), F.explode(F.regexp_extract_all(F.lower(passage), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    counts = words.groupBy("lang", "word").count().cache()
    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length(marked))), lambda n: F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, n))))
    grams = counts.select("lang", "count", F.explode(spans).alias("gram")).groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    word_rows = counts.where(F.col("count") >= LEAST_COUNT).collect()  # names of SAMPLE passages
    gram_rows = grams.where(F.col("count") >= LEAST_COUNT).collect()
    counts.unpersist()
    langs = sorted({r["lang"] for r in word_rows} | {r["lang"] for r in gram_rows})
    by_size: dict[int, list] = {n: [] for n in range(1, LONGEST + 1)}
    for r in gram_rows:
        by_size[len(r["gram"])].append((r["lang"], r["gram"], r["count"]))
    return Model(langs, _logs([(r["lang"], r["word"], r["count"]) for r in word_rows], langs), {n: _logs(x, langs) for n, x in by_size.items()})


def _logs(rows: list[tuple[str, str, int]], langs: list[str]) -> dict[str, tuple[float, ...]]:
    """Logarithms of frequencies; half a count is added to each."""
    at, counts, totals = {lang: k for k, lang in enumerate(langs)}, {}, [0.0] * len(langs)
    for lang, name, n in rows:
        counts.setdefault(name, [0.0] * len(langs))[at[lang]] += n
        totals[at[lang]] += n
    return {name: tuple(math.log((n + 0.5) / (t + 0.5 * len(counts))) for n, t in zip(each, totals)) for name, each in counts.items()}


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score (0..1), from the text alone."""
    others = [c for c in df.columns if c not in ("lang_pred", "score")]
    rows = common.small_batches(df).select(*others)
    at_text, shared = others.index(text_col), df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in common.freeing(batches):
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                langs, scores = model.predict(batch.column(at_text))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(run, rows.select(*others, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
