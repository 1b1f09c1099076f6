"""Similarities of dense, sparse and hashed phase vectors, and retrieval metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * by)


def close(a: Column, b: Column, tolerance: float) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)


def shift(a: Column, by: int) -> Column:
    """Rotate the places of an array."""
    n = F.size(a)
    at = F.pmod(F.lit(-by), n)
    return F.concat(F.slice(a, at + 1, n - at), F.slice(a, F.lit(1), at))


def mean_vector(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, mean): the mean of each group's vectors, place by place; no group is gathered in a task."""
    rows = df.select(*keys, F.posexplode(vec).alias("place", "x")).groupBy(*keys, "place").agg(F.avg("x").alias("x"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda r: r["x"]).alias("mean"))


def hashed_bag(tokens: DataFrame, key: str, token: str, size: int) -> DataFrame:
    """(key, place, value): signed counts of tokens (key, token) hashed to `size` places, those that are not 0; no vocabulary is kept.

    The place is the first four hexadecimal digits of a token's md5, the sign the parity of the fifth. Tokens are counted by key before
    they are hashed, so that a frequent token is hashed once for a key.
    """
    counts = tokens.groupBy(key, token).agg(F.count(F.lit(1)).alias("n"))
    digest = F.md5(F.col(token).cast("binary"))
    place = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % size
    sign = F.when(F.conv(F.substring(digest, 5, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = counts.select(key, place.alias("place"), (sign * F.col("n")).alias("x")).groupBy(key, "place").agg(F.sum("x").alias("value"))
    return sums.where("value <> 0")


def planes(bits: int, size: int) -> list[list[int]]:
    """The sides (+1 or -1) of `bits` planes: by the first hexadecimal digit of md5(plane:place), computed once for a plan."""
    return [[1 if int(hashlib.md5(f"{plane}:{place}".encode()).hexdigest()[0], 16) % 2 == 0 else -1 for place in range(size)] for plane in range(bits)]


def simhash(vec: Column, bits: int, size: int) -> Column:
    """One bit for each of `bits` (up to 63) planes: whether the vector of `size` components is on its side."""
    out = F.lit(0).cast("long")
    for plane, sides in enumerate(planes(bits, size)):
        side = F.aggregate(F.zip_with(vec, F.lit(sides), lambda x, s: x * s), F.lit(0.0), lambda t, x: t + x)
        out = out + F.when(side >= 0, F.lit(1 << plane).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_pairs(df: DataFrame, key: str, code: str, bands: int, width: int, most: int) -> DataFrame:
    """(a, b, apart): pairs (a < b) whose codes agree in a band of `width` bits and differ in at most `most` bits.

    A pair is made once, in the first band that it shares, and is dropped there if its codes differ more.
    """
    mask = (1 << width) - 1

    def cut(c: Column) -> Column:
        return F.array(*[F.shiftright(c, k * width).bitwiseAND(F.lit(mask)) for k in range(bands)])

    rows = df.select(F.col(key).alias("id"), F.col(code).alias("code"), F.posexplode(cut(F.col(code))).alias("band", "value"))
    a = rows.select("band", "value", F.col("id").alias("a"), F.col("code").alias("x"))
    b = rows.select("band", "value", F.col("id").alias("b"), F.col("code").alias("y"))
    same = F.transform(F.zip_with(cut(F.col("x")), cut(F.col("y")), lambda p, q: p == q), lambda e: e)
    met = a.join(b, ["band", "value"]).where((F.col("a") < F.col("b")) & (hamming(F.col("x"), F.col("y")) <= most))
    return met.where(F.array_position(same, True) - 1 == F.col("band")).select("a", "b", hamming(F.col("x"), F.col("y")).alias("apart"))


def set_cosine(left: DataFrame, right: DataFrame, least: float = 0.0) -> DataFrame:
    """(l_id, r_id, cosine) of weighted token sets (id, token, weight) whose cosine is at least `least`.

    Tokens of each set are ordered by how rare they are in the right table. Only a set's rarest tokens, those without
    which the rest cannot reach `least`, bring sets together (a prefix filter), so that frequent tokens make no pairs;
    the cosine is then counted on whole sets.
    """
    rare = right.groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def sets(df: DataFrame, key: str) -> DataFrame:
        rows = df.join(rare, "token", "left").select(F.col("id").alias(key), F.coalesce("df", F.lit(0)).alias("df"), "token", "weight")
        groups = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "token", "weight"))).alias("set"), F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
        # A prefix may end where the squares of what follows sum to less than least^2 of all.
        tail = F.transform("set", lambda _, i: F.aggregate(F.slice("set", i + 1, F.size("set")), F.lit(0.0), lambda t, x: t + x["weight"] * x["weight"]))
        prefix = F.filter(F.zip_with("set", tail, lambda x, t: F.when(F.sqrt(t) >= (least - 1e-9) * F.col("norm"), x["token"])), lambda x: x.isNotNull())
        return groups.select(key, "norm", F.map_from_entries(F.transform("set", lambda x: F.struct(x["token"], x["weight"]))).alias(f"{key}_map"), F.explode(prefix).alias("token"))

    a, b = sets(left, "l_id"), sets(right, "r_id").withColumnRenamed("norm", "r_norm")
    met = a.join(b, "token").dropDuplicates(["l_id", "r_id"])
    dots = F.aggregate(F.map_entries("l_id_map"), F.lit(0.0), lambda t, e: t + e["value"] * F.coalesce(F.try_element_at(F.col("r_id_map"), e["key"]), F.lit(0.0)))
    return met.select("l_id", "r_id", (dots / (F.col("norm") * F.col("r_norm"))).alias("cosine")).where(F.col("cosine") >= least)


#: Fixed value: what a token's name is seeded with.
TOKEN_SEED = "tok:"


def phases(token: str, size: int) -> np.ndarray:
    """A token's angles: little-endian 16-bit steps of a turn from the SHAKE-256 digest of its seeded name."""
    raw = hashlib.shake_256((TOKEN_SEED + token).encode("utf-8")).digest(2 * size)
    return np.frombuffer(raw, "<u2") * (2 * np.pi / 65536)


#: Tokens whose phasors a task keeps.
KEPT = 20_000


def encode_phases(df: DataFrame, tokens: str, size: int = 256) -> DataFrame:
    """df with re and im: the normalised sum of the tokens' unit phasors; a row without tokens gets zeros."""
    at = df.columns.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            if len(kept) > KEPT:
                kept.clear()
            total = np.zeros((batch.num_rows, size), complex)
            for k, words in enumerate(batch.column(at).to_pylist()):
                for w in words or ():
                    if w not in kept:
                        kept[w] = np.exp(1j * phases(w, size))
                    total[k] += kept[w]
            length = np.linalg.norm(total, axis=1, keepdims=True)
            total = total / np.where(length > 0, length, 1)
            offsets = pa.array(np.arange(batch.num_rows + 1) * size, pa.int32())
            parts = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(x).ravel())) for x in (total.real, total.imag)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *parts], [*batch.schema.names, "re", "im"])

    empty = F.array().cast("array<double>")
    return df.mapInArrow(run, df.select("*", empty.alias("re"), empty.alias("im")).schema)


def rotated(vec: Column, k: Column, size: int, base: float = 10_000.0) -> tuple[Column, Column]:
    """Real and imaginary parts of a real vector turned k times: place j turns by base^(-j / size)."""
    turn = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.pow(F.lit(base), -j / float(size)) * k)
    return F.zip_with(vec, turn, lambda x, t: x * F.cos(t)), F.zip_with(vec, turn, lambda x, t: x * F.sin(t))


def phase_similarity(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> Column:
    """The real part of the inner product."""
    return dot(a_re, b_re) + dot(a_im, b_im)


def bind(a_re: Column, a_im: Column, b_re: Column, b_im: Column, inverse: bool = False) -> tuple[Column, Column]:
    """The product of two phase vectors, place by place; with inverse, by the second's conjugate."""
    s = -1.0 if inverse else 1.0
    ab, cd = F.arrays_zip(a_re.alias("x"), a_im.alias("y")), F.arrays_zip(b_re.alias("x"), b_im.alias("y"))
    re = F.zip_with(ab, cd, lambda p, q: p["x"] * q["x"] - p["y"] * q["y"] * s)
    im = F.zip_with(ab, cd, lambda p, q: p["x"] * q["y"] * s + p["y"] * q["x"])
    return re, im


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, k: int, groups: Sequence[str] = ()) -> DataFrame:
    """recall, mrr and the number of queries, by groups of truth (query, target, groups), of ranked (query, candidate, rank)."""
    found = ranked.where(F.col("rank") <= k).select("query", F.col("candidate").alias("target"), "rank")
    rows = truth.join(found, ["query", "target"], "left").groupBy("query", *groups).agg(F.min("rank").alias("rank"))
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def rank_within(df: DataFrame, query: str, score: str, key: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key)))


def law_breaches(triples: DataFrame, tolerance: float) -> DataFrame:
    """(law, n): how many triples (a, b, c of vectors) break a law of sums by more than the tolerance."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    laws = {"commutes": close(add(a, b), add(b, a), tolerance), "associates": close(add(add(a, b), c), add(a, add(b, c)), tolerance), "scales": close(scale(add(a, b), 2.0), add(scale(a, 2.0), scale(b, 2.0)), tolerance)}
    counts = triples.agg(*[F.count_if(~ok).alias(name) for name, ok in laws.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(name).alias("law"), F.col(name).alias("n")) for name in laws])))


def inheritance(members: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, subset, similarity) of fuzzy sets (term, item, p), few terms: shared parts by min, united by max, over items."""
    sizes = members.groupBy("term").agg(F.sum("p").alias("size"))
    x, y = members.select(F.col("term").alias("a"), "item", F.col("p").alias("pa")), members.select(F.col("term").alias("b"), "item", F.col("p").alias("pb"))
    shared = x.join(y, "item").where("a <> b").groupBy("a", "b").agg(F.sum(F.least("pa", "pb")).alias("both"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    both = shared.join(sizes.select(F.col("term").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("term").alias("b"), F.col("size").alias("sb")), "b")
    return both.select("a", "b", (F.col("both") / F.col("sa")).alias("subset"), (F.col("both") / (F.col("sa") + F.col("sb") - F.col("both"))).alias("similarity"))


def auc(scored: DataFrame, by: str) -> DataFrame:
    """(by, auc) of rows (by, score, positive): the share of pairs in the right order, ties half, from rank sums."""
    per = scored.groupBy(by, "score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = per.withColumn("won", F.col("p") * (below + F.col("n") / 2)).groupBy(by).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.where("p > 0 AND n > 0").select(by, (F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))


#: Queries whose vectors a task holds at a time, at most; scores that it holds at a time, about.
MOST_QUERIES, MOST_SCORES = 10_000, 1_000_000


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, candidate, score, rank): the k largest cosines of each query (query, q) among rows (id, vec) but its own.

    A stated query set against all rows: each task multiplies blocks of its rows with the queries, MOST_SCORES scores at a time, and keeps
    k of each query, so that no row is made for a pair. Queries are read MOST_QUERIES at a time. Equal scores go to the smaller id.
    """
    out, n = None, max(1, -(-queries.count() // MOST_QUERIES))
    for part in range(n):
        asked = queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == part).collect()  # about MOST_QUERIES rows
        if not asked:
            continue
        names, vecs = np.array([r["query"] for r in asked], np.int64), np.array([r["q"] for r in asked], float)
        vecs = vecs / np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, vecs: np.ndarray = vecs) -> Iterator[pa.RecordBatch]:
            top, of = np.full((len(names), k), -np.inf), np.full((len(names), k), np.iinfo(np.int64).max)  # the best so far, best first
            step = max(1, MOST_SCORES // len(names))
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                mine = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
                mine = mine / np.maximum(np.linalg.norm(mine, axis=1, keepdims=True), 1e-300)
                for at in range(0, len(ids), step):
                    here = ids[at : at + step]
                    scores = vecs @ mine[at : at + step].T
                    np.round(scores, 9, out=scores)
                    scores[(names[:, None] == here[None, :]) | np.isnan(scores)] = -np.inf
                    some = np.flatnonzero(scores.max(axis=1) >= top[:, -1])  # queries that the block may give something
                    both, them = np.hstack([top[some], scores[some]]), np.hstack([of[some], np.broadcast_to(here, (len(some), len(here)))])
                    line = np.arange(len(some))
                    for rank in range(k):
                        best = both.max(axis=1)
                        first = np.where(both == best[:, None], them, np.iinfo(np.int64).max).argmin(axis=1)
                        top[some, rank], of[some, rank] = best, them[line, first]
                        both[line, first] = -np.inf
            keep = np.isfinite(top.ravel())
            found = [np.repeat(names, k), of.ravel(), top.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in found], ["query", "candidate", "score"])

        found = rows.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")).mapInArrow(run, "query long, candidate long, score double")
        out = found if out is None else out.union(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query long, candidate long, score double, rank int")
    return rank_within(out, "query", "score", "candidate").where(F.col("rank") <= k)
