"""The best sets for each query set, by Jaccard or by weighted cosine, from an inverted index that is read only as far as it counts.

A query's tokens are taken from the rarest on. Each token has a bound: the most that it can add to any set's score. A set that
none of the first tokens brings up scores at most the sum of the other tokens' bounds. So the first tokens' posting lists
give candidates, whose exact scores give each query the score that its k-th best has at least; further lists are read only
while their bounds still sum to that score. Candidates are scored exactly, whichever list has brought them up.

Everything is joins on tokens and ids: the sets (id, token), the queries (query, token); a frequent token's list is read
only by queries that can't do without it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged

#: How many of a query's rarest tokens bring up its first candidates; what scores may differ by rounding.
FIRST, SLACK = 4, 1e-8
#: Fixed value: what is added to counts before their logarithm.
SMOOTHING = 1.0


@dataclass
class Index:
    """postings (token, id, weight, size), terms (token, df, weight, most): most is the largest share that the token has in a set."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    cosine: bool


def index(sets: DataFrame, cosine: bool = True, smoothing: float = SMOOTHING) -> Index:
    """The index of sets (id, token): inverse document frequencies as weights for the cosine, ones for Jaccard."""
    rows = staged(sets.select("id", "token").distinct(), "sparse-sets")
    n = rows.select("id").distinct().count()
    df = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log((F.lit(n) + smoothing) / (F.col("df") + smoothing)) + 1 if cosine else F.lit(1.0)
    terms = staged(df.select("token", "df", weight.alias("weight")), "sparse-terms")
    weighed = rows.join(terms.select("token", "weight"), "token")
    size = F.sqrt(F.sum(F.col("weight") ** 2)) if cosine else F.sum("weight")
    postings = staged(weighed.join(weighed.groupBy("id").agg(size.alias("size")), "id").select("token", "id", "weight", "size"), "sparse-postings")
    most = postings.groupBy("token").agg(F.max(F.col("weight") / F.col("size")).alias("most"))
    return Index(postings, staged(terms.join(most, "token"), "sparse-bounds"), n, cosine)


def _asked(found: Index, queries: DataFrame, smoothing: float) -> DataFrame:
    """(query, token, q_weight, q_size, place, bound): place by rarity from 1; bound is what this token and later ones can add."""
    rows = queries.select("query", "token").distinct().join(found.terms, "token", "left")
    unknown = F.log(F.lit(found.documents + smoothing) / smoothing) + 1 if found.cosine else F.lit(1.0)
    rows = rows.select("query", "token", F.coalesce("df", F.lit(0)).alias("df"), F.coalesce("weight", unknown).alias("q_weight"), F.coalesce("most", F.lit(0.0)).alias("most"))
    of = Window.partitionBy("query")
    size = F.sqrt(F.sum(F.col("q_weight") ** 2).over(of)) if found.cosine else F.sum("q_weight").over(of)
    rows = rows.withColumn("q_size", size)
    gain = F.col("q_weight") * F.col("most") / F.col("q_size") if found.cosine else F.when(F.col("df") > 0, 1 / F.col("q_size")).otherwise(0.0)
    order = of.orderBy("df", "token")
    known = rows.withColumn("gain", gain).where("df > 0")
    return known.withColumn("place", F.row_number().over(order)).withColumn("bound", F.sum("gain").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))


def _scored(found: Index, asked: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query, id, score) of candidates (query, id), on whole sets."""
    met = candidates.join(asked.select("query", "token", "q_weight", "q_size"), "query").join(found.postings, ["id", "token"])
    sums = met.groupBy("query", "id").agg(F.sum(F.col("q_weight") * F.col("weight")).alias("both"), F.max("q_size").alias("q_size"), F.max("size").alias("size"))
    score = F.col("both") / (F.col("q_size") * F.col("size")) if found.cosine else F.col("both") / (F.col("q_size") + F.col("size") - F.col("both"))
    return sums.select("query", "id", F.round(score, 9).alias("score"))


def top_k(found: Index, queries: DataFrame, k: int, own: bool = False, first: int = FIRST, smoothing: float = SMOOTHING) -> DataFrame:
    """(query, id, score, rank) of the k best sets of each query (query, token); ties to the smaller id, sets that share nothing left out.

    With own, queries are sets of the index and their own id is left out.
    """
    asked = staged(_asked(found, queries, smoothing), "sparse-asked")
    lists = found.postings.select("token", "id")
    other = (F.col("query") != F.col("id")) if own else F.lit(True)

    def brought_up(tokens: DataFrame) -> DataFrame:
        return tokens.select("query", "token").join(lists, "token").where(other).select("query", "id").distinct()

    one = staged(_scored(found, asked, brought_up(asked.where(F.col("place") <= first))), "sparse-first")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    ranked = one.withColumn("rank", F.row_number().over(order))
    least = ranked.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    open_tokens = further(asked, least, first)
    two = _scored(found, asked, brought_up(open_tokens).join(one.select("query", "id"), ["query", "id"], "left_anti"))
    best = one.unionByName(two).withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= k) & (F.col("score") > 0))
    return best.select("query", "id", "score", "rank")


#: Rows of queries (query, token) that go to every task, counted first; tokens of sets whose weights do, the most frequent ones; cells of scores that a task holds.
MOST_ASKED, FREQUENT, MOST_SCORES = 100_000, 50_000, 1_000_000


def nearest(lists: DataFrame, queries: DataFrame, k: int, smoothing: float = SMOOTHING) -> DataFrame:
    """(query, id, score, rank) as top_k of a cosine index gives them, for sets (id, tokens) met once, without an index: a few queries against all sets.

    A set is read inside a task: it keeps the numbers of its asked tokens and the sum of squares of its frequent tokens' weights; only its rare
    tokens are shuffled, to meet their weights. Then each task scores its sets against all queries and keeps k of each. More
    queries than MOST_ASKED rows take the index.
    """
    spark = lists.sparkSession
    lists = lists.select(F.col("id").cast("long"), F.array_distinct("tokens").alias("tokens")).where(F.size("tokens") > 0)
    total, ids = lists.agg(F.count(F.lit(1)), F.count_distinct("id")).first()
    if total != ids:  # one row for each id
        lists = lists.select("id", F.explode("tokens").alias("token")).groupBy("id").agg(F.collect_set("token").alias("tokens"))
        ids = lists.count()
    given = queries.select("query", "token").distinct().limit(MOST_ASKED + 1).collect()  # bounded
    if len(given) > MOST_ASKED:
        return top_k(index(lists.select("id", F.explode("tokens").alias("token")), smoothing=smoothing), queries, k, smoothing=smoothing)
    weight = F.log((F.lit(ids) + smoothing) / (F.col("df") + smoothing)) + 1
    df = lists.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    terms = staged(df.select("token", "df", weight.alias("weight")), "sparse-terms")
    frequent = {r["token"]: r["weight"] for r in terms.orderBy(F.desc("df"), "token").limit(FREQUENT).select("token", "weight").collect()}  # bounded
    asked = {token: n for n, token in enumerate(sorted({r["token"] for r in given}))}
    wanted = spark.createDataFrame([(t,) for t in asked], "token string")
    known = {r["token"]: r["weight"] for r in terms.join(F.broadcast(wanted), "token").select("token", "weight").collect()}  # at most MOST_ASKED
    unknown = math.log((ids + smoothing) / smoothing) + 1
    weights = frequent | known
    numbers = {token: (asked.get(token, -1), w * w) for token, w in weights.items()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                codes, squares, rare = [], [], []
                for tokens in batch.column(1).to_pylist():
                    met = [numbers[t] for t in tokens if t in numbers]
                    codes.append([c for c, _ in met if c >= 0])
                    squares.append(math.fsum(w for _, w in met))
                    rare.append([t for t in tokens if t not in numbers])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.list_(pa.int32())), pa.array(squares, pa.float64()), pa.array(rare, pa.list_(pa.string()))], ["id", "codes", "squares", "rare"])

    parts = staged(lists.mapInArrow(split, "id long, codes array<int>, squares double, rare array<string>"), "sparse-parts")
    rest = parts.select("id", F.explode("rare").alias("token")).join(terms.select("token", "weight"), "token").groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("more"))
    whole = parts.where(F.size("codes") > 0).select("id", "codes", "squares").join(rest, "id", "left")
    sized = whole.select("id", "codes", F.sqrt(F.col("squares") + F.coalesce("more", F.lit(0.0))).alias("size"))

    names = sorted({r["query"] for r in given})
    place = {q: n for n, q in enumerate(names)}
    pairs = sorted((asked[r["token"]], place[r["query"]], weights.get(r["token"], unknown)) for r in given)
    token_of, query_of, q_weight = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs], float)
    q_size = np.sqrt(np.bincount(query_of, q_weight**2, minlength=len(names)))
    begin = np.searchsorted(token_of, np.arange(len(asked) + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, labels = max(1, MOST_SCORES // max(1, len(names))), np.array(names, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                n, lists = batch.num_rows, batch.column(1)
                set_ids, sizes = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
                codes, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                each = begin[codes + 1] - begin[codes]  # the queries of each posting
                spot = np.repeat(begin[codes] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                both = np.bincount(query_of[spot] * n + np.repeat(row, each), q_weight[spot] ** 2, minlength=len(names) * n).reshape(len(names), n)
                scores = np.where(both > 0, np.round(both / (q_size[:, None] * sizes[None, :]), 9), -np.inf)
                order = np.lexsort((np.broadcast_to(set_ids, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, axis=1).ravel()
                keep = np.isfinite(best)
                found = [np.repeat(labels, order.shape[1]), set_ids[order].ravel(), best]
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in found], ["query", "id", "score"])

    found = sized.mapInArrow(score, "query long, id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def further(asked: DataFrame, least: DataFrame, first: int) -> DataFrame:
    """The tokens behind the first whose lists may still bring up a set as good as `least` (query, least)."""
    rest = asked.where(F.col("place") > first).join(least, "query", "left")
    return rest.where(F.col("bound") >= F.coalesce(F.col("least"), F.lit(0.0)) - SLACK)


def postings_read(found: Index, queries: DataFrame, k: int, own: bool = False, first: int = FIRST) -> tuple[int, int]:
    """How many postings top_k reads to find candidates, and how many all lists of the queries' tokens have."""
    asked = staged(_asked(found, queries, SMOOTHING), "sparse-asked")
    rows = top_k(found, queries, k, own, first)
    least = rows.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    taken = asked.where(F.col("place") <= first).select("df").unionByName(further(asked, least, first).select("df"))
    total = lambda df: int(df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])
    return total(taken), total(asked)


def sweep(tops: DataFrame, by: list[str]) -> DataFrame:
    """(by, threshold, covered, coverage, precision) of rows (by, score, right): one row for each distinct score as a threshold, from
    one sorted pass of cumulative counts within each group; rows without a score count as asked but are never covered."""
    per = tops.where("score is not null").groupBy(*by, F.col("score").alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("good"))
    asked = tops.groupBy(*by).agg(F.count(F.lit(1)).alias("asked"))
    down = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    rows = per.withColumn("covered", F.sum("n").over(down)).withColumn("found", F.sum("good").over(down))
    rows = rows.join(asked, by) if by else rows.crossJoin(asked)  # one row
    return rows.select(*by, "threshold", "covered", (F.col("covered") / F.col("asked")).alias("coverage"), (F.col("found") / F.col("covered")).alias("precision"))


def at_coverage(swept: DataFrame, by: list[str], coverage: float) -> DataFrame:
    """(by, threshold, coverage, precision): the lowest threshold that covers no more than the wanted share."""
    fits = swept.where(F.col("coverage") <= coverage + 1e-12)
    return fits.groupBy(*by).agg(F.min_by(F.struct("threshold", "coverage", "precision"), "threshold").alias("x")).select(*by, "x.*")
