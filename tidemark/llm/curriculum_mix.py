"""Mixing sources to target weights along a curriculum.

Sources share the words of the whole table by weight; no target passes `most` times its source's
words, and what is cut off there is shared anew by weight. Each source has a schedule, a weight
over training time 0..1 made of straight pieces. Its integral is the source's cumulative demand;
inverting it turns a document's place in its source's stream of words into a training position.
Sources whose target is larger than they are go round again, so that a document may have several
positions. Documents are range-sorted by position.

Places in a source are exact running sums in a fixed pseudo-random order (md5 of the id): a range
partitioning on (source, order), running sums inside each partition, then one offset for each
partition and source. A source of any size is spread over many partitions; runs agree.

Texts: null has no words. A null source is a source of its own, ordered last. Repeated rows are
documents of their own. Documents without words are never taken. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: A schedule: (time, weight) knots from time 0 to 1, joined by straight lines; only its shape counts.
Schedule = Sequence[tuple[float, float]]
#: Light sources early, heavy ones late.
EARLY: Schedule = ((0.0, 1.5), (1.0, 0.5))
EVEN: Schedule = ((0.0, 1.0), (1.0, 1.0))
LATE: Schedule = ((0.0, 0.5), (0.6, 1.0), (1.0, 1.75))


#: Buckets of a source's order whose totals training_order goes by, and rows of totals that are broadcast, at most (some 200 bytes each).
BUCKETS = 1 << 10
BROADCAST_ROWS = 100_000


def position_of(share: Column, schedule: Schedule) -> Column:
    """The time by which the share (0..1) of a schedule's whole demand has come: its integral, inverted."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:])]
    done = np.concatenate([[0.0], np.cumsum(areas)]) / sum(areas)
    out = None
    for k, ((t0, w0), (t1, w1)) in enumerate(zip(schedule, schedule[1:])):
        if not areas[k]:
            continue
        need = (share - float(done[k])) * float(sum(areas))  # w0 x + slope x^2 / 2 = need
        slope = (w1 - w0) / (t1 - t0)
        x = need / w0 if not slope else (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * need, F.lit(0.0))) - w0) / slope
        at = F.least(F.greatest(x, F.lit(0.0)), F.lit(t1 - t0)) + t0
        out = F.when(share <= float(done[k + 1]), at) if out is None else out.when(share <= float(done[k + 1]), at)
    return out.otherwise(F.lit(float(schedule[-1][0])))


def targets(sources: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """sources (source_key, source_size) with turn, weight and target; one row for each source.

    In the order of most * size / weight, a source is cut at its limit as long as its weight's
    share of what is left is above that limit.
    """
    by_name, by_limit = Window.orderBy("source_key"), Window.orderBy("limit_by_weight", "source_key")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.withColumn("turn", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("turn") + 1).cast("long"))
    rows = rows.withColumn("most", most * F.col("source_size")).withColumn("limit_by_weight", F.col("most") / F.col("weight"))
    every = Window.partitionBy()
    rows = rows.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    rows = rows.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    wide = "decimal(38,0)"
    rows = rows.withColumn("cut", F.col("most").cast(wide) * F.col("left_weight") < F.col("weight").cast(wide) * F.col("left"))
    first = F.min_by(F.struct("left", "left_weight"), F.when(~F.col("cut"), F.struct("limit_by_weight", "source_key"))).over(every)
    rows = rows.withColumn("first", first)
    share = (F.col("weight") * F.col("first.left")).cast("double") / F.col("first.left_weight").cast("double")
    return rows.withColumn("target", F.when(F.col("cut"), F.col("most").cast("double")).otherwise(share)).select("source_key", "source_size", "turn", "weight", "target")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted rows their partition and the words of their source before them in it."""
    part, source, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, size = batch.column(1).dictionary_encode(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        names = keys.dictionary.to_pylist()
        place = keys.indices.to_numpy(zero_copy_only=False)
        before = np.cumsum(size) - size
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        carried = before[starts].copy()
        if names[place[0]] == source:
            carried[0] -= total
        before = before - np.repeat(carried, np.diff(np.concatenate([starts, [len(size)]])))
        source, total = names[place[-1]], int(before[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(len(size), part, np.int32)), pa.array(before)], ["doc_id", "source_key", "size", "part", "before"])


def mix(
    df: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    schedules: Sequence[Schedule] = (EARLY, EVEN, LATE),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, positions.

    weights and schedules go round the sources in code point order. positions has one training
    position (0..1) for each time the document is taken, ascending.
    """
    sized = df.select(
        F.col(id_col).alias("doc_id"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))).alias("source_key"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
    )
    sized = common.staged(sized, "mix-sizes")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    spread = sized.withColumn("order", order).repartitionByRange("source_key", "order", "doc_id", "size").sortWithinPartitions("source_key", "order", "doc_id", "size")
    kind = sized.schema["doc_id"].dataType.simpleString()
    rows = common.staged(spread.drop("order").mapInArrow(_running, f"doc_id {kind}, source_key string, size bigint, part int, before bigint"), "mix-places")
    parts = rows.groupBy("source_key", "part").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
    aims = targets(parts.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, most)
    rows = rows.join(parts.drop("words").join(aims, "source_key"), ["source_key", "part"])
    start = F.col("offset") + F.col("before")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("start", start).withColumn("rounds", rounds)
    over = F.col("target") - (F.col("rounds") * F.col("source_size")).cast("double")
    again = (2 * F.col("start") + F.col("size")).cast("double") < 2 * over
    copies = F.when(F.col("size") > 0, F.col("rounds") + F.when(again, 1).otherwise(0)).otherwise(F.lit(0))
    rows = rows.withColumn("copies", copies.cast("int"))

    def position(k: Column) -> Column:
        share = (k * F.col("source_size") + F.col("start")) / F.col("target")
        out = None
        for turn in range(len(weights)):
            at = position_of(share, schedules[turn % len(schedules)])
            out = F.when(F.col("turn") == turn, at) if out is None else out.when(F.col("turn") == turn, at)
        return out

    numbered = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))
    source = F.when(F.col("source_key").startswith("0"), F.substring("source_key", 2, 2147483647))
    return rows.select("doc_id", source.alias("source"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.transform(numbered, position).alias("positions"))


def by_position(mixed: DataFrame) -> DataFrame:
    """Mixed documents range-sorted by their first training position, those never taken last."""
    first = mixed.withColumn("first_position", F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)))
    return first.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id").drop("first_position")


def training_order(
    df: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    most: int = 3,
    schedules: Sequence[Schedule] = (EARLY, EVEN, LATE),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The rows of df as training sees them: one for each time that mix takes them, range-sorted by position; df's columns.

    Whole rows are shuffled once, for the sort. What they need to know comes from totals of each source's
    BUCKETS buckets of the order, joined by broadcast while these are at most broadcast_rows. A row is taken as
    often as mix says, exactly: only the bucket where a source's last round ends is looked at row by row. Its place
    inside its own bucket is where its hash lies there, so that positions are right to a bucket's words.

    Ids should be unique; rows that repeat an id are taken equally often. Columns may have any name.
    """
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    source = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    text = F.col(text_col).cast("string")
    place = F.conv(F.substring(order, 1, 11), 16, 10).cast("double") * (BUCKETS / float(1 << 44))  # of a row's hash among the buckets
    sized = df.select(
        F.col(id_col).alias("doc_id"),
        source.alias("source_key"),
        order.alias("order"),
        F.floor(place).cast("int").alias("bucket"),
        F.coalesce(F.regexp_count(text, F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
    )
    sized = common.staged(sized, "order-sizes")
    n_rows = sized.count()
    buckets = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = common.staged(buckets.withColumn("offset", F.coalesce(F.sum("words").over(so_far), F.lit(0))), "order-buckets", n_rows)
    n_buckets = buckets.count()
    aims = targets(buckets.groupBy("source_key").agg(F.sum("words").alias("source_size")), weights, most)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = aims.withColumn("rounds", rounds).withColumn("over", F.col("target") - (F.col("rounds") * F.col("source_size")).cast("double"))
    known = common.staged(buckets.join(aims, "source_key"), "order-aims", n_buckets)
    last = known.where((F.col("offset") < F.col("over")) & (F.col("over") < F.col("offset") + F.col("words")))
    inside = Window.partitionBy("source_key").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(_bounded(last.select("source_key", "bucket", "offset", "over"), broadcast_rows), ["source_key", "bucket"])
    rows = rows.withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = rows.where((2 * F.col("start") + F.col("size")).cast("double") >= 2 * F.col("over"))
    ends = out.groupBy("source_key").agg(F.min(F.struct("order", "doc_id")).alias("end"))
    known = known.join(ends, "source_key", "left").withColumn("whole", F.col("offset") + F.col("words") <= F.col("over")).withColumn("part", (F.col("offset") < F.col("over")) & ~F.col("whole"))
    known = common.staged(known.withColumnsRenamed({c: f"_{c}" for c in known.columns}), "order-known", n_buckets)

    packed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("_doc"), source.alias("_source_key"), order.alias("_order"), F.coalesce(text.rlike(common.WORD_PATTERN), F.lit(False)).alias("_words_in"))
    packed = packed.where("_words_in").withColumn("_place", F.conv(F.substring("_order", 1, 11), 16, 10).cast("double") * (BUCKETS / float(1 << 44))).withColumn("_bucket", F.floor("_place").cast("int"))
    packed = packed.join(_bounded(known, broadcast_rows), ["_source_key", "_bucket"])
    here = F.struct(F.col("_order").alias("order"), F.col("_doc").alias("doc_id"))
    again = F.col("_whole") | (F.col("_part") & F.coalesce(here < F.col("_end"), F.lit(True)))
    copies = F.col("_rounds") + F.when(again, 1).otherwise(0)
    start = F.col("_offset") + (F.col("_place") - F.col("_bucket")) * F.col("_words")
    packed = packed.withColumn("_copies", copies.cast("int")).where("_copies > 0").withColumn("_start", start).withColumn("_turn_of", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    share = (F.col("_turn_of") * F.col("_source_size") + F.col("_start")) / F.col("_target")
    position = None
    for turn in range(len(weights)):
        at = position_of(share, schedules[turn % len(schedules)])
        position = F.when(F.col("_turn") == turn, at) if position is None else position.when(F.col("_turn") == turn, at)
    packed = packed.select("row", position.alias("position"), F.col("_doc").alias("doc"), F.col("_turn_of").alias("turn"))
    return packed.repartitionByRange("position", "doc", "turn").sortWithinPartitions("position", "doc", "turn").select("row.*")


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """rows, to be broadcast if they are at most `most`."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
