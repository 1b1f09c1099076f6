"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

1. A document is the set of its distinct word shingles. Documents with the same set fall into one
   class, named by a 128-bit hash of the sorted set; only classes go on. An id on several rows with different
   sets joins their classes at the end.
2. `bands` keys of `rows` MinHash values each put classes into buckets; classes that share no bucket
   are not compared. At a similarity of 0.8 the defaults miss about one link in three million.
3. The MinHash sample of each class is folded into an odd sketch: every value flips one bit, so that
   the population count of the XOR of two sketches estimates the symmetric difference of the samples,
   most precisely for high similarities. Pairs whose estimate is below the threshold by several
   standard errors are dropped; all others are confirmed on the full sets.
4. First round: in every bucket all members are compared with one of them, the class with the most
   bucket mates overall (ties: the smallest hash). This joins a large group of near copies through its
   centre with as many pairs as members. Confirmed pairs are united to components.
5. Second round, so that no link is lost: buckets that still hold two components or more are dealt out
   in tiles of bounded size; members of the bucket's largest component meet only the tiles of the others, so that
   a bucket of n members with m outsiders takes about n m / TILE rows. Their members get a much finer odd sketch, of a sample of WIDE_SAMPLE values,
   since large groups of documents just below the threshold are common. A pair of members of different
   components is compared in the first bucket that it shares, inside a task, and only pairs whose fine
   sketches pass become rows for confirmation.

No pair rows are made for members of one component, for copies, or for sketches that differ.

Texts: A-Z are lower-cased, words are runs without white space; with fewer words than a shingle takes,
the whole row of words is the one shingle; null texts and texts without words have an empty set and are
linked with nothing. Repeated rows share their id's component, whether their texts are equal or not. Rows without
an id have no component and are not kept. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

ROWS, BANDS = 4, 28
SKETCH_BITS = 512
#: The sample and the bits of the second round's finer sketch.
WIDE_SAMPLE, WIDE_BITS = 2048, 4096
#: Members of a tile's side, about.
TILE = 256
STANDARD_ERRORS = 4.5
_HIGH = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of all texts on end, and each text's number of them."""
    hashes, counts, known = [], [], {}
    digest = xxhash.xxh3_64_intdigest
    for text in texts:
        words = text.lower().split()  # bytes: A-Z only, and \x20, \x09-\x0D only
        for w in {*words}:
            if w not in known:
                known[w] = digest(w)
        hashes.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        counts.append(len(words))
    flat, lengths = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(counts, np.int64)
    starts = np.cumsum(lengths) - lengths
    made, sizes = [], []
    with np.errstate(over="ignore"):
        # The hash of a shingle at each word, as if texts did not end.
        run = flat.copy()
        for k in range(1, size):
            run[: len(flat) - k] = _mix(run[: len(flat) - k] * np.uint64(3) + flat[k:] + _HIGH)
        for a, n in zip(starts.tolist(), lengths.tolist()):
            if n >= size:
                made.append(np.unique(run[a : a + n - size + 1]))
            elif n:
                made.append(np.array([xxhash.xxh3_64_intdigest(flat[a : a + n].tobytes(), seed=n)], np.uint64))
            else:
                made.append(np.zeros(0, np.uint64))
            sizes.append(len(made[-1]))
    return (np.concatenate(made) if made else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def min_hashes(flat: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of each set without an empty one; rows are sets."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), n), np.uint64)
    if not len(starts):
        return out
    odd = _mix(np.arange(1, n + 1, dtype=np.uint64) * _HIGH) | np.uint64(1)
    shift = _mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64) * _HIGH)
    step = np.empty_like(flat)
    high = np.empty_like(flat)
    for k in range(n):
        np.multiply(flat, odd[k], out=step)
        np.add(step, shift[k], out=step)
        np.right_shift(step, np.uint64(32), out=high)
        np.bitwise_xor(step, high, out=step)
        np.multiply(step, _MIX1, out=step)
        out[:, k] = np.minimum.reduceat(step, starts)
    return out


def odd_sketches(values: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Each row's values folded into a bitmap of parities: packed, bits / 8 bytes to a row."""
    with np.errstate(over="ignore"):
        bit = _mix(values + np.arange(values.shape[1], dtype=np.uint64) * _HIGH) % np.uint64(bits)
    at = (np.arange(len(values), dtype=np.int64)[:, None] * bits + bit.astype(np.int64)).ravel()
    counts = np.bincount(at, minlength=len(values) * bits).reshape(len(values), bits)
    return np.packbits((counts & 1).astype(np.uint8), axis=1)


def most_odd_bits(threshold: float, n: int, bits: int = SKETCH_BITS, errors: float | None = STANDARD_ERRORS) -> int:
    """The largest population count of an XOR of sketches that a pair at the threshold may well have; all bits without errors.

    Two errors add up: the sample's (n values) and the folding's (bits that even numbers of values hit).
    """
    if errors is None:
        return bits
    apart = 2 * n * (1 - threshold)
    expected = bits / 2 * (1 - (1 - 2 / bits) ** apart)
    slope = (1 - 2 / bits) ** apart
    sample = 2 * n * (threshold * (1 - threshold) / n) ** 0.5 * slope
    folding = (bits / 4 * max(1 - slope**2 - 2 * apart / bits * slope**2 * 2, 0.0)) ** 0.5
    return int(expected + errors * (sample**2 + folding**2) ** 0.5) + 1


def signatures(docs: DataFrame, shingle: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, set_hash, keys array<long>, sketch) of rows (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.freeing(batches):
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                flat, sizes = shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), shingle)
                ends = np.cumsum(sizes)
                raw = flat.tobytes()
                sets = [xxhash.xxh3_128_digest(raw[8 * (e - n) : 8 * e]) if n else None for e, n in zip(ends.tolist(), sizes.tolist())]
                full = np.flatnonzero(sizes > 0)
                keys, sketches = [None] * len(sizes), [None] * len(sizes)
                with np.errstate(over="ignore"):
                    values = min_hashes(flat, sizes, rows * bands)
                    banded = np.zeros((len(values), bands), np.uint64)
                    for r in range(rows):
                        banded = _mix(banded * np.uint64(31) + values[:, r::rows][:, :bands] + _HIGH)
                packed = odd_sketches(values) if len(values) else None
                for k, row in enumerate(full.tolist()):
                    keys[row] = banded[k].view(np.int64)
                    sketches[row] = packed[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["doc_id", "n_shingles", "set_hash", "keys", "sketch"],
                )

    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_hash binary, keys array<bigint>, sketch binary")


def _close(sketch_a: str, sketch_b: str, most: int):
    """Whether two sketch columns are near enough: population count of their XOR, in the JVM."""

    def words(name):
        hexed = F.hex(name)
        return [F.conv(F.substring(hexed, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(SKETCH_BITS // 32)]

    total = None
    for a, b in zip(words(sketch_a), words(sketch_b)):
        part = F.bit_count(a.bitwiseXOR(b))
        total = part if total is None else total + part
    return total <= most


def full_sets(docs: DataFrame, nodes: DataFrame, classes: DataFrame, shingle: int, rows: int) -> DataFrame:
    """(node, members) of nodes (node), staged: their shingles' sorted hashes, read from the rows of each class's smallest id."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.freeing(batches):
            for at in range(0, whole.num_rows, 512):
                flat, sizes = shingle_sets(whole.slice(at, 512).column(1).cast(pa.binary()).to_pylist(), shingle)
                raw = flat.tobytes()
                each = [raw[8 * (e - n) : 8 * e] for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in each], pa.binary()), pa.array(each, pa.binary())], ["node", "members"])

    ids = classes.join(nodes, "node", "left_semi").select(F.col("class_id").alias("doc_id")).distinct()
    ids = common.staged(ids, "near-dup-ids", rows)  # of known size, so that Spark need not shuffle the texts where it is small
    read = docs.join(ids, "doc_id", "left_semi").mapInArrow(sets, "node binary, members binary").dropDuplicates(["node"])
    return common.staged(read.join(nodes, "node", "left_semi"), "near-dup-sets", rows, common.TASK_TEXTS)


def wide_sketches(held: DataFrame) -> DataFrame:
    """(node, wide): the finer sketches of full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.freeing(batches):
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                each = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
                with np.errstate(over="ignore"):
                    values = min_hashes(np.concatenate(each), np.array([len(x) for x in each], np.int64), WIDE_SAMPLE)
                packed = odd_sketches(values, WIDE_BITS)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], ["node", "wide"])

    return held.mapInArrow(run, "node binary, wide binary")


def confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    rows = pairs.count()
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("members").alias("members_a")), "a")
    both = both.join(held.select(F.col("node").alias("b"), F.col("members").alias("members_b")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return common.staged(both.select("a", "b", "members_a", "members_b").mapInArrow(check, "a binary, b binary"), "near-dup-links", rows, common.TASK_TEXTS)


def components(links: DataFrame) -> DataFrame:
    """(node, component_id): the smallest node reachable over links (a, b), for every node that has one.

    Every round each node takes the smallest label among itself and its neighbours, and then the label
    of that label; the labels are staged after each round until none changes.
    """
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    rows = 2 * links.count()
    ends = common.staged(ends, "near-dup-ends", rows)
    labels = common.staged(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("component_id")), "near-dup-labels", rows)
    while True:
        offered = ends.join(labels.select(F.col("node").alias("other"), "component_id"), "other").select("node", "component_id")
        better = offered.union(labels).groupBy("node").agg(F.min("component_id").alias("component_id"))  # both uses share its shuffle
        jumped = better.join(better.select(F.col("node").alias("component_id"), F.col("component_id").alias("root")), "component_id")
        following = common.staged(jumped.select("node", F.least("component_id", "root").alias("component_id")), "near-dup-labels", rows)
        changed = following.join(labels.withColumnRenamed("component_id", "before"), "node").where("component_id <> before")
        if changed.isEmpty():
            return following
        labels = following


def _tiles(members: DataFrame, bits: int) -> DataFrame:
    """(a, b) of members (bucket, band, node, component, keys, wide, meets, tile) that differ in component and are close by sketch.

    Each member goes to the tile pairs (its tile, each of the first `meets` tiles); a pair of members meets in the one
    pair of their tiles, and is compared in the first band that it shares. Tiles are sorted by and read as a stream.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("meets") - 1)).alias("other")
    dealt = members.select("bucket", "tile", other, "band", "node", "component", "keys", "wide")
    dealt = dealt.select("bucket", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), (F.col("tile") > F.col("other")).alias("second"), "band", "node", "component", "keys", "wide")
    dealt = dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(low: int, high: int, rows: list[tuple]) -> list[tuple]:
            left = [r for r in rows if low == high or not r[0]]
            right = left if low == high else [r for r in rows if r[0]]
            if not left or not right:
                return []
            band, names = left[0][1], {}
            number = lambda part: np.array([names.setdefault(r[3], len(names)) for r in part])
            keys = lambda part: np.array([r[4] for r in part], np.int64)
            sketch = lambda part: np.frombuffer(b"".join(r[5] for r in part), np.uint64).reshape(len(part), -1)
            ca, cb, ka, kb, a, b = number(left), number(right), keys(left), keys(right), sketch(left), sketch(right)
            out = []
            for i in range(len(left)):
                near = np.flatnonzero(cb != ca[i])
                if low == high:
                    near = near[near > i]
                near = near[(kb[near] == ka[i]).argmax(axis=1) == band]
                near = near[np.bitwise_count(a[i] ^ b[near]).sum(axis=1) <= bits]
                out += [(left[i][2], right[j][2]) for j in near.tolist()]
            return out

        def result(found: list[tuple]) -> pa.RecordBatch:
            found = [(min(p), max(p)) for p in found]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], field.type) for k in range(2)], ["a", "b"])

        at, rows, field = None, [], None
        for batch in batches:
            field = batch.schema.field("node")
            found: list[tuple] = []
            for bucket, low, high, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (bucket, low, high):
                    if rows:
                        found += compare(at[1], at[2], rows)
                    at, rows = (bucket, low, high), []
                rows.append(row)
            yield result(found)
        if rows:
            yield result(compare(at[1], at[2], rows))

    return dealt.mapInArrow(pairs, "a binary, b binary").distinct()


def find(
    df: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    rows: int = ROWS,
    bands: int = BANDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    errors: float | None = STANDARD_ERRORS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of df.

    errors: how many standard errors below the threshold a pair's sketches may say and yet be confirmed on full sets; None drops
    no pair by its sketches, so that only the bands choose what is compared.
    """
    docs = common.small_batches(df).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    signed = common.staged(signatures(docs, shingle, rows, bands), "near-dup-signatures")
    named = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = named.groupBy(F.col("set_hash").alias("node")).agg(F.min("doc_id").alias("class_id"))
    n_docs = signed.count()
    classes = common.staged(classes, "near-dup-classes", n_docs)
    n_classes = classes.count()
    # An id may stand on several rows with different sets; its classes then belong together.
    ids = named.groupBy("doc_id").agg(F.min("set_hash").alias("b"), F.max("set_hash").alias("most")).where("b <> most").select("doc_id", "b")
    same = named.join(ids, "doc_id").where(F.col("set_hash") != F.col("b")).select(F.col("set_hash").alias("a"), "b").distinct()
    heads = named.join(classes.select(F.col("node").alias("set_hash"), F.col("class_id").alias("doc_id")), ["set_hash", "doc_id"], "left_semi").dropDuplicates(["doc_id", "set_hash"])
    heads = heads.select(F.col("set_hash").alias("node"), "keys", "sketch")
    band_rows = heads.select("node", F.posexplode("keys").alias("band", "key")).select("node", "band", F.xxhash64("band", "key").alias("bucket"))
    counts = band_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mates = common.staged(band_rows.join(counts, "bucket"), "near-dup-mates", n_classes * bands)
    n_mates = mates.count()
    weights = common.staged(mates.groupBy("node").agg(F.sum("n").alias("weight")), "near-dup-weights", n_mates)
    n_weighed = weights.count()
    weighed = mates.join(weights, "node")
    centres = weighed.groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("weight"), "node"))["node"].alias("centre"))
    stars = mates.join(centres, "bucket").where(F.col("node") != F.col("centre")).select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    held = full_sets(docs, weights.select("node"), classes, shingle, n_weighed)  # whatever shares a bucket
    sketches = heads.join(weights.select("node"), "node", "left_semi")
    sketches = common.staged(sketches, "near-dup-sketches", n_weighed)
    bits = most_odd_bits(percent / 100, rows * bands, errors=errors)
    seen = stars.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    seen = seen.join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    close = common.staged(seen.where(_close("sketch_a", "sketch_b", bits)).select("a", "b"), "near-dup-close", n_mates)
    links = confirmed(close, held, percent)
    labels = components(links)
    # Second round: members of different components that share a bucket.
    placed = mates.select("node", "band", "bucket").join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("component_id", "node").alias("component"))
    placed = common.staged(placed, "near-dup-placed", n_mates)
    mixed = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket", "n")
    open_rows = common.staged(placed.join(mixed, "bucket"), "near-dup-open", n_mates)
    wide = wide_sketches(held.join(open_rows.select("node").distinct(), "node", "left_semi"))
    wide = common.staged(wide.join(sketches.select("node", "keys"), "node"), "near-dup-wide", n_weighed, common.TASK_TEXTS)
    # A bucket's largest component is never compared with itself: its members only meet the tiles of the others.
    shares = open_rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = shares.groupBy("bucket").agg(F.max(F.struct("size", "component")).alias("largest"))
    largest = largest.select("bucket", F.col("largest.size").alias("size"), F.col("largest.component").alias("largest"))
    inside = F.col("component") == F.col("largest")
    own, others = F.ceil(F.col("size") / TILE).cast("int"), F.ceil((F.col("n") - F.col("size")) / TILE).cast("int")
    tile = F.when(inside, others + F.pmod(F.xxhash64("node", "bucket"), own)).otherwise(F.pmod(F.xxhash64("node", "bucket"), others)).cast("int")
    meets = F.when(inside, others).otherwise(others + own)
    open_rows = open_rows.join(largest, "bucket").withColumn("tile", tile).withColumn("meets", meets)
    open_rows = open_rows.join(wide, "node").select("bucket", "band", "node", "component", "keys", "wide", "meets", "tile")
    more = _tiles(open_rows, most_odd_bits(percent / 100, WIDE_SAMPLE, WIDE_BITS, errors))
    tried = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = common.staged(more.join(tried, ["a", "b"], "left_anti"), "near-dup-more")
    late = confirmed(more, held, percent)
    labels = components(common.staged(links.union(late).union(same), "near-dup-all", links.count() + late.count() + n_docs))
    owned = labels.join(classes, "node")
    least = owned.groupBy("component_id").agg(F.min("class_id").alias("least"))
    final = classes.join(owned.join(least, "component_id").select("node", "least"), "node", "left").select(F.col("node").alias("set_hash"), F.coalesce("least", "class_id").alias("component"))
    final = common.staged(final, "near-dup-final", n_docs)
    found = signed.select("doc_id", "n_shingles", "set_hash").join(final, "set_hash", "left")
    component = F.coalesce("component", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def dedup(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document of each component: the one with the smallest id; rows without an id stay."""
    found = find(df, shingle, percent, id_col=id_col, text_col=text_col)
    gone = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(id_col)).distinct()
    return df.join(gone, id_col, "left_anti")
