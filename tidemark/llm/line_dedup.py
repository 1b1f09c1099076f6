"""Line dedup with two Bloom filters.

A line's key is the line without white space at its ends, A-Z lower-cased. Every batch of documents
notes its keys' hashes by segment of a filter; a segment's owner folds them into two bitmaps, once
seen and twice seen. Only lines whose key is in the twice-seen filter are suspected: they alone
shuffle, by a 128-bit digest of the key, for the exact number of documents and the first place.
False alarms of the filters therefore cost a little shuffle and never change a result.

The filters have `BITS_A_LINE` bits for each line up to `MOST_BITS`; beyond that they fill up, more
lines are suspected, and results stay exact. The repeated keys are broadcast while there are at most
`BROADCAST_KEYS` of them; beyond that their places are joined back by shuffles.

Texts: null and empty texts are one empty line. Keys shorter than `min_chars` are never dropped.
Each row counts as a document, repeated rows too; every row gives a row; an empty table an empty one.
Existing columns n_lines and n_dropped are replaced; others stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

BITS_A_LINE = 12
MOST_BITS = 1 << 30
SEGMENT_BITS = 1 << 16
BROADCAST_KEYS = 100_000


def key_of(line: bytes) -> bytes:
    return line.strip(common.WHITE).lower()  # bytes.lower() knows A-Z only


def digests(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line its key's digest; None for keys that are too short."""
    out = []
    for line in text.split(b"\n"):
        key = key_of(line)
        short = not key or (min_chars > 1 and len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars)
        out.append(None if short and min_chars > 0 else xxhash.xxh3_128_digest(key))
    return out


def _places(hashes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each 64-bit hash, and its two bits there packed in 32."""
    shift = np.uint64(64 - (segments.bit_length() - 1))
    segment = (hashes >> shift).astype(np.int32) if segments > 1 else np.zeros(len(hashes), np.int32)
    return segment, (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _set(bitmap: np.ndarray, packed: np.ndarray) -> None:
    bitmap[packed & np.uint32(0xFFFF)] = True
    bitmap[packed >> np.uint32(16)] = True


def _held(bitmap: np.ndarray, packed: np.ndarray) -> np.ndarray:
    return bitmap[packed & np.uint32(0xFFFF)] & bitmap[packed >> np.uint32(16)]


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def twice_filter(rows: DataFrame, segments: int, min_chars: int) -> DataFrame:
    """(segment, bits): the packed twice-seen bitmaps of the segments that have any."""

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.freeing(batches):
            seen = [np.frombuffer(b"".join(d), np.uint64)[::2] for t in _texts(batch.column(1)) if (d := {x for x in digests(t, min_chars) if x})]
            if not seen:
                continue
            hashes, counts = np.unique(np.concatenate(seen), return_counts=True)
            segment, packed = _places(hashes, segments)  # sorted, since the segment is the hash's top
            cuts = np.flatnonzero(np.diff(segment)) + 1
            names, once, twice = [], [], []
            for s, bits, n in zip(np.split(segment, cuts), np.split(packed, cuts), np.split(counts, cuts)):
                names.append(s[0])
                if 4 * len(bits) > SEGMENT_BITS // 8:  # a bitmap is smaller
                    for out, part in ((once, bits), (twice, bits[n > 1])):
                        bitmap = np.zeros(SEGMENT_BITS, bool)
                        _set(bitmap, part)
                        out.append(np.packbits(bitmap).tobytes())
                else:
                    once.append(bits.tobytes())
                    twice.append(bits[n > 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

        for batch in batches:
            for segment, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != at:
                    if at is not None and twice.any():
                        yield done()
                    at, once, twice = segment, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
                if len(a) == SEGMENT_BITS // 8:
                    bits = np.unpackbits(np.frombuffer(a, np.uint8)).astype(bool)
                    twice |= once & bits
                    twice |= np.unpackbits(np.frombuffer(b, np.uint8)).astype(bool)
                    once |= bits
                else:
                    packed = np.frombuffer(a, np.uint32)
                    _set(twice, packed[_held(once, packed)])
                    _set(twice, np.frombuffer(b, np.uint32))
                    _set(once, packed)
        if at is not None and twice.any():
            yield done()

    noted = rows.mapInArrow(note, "segment int, once binary, twice binary")
    return noted.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")


class Suspects:
    """The twice-seen filter as tasks hold it."""

    def __init__(self, parts: list, segments: int):
        self.segments = segments
        self.slot = np.zeros(segments, np.int64)
        bits = [np.zeros(SEGMENT_BITS // 8, np.uint8)]
        for part in parts:
            self.slot[part["segment"]] = len(bits)
            bits.append(np.frombuffer(bytes(part["bits"]), np.uint8))
        self.bits = np.stack(bits)

    def held(self, joined: bytes) -> np.ndarray:
        """For 16-byte digests, whether each may have been seen twice."""
        hashes = np.frombuffer(joined, np.uint64)[::2]
        segment, packed = _places(hashes, self.segments)
        slot, out = self.slot[segment], np.ones(len(hashes), bool)
        for bit in (packed & np.uint32(0xFFFF), packed >> np.uint32(16)):
            out &= (self.bits[slot, bit >> np.uint32(3)] >> (7 - (bit & np.uint32(7))).astype(np.uint8) & 1).astype(bool)
        return out


def repeats(df: DataFrame, min_docs: int = 2, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(key, n_docs, first_doc, first_line): the keys of lines found in min_docs documents or more, staged."""
    spark = df.sparkSession
    rows = common.small_batches(df).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n_lines = rows.agg(F.sum(lines)).first()[0] or 1
    bits = min(max(SEGMENT_BITS, 1 << (BITS_A_LINE * n_lines - 1).bit_length()), most_bits)
    segments = bits // SEGMENT_BITS
    parts = twice_filter(rows, segments, min_chars).collect()  # at most most_bits / 8 bytes
    shared = spark.sparkContext.broadcast(Suspects(parts, segments))
    kind = rows.schema["doc_id"].dataType

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suspects = shared.value
        for batch in common.freeing(batches):
            row, line, keys = [], [], []
            for k, text in enumerate(_texts(batch.column(1))):
                first: dict[bytes, int] = {}
                for n, digest in enumerate(digests(text, min_chars)):
                    if digest and digest not in first:
                        first[digest] = n
                row += [k] * len(first)
                line += first.values()
                keys += first
            if keys and (at := np.flatnonzero(suspects.held(b"".join(keys)))).size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in at], pa.binary()), batch.column(0).take(pa.array(np.asarray(row)[at])), pa.array(np.asarray(line)[at], pa.int32())],
                    ["key", "doc_id", "line"],
                )

    found = rows.mapInArrow(suspected, f"key binary, doc_id {kind.simpleString()}, line int")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "line")
    exact = found.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min(place).alias("first"))
    exact = exact.where(F.col("n_docs") >= min_docs)
    return common.staged(exact.select("key", "n_docs", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line")), "repeated-lines")


def dedup(
    df: DataFrame,
    min_docs: int = 2,
    min_chars: int = 1,
    keep_first: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_keys: int = BROADCAST_KEYS,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """df without repeated lines, the text column replaced, with n_lines (before) and n_dropped added.

    Lines whose key is found in min_docs documents or more go, but, with keep_first, for the first
    of them by id and line. A repeat inside one document goes with the others of its key.
    """
    spark = df.sparkSession
    found = repeats(df, min_docs, min_chars, id_col, text_col, most_bits)
    others = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    rows = df.select(*others)
    schema = rows.select(*others, F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    schema[text_col].nullable = True
    at_id, at_text = others.index(id_col), others.index(text_col)
    if found.count() <= broadcast_keys:
        first = {bytes(r["key"]): (r["first_doc"], r["first_line"]) for r in found.collect()}  # checked: at most broadcast_keys
        shared = spark.sparkContext.broadcast(first)

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = shared.value
            for batch in common.freeing(batches):
                gone = []
                for doc, text in zip(batch.column(at_id).to_pylist(), _texts(batch.column(at_text))):
                    gone.append([n for n, d in enumerate(digests(text or b"", min_chars)) if d in first and not (keep_first and first[d] == (doc, n))])
                yield _without(batch, at_text, gone)

        return rows.mapInArrow(drop, schema)
    # More keys than a broadcast should hold: find the lines' fates by joins. Rows alike in id and text share them.
    row_name, gone_name = common.fresh(df, "_row"), common.fresh(df, "_gone")
    named = rows.withColumn(row_name, F.md5(F.concat_ws("\x00", F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit("")))))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(r, d, n, x) for r, d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))) for n, x in enumerate(digests(t or b"", min_chars)) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], batch.column(1).type), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.binary())], ["_row", "doc", "line", "key"])

    kind = rows.schema[id_col].dataType.simpleString()
    lines = named.select(F.col(row_name).alias("_row"), id_col, text_col).mapInArrow(listed, f"_row string, doc {kind}, line int, key binary").join(found, "key")
    if keep_first:
        lines = lines.where(~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("line") == F.col("first_line"))))
    fates = lines.groupBy(F.col("_row").alias(row_name)).agg(F.collect_set("line").alias(gone_name))
    named = named.join(fates, row_name, "left").select(*others, gone_name)

    def drop_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _without(batch.select(others), at_text, [x or [] for x in batch.column(len(others)).to_pylist()])

    return named.mapInArrow(drop_listed, schema)


def _without(batch: pa.RecordBatch, at_text: int, gone: list[list[int]]) -> pa.RecordBatch:
    texts, counts = [], []
    for text, lines in zip(_texts(batch.column(at_text)), gone):
        parts, drop = (text or b"").split(b"\n"), set(lines)
        counts.append(len(parts))
        texts.append(text if not drop else b"\n".join(x for n, x in enumerate(parts) if n not in drop))
    columns = list(batch.columns)
    columns[at_text] = pa.array(texts, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array([len(set(x)) for x in gone], pa.int64())], [*batch.schema.names, "n_lines", "n_dropped"])
