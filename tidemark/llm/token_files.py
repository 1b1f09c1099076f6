"""Token-id files: a context-mixing range coder over independently reset, checksummed blocks.

Documents are tokenized, get an end id each and are written in ascending id order: a range
partitioning by id, then frames of whole documents. A frame holds its documents' ids and lengths, a
table of its own ids' frequencies and its token ids cut into blocks of BLOCK ids. Every block starts
from the same state and has its own checksum, so that blocks are coded (and damage is found)
independently; numpy codes all blocks of a frame side by side, one id of each at a step.

The model of a block predicts the next id from the last two ids (order 2), from the last one (order 1)
and from nothing (order 0). Order 0 is the distribution of the frame's ids, from their true counts. Orders
2 and 1 learn within the block: each keeps, for CONTEXTS hashed contexts, the id seen there and how far it
is to be trusted. The share that each order gets in the mixed distribution adapts, separately for each pair of
trusts and for agreeing and differing guesses. The mixed distribution over all ids narrows the interval of a
range coder, once for an id; carries are settled at the end of a block.

Ids are any unsigned 32-bit integers. The OWN most frequent ids of a frame have slots of their own in order 0;
the others share one and are told apart by their number in the frame's table.

Frames are rows of a Parquet table (`payload` holds the file format's bytes), written and read by Spark,
so any store that Spark reaches will do and lost tasks are simply run again.

Texts: null counts as empty; every document has at least its end id. Rows that repeat an id are
documents of their own, ordered by text; rows without an id come first. Other columns are left out, whatever
their names. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

BLOCK = 2048
#: Ids in a frame, about: its documents are whole.
FRAME = 3 << 21
MAGIC = b"TID2"
#: Contexts that a block's tables of order 2 and order 1 tell apart.
CONTEXTS = 1024
#: Ids of a frame with slots of their own; a number and a trust fit into 16 bits.
OWN = (1 << 14) - 2
#: Slots of order 0 and of the mixed distribution; orders 2 and 1 together get at most MOST of these.
ZERO, SLOTS = float(1 << 15), float(1 << 20)
MOST = SLOTS - 2 * ZERO
#: A block's code is made of 24-bit words.
WORD, FULL = float(1 << 24), float(1 << 48)
RATE = 1 / 16
#: Words whose ids each worker keeps, at most, between two batches; then the more used half stays.
KEPT = 400_000
#: Bytes of text that are encoded together, about.
TOGETHER = 8 << 20
#: What order 2 and order 1 get at first, by their trust.
EARLY = (0.0, 0.15, 0.4, 0.7)


class Frequencies:
    """A frame's ids, most frequent first, and their slots in order 0. Numbers of ids start at 1."""

    def __init__(self, ids: np.ndarray, slots: np.ndarray):
        self.ids, self.slots = ids, slots
        self.many = len(ids) > len(slots)  # then the last number is what the other ids share
        #: By number the end of its slots, as a share of ZERO; they start where those of the number before end.
        self.ends = np.append(0.0, np.cumsum(slots, dtype=np.int64) / ZERO)
        self.number = np.repeat(np.arange(1, len(slots) + 1, dtype=np.uint16), slots)

    @classmethod
    def count(cls, ids: np.ndarray) -> tuple[Frequencies, np.ndarray]:
        """The frequencies of ids, and each one's number."""
        if int(ids.max()) < 1 << 22:
            counts = np.bincount(ids)
            found = np.flatnonzero(counts)
            counts, place = counts[found], None
        else:
            found, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        number = np.empty(len(found), np.int32)
        number[order] = np.arange(1, len(found) + 1, dtype=np.int32)
        if place is None:
            table = np.zeros(int(found[-1]) + 1, np.int32)
            table[found] = number
            numbers = table[ids]
        else:
            numbers = number[place.ravel()]
        sizes = counts[order].astype(np.int64)
        if len(sizes) > OWN:
            sizes = np.append(sizes[:OWN], sizes[OWN:].sum())
        slots = 1 + sizes * (int(ZERO) - len(sizes)) // sizes.sum()
        slots[0] += int(ZERO) - slots.sum()
        return cls(found[order].astype(np.uint32), slots.astype(np.uint16)), numbers


#: Numbers of the steps below as arrays without a dimension: numpy takes those in half the time that it needs for Python's numbers.
U1, U2, U3 = (np.array(k, np.uint16) for k in (1, 2, 3))
HASHED, CONTEXT, NEXT, TWICE, SPREAD = (np.array(k, np.int64) for k in (16, CONTEXTS - 1, 1, 3, 0x9E3779B1))
LEAST, WHOLE, ALL, GIVEN, STEP = (np.array(k, np.float64) for k in (16, 1, SLOTS, MOST, RATE))
UNIT, RADIX, SHIFT, LAST = (np.array(k, np.float64) for k in (1 / SLOTS, WORD, 1 / WORD, SLOTS - 1))


class Model:
    """The mixed predictions of many blocks side by side. Arrays of two rows are for order 2 and order 1.

    A step is some forty calls on a few thousand lanes: choices are made by sums and masks, as numpy's own (where) take
    several times as long, and what a lane needs together lies together.
    """

    def __init__(self, lanes: int, zero: Frequencies):
        self.zero = zero
        self.cell = np.arange(2 * lanes).reshape(2, lanes) * CONTEXTS
        self.states = np.arange(lanes) * 32
        #: Hashes of the two last ids and of the last one; only 26 bits of them count.
        self.key = np.zeros((2, lanes), np.int64)
        self.before, self.last = self.key
        #: By context the number of the id seen there, times 4, and how far it is trusted, 0 (nothing seen) to 3.
        self.table = np.zeros(2 * lanes * CONTEXTS, np.uint16)
        two, one = np.meshgrid(EARLY, EARLY)  # state: trust of order 2 + 4 * trust of order 1 + 16 if they agree
        early = [np.concatenate(x, axis=None) for x in ((two, two), (one * (1 - two), 0 * one))]
        #: By state what order 2 (real) and order 1 (imaginary) get, so that one look-up finds both.
        self.share = np.tile(MOST * (early[0] + 1j * early[1]), lanes)
        self.at, self.state, self.place = np.zeros((2, lanes), np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.intp)
        self.packed, self.seen, self.trust, self.kept, self.mask, self.hit = (np.zeros((2, lanes), np.uint16) for _ in range(6))
        self.one, self.fresh, self.agree = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16), np.zeros(lanes, bool)
        #: Rows are lanes here, as in share.
        self.part, self.gain, self.whole = np.zeros(lanes, np.complex128), np.zeros(lanes, np.complex128), np.zeros((lanes, 2))
        self.parts, self.gains = (x.view(np.float64).reshape(lanes, 2) for x in (self.part, self.gain))
        self.two, self.both, self.rest, self.none = (np.zeros(lanes) for _ in range(4))
        self.bound, self.chosen, self.step = np.zeros((2, lanes)), np.zeros((2, lanes)), np.zeros(lanes)

    def mix(self) -> None:
        """The guesses of order 2 and 1 for the next id, and the slots that they get."""
        np.right_shift(self.key, HASHED, self.at)
        np.bitwise_and(self.at, CONTEXT, self.at)
        np.add(self.at, self.cell, self.at)
        self.table.take(self.at, mode="wrap", out=self.packed)
        np.right_shift(self.packed, U2, self.seen)
        np.bitwise_and(self.packed, U3, self.trust)
        np.equal(self.seen[0], self.seen[1], self.agree)
        np.copyto(self.one, self.agree.view(np.uint8))
        np.left_shift(self.one, U2, self.one)
        np.add(self.one, self.trust[1], self.one)
        np.left_shift(self.one, U2, self.one)
        np.add(self.one, self.trust[0], self.one)
        np.copyto(self.state, self.one)
        np.add(self.states, self.state, self.state)
        self.share.take(self.state, mode="wrap", out=self.part)
        np.floor(self.parts, self.whole)
        np.add(self.whole[:, 0], LEAST, self.two)
        np.add(self.whole[:, 1], LEAST, self.both)
        np.add(self.both, self.two, self.both)
        np.subtract(ALL, self.both, self.rest)

    def interval(self, now: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """The first slot of the numbers now, and the one after their last; hits: whether order 2, or only order 1, guessed them."""
        lo, hi = bound = self.bound
        np.copyto(self.place, now)
        self.zero.ends.take(self.place, mode="clip", out=hi)
        np.subtract(self.place, NEXT, self.place)
        self.zero.ends.take(self.place, mode="clip", out=lo)
        np.multiply(bound, self.rest, bound)
        np.floor(bound, bound)
        np.add(bound, self.both, bound)
        # Guessed by order 2: from 0 to two; by order 1: from two to both; all are whole numbers, so sums are exact.
        np.copyto(self.chosen, hits)
        by_two, by_one = self.chosen
        np.subtract(WHOLE, by_two, self.none)
        np.subtract(self.none, by_one, self.none)
        np.multiply(bound, self.none, bound)
        np.multiply(by_one, self.two, self.step)
        np.add(lo, self.step, lo)
        np.multiply(by_two, self.two, self.step)
        np.add(hi, self.step, hi)
        np.multiply(by_one, self.both, self.step)
        np.add(hi, self.step, hi)
        return bound

    def learn(self, now: np.ndarray, hits: np.ndarray) -> None:
        np.multiply(self.chosen, GIVEN, self.gains.T)
        np.subtract(self.gains, self.parts, self.gains)
        np.multiply(self.gains, STEP, self.gains)
        np.add(self.gains, self.parts, self.gains)
        self.share[self.state] = self.gain
        # A hit raises the trust up to 3, a miss lowers it; at the lowest the new id takes the place.
        np.equal(self.seen, now, hits)
        np.copyto(self.hit, hits.view(np.uint8))
        np.add(self.trust, U1, self.kept)
        np.right_shift(self.kept, U2, self.kept)
        np.subtract(U2, self.kept, self.kept)
        np.multiply(self.kept, self.hit, self.kept)
        np.subtract(self.kept, U1, self.kept)
        np.add(self.kept, self.packed, self.kept)
        np.right_shift(self.trust, U1, self.mask)
        np.bitwise_or(self.mask, self.hit, self.mask)
        np.negative(self.mask, self.mask)
        np.left_shift(now, U2, self.fresh)
        np.add(self.fresh, U1, self.fresh)
        np.bitwise_xor(self.kept, self.fresh, self.kept)
        np.bitwise_and(self.kept, self.mask, self.kept)
        np.bitwise_xor(self.kept, self.fresh, self.kept)
        self.table[self.at] = self.kept
        np.multiply(self.last, TWICE, self.before)
        np.copyto(self.last, now)
        np.multiply(self.last, SPREAD, self.last)
        np.add(self.before, self.last, self.before)


class Encoder:
    """A range coder for each lane: words may exceed 24 bits by a carry until finish settles it."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes), np.full(lanes, FULL)
        #: The words sent at each step and their lanes.
        self.words, self.lanes = [], []
        self.kind = np.uint16 if lanes <= 1 << 16 else np.uint32
        self.unit, self.step, self.short = np.zeros(lanes), np.zeros(lanes), np.zeros(lanes, bool)

    def put(self, bound: np.ndarray) -> None:
        """Narrow every lane to the slots from its first bound to its second."""
        lo, hi = bound
        np.multiply(self.range, UNIT, self.unit)
        np.floor(self.unit, self.unit)
        np.multiply(lo, self.unit, self.step)
        np.add(self.low, self.step, self.low)
        np.subtract(hi, lo, self.step)
        np.multiply(self.step, self.unit, self.range)
        np.less(self.range, RADIX, self.short)
        due = np.flatnonzero(self.short)
        if due.size:
            low = self.low[due]
            word = np.floor(low * SHIFT)
            self.words.append(word.astype(np.int32))
            self.lanes.append(due.astype(self.kind))
            self.low[due] = (low - word * RADIX) * RADIX
            self.range[due] *= RADIX

    def finish(self) -> list[bytes]:
        """The code of each lane. What a decoder reads beyond its end counts as 0."""
        lanes = len(self.low)
        self.words.append(np.ceil(self.low * SHIFT).astype(np.int32))
        self.lanes.append(np.arange(lanes, dtype=self.kind))
        lane = np.concatenate(self.lanes)
        order, sent = np.argsort(lane, kind="stable"), np.bincount(lane, minlength=lanes)
        out = np.zeros((lanes, int(sent.max())), np.int32)
        out[np.arange(out.shape[1]) < sent[:, None]] = np.concatenate(self.words)[order]
        while (carry := out >> 24).any():
            out &= 0xFFFFFF
            out[:, :-1] += carry[:, 1:]
        raw = out.astype(">u4").view(np.uint8).reshape(*out.shape, 4)[:, :, 1:]
        return [raw[k, :n].tobytes() for k, n in enumerate(sent.tolist())]


class Decoder:
    def __init__(self, data: bytes, sizes: np.ndarray):
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.float64)
        lengths = np.asarray(sizes) // 3
        words = int(lengths.max()) + 4
        table = np.zeros((len(lengths), words), np.float32)  # exact, as words have 24 bits
        table[np.arange(words) < lengths[:, None]] = raw[:, 0] * 65536 + raw[:, 1] * 256 + raw[:, 2]
        #: Where in flat each lane's next word stands; only a damaged code leaves its lane.
        self.flat, self.at = table.ravel(), np.arange(len(lengths)) * words + 2
        self.code, self.range = table[:, :2].astype(np.float64) @ (WORD, 1.0), np.full(len(lengths), FULL)
        self.unit, self.place, self.step = (np.zeros(len(lengths)) for _ in range(3))
        self.short = np.zeros(len(lengths), bool)

    def slot(self) -> np.ndarray:
        """The slot that each lane's code lies in."""
        np.multiply(self.range, UNIT, self.unit)
        np.floor(self.unit, self.unit)
        np.divide(self.code, self.unit, self.place)
        np.floor(self.place, self.place)
        return np.minimum(self.place, LAST, self.place)

    def take(self, bound: np.ndarray) -> None:
        lo, hi = bound
        np.multiply(lo, self.unit, self.step)
        np.subtract(self.code, self.step, self.code)
        np.subtract(hi, lo, self.step)
        np.multiply(self.step, self.unit, self.range)
        np.less(self.range, RADIX, self.short)
        due = np.flatnonzero(self.short)
        if due.size:
            at = self.at[due]
            self.code[due] = self.code[due] * RADIX + self.flat.take(at, mode="clip")
            self.at[due] = at + 1
            self.range[due] *= RADIX


def _digit(value: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The slots of a 16-bit digit, all slots for the lanes that have none."""
    return np.stack([np.where(some, value * (SLOTS / 65536), 0.0), np.where(some, (value + 1) * (SLOTS / 65536), SLOTS)])


def encode_blocks(numbers: np.ndarray, zero: Frequencies) -> list[bytes]:
    """The code of each run of BLOCK ids, given by their numbers in zero; the last run may be shorter."""
    lanes, shared = -(-len(numbers) // BLOCK), len(zero.slots)
    if not lanes:
        return []
    steps = min(BLOCK, len(numbers))
    table = np.ones((lanes, BLOCK), np.int32 if zero.many else np.uint16)
    table.ravel()[: len(numbers)] = numbers
    table = np.ascontiguousarray(table[:, :steps].T)
    small = np.minimum(table, shared).astype(np.uint16) if zero.many else table
    model, coder, hits = Model(lanes, zero), Encoder(lanes), np.zeros((2, lanes), bool)
    for step, now in enumerate(small):
        model.mix()
        np.equal(model.seen, now, hits)
        np.greater(hits[1], hits[0], hits[1])
        coder.put(model.interval(now, hits))
        if zero.many and (some := now == shared).any():
            rest = table[step] - float(shared)
            coder.put(_digit(np.floor(rest / 65536), some))
            coder.put(_digit(rest % 65536, some))
        model.learn(now, hits)
    return coder.finish()


def decode_blocks(data: bytes, sizes: np.ndarray, n: int, zero: Frequencies) -> np.ndarray:
    """The n numbers of blocks whose codes of the given sizes (in bytes) stand on end."""
    lanes, shared = len(sizes), len(zero.slots)
    if not lanes:
        return np.zeros(0, np.int32)
    steps = min(BLOCK, n)
    out = np.zeros((steps, lanes), np.int32 if zero.many else np.uint16)
    model, coder, hits, place, at = Model(lanes, zero), Decoder(data, sizes), np.zeros((2, lanes), bool), np.zeros(lanes), np.zeros(lanes, np.intp)
    now, either, flags, guess = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16), np.zeros((2, lanes), np.uint16), np.zeros((2, lanes), np.uint16)
    spread, top = np.array(ZERO), np.array(ZERO - 1)
    for step in range(steps):
        model.mix()
        slot = coder.slot()
        np.less(slot, model.two, hits[0])
        np.less(slot, model.both, hits[1])
        np.greater(hits[1], hits[0], hits[1])
        # The last slot of order 0 that starts at this slot or before, then its number, unless an order guessed it.
        np.subtract(slot, model.both, place)
        np.multiply(place, spread, place)
        np.add(place, top, place)
        np.divide(place, model.rest, place)
        np.copyto(at, place, casting="unsafe")
        zero.number.take(at, mode="clip", out=now)
        np.copyto(flags, hits.view(np.uint8))
        np.multiply(flags, model.seen, guess)
        np.add(flags[0], flags[1], either)
        np.subtract(either, U1, either)  # all bits where neither guessed it
        np.bitwise_and(now, either, now)
        np.add(now, guess[0], now)
        np.add(now, guess[1], now)
        coder.take(model.interval(now, hits))
        out[step] = now
        if zero.many and (some := now == shared).any():
            number = np.zeros(lanes)
            for _ in range(2):
                digit = np.floor(coder.slot() / (SLOTS / 65536))
                coder.take(_digit(digit, some))
                number = number * 65536 + digit
            out[step, some] = np.minimum(number[some] + shared, len(zero.ids))
        model.learn(now, hits)
    full = np.zeros((lanes, BLOCK), np.int32)
    full[:, :steps] = out.T
    return full.ravel()[:n]


_HEAD = "<4sIQIIII"


def write_frame(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one frame of unsigned 32-bit ids."""
    if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 32:
        raise ValueError("ids outside 0..4294967295 do not fit this format")
    zero, numbers = Frequencies.count(ids) if len(ids) else (Frequencies(np.zeros(0, np.uint32), np.zeros(0, np.uint16)), ids)
    blocks = encode_blocks(numbers, zero)
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    sums = [zlib.crc32(raw[4 * k * BLOCK : 4 * (k + 1) * BLOCK]) for k in range(len(blocks))]
    head = struct.pack(_HEAD, MAGIC, len(docs), len(ids), len(blocks), BLOCK, len(zero.ids), len(zero.slots))
    head += bytes(d is not None for d in docs) + np.array([d or 0 for d in docs], "<i8").tobytes() + lengths.astype("<u8").tobytes()
    head += zero.ids.astype("<u4").tobytes() + zero.slots.astype("<u2").tobytes()
    head += np.array([len(b) for b in blocks], "<u4").tobytes() + np.array(sums, "<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


def read_frame(frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(documents, lengths, ids) of a frame; raises ValueError where a checksum differs."""
    magic, n_docs, n_ids, n_blocks, block, n_known, n_slots = struct.unpack_from(_HEAD, frame)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a frame of this format")
    at, parts = struct.calcsize(_HEAD), []
    for kind, n in (("u1", n_docs), ("<i8", n_docs), ("<u8", n_docs), ("<u4", n_known), ("<u2", n_slots), ("<u4", n_blocks), ("<u4", n_blocks)):
        if at + n * int(kind[-1]) > len(frame):
            raise ValueError("the frame's head is damaged")
        parts.append(np.frombuffer(frame, kind, n, at))
        at += n * int(kind[-1])
    known, docs, lengths, known_ids, slots, sizes, sums = parts
    if len(frame) < at + 4 or zlib.crc32(frame[:at]) != struct.unpack_from("<I", frame, at)[0]:
        raise ValueError("the frame's head is damaged")
    if len(frame) - at - 4 != int(sizes.sum(dtype=np.int64)):
        raise ValueError("the frame has lost or gained bytes")
    zero = Frequencies(known_ids, slots)
    with np.errstate(all="ignore"):  # damaged codes may lead anywhere until their checksum is compared
        ids = known_ids[decode_blocks(memoryview(frame)[at + 4 :], sizes.astype(np.int64), n_ids, zero) - 1] if n_ids else known_ids[:0]
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    for k, total in enumerate(sums.tolist()):
        if zlib.crc32(raw[4 * k * BLOCK : 4 * (k + 1) * BLOCK]) != total:
            raise ValueError(f"block {k} is damaged")
    return [d if k else None for d, k in zip(docs.tolist(), known.tolist())], lengths.astype(np.int64), ids


#: What a tokenizer's JSON must say so that its ids can be taken word by word: white space is dropped, pieces stay
#: within words, and what lower-casing and splitting off a last mark do to a word, the tokenizer does itself.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Letters to which normalizing does no more than to lower-case them.
PLAIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Marks; a run of them at a word's end, behind a letter or a digit, is a piece of its own.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def _lists(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists named by which on end, and where each ends; flat holds sizes[k] values of list k, on end."""
    starts, each = np.cumsum(sizes) - sizes, sizes[which]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat((starts[which] - ends + each).astype(np.int32 if total + len(flat) < 1 << 31 else np.int64), each)
    at += np.arange(total, dtype=at.dtype)
    return flat[at], ends


class WordIds:
    """The ids of texts. Where the tokenizer allows it (BY_WORDS), each new word is encoded once and many words in one call."""

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        said = json.loads(spec)
        suffix, added = said["model"].get("end_of_word_suffix"), said.get("added_tokens") or []
        self.tokenizer = Tokenizer.from_str(spec)
        self.by_words = bool(suffix) and all(said.get(k) == v for k, v in BY_WORDS.items()) and all(t["content"].startswith("<|") and not t["normalized"] for t in added) and bool(added)
        if self.by_words:
            ways = [{"type": "WhitespaceSplit"}, BY_WORDS["pre_tokenizer"]["pretokenizers"][1]]
            self.plain = Tokenizer.from_str(json.dumps({**said, "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": ways}}))
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            self.mark, self.mark_id = added[0]["content"], added[0]["id"]
            #: Known pieces of words, their uses so far, and their ids: sizes[k] of flat for each, on end.
            self.words, self.uses = pa.array([], pa.string()), np.zeros(0, np.int64)
            self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _many(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids on end, and each one's number of ids."""
        whole = pc.match_substring_regex(words, f"^[{PLAIN}]+$")
        named = pc.match_substring(words, "<|")
        parts = []
        for kind, some in ((0, whole), (1, pc.and_(pc.invert(whole), pc.invert(named))), (2, pc.and_(pc.invert(whole), named))):
            at = np.flatnonzero(some.to_numpy(zero_copy_only=False))
            if not at.size:
                continue
            chosen = words.filter(some)
            if kind == 2:
                found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(chosen.to_pylist(), add_special_tokens=False)]
                ids, sizes = np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
            else:
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(chosen), 256), len(chosen)), pa.int32()), chosen)
                lines = (pc.utf8_lower(pc.binary_join(lists, " ")) if kind == 0 else pc.binary_join(lists, f" {self.mark} ")).to_pylist()
                tokenizer = self.plain if kind == 0 else self.tokenizer
                found = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(lines if kind == 0 else [f"{line} {self.mark}" for line in lines], add_special_tokens=False)]
                ids = np.concatenate(found)
                last = np.flatnonzero(self.ends[ids] if kind == 0 else ids == self.mark_id)
                sizes = np.diff(last, prepend=-1)
                if kind == 1:
                    ids, sizes = np.delete(ids, last), sizes - 1
            if len(sizes) != at.size:
                raise ValueError("the tokenizer's ids do not fall into words")
            parts.append((at, ids, sizes))
        sizes = np.zeros(len(words), np.int32)
        for at, _, each in parts:
            sizes[at] = each
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.int32)
        for at, ids, each in parts:
            flat[np.repeat(starts[at] - (np.cumsum(each) - each), each) + np.arange(len(ids))] = ids
        return flat, sizes

    def _learn(self, words: pa.Array) -> np.ndarray:
        """The places of words among the known ones, after encoding the new ones."""
        if len(self.words) > KEPT:
            kept = np.sort(np.argsort(-self.uses, kind="stable")[: KEPT // 2])
            self.flat = _lists(self.flat, self.sizes, kept)[0]
            self.words, self.uses, self.sizes = self.words.take(pa.array(kept)), self.uses[kept] // 2, self.sizes[kept]
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy()
        if (new := at < 0).any():
            learnt, at = words.filter(pa.array(new)), at.copy()
            flat, sizes = self._many(learnt)
            at[new] = len(self.words) + np.arange(len(learnt))
            self.words, self.uses = pa.concat_arrays([self.words, learnt]), np.append(self.uses, np.zeros(len(learnt), np.int64))
            self.flat, self.sizes = np.append(self.flat, flat), np.append(self.sizes, sizes)
        return at

    def _ids(self, words: pa.Array, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids on end of different words, each used so often, and each one's number of ids.

        Case and marks after a word change no ids of the rest but would make more words to know. What holds "<|" may
        name a special token and stays as it is.
        """
        named = pc.match_substring(words, "<|")
        words = pc.if_else(named, words, pc.ascii_lower(words))
        marked = pc.and_not(pc.less(pc.binary_length(pc.ascii_rtrim(words, MARKS)), pc.binary_length(words)), named)
        cut = pc.extract_regex(words.filter(marked), rf"^(?P<stem>.*[{PLAIN}0-9])(?P<marks>[{re.escape(MARKS)}]+)$")
        apart = np.flatnonzero(marked.to_numpy(zero_copy_only=False))[cut.is_valid().to_numpy(zero_copy_only=False)]
        stems, marks = cut.drop_null().flatten()
        split = np.zeros(len(words), bool)
        split[apart] = True
        coded = pa.concat_arrays([pc.replace_with_mask(words, pa.array(split), stems), marks]).dictionary_encode()
        pieces = coded.indices.to_numpy()
        known = self._learn(coded.dictionary)
        self.uses[known] += np.bincount(pieces, np.append(uses, uses[apart]), len(known)).astype(np.int64)
        pieces = known[pieces]
        stem, mark = pieces[: len(words)], pieces[len(words) :]
        sizes = self.sizes[stem]
        sizes[apart] += self.sizes[mark]
        return _lists(self.flat, self.sizes, np.insert(stem, apart + 1, mark))[0], sizes

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids on end, each with the end id, and each text's number of ids."""
        if not self.by_words:
            found = [np.array([*e.ids, end], np.int64) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int64), *found]), np.fromiter(map(len, found), np.int64, len(found))
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        indices = coded.indices.to_numpy()
        flat, sizes = self._ids(coded.dictionary, np.bincount(indices, minlength=len(coded.dictionary)))
        # The end id stands behind the words' ids and is put after each text's words.
        ends = np.cumsum(pc.list_value_length(words).to_numpy())
        ids, upto = _lists(np.append(flat, np.array(end, flat.dtype)), np.append(sizes, np.int32(1)), np.insert(indices, ends, len(sizes)))
        return ids, np.diff(upto[ends + np.arange(len(ends))], prepend=0)


_tokenizers: dict[int, WordIds] = {}


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about TOGETHER bytes."""
    held, size = [], 0
    for batch in common.freeing(batches):
        pieces = max(1, batch.nbytes // TOGETHER)
        step = max(1, -(-batch.num_rows // pieces))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            held.append(piece)
            size += piece.nbytes
            if size >= TOGETHER:
                whole, held, size = pa.concat_batches(held), [], 0
                yield whole
    if held:
        yield pa.concat_batches(held)


def write(df: DataFrame, spec: str, end: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the files (to path, or to the shared folder) and return their frames.

    spec is the tokenizer's JSON; (part, frame, before, n_tokens, payload): frames are ordered by part
    and frame, before counts the ids of earlier frames of the part.
    """
    rows = common.small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizers.get(hash(spec)) or _tokenizers.setdefault(hash(spec), WordIds(spec))
        part, frame, before = TaskContext.get().partitionId(), 0, 0
        docs, lengths, ids, held = [], [], [], 0

        def cut() -> pa.RecordBatch:
            nonlocal frame, before, held
            whole = np.concatenate(ids)
            payload = write_frame(docs, np.concatenate(lengths), whole)
            row = [pa.array([x], t) for x, t in ((part, pa.int32()), (frame, pa.int32()), (before, pa.int64()), (len(whole), pa.int64()), (payload, pa.binary()))]
            frame, before, held = frame + 1, before + len(whole), 0
            docs.clear(), lengths.clear(), ids.clear()
            return pa.RecordBatch.from_arrays(row, ["part", "frame", "before", "n_tokens", "payload"])

        for batch in _together(batches):
            got, each = tokens.encode(batch.column(1), end)
            docs += batch.column(0).to_pylist()
            ids.append(got)
            lengths.append(each)
            held += len(got)
            if held >= FRAME:
                yield cut()
        if docs:
            yield cut()

    frames = rows.mapInArrow(run, "part int, frame int, before bigint, n_tokens bigint, payload binary")
    if path is None:
        return common.staged(frames, "token-files")
    frames.write.parquet(path)
    return frames.sparkSession.read.parquet(path)


def read(frames: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the files, ids as little-endian 32-bit integers."""
    totals = sorted((r["part"], r["n"]) for r in frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row for each partition
    starts, so_far = {}, 0
    for part, n in totals:
        starts[part] = so_far
        so_far += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.freeing(batches):
            for part, before, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                docs, lengths, ids = read_frame(payload)
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                for at in range(0, len(docs), 4096):
                    some = range(at, min(at + 4096, len(docs)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([docs[k] for k in some], pa.int64()),
                            pa.array(starts[part] + before + (ends - lengths)[at : at + 4096]),
                            pa.array(lengths[at : at + 4096]),
                            pa.array([raw[4 * (ends[k] - lengths[k]) : 4 * ends[k]] for k in some], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return frames.select("part", "before", "payload").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
