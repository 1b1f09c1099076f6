"""SentencePiece encoding and decoding by a table of each prefix's last token.

A model of the merge type joins the best-scored neighbouring pair again and again. Its result
has a property that needs no merging at all to exploit: a row of tokens is the encoding of its
text exactly if every token encodes to itself and every neighbouring pair encodes to itself. So
each prefix of a text has one last token: the only piece that ends there and is compatible with
the last token of the prefix before it. One pass over the text fills the table of last tokens;
following it from the end gives the ids backwards.

Texts are cut where no piece can reach across (before the space mark of the next word and at
characters that no piece holds), so that the tables of frequent words are kept and used again.

Texts: null counts as empty, an empty text has no ids; every row gives one row, repeated rows
included; an empty table gives an empty one. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

SPACE = "▁"
#: Marks cuts inside a batch; texts that hold it take the plainer way.
CUT = "\x1f"
#: Words kept by each Python worker, in two generations.
KEPT_WORDS = 80_000
KEPT_PAIRS = 250_000


class MergeTable:
    """The pieces of a model with what the prefix tables need."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.text: list[str] = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        byte = [sp.is_byte(i) for i in range(size)]
        self.unknown = sp.unk_id()
        self.byte_id = {int(self.text[i][3:5], 16): i for i in range(size) if byte[i]}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.score = {self.text[i]: sp.get_score(i) for i in range(size) if not (special[i] or byte[i])}
        self.id = {self.text[i]: i for i in range(size) if not (special[i] or byte[i])}
        self.known = set(chain.from_iterable(self.id))
        self.shown = [self.unknown_surface(sp) if i == self.unknown else "" if special[i] else self.text[i].replace(SPACE, " ") for i in range(size)]
        self.inner = any(SPACE in t.lstrip(SPACE) for t in self.id)
        alone = "" if "\n" in self.known else "\n"
        self.cut = re.compile("(?s).+" if self.inner else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|{alone}" if alone else ""))
        self.steps: dict[str, list[tuple[float, int, int, int]]] = {}
        self.goto: list[dict[str, int]] = [{}]
        self.ending: list[tuple[tuple[int, int], ...]] = [()]
        for token, i in self.id.items():
            if self.merged(token, self.steps.setdefault(token, [])) == [token]:  # else merging never yields it
                self.add(token, i)
        self.link()
        self.size = [len(t) for t in self.text]
        self.pairs: dict[int, bool] = {}
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def add(self, token: str, i: int) -> None:
        node = 0
        for c in token:
            if c not in self.goto[node]:
                self.goto[node][c] = len(self.goto)
                self.goto.append({})
                self.ending.append(())
            node = self.goto[node][c]
        self.ending[node] = ((i, len(token)),)

    def link(self) -> None:
        """Each node's longest proper suffix that is a node; all pieces that end at a node, longest first."""
        self.suffix = [0] * len(self.goto)
        level = list(self.goto[0].values())
        while level:
            below = []
            for node in level:
                self.ending[node] += self.ending[self.suffix[node]]
                for c, child in self.goto[node].items():
                    up = self.suffix[node]
                    while up and c not in self.goto[up]:
                        up = self.suffix[up]
                    self.suffix[child] = self.goto[up].get(c, 0)
                    below.append(child)
            level = below
        self.moves: list[dict[str, int]] = [{}] * len(self.goto)  # one shared empty table until a node is visited
        self.unvisited = self.moves[0]

    def move(self, node: int, c: str) -> int:
        up = node
        while up and c not in self.goto[up]:
            up = self.suffix[up]
        to = self.goto[up].get(c, 0)
        if c in self.known:
            if self.moves[node] is self.unvisited:
                self.moves[node] = {}
            self.moves[node][c] = to
        return to

    @staticmethod
    def unknown_surface(sp) -> str:
        return sp.decode([sp.unk_id()])

    def merged(self, text: str, steps: list[tuple[float, int, int, int]]) -> list[str]:
        """What merging yields, for pieces, which are short. Notes each merge: its rank, where it begins, the size of the first and of the last part after it."""
        part: list[str | None] = list(text)
        after = list(range(1, len(part))) + [-1]
        before = [-1, *range(len(part) - 1)]
        score = self.score
        heap = [(-score[a + b], i, 2) for i, (a, b) in enumerate(zip(text, text[1:])) if a + b in score]
        heapify(heap)
        tail = len(part) - 1
        while heap:
            rank, i, size = heappop(heap)
            j = after[i]
            if part[i] is None or j < 0 or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if j == tail:
                tail = i
            steps.append((rank, i, len(part[0]), len(part[tail])))
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (both := part[left] + part[right]) in score:
                    heappush(heap, (-score[both], left, len(both)))
        return [x for x in part if x is not None]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the two tokens' text yields the two tokens.

        Both sides merge by themselves, best rank first, until a merge across their border is
        the best one left: then they are not compatible.
        """
        steps, more, score = self.steps[left], self.steps[right], self.score
        i, j, size = 0, 0, len(left)
        tail, head = 1, 1
        while True:
            cross = score.get(left[size - tail :] + right[:head])
            best = None if cross is None else (-cross, size - tail)
            while True:
                a = steps[i] if i < len(steps) else None
                b = more[j] if j < len(more) else None
                if a is not None and (b is None or a[0] <= b[0]):
                    if best is not None and best < (a[0], a[1]):
                        return False
                    i += 1
                    if a[3] != tail:
                        tail = a[3]
                        break
                elif b is not None:
                    if best is not None and best < (b[0], b[1] + size):
                        return False
                    j += 1
                    if b[2] != head:
                        head = b[2]
                        break
                else:
                    return best is None

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each word. In sorted order, a word goes on from the prefix shared with the one before it."""
        out, before, last, nodes = {}, "", [0], [0]  # last: of each prefix; 0 for a character that no piece has
        moves, ending, pairs, size_of, text = self.moves, self.ending, self.pairs, self.size, self.text
        for word in sorted(words):
            full, shared = len(word), min(len(before), len(word))
            while word[:shared] != before[:shared]:
                shared -= 1
            del last[shared + 1 :], nodes[shared + 1 :]
            node = nodes[shared]
            for end in range(shared + 1, full + 1):
                c = word[end - 1]
                to = moves[node].get(c)
                node = self.move(node, c) if to is None else to
                nodes.append(node)
                for token, size in ending[node]:
                    if size == end or not (left := last[end - size]):
                        last.append(token)
                        break
                    fits = pairs.get(pair := left << 24 | token)
                    if fits is None:
                        if len(pairs) > KEPT_PAIRS:
                            pairs.clear()
                        fits = pairs[pair] = self.compatible(text[left], text[token])
                    if fits:
                        last.append(token)
                        break
                else:
                    last.append(0)
            end, ids = full, []
            while end:
                if token := last[end]:
                    ids.append(token)
                    end -= size_of[token]
                else:
                    end -= 1
                    ids.extend(self.bytes_of(word[end]))
            ids.reverse()
            out[word] = tuple(ids)
            before = word
        return out

    def bytes_of(self, c: str) -> list[int]:
        """Backwards, the ids of a character that no piece has."""
        return [self.byte_id[b] for b in reversed(c.encode("utf-8"))] if self.byte_id else [self.unknown]

    def words(self, text: str) -> list[str]:
        """Cut where no piece reaches across."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def ids_of(self, words: list[str]) -> list[tuple[int, ...]]:
        new, old = self.new, self.old
        if len(new) > KEPT_WORDS:
            self.old = old = new
            self.new = new = {}
        missing = []
        for word in words:
            if word not in new:
                if (ids := old.get(word)) is None:
                    missing.append(word)
                else:
                    new[word] = ids
        if missing:
            new.update(self.encode_words(missing))
        return [new[word] for word in words]

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        return list(chain.from_iterable(self.ids_of(self.words(text))))

    def encode_many(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text: a batch's distinct words are encoded once and dealt out by their places."""
        marked = pc.binary_join_element_wise(pa.scalar(SPACE), pc.replace_substring(texts, " ", CUT + SPACE), "")
        marked = pc.if_else(pc.equal(texts, ""), "", marked)
        if "\n" not in self.known:
            marked = pc.replace_substring(marked, "\n", f"{CUT}\n{CUT}")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.match_substring(texts, SPACE), pc.or_(pc.match_substring(texts, CUT), pc.starts_with(texts, " "))))
        if self.inner or pc.any(odd).as_py():  # runs of space marks stay together
            places = np.flatnonzero(np.asarray(odd)) if not self.inner else np.arange(len(texts))
            lists = pc.split_pattern(marked, CUT).to_pylist()
            for i in places.tolist():
                lists[i] = self.words(texts[i].as_py())
            lists = pa.array(lists, pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(marked, CUT)
        coded = lists.flatten().dictionary_encode()
        found = self.ids_of(coded.dictionary.to_pylist())
        place = coded.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        starts, each = np.cumsum(sizes) - sizes, sizes[place]
        ends = np.concatenate([[0], np.cumsum(each)])
        values = flat[np.repeat(starts[place] - ends[:-1], each) + np.arange(ends[-1])]
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        offsets = ends[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))

    def decode(self, ids: list[int]) -> str:
        shown, of_byte = self.shown, self.id_byte
        if of_byte.keys().isdisjoint(ids):
            text = "".join(map(shown.__getitem__, ids))
        else:
            out, run = [], bytearray()
            for i in ids:
                if i in of_byte:
                    run.append(of_byte[i])
                else:
                    if run:
                        out.append(_as_text(bytes(run)))
                        run.clear()
                    out.append(shown[i])
            text = "".join(out) + _as_text(bytes(run))
        return text[1:] if ids and self.text[ids[0]].startswith(SPACE) else text


def _as_text(run: bytes) -> str:
    """Bytes as UTF-8, with one replacement character for each byte that belongs to no character."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                size = 1
                out.append("�")
            at += size
        return "".join(out)


_tables: dict[int, MergeTable] = {}


def table_of(model: bytes) -> MergeTable:
    """The model's table, built once in each Python worker."""
    key = hash(model)
    if key not in _tables:
        _tables[key] = MergeTable(model)
    return _tables[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _encoded(table: MergeTable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, text) as (doc_id, ids)."""
    for whole in common.freeing(batches):
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([batch.column(0), table.encode_many(batch.column(1))], ["doc_id", "ids"])


def _decoded(table: MergeTable, batches: Iterator[pa.RecordBatch], at_ids: int) -> Iterator[pa.RecordBatch]:
    """Batches with the column decoded added."""
    for whole in common.freeing(batches):
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts = []
            for ids in batch.column(at_ids):
                values = ids.values
                texts.append(table.decode(values.to_numpy(zero_copy_only=False).tolist()) if values is not None else "")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def _rows(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, T.StructType]:
    rows = common.small_batches(df).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the ids of each row's whole text, without begin or end ids."""
    rows, schema = _rows(df, id_col, text_col)
    return rows.mapInArrow(lambda batches: _encoded(table_of(model), batches), schema)


def decode(df: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """df with the column decoded (an existing one is replaced): the text of the ids; null ids give an empty text."""
    kept = [c for c in df.columns if c != "decoded"]
    rows = common.small_batches(df).select(*kept)
    at_ids = kept.index(ids_col)
    return rows.mapInArrow(lambda batches: _decoded(table_of(model), batches, at_ids), T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trip(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): decode(encode(df)) in one Python worker a task instead of two."""
    rows, schema = _rows(df, id_col, text_col)
    schema = T.StructType([*schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(lambda batches: _decoded(table_of(model), _encoded(table_of(model), batches), 1), schema)
