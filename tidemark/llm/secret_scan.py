"""Secret scans through a trigram index.

Each rule's regular expression gives a Boolean query over trigrams that every match must hold.
Each Arrow batch of documents is a segment of the index: its postings (trigram -> rows) are built
over the bytes, the queries intersect and unite them, and only the rows left are searched with the
expression itself. Rules without a mandatory trigram search every row. Segments need no shuffle, so
a source or a text that is very common costs no more than others.

Texts: null counts as empty, an empty text has no spans; repeated rows each give a row; an empty
table gives an empty one. Of matches of one rule that overlap, the leftmost holds; spans of
different rules may overlap and are ordered by start, then by the rules' order. Columns other than the id and the
text are left out, whatever their names.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Strings that one part of an expression may stand for, at most, to be spelled out.
SPELLED = 64
#: Documents in one segment of the index.
SEGMENT = 512


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression, and how many characters a group of it needs."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 1

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        for m in self.regex.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.span()


#: Fixed values of the contract: the base rules in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]+", re.A, least=20),
    Rule("hex", r"[0-9a-f]{24,}", re.A, least=24),
)
#: Further kinds with a public fixed prefix or frame.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----", re.A),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", re.A),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", re.A),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", re.A),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", re.A),
)

# A query is True (any row), a trigram's code, or ("and" | "or", queries).


def _fold(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def _code(a: int, b: int, c: int) -> int:
    return a << 16 | b << 8 | c


def _join(kind: str, parts: Sequence) -> object:
    flat = list(dict.fromkeys(p for p in parts if p is not True))
    if kind == "or" and len(flat) < len(parts) or not flat:
        return True
    return flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _spelled(strings: set[str]) -> object:
    """The query of a part that is one of some strings."""

    def one(text: str) -> object:
        b = text.encode("utf-8")
        return _join("and", [_code(*b[i : i + 3]) for i in range(len(b) - 2)])

    return _join("or", [one(s) for s in sorted(strings)])


def trigram_query(pattern: str, flags: int = 0) -> object:
    """The Boolean query that holds for every text with a match, over ASCII-folded bytes."""
    parsed = rp.parse(pattern, flags)
    return _part(list(parsed), parsed.state.flags)[1]


def _part(nodes: list, flags: int) -> tuple[set[str] | None, object]:
    """The strings that a sequence stands for (None: too many or unknown), and its query."""
    query, run, exact = [], {""}, True
    for node in nodes:
        strings, more = _node(node, flags)
        if strings is not None and len(run) * len(strings) <= SPELLED:
            run = {a + b for a in run for b in strings}
            continue
        query.append(_spelled(run))
        exact, run = False, {""}
        if strings is None:
            query.append(more)
        else:
            run = strings
    query.append(_spelled(run))
    return (run if exact else None), _join("and", query)


def _node(node: tuple, flags: int) -> tuple[set[str] | None, object]:
    op, value = node
    if op is rc.LITERAL:
        c = chr(value)
        if flags & re.I and (not c.isascii() or (not flags & re.A and c in "kKsS")):
            return None, True  # other characters fold to it
        return {_fold(c)}, True
    if op is rc.IN:
        if all(o is rc.LITERAL for o, _ in value):
            each = [_node(x, flags)[0] for x in value]
            if all(x is not None for x in each):
                return set().union(*each), True
        if all(o is rc.LITERAL or (o is rc.RANGE and v[1] - v[0] < SPELLED) for o, v in value) and not flags & re.I:
            chars = {_fold(chr(c)) for o, v in value for c in (range(v[0], v[1] + 1) if o is rc.RANGE else [v])}
            return (chars if len(chars) <= 8 else None), True
        return None, True
    if op is rc.SUBPATTERN:
        return _part(list(value[3]), (flags | value[1]) & ~value[2])
    if op is rc.BRANCH:
        parts = [_part(list(x), flags) for x in value[1]]
        if all(s is not None for s, _ in parts) and len(strings := set().union(*(s for s, _ in parts))) <= SPELLED:
            return strings, True
        return None, _join("or", [_spelled(s) if s is not None else q for s, q in parts])
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _part(list(inner), flags)
        if strings is not None and most <= 4 and len(strings) ** most <= SPELLED:
            out, power = set(), {""}
            for n in range(most + 1):
                out |= power if n >= least else set()
                power = {a + b for a in power for b in strings}
            return out, True
        return None, (True if not least else _spelled(strings) if strings is not None else query)
    if op is rc.AT or op in (rc.ASSERT, rc.ASSERT_NOT):
        return {""}, True
    return None, True


def trigrams_of(query: object) -> set[int]:
    if query is True:
        return set()
    return {query} if isinstance(query, int) else set().union(*map(trigrams_of, query[1]))


class Segment:
    """The postings of one run of documents for the trigrams that queries name."""

    def __init__(self, texts: pa.StringArray, index: TrigramIndex):
        self.rows = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + self.rows + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = (offsets - offsets[0]).astype(np.int64)
        low = index.fold[data].astype(np.uint32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        hits = np.flatnonzero(index.slot[codes] >= 0)
        row = np.searchsorted(offsets, hits, "right") - 1
        inside = hits + 2 < offsets[row + 1]
        pairs = np.unique(index.slot[codes[hits[inside]]].astype(np.int64) * self.rows + row[inside])
        slot, self.row = pairs // max(1, self.rows), pairs % max(1, self.rows)
        self.starts = np.searchsorted(slot, np.arange(len(index.trigrams) + 1))
        self.index = index

    def posting(self, code: int) -> np.ndarray:
        k = self.index.slot[code]
        return self.row[self.starts[k] : self.starts[k + 1]]

    def candidates(self, query: object) -> np.ndarray:
        """Sorted rows that satisfy a query."""
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, int):
            return self.posting(query)
        kind, parts = query
        found = None
        for rows in sorted(map(self.candidates, parts), key=len):
            found = rows if found is None else np.intersect1d(found, rows, True) if kind == "and" else np.union1d(found, rows)
        return found


class TrigramIndex:
    """The rules' queries and a table that knows their trigrams."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern, r.flags) for r in rules]
        self.trigrams = sorted(set().union(*map(trigrams_of, self.queries)))
        self.slot = np.full(1 << 24, -1, np.int16 if len(self.trigrams) < 32_000 else np.int32)
        self.slot[self.trigrams] = np.arange(len(self.trigrams))
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[ord("A") : ord("Z") + 1] += 32

    def spans(self, texts: pa.StringArray) -> list[list[tuple[int, int, int]]]:
        """For each text its spans as (start, rule, end), sorted."""
        segment = Segment(texts, self)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        plain = texts.to_pylist()
        for k, (rule, query) in enumerate(zip(self.rules, self.queries)):
            for row in segment.candidates(query).tolist():
                found[row] += [(start, k, end) for start, end in rule.spans(plain[row])]
        for spans in found:
            spans.sort()
        return found


_indexes: dict[tuple, TrigramIndex] = {}


def scan(df: DataFrame, rules: Sequence[Rule] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): for each row the secrets as structs (kind, start, end) in code points."""
    rows = common.small_batches(df).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rules = tuple(rules)
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _indexes.get(rules) or _indexes.setdefault(rules, TrigramIndex(rules))
        for whole in common.freeing(batches):
            for at in range(0, whole.num_rows, SEGMENT):
                batch = whole.slice(at, SEGMENT)
                spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in index.spans(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
