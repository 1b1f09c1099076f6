"""Ranked full text: weighted tokens with positions, a positional index, and ranks by covers.

Fields are read in sections, one for each language of the field: the folded words of the field, without the language's
stop words, as stems ("simple" keeps words as they are). Positions count stop words too and go on from section to section, so that
no two sections overlap. The index has a row for each token and document with the token's positions and weights.

A query is read in every language too. Each reading of each alternative (`or`) is a set of tokens that a document must have;
"quoted words" must stand next to each other, and words after a minus must be absent. A cover is a shortest stretch
of positions that holds all tokens of some reading; it counts the mean weight of its tokens' positions by the share of
positions in it that are no tokens of the query. A document's rank is the sum of its covers, divided by the logarithm of its length.

Windows run over one document's hits, rows of the query's own tokens.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stemming
from tidemark.operators import search

#: What a position counts by its field's weight.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
#: Words without weight of their own.
STOP_WORDS = {
    "english": """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
        them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did
        doing a an the and but if or because as until while of at by for with about against between into through during before after above below
        to from up down in out on off over under again further then once here there when where why how all any both each few more most other some
        such no nor not only own same so than too very s t can will just don should now""".split(),
    "french": """au aux avec ce ces dans de des du elle en et eux il je la le leur lui ma mais me mes moi mon ne nos notre nous on ou par pas pour qu que
        qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l m n s t y suis es est sommes sont serai seras sera serons serez
        seront serais serait serions seriez seraient fus fut furent sois soit soyons soyez soient fusse fusses fussions fussiez fussent ayant eu
        eue eues eus ai as avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez
        avaient eut eurent aie aies ait ayons ayez aient eusse eusses eussions eussiez eussent""".split(),
    "simple": [],
}
LANGUAGES = ("english", "french", "simple")


@dataclass(frozen=True)
class Field:
    """A text column, its weight, and the languages it is read in."""

    column: str
    weight: str
    languages: tuple[str, ...] = LANGUAGES


#: Letters of words before they are folded.
LETTERS = re.compile(f"[a-z0-9{search.ACCENTED}œæß]+")
#: Different words whose tokens a task keeps, and as many of before them; documents, and bytes of their texts, that a task reads side by side.
KEPT, PIECE, PIECE_BYTES = 250_000, 500, 4_000_000


class _Tokens(dict):
    """Unfolded words with their tokens in a language, None for stop words; each word is folded and stemmed when first met.

    A stem begins with its word's first letter: of words with another one than `begun` the token is left empty (None: of no word).
    """

    def __init__(self, language: str, begun: frozenset[str] | None = None) -> None:
        super().__init__()
        self.language, self.begun, self.stop, self.before = language, begun, frozenset(STOP_WORDS[language]), {}

    def __missing__(self, word: str) -> str | None:
        if word in self.before:
            token = self.before[word]
        else:
            folded = word if word.isascii() else search.fold_text(word)
            token = None if folded in self.stop else "" if self.begun is not None and folded[0] not in self.begun else stemming.stem(folded, self.language)
        self[word] = token
        return token

    def trim(self) -> None:
        if len(self) > KEPT:
            self.before = dict(self)
            self.clear()


#: By language and first letters, the tokens that a Python worker has met; it keeps them from task to task.
_MET: dict[tuple[str, frozenset[str] | None], _Tokens] = {}


@dataclass
class _Places:
    """The kept words of some documents, by document, token and position: parallel arrays; field is a field's number."""

    row: np.ndarray
    token: np.ndarray
    pos: np.ndarray
    field: np.ndarray
    vocabulary: pa.Array
    lengths: np.ndarray

    def groups(self) -> np.ndarray:
        """Where the places of each document's tokens begin, and the end."""
        new = (np.diff(self.row) != 0) | (np.diff(self.token) != 0)
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(self.row)]]) if len(self.row) else np.zeros(1, np.int64)


def _read(batch: pa.RecordBatch, fields: list[Field], only: frozenset[str] | None = None) -> _Places:
    """The places of a batch's documents: a key, then the fields' texts. only: the tokens that are wanted, all if None."""
    n, words, ids, parts = batch.num_rows, {}, {}, []
    begun = None if only is None else frozenset(t[:1] for t in only)
    lengths, shift = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, field in enumerate(fields):
        found = [LETTERS.findall((text or "").lower()) for text in batch.column(k + 1).to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, n)
        codes = np.fromiter((words.setdefault(w, len(words)) for each in found for w in each), np.int64, sizes.sum())
        row = np.repeat(np.arange(n), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        for language in field.languages:
            if (language, begun) not in _MET and len(_MET) >= 2 * len(LANGUAGES):
                _MET.clear()  # of earlier searches
            met = _MET.setdefault((language, begun), _Tokens(language, begun))
            met.trim()
            tokens = np.fromiter((-1 if t is None else ids.setdefault(t, len(ids)) for t in map(met.__getitem__, words)), np.int64, len(words))[codes]
            kept = np.flatnonzero(tokens >= 0)
            lengths += np.bincount(row[kept], minlength=n)
            parts.append((row[kept], tokens[kept], (at + shift[row])[kept], np.full(len(kept), k)))
            last = np.zeros(n, np.int64)
            np.maximum.at(last, row[kept], at[kept])
            shift += last  # each section starts behind the last kept word of those before it
    row, token, pos, number = (np.concatenate(x) for x in zip(*parts))
    names = list(ids)
    if only is not None:
        chosen = np.fromiter((t in only for t in names), bool, len(names))[token]
        row, token, pos, number = (x[chosen] for x in (row, token, pos, number))
    vocabulary = pa.array(names, pa.string())
    order = pc.array_sort_indices(pc.binary_join_element_wise(vocabulary, ":", ""))  # as entries of a vector are sorted
    place = np.empty(len(names), np.int64)
    place[order.to_numpy()] = np.arange(len(names))
    token = place[token]
    sort = np.argsort(row * max(1, len(names)) + token, kind="stable")  # positions rise already
    return _Places(row[sort], token[sort], pos[sort], number[sort], vocabulary.take(order), lengths)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most PIECE documents and about PIECE_BYTES of texts; a larger text comes alone."""
    for batch in batches:
        size = sum(np.nan_to_num(pc.binary_length(c).to_numpy(zero_copy_only=False).astype(float)) for c in batch.columns[1:])
        begin, held = 0, 0.0
        for k, x in enumerate(size):
            if k > begin and (k - begin >= PIECE or held + x > PIECE_BYTES):
                yield batch.slice(begin, k - begin)
                begin, held = k, 0.0
            held += x
        if begin < batch.num_rows:
            yield batch.slice(begin)


def _texts(docs: DataFrame, key: str, fields: list[Field]) -> DataFrame:
    return docs.select(key, *(F.col(f.column).cast("string").alias(f"_text{k}") for k, f in enumerate(fields)))


def index(docs: DataFrame, key: str, fields: list[Field], only: Collection[str] | None = None) -> DataFrame:
    """(token, key, length, places): the positional index; a caller stores it partitioned or sorted by token. No two documents share a key.

    Each document is read whole inside a task, so that its words are not shuffled. only: the tokens that are wanted, all if None; a
    document's length counts all its kept words.
    """
    wanted, letters = None if only is None else frozenset(only), pa.array([f.weight for f in fields], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            p = _read(batch, fields, wanted)
            ends = p.groups()
            rows = p.row[ends[:-1]]
            places = pa.StructArray.from_arrays([pa.array(p.pos, pa.int32()), letters.take(pa.array(p.field))], ["pos", "weight"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)
            yield pa.RecordBatch.from_arrays([p.vocabulary.take(pa.array(p.token[ends[:-1]])), batch.column(0).take(pa.array(rows)), pa.array(p.lengths[rows], pa.int32()), lists], ["token", key, "length", "places"])

    texts = _texts(docs, key, fields)
    none = F.array().cast("array<struct<pos:int,weight:string>>")
    return texts.mapInArrow(run, texts.select(F.lit("").alias("token"), key, F.lit(0).alias("length"), none.alias("places")).schema)


def vectors(docs: DataFrame, key: str, fields: list[Field]) -> DataFrame:
    """(key, n_tokens, n_places, vector): each document's tokens in order, `token:1A,7C`; documents without tokens have none."""
    letters = pa.array([f.weight for f in fields], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            p = _read(batch, fields)
            ends = p.groups()
            spots = pc.binary_join_element_wise(pa.array(p.pos).cast(pa.string()), letters.take(pa.array(p.field)), "")
            lists = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spots), ",")
            entries = pc.binary_join_element_wise(p.vocabulary.take(pa.array(p.token[ends[:-1]])), lists, ":")
            rows, sizes = np.unique(p.row[ends[:-1]], return_counts=True)
            said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), entries), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sizes, pa.int64()), pa.array(p.lengths[rows], pa.int64()), said], [key, "n_tokens", "n_places", "vector"])

    texts = _texts(docs, key, fields)
    zero = F.lit(0).cast("long")
    return texts.mapInArrow(run, texts.select(key, zero.alias("n_tokens"), zero.alias("n_places"), F.lit("").alias("vector")).schema)


@dataclass(frozen=True)
class Slot:
    """A word of a reading: it must be there, or must not; words of one phrase have their distances from its first word."""

    reading: int
    slot: int
    word: str
    language: str
    absent: bool = False
    phrase: int = -1
    distance: int = 0


def readings(query: str) -> list[Slot]:
    """The slots of a query in every language; readings without a wanted word are left out."""
    alternatives: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, quoted, plain in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query):
        if not quoted and plain.lower() == "or":
            alternatives.append([])
        else:
            words = [w for w in re.split("[^a-z0-9]+", search.fold_text(quoted or plain.lstrip("-"))) if w]
            alternatives[-1].append((bool(minus) or plain.startswith("-"), words))
    out: list[Slot] = []
    for terms in alternatives:
        for language in LANGUAGES:
            number, slots = len({s.reading for s in out}), []
            for phrase, (absent, words) in enumerate(terms):
                kept = [(n, w) for n, w in enumerate(words) if w not in STOP_WORDS[language]]
                slots += [Slot(number, len(slots) + k, w, language, absent, phrase if len(kept) > 1 else -1, n - kept[0][0]) for k, (n, w) in enumerate(kept)]
            if any(not s.absent for s in slots):
                out += slots
    return out


def asked(query: str) -> set[str]:
    """The tokens that ranks() of a query reads."""
    return {stemming.stem(s.word, s.language) for s in readings(query)}


def ranks(postings: DataFrame, key: str, query: str) -> DataFrame:
    """(key, rank) of the documents that match the query, from the index (token, key, length, places)."""
    slots = readings(query)
    if not slots:
        return postings.select(key, F.lit(0.0).alias("rank")).limit(0)
    marks: dict[str, set[int]] = {}
    for s in slots:
        marks.setdefault(stemming.stem(s.word, s.language), set()).add(100 * s.reading + s.slot)
    table = F.create_map(*(x for token, each in marks.items() for x in (F.lit(token), F.array(*map(F.lit, sorted(each))))))
    asked = postings.where(F.col("token").isin(*marks))  # reaches the index, where it is stored by token
    hits = asked.select(key, "length", F.element_at(table, F.col("token")).alias("marks"), F.inline("places"))
    hits = hits.groupBy(key, "length", "pos").agg(F.array_distinct(F.flatten(F.collect_list("marks"))).alias("marks"), F.max(_weight(F.col("weight"))).alias("weight"))
    whole, so_far = Window.partitionBy(key), Window.partitionBy(key).orderBy("pos")
    last, bad, phrases = {}, {}, {}
    for s in slots:
        mark = 100 * s.reading + s.slot
        if s.absent and s.phrase < 0:
            bad.setdefault(s.reading, []).append(F.max(F.array_contains("marks", mark)).over(whole))
        elif not s.absent:
            last.setdefault(s.reading, []).append(F.max(F.when(F.array_contains("marks", mark), F.col("pos"))).over(so_far))
        if s.phrase >= 0:
            phrases.setdefault((s.reading, s.phrase, s.absent), []).append(s)
    rows = hits
    for n, ((reading, _, absent), words) in enumerate(phrases.items()):  # the query's own phrases
        steps = F.array(*(F.struct(F.lit(100 * s.reading + s.slot).alias("mark"), F.lit(s.distance).alias("distance")) for s in words))
        begun = hits.select(key, "pos", F.explode(F.filter(steps, lambda x: F.array_contains("marks", x["mark"]))).alias("step"))
        found = begun.groupBy(key, (F.col("pos") - F.col("step.distance")).alias("at")).agg(F.count_distinct("step.mark").alias("n")).where(F.col("n") == len(words))
        rows = rows.join(found.select(key, F.lit(True).alias(f"_phrase{n}")).distinct(), key, "left")
        there = F.coalesce(F.col(f"_phrase{n}"), F.lit(False))
        bad.setdefault(reading, []).append(there if absent else ~there)
    starts = []
    for reading, each in last.items():
        complete = F.lit(True)
        for x in each:
            complete = complete & x.isNotNull()
        for x in bad.get(reading, []):
            complete = complete & ~x
        starts.append(F.when(complete, F.least(*each) if len(each) > 1 else each[0]))
    inverse = 1 / F.col("weight")
    rows = rows.select(
        key, "length", "pos", "weight", (F.greatest(*starts) if len(starts) > 1 else starts[0]).alias("start"),
        F.row_number().over(so_far).alias("n"), F.sum(inverse).over(so_far).alias("inverse"),
    )
    before = F.lag("start").over(so_far)
    covers = rows.withColumn("_before", before).where(F.col("start").isNotNull() & (F.col("_before").isNull() | (F.col("start") > F.col("_before"))))
    first = rows.select(key, F.col("pos").alias("start"), F.col("n").alias("n_first"), (F.col("inverse") - 1 / F.col("weight")).alias("inverse_first"))
    covers = covers.join(first, [key, "start"])
    n, sums = F.col("n") - F.col("n_first") + 1, F.col("inverse") - F.col("inverse_first")
    noise = F.col("pos") - F.col("start") - n + 1
    return covers.groupBy(key).agg((F.sum(n / sums / (1 + noise)) / F.ln(F.max("length") + 1.0)).alias("rank"))


def _weight(letter: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))
    return F.element_at(table, letter)
