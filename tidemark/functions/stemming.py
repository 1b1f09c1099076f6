"""Suffix stripping for English and French words, as columns.

A language is a list of steps, a step a list of rules: where a word ends in a rule's suffix, the suffix is replaced if it
stands in a region of the word and what stands before it fits. Of several suffixes the longest counts; of several rules
with one suffix the first that fits. Each step is a column of its own, whose value later steps read.

Regions begin behind the first vowel and consonant (r1), behind the next such pair (r2), and, in French, behind the first vowel that
is not the first letter, the third letter, or a listed beginning (rv).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A suffix and what replaces it. span: how many letters at the end must lie in the region (the suffix, if 0)."""

    suffix: str
    put: str = ""
    region: str = ""
    before: str = ""
    unless: str = ""
    span: int = 0


@dataclass(frozen=True)
class Step:
    """inside: only suffixes that lie in their region compete for the longest."""

    rules: tuple[Rule, ...]
    inside: bool = False

    @cached_property
    def by_last(self) -> dict[str, list[tuple[str, list[Rule]]]]:
        """By a word's last letter, the suffixes that it may end in, the longest first, with their rules; the empty suffix under ""."""
        names = sorted({r.suffix for r in self.rules}, key=len, reverse=True)
        pairs = [(x, [r for r in self.rules if r.suffix == x]) for x in names]
        return {last: [p for p in pairs if p[0][-1:] in ("", last)] for last in {x[-1:] for x in names} | {""}}


def _rules(pairs: str, region: str = "", before: str = "") -> list[Rule]:
    """`a>b c` as the rules a to b and c to nothing."""
    return [Rule(a, b, region, before) for a, _, b in (x.partition(">") for x in pairs.split())]


def _step(*groups: Iterable[Rule], inside: bool = False) -> Step:
    return Step(tuple(r for g in groups for r in g), inside)


VOWELS = "aeiouy"
#: A short syllable at the end of what is before.
SHORT = r"(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
#: Fixed values of the published English stemmer: words of their own, words that stop after the first step, suffixes.
ENGLISH_WORDS = dict(x.split(">") for x in "skis>ski skies>sky dying>die lying>lie tying>tie idly>idl gently>gentl ugly>ugli early>earli only>onli singly>singl sky>sky news>news howe>howe atlas>atlas cosmos>cosmos bias>bias andes>andes".split())
ENGLISH_WHOLE = "inning outing canning herring earring proceed exceed succeed".split()
ENGLISH = (
    _step(_rules("sses>ss"), [Rule(s, p, before=b) for s in ("ied", "ies") for p, b in (("i", r"..$"), ("ie", ""))], _rules("us>us ss>ss"), [Rule("s", before=r"[aeiouy].+$")]),
    _step(_rules("eedly>ee eed>ee", "r1"), _rules("ingly edly ing ed", before=r"[aeiouy]")),
    _step(_rules("at>ate bl>ble iz>ize bb>b dd>d ff>f gg>g mm>m nn>n pp>p rr>r tt>t"), [Rule("", "e", "none", SHORT)]),
    _step(_rules("y>i Y>i", before=r"..*[^aeiouy]$")),
    _step(
        _rules("tional>tion enci>ence anci>ance abli>able entli>ent izer>ize ization>ize ational>ate ation>ate ator>ate alism>al aliti>al alli>al fulness>ful ousli>ous ousness>ous iveness>ive iviti>ive biliti>ble bli>ble fulli>ful lessli>less", "r1"),
        _rules("ogi>og", "r1", r"l$"),
        _rules("li", "r1", r"[cdeghkmnrt]$"),
    ),
    _step(_rules("tional>tion ational>ate alize>al icate>ic iciti>ic ical>ic ful ness", "r1"), _rules("ative", "r2")),
    _step(_rules("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize", "r2"), _rules("ion", "r2", r"[st]$")),
    _step([Rule("e", "", "r2"), Rule("e", "", "r1", unless=SHORT), Rule("l", "", "r2", r"l$")]),
)
FRENCH_VOWELS = "aeiouyâàëéêèïîôûù"
_FV, _NV = f"[{FRENCH_VOWELS}]", f"[^{FRENCH_VOWELS}]"


def _tails(stem: str, ends: str, rules: Iterable[tuple[str, str, str, int]]) -> list[Rule]:
    """For each end, rules (letters before the stem, replacement, region, 0 or how many of these letters may stand outside)."""
    return [Rule(f"{pre}{stem}{end}", put, region, span=len(pre + stem + end) - out) for end in ends.split(",") for pre, put, region, out in rules]


#: Fixed values of the published French stemmer: suffixes by step.
FRENCH = (
    _step(
        _rules("ance iqUe isme able iste eux ances iqUes ismes ables istes", "r2"),
        *(_tails(stem, ",s", [("ic", "", "r2", 0), ("ic", "iqU", "r2", 2), ("", "", "r2", 0)]) for stem in ("atrice", "ateur", "ation")),
        _rules("logie>log logies>log usion>u ution>u usions>u utions>u ence>ent ences>ent", "r2"),
        _tails(
            "ement",
            ",s",
            [("ativ", "", "r2", 0), ("ativ", "at", "r2", 2), ("ativ", "ativ", "rv", 4), ("iv", "", "r2", 0), ("iv", "iv", "rv", 2), ("eus", "", "r2", 0), ("eus", "eux", "r1", 0), ("eus", "eus", "rv", 3)]
            + [x for p in ("abl", "iqU") for x in ((p, "", "r2", 0), (p, p, "rv", 3))]
            + [x for p in ("ièr", "Ièr") for x in ((p, "i", "rv", 0), (p, p, "rv", 3))]
            + [("", "", "rv", 0)],
        ),
        _tails("ité", ",s", [("abil", "", "r2", 0), ("abil", "abl", "r2", 4), ("ic", "", "r2", 0), ("ic", "iqU", "r2", 2), ("iv", "", "r2", 0), ("iv", "iv", "r2", 2), ("", "", "r2", 0)]),
        *(_tails(stem, ",s", [("icat", "", "r2", 0), ("icat", "iqU", "r2", 2), ("icat", "icat", "r2", 4), ("at", "", "r2", 0), ("at", "at", "r2", 2), ("", "", "r2", 0)]) for stem in ("if", "ive")),
        _rules("eaux>eau"),
        _rules("aux>al", "r1"),
        [Rule(s, p, r) for s in ("euse", "euses") for p, r in (("", "r2"), ("eux", "r1"))],
        [Rule(s, "", "r1", _NV + "$") for s in ("issement", "issements")],
    ),
    _step(_rules("amment>ant emment>ent", "rv"), [Rule(s, "", "rv", _FV + "$", span=len(s) + 1) for s in ("ment", "ments")]),
    _step([Rule(s, "", "rv", _NV + "$") for s in "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()], inside=True),
    _step(
        [Rule("ions", "", "r2")],
        _rules("é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez", "rv"),
        [Rule(p + s, "", "rv") for s in "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split() for p in ("e", "")],
        inside=True,
    ),
    _step(_rules("Y>i ç>c")),
    _step([Rule("s", "", "", r"[^aiouès]$")]),
    _step([Rule("ion", "", "r2", r"[st]$", span=3)], _rules("ier>i ière>i Ier>i Ière>i e", "rv"), inside=True),
    _step(_rules("enn>en onn>on ett>et ell>el eill>eil")),
)
STEPS = {"english": ENGLISH, "french": FRENCH}


def _behind(word: Column, vowels: str, pairs: int) -> Column:
    """Letters up to the end of the pairs-th vowel followed by another letter; all, if there is none."""
    found = F.regexp_extract(word, "^" + f".*?[{vowels}][^{vowels}]" * pairs, 0)
    return F.when(found != "", F.length(found)).otherwise(F.length(word))


@dataclass
class _Chain:
    """Columns that build on each other, each in a projection of its own."""

    df: DataFrame
    names: list[str] = field(default_factory=list)

    def add(self, value: Column) -> Column:
        name = f"_stem{len(self.names)}"
        self.df = self.df.withColumn(name, value)
        self.names.append(name)
        return F.col(name)


def _applied(word: Column, step: Step, starts: dict[str, Column]) -> Column:
    """The word after one step; starts has the number of letters before each region."""
    n = F.length(word)
    names = sorted({r.suffix for r in step.rules}, key=len, reverse=True)
    area = F.substring(word, starts["rv"] + 1, n) if step.inside else word
    suffix = F.regexp_extract(area, f"({'|'.join(names)})$", 1)  # a search from the left finds the longest

    def text(x: str) -> str:
        return "'" + x + "'"

    def rule(r: Rule) -> str:
        return f"struct({text(r.put)} AS put, {text(r.region)} AS region, {text(r.before)} AS before, {text(r.unless)} AS unless, {r.span or len(r.suffix)} AS span)"

    table = F.expr("map(" + ", ".join(f"{text(name)}, array({', '.join(rule(r) for r in step.rules if r.suffix == name)})" for name in names) + ")")  # a constant

    def replaced(suffix: Column) -> Column:
        base = F.substring(word, F.lit(1), n - F.length(suffix))

        def fits(r: Column) -> Column:
            place = n - r["span"]
            region = F.when(r["region"] == "", True).when(r["region"] == "none", starts["r1"] >= n).when(r["region"] == "r1", place >= starts["r1"])
            region = region.when(r["region"] == "r2", place >= starts["r2"]).otherwise(place >= starts.get("rv", starts["r1"]))
            return region & ((r["before"] == "") | F.rlike(base, r["before"])) & ((r["unless"] == "") | ~F.rlike(base, r["unless"]))

        put = F.get(F.filter(F.try_element_at(table, suffix), fits), F.lit(0))["put"]
        return F.coalesce(F.concat(base, put), word)

    return F.get(F.transform(F.array(suffix), replaced), F.lit(0))


def stemmed(df: DataFrame, word: str, language: str, name: str = "stem") -> DataFrame:
    """df with the stem of its column of lower-case words; null stays null."""
    chain = _Chain(df)
    w = F.col(word)
    if language == "english":
        w = chain.add(F.regexp_replace(F.regexp_replace(w, "^y", "Y"), f"([{VOWELS}])y", "$1Y"))
        head = F.regexp_extract(w, "^(gener|commun|arsen)", 1)
        r1 = chain.add(F.when(head != "", F.length(head)).otherwise(_behind(w, VOWELS, 1)))
        starts = {"r1": r1, "r2": chain.add(r1 + _behind(F.substring(w, r1 + 1, F.length(w)), VOWELS, 1))}
        a = chain.add(_applied(w, ENGLISH[0], starts))
        b = chain.add(_applied(a, ENGLISH[1], starts))
        again = (a != b) & ~a.rlike("eed(ly)?$")
        c = chain.add(F.when(again, _applied(b, ENGLISH[2], starts)).otherwise(b))
        for step in ENGLISH[3:]:
            c = chain.add(_applied(c, step, starts))
        words = F.create_map(*(F.lit(x) for pair in ENGLISH_WORDS.items() for x in pair))
        out = F.when(F.length(word) <= 2, F.col(word)).when(F.col(word).isin(*ENGLISH_WORDS), F.try_element_at(words, F.col(word))).when(F.lower(a).isin(*ENGLISH_WHOLE), a).otherwise(c)
    else:
        w = chain.add(F.regexp_replace(w, "qu", "qU"))
        w = chain.add(F.regexp_replace(F.regexp_replace(w, f"({_FV})u(?={_FV})", "$1U"), f"({_FV})i(?={_FV})", "$1I"))
        w = chain.add(F.regexp_replace(F.regexp_replace(w, f"y(?={_FV})", "Y"), f"({_FV})y", "$1Y"))
        first = F.length(F.regexp_extract(w, f"^.[^{FRENCH_VOWELS}]*{_FV}", 0))
        rv = chain.add(F.when(w.rlike(f"^({_FV}{_FV}|par|col|tap)"), F.least(F.lit(3), F.length(w))).when(first > 0, first).otherwise(F.length(w)))
        starts = {"rv": rv, "r1": chain.add(_behind(w, FRENCH_VOWELS, 1)), "r2": chain.add(_behind(w, FRENCH_VOWELS, 2))}
        one = chain.add(_applied(w, FRENCH[0], starts))
        go = chain.add(F.when(one == w, _applied(one, FRENCH[1], starts)).otherwise(one))
        two = chain.add(F.when(one == w, _applied(go, FRENCH[2], starts)).otherwise(one))
        three = chain.add(F.when((one == w) & (two == go), _applied(go, FRENCH[3], starts)).otherwise(two))
        done = (one != w) | (three != go)
        left = chain.add(F.when(done, _applied(three, FRENCH[4], starts)).otherwise(_applied(three, FRENCH[5], starts)))
        rest = chain.add(F.when(done, left).otherwise(_applied(left, FRENCH[6], starts)))
        last = chain.add(_applied(rest, FRENCH[7], starts))
        out = F.regexp_replace(last, f"[éè]({_NV}+)$", "e$1")
    return chain.df.withColumn(name, F.lower(out)).drop(*chain.names)


@cache
def _found(pattern: str) -> Callable[[str], re.Match | None]:
    return re.compile(pattern).search


class _Starts(dict):
    """The regions of a word, each found when first asked for."""

    def __init__(self, word: str, language: str) -> None:
        super().__init__()
        self.word, self.language = word, language

    def __missing__(self, region: str) -> int:
        w, vowels = self.word, VOWELS if self.language == "english" else FRENCH_VOWELS
        if region == "rv":
            first = _found(f"^.{_NV}*{_FV}")(w)
            start = min(3, len(w)) if _found(f"^(?:{_FV}{_FV}|par|col|tap)")(w) else first.end() if first else len(w)
        elif region == "r1" and self.language == "english" and w.startswith(("gener", "commun", "arsen")):
            start = 6 if w.startswith("commun") else 5
        else:
            skipped = 0 if region == "r1" else self["r1"]
            found = _pairs(vowels)(w, skipped)
            start = found.end() if found else len(w)
        self[region] = start
        return start


@cache
def _pairs(vowels: str) -> Callable[..., re.Match | None]:
    return re.compile(f"[{vowels}][^{vowels}]").search


def _next(word: str, step: Step, starts: dict[str, int]) -> str:
    """One step for one word, as `_applied` has it for columns."""
    for suffix, rules in step.by_last.get(word[-1:], step.by_last[""]):
        if not word.endswith(suffix) or (step.inside and len(word) - len(suffix) < starts["rv"]):
            continue
        base = word[: len(word) - len(suffix)]
        for r in rules:
            start = 0 if not r.region else starts["r1"] if r.region == "none" else starts[r.region]
            placed = start >= len(word) if r.region == "none" else len(word) - (r.span or len(suffix)) >= start
            if placed and (not r.before or _found(r.before)(base)) and not (r.unless and _found(r.unless)(base)):
                return base + r.put
        return word
    return word


def stem(word: str, language: str) -> str:
    """The stem of a single word, for words that are met one by one in a task or a query; "simple" gives the word."""
    if language == "english":
        if len(word) <= 2 or word in ENGLISH_WORDS:
            return ENGLISH_WORDS.get(word, word)
        w = re.sub(f"([{VOWELS}])y", r"\1Y", re.sub("^y", "Y", word)) if "y" in word else word
        starts = _Starts(w, language)
        first = _next(w, ENGLISH[0], starts)
        if first.lower() in ENGLISH_WHOLE:
            return first.lower()
        w = _next(first, ENGLISH[1], starts)
        if w != first and not first.endswith(("eed", "eedly")):
            w = _next(w, ENGLISH[2], starts)
        for step in ENGLISH[3:]:
            w = _next(w, step, starts)
        return w.lower()
    if language == "french":
        w = word.replace("qu", "qU")
        for letter, capital in (("u", "U"), ("i", "I")):
            if letter in w:
                w = re.sub(f"({_FV}){letter}(?={_FV})", rf"\1{capital}", w)
        if "y" in w:
            w = re.sub(f"({_FV})y", r"\1Y", re.sub(f"y(?={_FV})", "Y", w))
        starts = _Starts(w, language)
        one = _next(w, FRENCH[0], starts)
        done = one != w
        if not done:
            one = _next(one, FRENCH[1], starts)
            for step in (2, 3):
                then = _next(one, FRENCH[step], starts)
                if then != one:
                    one, done = then, True
                    break
        one = _next(one, FRENCH[4], starts) if done else _next(_next(one, FRENCH[5], starts), FRENCH[6], starts)
        last = _next(one, FRENCH[7], starts)
        return (last if last.isascii() else re.sub(f"[éè]({_NV}+)$", r"e\1", last)).lower()
    return word
