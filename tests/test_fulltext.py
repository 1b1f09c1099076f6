"""Stems against published pairs; ranks by covers against plain loops."""

import math
import random

import pytest

from tidemark.functions import stemming
from tidemark.operators import fulltext

#: From the published lists of the two stemmers: word>stem.
ENGLISH = """consign consigned>consign consigning>consign consignment>consign consistency>consist consistently>consist consolation>consol consolatory>consolatori
    consolidating>consolid consolingly>consol consonant>conson conspicuously>conspicu conspiracy>conspiraci conspirators>conspir constables>constabl constancy>constanc
    knackeries>knackeri knavish kneaded>knead knees>knee knitted>knit knives>knive knockers>knocker skies>sky dying>die hopping>hop hoping>hope agreed>agre ties>tie
    cries>cri gas this kiwis>kiwi generously>generous communism succeeding>succeed luxuriated>luxuri happy>happi say by youth relational>relat rational>ration
    vietnamization>vietnam operator>oper feudalism>feudal decisiveness>decis hopefulness>hope formalize>formal electricity>electr adoption>adopt homologous>homolog probate>probat news"""
FRENCH = """continu continuait>continu continuation>continu continuellement>continuel continuité>continu continuons>continuon contorsions>contors contournant>contourn
    contractée>contract contradictoirement>contradictoir contraindre>contraindr contraires>contrair contrariait>contrari contrarié>contrari maintenaient>mainten maintenue>maintenu
    mairie>mair maisons>maison maître>maîtr maîtresse>maîtress majesté>majest majestueuse>majestu majestueusement>majestu majestueux>majestu majeure>majeur majorité>major
    malades>malad maladive>malad constamment>const évidemment>évident rapidement>rapid journaux>journal bateaux>bateau finissait>fin"""


@pytest.mark.parametrize(("language", "text"), [("english", ENGLISH), ("french", FRENCH)])
def test_stems_are_the_published_ones(spark, language, text):
    pairs = [(a, b or a) for a, _, b in (x.partition(">") for x in text.split())]
    rows = stemming.stemmed(spark.createDataFrame([*pairs, (None, None)], "word string, want string"), "word", language).collect()
    assert [(r["word"], r["stem"]) for r in rows] == [*pairs, (None, None)]
    assert [stemming.stem(a, language) for a, _ in pairs] == [b for _, b in pairs]


@pytest.mark.parametrize("language", ["english", "french"])
def test_single_stems_are_those_of_columns(spark, language):
    rng = random.Random(7)
    parts = "a e i o u y b c d t s st ss ing ed ly ly ation ateur ement iv eus ité é è qu ou ie ier ions eux aux able ment isse ent".split()
    words = sorted({"".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(3000)})
    rows = stemming.stemmed(spark.createDataFrame([(w,) for w in words], "word string"), "word", language).collect()
    assert [r["stem"] for r in rows] == [stemming.stem(r["word"], language) for r in rows]


FIELDS = [fulltext.Field("title", "A", ("simple",)), fulltext.Field("body", "C", ("simple",))]


def plain_rank(doc, readings, absent):
    """Covers by trying every stretch: readings are sets of words, absent words that no document may have."""
    spots, last = [], 0
    for words, weight in ((doc[1] or "").split(), 1.0), ((doc[2] or "").split(), 0.2):
        spots += [(last + n, w, weight) for n, w in enumerate(words, 1)]
        last += len(words)
    if any(w in absent for _, w, _ in spots):
        return None
    hits = [s for s in spots if any(s[1] in r for r in readings)]
    full = [(a[0], b[0]) for a in hits for b in hits if a[0] <= b[0] and any(r <= {w for p, w, _ in hits if a[0] <= p <= b[0]} for r in readings)]
    total = 0.0
    for low, high in full:
        if not any((x, y) != (low, high) and low <= x and y <= high for x, y in full):
            inside = [w for p, _, w in hits if low <= p <= high]
            total += len(inside) / sum(1 / w for w in inside) / (1 + high - low + 1 - len(inside))
    return total / math.log(len(spots) + 1) if full else None


def test_ranks_equal_every_stretch_tried(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "LANGUAGES", ("simple",))
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choices("ab cd ef gh xy".split(), k=rng.randint(0, 4))), " ".join(rng.choices("ab cd ef gh zz qq".split(), k=rng.randint(0, 25)))) for k in range(80)]
    docs += [(80, None, None), (81, "ab", None)]
    postings = fulltext.index(spark.createDataFrame(docs, "id long, title string, body string"), "id", FIELDS).cache()
    for query, readings, absent in (("ab cd", [{"ab", "cd"}], ()), ("ab", [{"ab"}], ()), ("AB -xy cd", [{"ab", "cd"}], ("xy",)), ("ab ef or gh", [{"ab", "ef"}, {"gh"}], ()), ("nothing here", [{"nothing", "here"}], ())):
        got = {r["id"]: r["rank"] for r in fulltext.ranks(postings, "id", query).collect()}
        want = {d[0]: x for d in docs if (x := plain_rank(d, readings, absent)) is not None}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want), query
    assert fulltext.ranks(postings, "id", " -ab ").collect() == []


def test_phrases_and_languages(spark):
    docs = [(1, "The licenses of the apache", ""), (2, "Apache licensed", "versions of it"), (3, "Un musée des batteries", ""), (4, "musee", "battery"), (5, "", "")]
    postings = fulltext.index(spark.createDataFrame(docs, "id long, title string, body string"), "id", [fulltext.Field("title", "A"), fulltext.Field("body", "C")])
    found = lambda q: {r["id"] for r in fulltext.ranks(postings, "id", q).collect()}
    assert found("license apache") == {1, 2} and found('"apache license"') == {2} and found('apache -"apache licensed"') == {1}
    assert found('"licenses of the apache"') == {1} and found("batteries musees") == {3, 4} and found("the of") == {1}
    row = fulltext.vectors(spark.createDataFrame(docs, "id long, title string, body string"), "id", FIELDS).where("id = 4").first()
    assert row["vector"] == "battery:2C musee:1A" and (row["n_tokens"], row["n_places"]) == (2, 2)
