"""Longer names and beams over trees against plain loops."""

import math
import random
import re

from pyspark.sql import functions as F

from tidemark.operators import names, readings


def words(surface):
    plain = re.sub(r"'s\b", "", surface.lower().replace("’", "'"))
    return [w for w in re.split(r"[^\w]+", plain) if w]


def test_words_of_names(spark):
    said = ["Sean O’Kane", "Lloyd's of London", "  ", "Élysée-Montmartre", "it's Sam's"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert [r["w"] for r in df.select(names.name_words(F.col("s")).alias("w")).collect()] == [words(s) for s in said]


def test_longer_names_are_the_nearest(spark):
    dice = random.Random(5)
    vocabulary = ["rare" + str(k) for k in range(12)] + ["the"] * 8 + ["of"] * 4
    surfaces = {" ".join(dice.choice(vocabulary) for _ in range(dice.randint(1, 5))) for _ in range(300)}
    surfaces |= {s.title() for s in sorted(surfaces)[:60]} | {"", "..."}
    df = spark.createDataFrame([(s,) for s in [*surfaces, *surfaces, None]], "surface string")
    split = {s: words(s) for s in surfaces if words(s)}
    expected = set()
    for a, x in split.items():
        held = [(len(y), b) for b, y in split.items() if (len(y) > len(x) and any(y[k : k + len(x)] == x for k in range(len(y)))) or (y == x and b > a)]
        expected |= {(a, b, n) for n, (_, b) in enumerate(sorted(held), 1)}
    got = lambda most: {tuple(r) for r in names.longer_names(df, most).collect()}
    assert got(4) == {r for r in expected if r[2] <= 4} and got(None) == expected
    assert any(r[2] > 4 for r in expected)


def test_beam_asks_what_it_reaches(spark):
    tree = {"": ["a", "b", "c", "d"], "a": ["a1", "a2"], "b": ["b1"], "c": ["c1", "c2", "c3"], "b1": ["b11", "b12"]}
    p = lambda link, node: ((link * 7 + sum(map(ord, node)) * 13) % 97 + 1) / 98
    table = spark.createDataFrame([(k, n) for k, ns in tree.items() for n in ns], "parent string, node string")
    links = spark.createDataFrame([(k,) for k in range(40)], "id long")
    points = lambda node: F.aggregate(F.transform(F.split(node, ""), lambda c: F.ascii(c)), F.lit(0), lambda t, x: t + x)
    answer = lambda link, node: ((link * 7 + points(node) * 13) % 97 + 1) / 98.0
    got = {(r["id"], r["node"]): r["score"] for r in readings.beam_over_tree(links, table, "id", 3, answer).collect()}
    expected = {}
    for link in range(40):
        beam = [("", 0.0, 0)]
        score = lambda s: math.exp(s[1] / s[2]) if s[2] else 1.0
        for _ in range(3):
            grown = []
            for node, logs, n in beam:
                below = tree.get(node, [])
                if not below:
                    grown.append((node, logs, n))
                elif len(below) == 1 and node:
                    grown.append((below[0], logs, n))
                else:
                    grown += [(c, logs + math.log(p(link, c)), n + 1) for c in below]
            beam = sorted(grown, key=lambda s: (-score(s), s[0]))[:3]
        for s in [s for s in beam if score(s) >= 0.5][:3]:
            expected[link, s[0]] = round(score(s), 3)
    assert got == expected


def test_scores_of_names(spark):
    dice = random.Random(7)
    some = lambda n: [(g, [dice.choice("abcd") for _ in range(dice.randint(0, 3))]) for g in "xyz" for _ in range(n)]
    gold, got = some(12), [r for r in some(10) if r[0] != "z"]
    frame = lambda rows: spark.createDataFrame(rows, "g string, words array<string>")
    sides = lambda rows, g: {tuple(w) for k, w in rows if k == g}
    holds = lambda y, x: x != () and any(y[k : k + len(x)] == x for k in range(len(y)))
    near = lambda x, y: holds(y, x) or holds(x, y)
    expected = {(g, len(a := sides(gold, g)), len(a & (b := sides(got, g))), sum(any(near(x, y) for y in b) for x in a), sum(any(near(x, y) for x in a) for y in b)) for g in "xyz"}
    assert {tuple(r) for r in names.scores(frame(gold), frame(got), "g").collect()} == expected


def test_few_rows_as_lists(spark):
    from tidemark.operators import few

    rows, table = spark.range(50), spark.createDataFrame([(k, str(k)) for k in range(23)], "k int, s string")
    for most in (23, 22, 5, 1):
        met = few.with_lists(rows, table, "list", most).select("id", F.inline("list"))
        assert met.count() == 50 * 23 and met.distinct().count() == 50 * 23
    assert few.with_lists(rows, table.limit(0), "list").select(F.size("list")).distinct().collect()[0][0] == 0
