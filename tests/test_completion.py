"""A word still being typed finishes a name only where one name could be meant."""

from tidemark.operators import readings


def test_only_one_name_is_finished(spark):
    names = ["paris", "paris saint germain", "parma", "new york", "new york times", "small smart", "rome"]
    lexicon = spark.createDataFrame([(n, n.split()) for n in names], "name string, words array<string>")
    typed = {
        1: "par",  # two names begin so
        2: "pari",
        3: "in rom",
        4: "new yo",
        5: "new york ti",  # "new york" is whole, and takes its words
        6: "smal sm",
        7: "rome ro",  # taken, and nothing else
        8: "york new",
        9: "paris saint ger",
        10: "zzz",
    }
    rows = spark.createDataFrame([(k, t.split(), t.split()[-1]) for k, t in typed.items()], "key int, words array<string>, partial string")
    got = {}
    for r in readings.completed_names(rows, lexicon, "key").collect():
        got.setdefault(r["key"], set()).add(r["name"])
    assert got == {2: {"paris"}, 3: {"rome"}, 4: {"new york"}, 5: {"new york"}, 6: {"small smart"}, 7: {"rome"}, 8: {"new york"}, 9: {"paris"}}
    assert readings.completed_names(rows.limit(0), lexicon, "key").count() == 0
