"""Arguments by declared fields: values, defaults, messages and the schema that is shown."""

import json

import pytest

from pyspark.sql import functions as F

from tidemark.functions import arguments as a

FIELDS = {
    "limit": a.integer(1, 50, default=20),
    "p": a.optional(a.number(above=0, maximum=1)),
    "name": a.string(most=5),
    "sort": a.one_of(["new", "old"], default="new"),
    "tags": a.optional(a.array(a.string(least=2), 1, 2)),
    "deep": a.optional(a.record({"on": a.boolean(), "id": a.optional(a.uuid())})),
}


def read(spark, *texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    value, error = a.parsed(F.col("t"), FIELDS)
    return df.select("n", value.alias("v"), error.alias("e")).orderBy("n").collect()


def test_values_and_defaults(spark):
    full = {"limit": 3, "p": 0.5, "name": " ab ", "sort": "old", "tags": ["xx", " yy "], "deep": {"on": False, "id": "0" * 8 + "-0000-0000-0000-" + "A" * 12}}
    rows = read(spark, '{"name": "x"}', json.dumps(full), '{"name": "x", "limit": null, "tags": null, "other": 1}', '{"name": "x", "limit": 2.0}')
    assert [r["e"] for r in rows] == [None] * 4
    assert (rows[0]["v"]["limit"], rows[0]["v"]["sort"], rows[0]["v"]["p"], rows[0]["v"]["tags"], rows[0]["v"]["deep"]) == (20, "new", None, None, None)
    v = rows[1]["v"]
    assert (v["limit"], v["p"], v["name"], v["sort"], v["tags"], v["deep"]["on"]) == (3, 0.5, "ab", "old", ["xx", "yy"], False)
    assert rows[2]["v"]["limit"] == 20 and rows[3]["v"]["limit"] == 2


@pytest.mark.parametrize(
    "text, said",
    [
        (None, "name must be a non-empty string of at most 5 characters"),
        ("no json", "name must be a non-empty string of at most 5 characters"),
        ("[1]", "name must be a non-empty string of at most 5 characters"),
        ('{"limit": 0, "name": ""}', "limit must be an integer from 1 to 50"),
        ('{"limit": "3", "name": "x"}', "limit must be an integer from 1 to 50"),
        ('{"limit": 1.5, "name": "x"}', "limit must be an integer from 1 to 50"),
        ('{"limit": true, "name": "x"}', "limit must be an integer from 1 to 50"),
        ('{"name": "   "}', "name must be a non-empty string of at most 5 characters"),
        ('{"name": 5}', "name must be a non-empty string of at most 5 characters"),
        ('{"name": "x", "p": 0}', "p must be a number in (0, 1]"),
        ('{"name": "x", "sort": "up"}', "sort must be one of new, old"),
        ('{"name": "x", "tags": []}', "tags must list 1-2 items"),
        ('{"name": "x", "tags": "xx"}', "tags must list 1-2 items"),
        ('{"name": "x", "tags": ["xx", "y"]}', "tags[1] must be a string of at least 2 characters"),
        ('{"name": "x", "deep": {}}', "deep.on must be true or false"),
        ('{"name": "x", "deep": {"on": true, "id": "7"}}', "deep.id must be an id (a UUID)"),
    ],
)
def test_messages(spark, text, said):
    row = read(spark, text)[0]
    assert row["e"] == said and row["v"] is None


def test_schema():
    schema = a.record(FIELDS).schema
    assert schema["required"] == ["name"] and schema["properties"]["limit"] == {"type": "integer", "minimum": 1, "maximum": 50, "default": 20}
    assert schema["properties"]["deep"]["required"] == ["on"] and schema["properties"]["tags"]["items"]["minLength"] == 2


def test_compiled_types(spark):
    from tidemark.operators import styles

    said = [({"b": "size", "a": "color"}, None), ({}, "a type declares 1 to 64 names"), (None, "a type declares 1 to 64 names"), ({f"n{k}": "word" for k in range(65)}, "a type declares 1 to 64 names"), ({"a": "size", "B": "size"}, "bad name: B"), ({"a": "script"}, "unknown kind: script"), ({"a": None}, "unknown kind: null")]
    df = spark.createDataFrame([(n, d) for n, (d, _) in enumerate(said)], "n int, d map<string,string>")
    schema, refusal = styles.compiled_type(F.col("d"))
    rows = df.select("n", schema.alias("s"), refusal.alias("r")).orderBy("n").collect()
    assert [r["r"] for r in rows] == [s for _, s in said] and all(r["s"] is None for r in rows[1:])
    driver = styles.compiled({"a": "color", "b": "size"})
    assert json.loads(rows[0]["s"]) == driver | {"required": ["a", "b"]}
