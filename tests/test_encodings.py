"""Composed encodings against an independent computation from SHAKE-256 digests."""

import cmath
import hashlib
import math
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.operators import encodings

SIZE = 32


def phasor(token):
    return [cmath.exp(1j * q * 2 * math.pi / 65536) for q in struct.unpack(f"<{SIZE}H", hashlib.shake_256(b"tok:" + token.encode()).digest(2 * SIZE))]


def unit(v):
    n = math.sqrt(sum(abs(x) ** 2 for x in v))
    return [x / n for x in v] if n else v


def total(vectors):
    return [sum(xs) for xs in zip(*vectors)] if vectors else [0j] * SIZE


def vector(row):
    return [complex(a, b) for a, b in zip(row["re"], row["im"])]


def same(a, b):
    return max(abs(x - y) for x, y in zip(a, b)) < 1e-12


def test_encodings_equal_an_independent_computation(spark):
    rows = [(0, ["ab", "bc"], ["one", "two", "two"]), (1, ["ab"], ["é"]), (2, [], []), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, grams array<string>, words array<string>")
    bags = encodings.encode_bags(df.withColumn("g", F.transform("grams", lambda x: F.struct(x.alias("token"), F.length(x).cast("double").alias("weight")))), "g", SIZE)
    titles, moved = encodings.encode_titles(df, "grams", "words", SIZE), encodings.encode_sequences(df, "words", SIZE, offset=2)
    for name, got in (("bag", bags), ("title", titles), ("sequence", moved)):
        for r in got.collect():
            grams, words = r["grams"] or [], r["words"] or []
            bag = unit(total([phasor(g) for g in grams]))
            pairs = []
            for a, b in zip(words, words[1:]):
                second = phasor(b)
                pairs.append([x * y for x, y in zip(phasor(a), second[-1:] + second[:-1])])
            turned = [[x * cmath.exp(1j * (k + 2) * 10_000.0 ** (-j / SIZE)) for j, x in enumerate(phasor(w))] for k, w in enumerate(words)]
            want = {"bag": bag, "title": unit([a + b for a, b in zip(bag, unit(total(pairs)))]), "sequence": unit(total(turned))}[name]
            assert same(vector(r), want), (name, r["id"])


def test_laws_hold_and_the_one_that_is_none_fails(spark):
    df = spark.createDataFrame([(["ab", "bc", "cd"], ["one", "two"]), (["ab"], ["one"]), (["x"], ["two", "mid", "two"]), (["x"], [])], "grams array<string>, words array<string>")
    got = {r["law"]: (r["tried"], r["broken"]) for r in encodings.law_breaches(df, "grams", "words").collect()}
    assert got.pop("pairs are order free") == (3, 1) and set(got.values()) == {(3, 0)} and len(got) == 5
    strict = {r["law"]: r["broken"] for r in encodings.law_breaches(df, "grams", "words", tolerance=-1.0).collect()}
    assert set(strict.values()) == {3}  # every law is really measured
    assert pytest.approx(1.0) == sum(abs(x) ** 2 for x in unit(phasor("one")))
