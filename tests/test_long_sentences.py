"""Names in sentences of many words."""

import re

import duckdb
import pytest

import __spark_entry__  # noqa: F401
from tidemark.operators import names
from tidemark.plans import registry


def test_a_run_of_many_capitals_is_one_run(spark):
    docs = spark.createDataFrame([(1, "Ab " * 20_000), (2, "so Ab de la Cd 7 9 Ef of the of Gh X. Y")], "doc_id long, text string")
    rows = sorted((r["doc_id"], r["run"], r["words"], r["opens"]) for r in names.capital_runs(docs).collect())
    assert rows == [(1, 0, ("Ab " * 20_000).strip(), True), (2, 0, "Ab de la Cd 7 9 Ef", False), (2, 1, "Gh X. Y".replace(".", ""), False)]


def test_runs_are_found_as_before():
    parts = ["C‹A›", "P‹de›", "N‹1›", "O‹x›", "C‹B›|", "P‹la›|", "C‹É›"]
    import random

    rng = random.Random(4)
    for _ in range(3000):
        marked = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert re.findall(names.RUN_IN_JAVA, marked) == re.findall(names.RUN, marked), marked


@pytest.mark.parametrize("few", [10_000, 0])
def test_a_known_name_in_a_sentence_of_many_words(spark, monkeypatch, few):
    monkeypatch.setattr(names, "FEW_NAMES", few)
    long = " ".join(f"w{k}" for k in range(20_000))
    docs = spark.createDataFrame([(1, f"{long} Old Town {long}"), (2, "old town. Old town. l'Old Town Old"), (3, "")], "doc_id long, text string")
    known = spark.createDataFrame([("Old Town",), ("Old Town Old Town Old Town",), ("Old",), ("!",)], "name string")
    rows = names.known_names(docs, known)
    assert sorted(map(tuple, rows.collect())) == [(1, "Old", 0, 20_000), (1, "Old Town", 0, 20_000), (2, "Old", 1, 0), (2, "Old", 2, 0), (2, "Old", 2, 2), (2, "Old Town", 2, 0)]
    assert names.known_names(docs, known.limit(0)).collect() == []


def test_page_candidates_of_long_runs_are_those_of_their_sql(spark, tmp_path):
    texts = [(1, "Ab Cd " * 15 + "and so Old Town said"), (2, "So Old Town. Ab de la Cd\nMonday. Old Town of X. Y"), (3, "Of The\nold town")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Old Town is"), (2, "Ab Cd Ef")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    for name in ("txt_09_page_candidates", "txt_07_known_names"):
        found = con.execute(registry.ORACLES[name])
        columns = [c[0] for c in found.description]
        mine = registry.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
        assert sorted(map(repr, map(tuple, mine))) == sorted(map(repr, found.fetchall())) != []
