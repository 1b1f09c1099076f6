"""The positional index and vectors made inside tasks."""

import random

import duckdb
from pyspark.sql import functions as F

from tidemark.functions import stemming
from tidemark.operators import fulltext, search
from tidemark.plans import oracle_text

FIELDS = [fulltext.Field("title", "A"), fulltext.Field("body", "C")]
DOCS = [(1, "The licenses of the APACHE", "licensing les batteries Œuvre strasse"), (2, None, "the of"), (3, "Straße l’été", None), (4, "", ""), (5, "ab ab1 ab", "ab. y yes says " * 3), (6, "x", "hopping hoped ß̧ K9 É " + "word" * 50), (None, "no key", "")]


def test_vectors_are_those_of_their_sql_and_shuffle_nothing(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "PIECE", 3)
    monkeypatch.setattr(fulltext, "KEPT", 5)
    docs = spark.createDataFrame(DOCS, "id long, title string, body string").coalesce(1)
    rows = fulltext.vectors(docs, "id", FIELDS)
    con = duckdb.connect()
    con.execute("CREATE TABLE texts (id BIGINT, title VARCHAR, body VARCHAR)")
    con.executemany("INSERT INTO texts VALUES (?, ?, ?)", DOCS)
    wanted = con.execute(f"WITH {oracle_text.vectors('texts', 'id', FIELDS)} SELECT id, n_tokens, n_places, vector FROM vectors").fetchall()
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, wanted))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_an_index_of_few_tokens_is_the_whole_index_of_them(spark):
    docs = spark.createDataFrame(DOCS, "id long, title string, body string")
    whole = fulltext.index(docs, "id", FIELDS).where(F.col("token").isin("licens", "ab"))
    some = fulltext.index(docs, "id", FIELDS, only={"licens", "ab"})
    assert some.schema == whole.schema and sorted(map(repr, some.collect())) == sorted(map(repr, whole.collect())) and whole.count() == 2
    assert fulltext.index(docs, "id", FIELDS, only={"nowhere"}).collect() == []


def test_words_of_every_letter_are_those_of_columns(spark):
    rows = [(k, "".join(f" a{chr(c)}b" for c in range(k, min(k + 4096, 0x110000)) if c and not 0xD800 <= c < 0xE000)) for k in range(0, 0x110000, 4096)]
    found = spark.createDataFrame(rows, "k int, t string").select("k", search.words(F.col("t")).alias("words")).collect()
    texts = dict(rows)
    for r in found:
        assert [search.fold_text(w) for w in fulltext.LETTERS.findall(texts[r["k"]].lower())] == r["words"], r["k"]


def test_tokens_of_a_query_are_all_that_its_ranks_read(spark):
    query = 'licensed "apache versions" -mit or gnu -mit'
    assert fulltext.asked(query) == {"licens", "licensed", "apach", "apache", "version", "versions", "mit", "gnu"}
    docs = spark.createDataFrame([(1, "Apache versions licensed", "x"), (2, "gnu", "mit"), (3, "gnu", "")], "id long, title string, body string")
    ranks = [sorted(map(tuple, fulltext.ranks(p, "id", query).collect())) for p in (fulltext.index(docs, "id", FIELDS), fulltext.index(docs, "id", FIELDS, only=fulltext.asked(query)))]
    assert ranks[0] == ranks[1] and [r[0] for r in ranks[0]] == [1, 3]


def test_a_search_of_documents_reads_them_once_and_shuffles_only_its_own_tokens(spark, tmp_path, monkeypatch):
    from tidemark.plans import registry, search_queries

    kept = []
    monkeypatch.setattr(search_queries, "staged", lambda df, name: kept.append(df) or df)
    spark.createDataFrame([(1, "Apache license version"), (2, "words without any hit " * 50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["q_05_document_hits"](spark, str(tmp_path))
    assert [r["doc_id"] for r in found.collect()] == [1]
    (postings,) = kept
    assert {r["token"] for r in postings.collect()} <= {"licens", "license", "licensed", "apach", "apache", "version"}
    assert "Exchange" not in postings._jdf.queryExecution().executedPlan().toString()


def test_stems_begin_as_their_words():
    rng = random.Random(3)
    parts = [r.suffix for steps in stemming.STEPS.values() for step in steps for r in step.rules if r.suffix.isascii()] + list("abcdefghijklmnopqrstuvwxyz0123456789")
    words = {search.fold_text("".join(rng.choices(parts, k=rng.randint(1, 3)))) for _ in range(60_000)} | set(stemming.ENGLISH_WORDS) | {search.fold_text(p) for p in parts}
    words -= {""}
    assert [w for w in words for x in fulltext.LANGUAGES if stemming.stem(w, x)[:1] != w[0]] == []
