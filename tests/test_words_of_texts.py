"""Words of texts, read inside each row."""

from tidemark.operators import names
from tidemark.plans import registry

import __spark_entry__  # noqa: F401


def test_words_are_those_of_the_tokens_and_nothing_is_shuffled(spark):
    texts = [(1, "The Old town. of l'État 7 New x 7up\nNew old. The"), (2, ""), (3, None), (4, "a b C. D"), (5, "word " * 3000 + "Éa"), (6, "1 2 3"), (7, "old Old")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    mine, wanted = names.words_of_texts(docs), names.text_words(names.tokens(docs))
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, wanted.collect()))
    assert "Exchange" not in mine._jdf.queryExecution().executedPlan().toString()


def test_hints_shuffle_the_words_of_texts_once(spark):
    plan = registry.QUERIES["txt_06_name_hints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LeftSemi" not in plan and plan.count("inline(") == 1
