"""Names in sentences: where they occur, and which of them are only fragments of longer names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_places(words: Column, name: Column) -> Column:
    """The places (from 1) at which an array of words has another as a run of neighbours."""
    n = F.size(name)
    starts = F.when(n <= F.size(words), F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(words, i, n) == name)


def occurrences(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(text_id, name, first, last): texts (text_id, words) meet names (name, parts) by each name's first word."""
    words = texts.select("text_id", "words", F.explode(F.array_distinct("words")).alias("_first"))
    met = words.join(names.withColumn("_first", F.element_at("parts", 1)), "_first")
    rows = met.select("text_id", "name", F.size("parts").alias("n"), F.explode(word_places(F.col("words"), F.col("parts"))).alias("first"))
    return rows.select("text_id", "name", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def fragments(found: DataFrame) -> DataFrame:
    """(text_id, name) of names that stand alone nowhere: every occurrence lies inside a longer name."""
    a, b = found.alias("a"), found.alias("b")
    inside = (F.col("a.text_id") == F.col("b.text_id")) & (F.col("b.first") <= F.col("a.first")) & (F.col("b.last") >= F.col("a.last")) & (F.col("b.last") - F.col("b.first") > F.col("a.last") - F.col("a.first"))
    alone = a.join(b, inside, "left_anti").select("text_id", "name").distinct()
    return found.select("text_id", "name").distinct().join(alone, ["text_id", "name"], "left_anti")
