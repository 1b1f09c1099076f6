"""Decisions over given probabilities and stored names: titles, descriptors, resolution of names and places, events, query words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import names
from tidemark.operators.search import fold
from tidemark.session import staged

#: A title's candidates, at most; the least probability of a pick, and of an event that is none.
MOST_TITLE, LEAST_PICK, NO_EVENT = 20, 0.6, 0.5
#: Words that end a descriptor.
STOPS = "and or the a an of in on at by for to is was are were who which that".split()
#: What query words ask for.
SORTS = {"top": "top", "best": "top", "new": "latest", "latest": "latest", "discussed": "discussed"}
FILLERS = "show me the a posts links about please".split()


def title_candidates(rows: DataFrame, key: str, title: str, most: int = MOST_TITLE) -> DataFrame:
    """(key, n, phrase): parts of a title at separators, its capitalised runs, camel-case words, windows of two words; each once."""
    parts = F.transform(F.split(title, r"\s+[-–—|]\s+|[:,;]\s+"), lambda x: F.trim(x))
    runs = F.transform(F.regexp_extract_all(names.marked_sentence(F.col(title)), F.lit(names.RUN), F.lit(1)), lambda r: F.trim(F.regexp_replace(r, "[CPN]‹([^›]*)›", "$1 ")))
    words = F.regexp_extract_all(title, F.lit(f"({names.TOKEN})"), F.lit(1))
    camel = F.filter(words, lambda w: w.rlike(r"\p{Ll}\p{Lu}"))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    listed = F.filter(F.array_distinct(F.concat(parts, runs, camel, pairs)), lambda x: F.length(x) >= 2)
    return rows.select(key, F.posexplode(F.slice(listed, 1, most)).alias("n", "phrase"))


def descriptors(rows: DataFrame, key: str, text: str, name: str, most: int = 3) -> DataFrame:
    """(key, before, after, former): up to `most` words on either side of a name, as far as a stop word; former: one of those before says so."""
    said = F.split(F.col(text), r"\s+")
    n, own = F.size(said), F.split(F.col(name), " ")
    at = F.array_min(F.filter(F.sequence(F.lit(1), n), lambda i: F.slice(said, i, F.size(own)) == own))
    left = F.reverse(F.slice(said, F.greatest(at - most, F.lit(1)), at - F.greatest(at - most, F.lit(1))))
    right = F.slice(said, at + F.size(own), F.lit(most))

    def until(words: Column) -> Column:
        stop = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.lower(F.get(words, i - 1)).isin(*STOPS)))
        return F.slice(words, F.lit(1), F.coalesce(stop - 1, F.size(words)))

    before, after = F.reverse(until(left)), until(right)
    out = rows.withColumn("_at", at).where("_at is not null").select(key, F.array_join(before, " ").alias("before"), F.array_join(after, " ").alias("after"))
    return out.withColumn("former", F.lower("before").rlike(r"\b(former|ex|late)\b"))


def read_query(rows: DataFrame, key: str, text: str, topics: DataFrame) -> DataFrame:
    """(key, sort, topic, search): the first sort word and topic name (topic, name) of a query; other words but fillers are searched for."""
    words = rows.select(key, F.posexplode(F.split(F.trim(fold(F.col(text))), r"\s+")).alias("n", "word"))
    sorts = F.create_map(*[F.lit(x) for pair in SORTS.items() for x in pair])
    named = words.join(topics.select(F.col("name").alias("word"), "topic"), "word", "left").withColumn("sort", F.try_element_at(sorts, F.col("word")))
    read = F.min(F.when(F.col("sort").isNotNull(), F.struct("n", "sort")))["sort"], F.min(F.when(F.col("topic").isNotNull(), F.struct("n", "topic")))["topic"]
    rest = F.when(F.col("sort").isNull() & F.col("topic").isNull() & ~F.col("word").isin(*FILLERS), F.struct("n", "word"))
    search = F.array_join(F.transform(F.array_sort(F.collect_list(rest)), lambda x: x["word"]), " ")
    return named.groupBy(key).agg(F.coalesce(read[0], F.lit("ranked")).alias("sort"), read[1].alias("topic"), search.alias("search"))


def follow_same(entities: DataFrame, same: DataFrame, most: int = 64) -> DataFrame:
    """(entity_id, root): where chains of same (entity_id, other) end; a chain in a circle ends at its smallest id.

    Each round doubles how far every entity has followed its chain and is staged. It carries the smallest id on the way, so that
    after n rounds an entity in a circle of up to 2^n steps has seen all of it. Rounds go on until no root and no smallest id changes;
    `most` rounds, 2^most steps, are more than there are ids, and going on beyond them raises.
    """
    rows = entities.select("entity_id").join(same.groupBy("entity_id").agg(F.min("other").alias("other")), "entity_id", "left")
    rows = rows.select("entity_id", F.coalesce("other", "entity_id").alias("root"), F.least("entity_id", F.coalesce("other", "entity_id")).alias("least"))
    rows = staged(rows, "same")
    starts = same.select(F.col("entity_id").alias("root")).distinct().withColumn("_on", F.lit(True))
    for _ in range(most):
        step = rows.select(F.col("entity_id").alias("root"), F.col("root").alias("further"), F.col("least").alias("its"))
        on = rows.join(step, "root", "left").select("entity_id", F.coalesce("further", "root").alias("root"), F.least("least", F.coalesce("its", "root")).alias("least"), F.col("root").alias("_root"), F.col("least").alias("_least"))
        on = staged(on, "same")
        # Chains with an end stand still when they are there; in circles roots go round for ever, but smallest ids settle.
        moved = on.join(starts, "root", "left").where((F.col("_least") != F.col("least")) | (F.col("_on").isNull() & (F.col("_root") != F.col("root"))))
        rows = on.select("entity_id", "root", "least")
        if moved.isEmpty():
            break
    else:
        raise RuntimeError(f"chains are longer than 2^{most} steps")
    # An end is an entity that is the same as no other. An entity before a circle takes the circle's smallest id, which its root there knows.
    circles = rows.select(F.col("entity_id").alias("root"), F.col("least").alias("_circle"))
    found = rows.join(starts, "root", "left").join(circles, "root", "left")
    return found.select("entity_id", F.when(F.col("_on"), F.coalesce("_circle", "least")).otherwise(F.col("root")).alias("root"))


def resolved(phrases: DataFrame, entities: DataFrame, judged: DataFrame, least: float = LEAST_PICK) -> DataFrame:
    """(phrase, entity_id, how): an entity of exactly that name (the smallest id), else the likeliest candidate of judged (phrase, entity_id, p), else new."""
    exact = entities.groupBy(fold(F.col("name")).alias("key")).agg(F.min("entity_id").alias("exact"))
    best = judged.groupBy("phrase").agg(F.max(F.struct("p", (-F.col("entity_id")).alias("m"))).alias("b")).where(F.col("b.p") >= least).select("phrase", (-F.col("b.m")).alias("likely"))
    rows = phrases.withColumn("key", fold(F.col("phrase"))).join(exact, "key", "left").join(best, "phrase", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("likely").isNotNull(), "candidate").otherwise("new")
    return rows.select("phrase", F.coalesce("exact", "likely").alias("entity_id"), how.alias("how"))


def placed(picks: DataFrame, items: DataFrame, least: float = LEAST_PICK) -> DataFrame:
    """(place_id, item, path, duplicate_of) from picks (place_id, item, p) and items (item, path): the likeliest item above the threshold; places of one item are duplicates of the first."""
    best = picks.groupBy("place_id").agg(F.max(F.struct("p", "item")).alias("b")).where(F.col("b.p") >= least).select("place_id", F.col("b.item").alias("item"))
    first = F.min("place_id").over(Window.partitionBy("item"))
    rows = best.join(items, "item").withColumn("_first", first)
    return rows.select("place_id", "item", "path", F.when(F.col("_first") != F.col("place_id"), F.col("_first")).alias("duplicate_of"))


def restaged(fragments: DataFrame, mentions: DataFrame, staged: DataFrame) -> DataFrame:
    """(link_id, entity_id): drops to stage for stored mentions (link_id, entity_id, name) whose names are all fragments (link_id, name); those staged before are left out."""
    marked = mentions.join(fragments.withColumn("_part", F.lit(True)), ["link_id", "name"], "left")
    gone = marked.groupBy("link_id", "entity_id").agg(F.bool_and(F.coalesce("_part", F.lit(False))).alias("all")).where("all")
    return gone.select("link_id", "entity_id").join(staged.select("link_id", "entity_id"), ["link_id", "entity_id"], "left_anti")


def decoded_events(kinds: DataFrame, dates: DataFrame, key: str) -> DataFrame:
    """(key, kind, day) from kinds (key, kind, p) and dates (key, origin, day, p): a page that is surely none has no event; dates of the title or description beat the page's."""
    none = F.max(F.when(F.col("kind") == "none", F.col("p")))
    best = F.max(F.when(F.col("kind") != "none", F.struct("p", "kind")))["kind"]
    what = kinds.groupBy(key).agg(none.alias("none"), best.alias("kind")).where((F.coalesce("none", F.lit(0.0)) < NO_EVENT) & F.col("kind").isNotNull())
    first = F.min(F.struct(F.when(F.col("origin") == "page", 1).otherwise(0).alias("o"), (-F.col("p")).alias("q"), "day"))["day"]
    return what.join(dates.groupBy(key).agg(first.alias("day")), key).select(key, "kind", "day")
