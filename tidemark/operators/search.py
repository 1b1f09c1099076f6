"""Names and text search: folding, trigrams, word matches, weighted hits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranking
from tidemark.session import staged

#: Accented Latin letters and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"
#: Words of names that carry no meaning.
LITTLE_WORDS = "a an and the of on in for to at by with de du des la le les l d et y el von van der den".split()


def fold(text: Column) -> Column:
    """Lower case without accents; ligatures and sharp s are spelled out."""
    out = F.translate(F.lower(text), ACCENTED, PLAIN)
    for a, b in (("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("’", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def words(text: Column) -> Column:
    """The folded words: runs of a-z and 0-9."""
    return F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each folded word, padded by two spaces before and one behind."""

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words(text), of)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two trigram arrays; 0 where both are empty."""
    shared, united = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(united > 0, shared / united).otherwise(F.lit(0.0))


def similar(left: DataFrame, right: DataFrame, l_id: str, l_text: str, r_id: str, r_text: str, least: float = 0.3) -> DataFrame:
    """(l_id, r_id, similarity) of pairs at or above a trigram similarity.

    A prefix filter: two sets at or above `least` share one of the rarest n - ceil(least n) + 1 grams of either, so that
    frequent grams bring no rows together. Pairs that also agree in size are then compared on whole sets.
    """
    a = left.select(F.col(l_id).alias("a_id"), trigrams(F.col(l_text)).alias("a_grams"))
    b = right.select(F.col(r_id).alias("b_id"), trigrams(F.col(r_text)).alias("b_grams"))
    rare = a.select(F.explode("a_grams").alias("gram")).union(b.select(F.explode("b_grams"))).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))

    def sides(rows: DataFrame, name: str) -> DataFrame:
        grams = rows.select(f"{name}_id", F.explode(f"{name}_grams").alias("gram")).join(rare, "gram")
        sets = grams.groupBy(f"{name}_id").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("set"))
        n = F.size("set")
        prefix = F.slice("set", F.lit(1), n - F.ceil(n * least - 1e-9).cast("int") + 1)
        return sets.select(f"{name}_id", F.transform("set", lambda x: x["gram"]).alias(f"{name}_grams"), n.alias(f"{name}_n"), F.explode(F.transform(prefix, lambda x: x["gram"])).alias("gram"))

    pairs = sides(a, "a").join(sides(b, "b"), "gram").where(F.least("a_n", "b_n") >= least * F.greatest("a_n", "b_n") - 1e-9).dropDuplicates(["a_id", "b_id"])
    score = similarity(F.col("a_grams"), F.col("b_grams"))
    return pairs.withColumn("similarity", score).where(F.col("similarity") >= least).select(F.col("a_id").alias(l_id), F.col("b_id").alias(r_id), "similarity")


def match_names(names: DataFrame, typed: list[str], partial: str | None = None) -> DataFrame:
    """Names (entity_id, name) whose meaningful words are at least half hit by the typed words.

    A hit is an equal word, a plural in s or es either way (from three letters on), or, for the word
    still being typed, a prefix. Adds n (meaningful words) and hits.
    """
    import re

    plain = [w for w in (re.sub("[^a-z0-9]", "", t.lower()) for t in typed[:12]) if w]
    begun = re.sub("[^a-z0-9]", "", (partial or "").lower())
    parts = F.filter(words(F.col("name")), lambda w: ~w.isin(LITTLE_WORDS))

    def hit(w: Column) -> Column:
        same = set(plain) | {t + e for t in plain if len(t) >= 3 for e in ("s", "es")}
        found = w.isin(sorted(same)) if same else F.lit(False)
        for t in plain:
            if len(t) >= 3:
                found = found | F.lit(t).isin(F.concat(w, F.lit("s")), F.concat(w, F.lit("es")))
        return found | w.startswith(begun) if len(begun) >= 2 else found

    rows = names.withColumn("_words", parts).withColumn("n", F.size("_words")).withColumn("hits", F.size(F.filter("_words", hit))).drop("_words")
    return rows.where((F.col("n") > 0) & (2 * F.col("hits") >= F.col("n")))


def hits(links: DataFrame, mentions: DataFrame, entities: DataFrame, search: str, as_of: datetime, half_life_days: float = 60.0) -> DataFrame:
    """(link_id, score, names) of links that a search finds.

    The title's full-text rank counts, entity tags by 0.3 p (half outside the
    title), a title that holds all words as substrings by 0.02. Only text, substrings, and entities named
    by the whole search qualify a link; the sum is boosted for young links.
    """
    from tidemark.operators import fulltext

    wanted = [w for w in fold_text(search).split() if w]
    folded = fold_text(" ".join(wanted))
    links = staged(links.select("link_id", "title", "created_at"), "search-links")  # read four times below
    postings = fulltext.index(links.select("link_id", "title"), "link_id", [fulltext.Field("title", "A")], only=fulltext.asked(search))
    text = fulltext.ranks(postings, "link_id", search)
    text = text.select("link_id", F.col("rank").alias("r"), F.lit(None).cast("string").alias("name"), F.lit(True).alias("qualifies"))
    whole = fold(F.col("name")) == folded
    named = entities.where(whole | F.arrays_overlap(words(F.col("name")), F.array(*[F.lit(w) for w in wanted]))).select("entity_id", "name", whole.alias("qualifies"))
    tags = mentions.join(named, "entity_id").select("link_id", (0.3 * F.col("p") * F.when(F.col("in_title"), 1.0).otherwise(0.5)).alias("r"), "name", "qualifies")
    holds = F.lit(True)
    for w in wanted:
        holds = holds & fold(F.col("title")).contains(w)
    inside = links.where(holds).select("link_id", F.lit(0.02).alias("r"), F.lit(None).cast("string").alias("name"), F.lit(True).alias("qualifies"))
    sums = text.unionByName(tags).unionByName(inside).groupBy("link_id").agg(F.sum("r").alias("r"), F.sort_array(F.collect_set("name")).alias("names"), F.bool_or("qualifies").alias("ok"))
    boost = 0.75 + 0.25 * ranking.decay(F.col("created_at"), as_of, half_life_days, 1e6)
    return sums.where("ok").join(links.select("link_id", "created_at"), "link_id").select("link_id", (F.col("r") * boost).alias("score"), "names", "created_at")


def fold_text(text: str) -> str:
    """fold() of a Python string."""
    out = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    for a, b in (("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("’", "'")):
        out = out.replace(a, b)
    return out
