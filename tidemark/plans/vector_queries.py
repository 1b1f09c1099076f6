"""Vector similarities and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import encodings, few, search, sparse, vectors
from tidemark.plans.domain import Domain
from tidemark.plans.registry import query
from tidemark.session import staged

PLAIN = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


def plain(d: Domain) -> DataFrame:
    return d.raw("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


@query("vec_04_cosine", f"WITH {PLAIN} SELECT a.vec_id AS vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a, v b WHERE b.vec_id = 0")
def cosine(d: Domain) -> DataFrame:
    one = F.broadcast(plain(d).where("vec_id = 0").select(F.col("e").alias("q")))  # one row
    return plain(d).crossJoin(one).select("vec_id", F.round(vectors.cosine(F.col("e"), F.col("q")), 6).alias("cosine"))


@query("vec_10_brute_force", f"WITH {PLAIN} SELECT query, candidate, rank FROM (SELECT a.vec_id AS query, b.vec_id AS candidate, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id)::INTEGER AS rank FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 8")
def brute_force(d: Domain) -> DataFrame:
    asked = plain(d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("e").alias("q"))
    return vectors.nearest(plain(d).select(F.col("vec_id").alias("id"), F.col("e").alias("vec")), asked, 8).select("query", "candidate", "rank")


WORD_SETS = """doc_words AS (SELECT DISTINCT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS token FROM documents),
  item_words AS (SELECT DISTINCT item_id AS query, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '')) AS token FROM benchmark)"""


def word_sets(d: Domain, table: str, key: str, name: str) -> DataFrame:
    return d.raw(table).select(F.col(key).alias(name), F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")).alias("token")).distinct()


@query(
    "vec_10_sparse_cosine",
    f"""WITH {WORD_SETS}, n AS (SELECT count(DISTINCT id) AS n FROM doc_words), dfs AS (SELECT token, ln((SELECT n + 1.0::DOUBLE FROM n) / (count(*) + 1)) + 1 AS w FROM doc_words GROUP BY 1),
    a AS (SELECT query, i.token, coalesce(w, ln(n + 1.0::DOUBLE) + 1) AS w FROM item_words i CROSS JOIN n LEFT JOIN dfs USING (token)), an AS (SELECT query, sqrt(sum(w * w)) AS size FROM a GROUP BY 1), bn AS (SELECT id, sqrt(sum(w * w)) AS size FROM doc_words JOIN dfs USING (token) GROUP BY 1),
    s AS (SELECT query, id, round(sum(a.w * t.w) / (any_value(an.size) * any_value(bn.size)), 9) AS score FROM a JOIN doc_words d USING (token) JOIN dfs t USING (token) JOIN an USING (query) JOIN bn USING (id) GROUP BY 1, 2)
    SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5""",
)
def sparse_cosine(d: Domain) -> DataFrame:
    """The five documents nearest to each benchmark passage."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    return sparse.nearest(d.raw("documents").select(F.col("doc_id").alias("id"), words.alias("tokens")), word_sets(d, "benchmark", "item_id", "query"), 5)


@query(
    "vec_10_sparse_jaccard",
    f"""WITH {WORD_SETS}, an AS (SELECT query, count(*) AS n FROM item_words GROUP BY 1), bn AS (SELECT id, count(*) AS n FROM doc_words GROUP BY 1),
    s AS (SELECT query, id, round(count(*) / (any_value(an.n) + any_value(bn.n) - count(*)), 9) AS score FROM item_words JOIN doc_words USING (token) JOIN an USING (query) JOIN bn USING (id) GROUP BY 1, 2)
    SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 5""",
)
def sparse_jaccard(d: Domain) -> DataFrame:
    found = sparse.index(word_sets(d, "documents", "doc_id", "id"), cosine=False)
    return sparse.top_k(found, word_sets(d, "benchmark", "item_id", "query"), 5)


TOPS = """tops AS (SELECT a.vec_id % 3 AS source, round(list_cosine_similarity(a.e, b.e), 6) AS score, a.label = b.label AS good FROM v a JOIN v b ON a.vec_id % 10 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) = 1)"""


@query(
    "vec_11_threshold_sweep",
    f"WITH {PLAIN}, {TOPS}, t AS (SELECT DISTINCT source, score AS threshold FROM tops) SELECT source, threshold, (SELECT count(*) FROM tops x WHERE x.source = t.source AND score >= threshold) AS covered, round((SELECT count(*) FILTER (score >= threshold) / count(*) FROM tops x WHERE x.source = t.source), 9) AS coverage, round((SELECT count(*) FILTER (good) / count(*) FROM tops x WHERE x.source = t.source AND score >= threshold), 9) AS precision FROM t",
)
def threshold_sweep(d: Domain) -> DataFrame:
    """Precision and coverage at every threshold of the nearest vector's score, by source."""
    return sparse.sweep(nearest_label(d), ["source"]).select("source", "threshold", "covered", F.round("coverage", 9).alias("coverage"), F.round("precision", 9).alias("precision"))


@query(
    "vec_11_matched_coverage",
    f"WITH {PLAIN}, {TOPS}, c AS (SELECT source, score, good, count(*) OVER (PARTITION BY source ORDER BY score DESC RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY source) AS coverage FROM tops) SELECT source, min(score) AS threshold, round(max(coverage), 9) AS coverage, round(avg(good::INTEGER), 9) AS precision FROM c WHERE coverage <= 0.5 GROUP BY 1",
)
def matched_coverage(d: Domain) -> DataFrame:
    """The threshold at which half of each source's queries are answered, and the precision there."""
    rows = sparse.at_coverage(sparse.sweep(nearest_label(d), ["source"]), ["source"], 0.5)
    return rows.select("source", "threshold", F.round("coverage", 9).alias("coverage"), F.round("precision", 9).alias("precision"))


def nearest_label(d: Domain) -> DataFrame:
    """(source, score, right) of each tenth vector's nearest one."""
    rows = plain(d)
    asked = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query"), F.col("e").alias("q"))
    found = vectors.nearest(rows.select(F.col("vec_id").alias("id"), F.col("e").alias("vec")), asked, 1)
    labels = rows.select(F.col("vec_id").alias("query"), F.col("label").alias("own")), rows.select(F.col("vec_id").alias("candidate"), "label")
    met = found.join(labels[0], "query").join(labels[1], "candidate")
    rows = met.select((F.col("query") % 3).alias("source"), F.round("score", 6).alias("score"), (F.col("own") == F.col("label")).alias("right"))
    return staged(rows, "nearest-labels")  # a sweep reads it twice


@query("vec_11_retrieval_metrics", f"WITH {PLAIN}, r AS (SELECT a.vec_id AS query, a.label AS label, b.label AS found, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) AS rank FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), m AS (SELECT query, label, min(rank) FILTER (found = label AND rank <= 8) AS rank FROM r GROUP BY 1, 2) SELECT count(*) AS queries, round(avg((rank IS NOT NULL)::INTEGER), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM m")
def retrieval_metrics(d: Domain) -> DataFrame:
    labels = plain(d).select(F.col("vec_id").alias("candidate"), F.col("label").alias("found"))
    ranked = brute_force(d).join(labels, "candidate").select("query", F.col("found").alias("candidate"), "rank")
    truth = plain(d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("target"))
    rows = vectors.retrieval_metrics(ranked, truth, 8)
    return rows.select("queries", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query("agg_27_mean_vector", f"WITH {PLAIN} SELECT label, place::INTEGER AS place, round(avg(x), 6) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS place FROM v) GROUP BY 1, 2")
def mean_vector(d: Domain) -> DataFrame:
    means = vectors.mean_vector(plain(d), ["label"], "e")
    return means.select("label", F.posexplode("mean").alias("place", "x")).select("label", "place", F.round("x", 6).alias("x"))


GRAM_SETS = "g AS (SELECT DISTINCT p_name AS id, unnest(flatten(list_transform(string_split(p_name, ' '), lambda w: list_transform(range(1, len(w) + 2), lambda i: substring('  ' || w || ' ', i, 3))))) AS token FROM part)"


@query("vec_07_set_cosine", f"WITH {GRAM_SETS}, n AS (SELECT id, sqrt(count(*)) AS n FROM g GROUP BY 1) SELECT a.id AS l_id, b.id AS r_id, round(count(*) / (any_value(x.n) * any_value(y.n)), 9) AS cosine FROM g a JOIN g b USING (token) JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY 1, 2 HAVING count(*) / (any_value(x.n) * any_value(y.n)) >= 0.5 - 1e-9")
def set_cosine(d: Domain) -> DataFrame:
    rows = gram_sets(d).withColumn("weight", F.lit(1.0))
    return vectors.set_cosine(rows, rows, 0.5 - 1e-9).select("l_id", "r_id", F.round("cosine", 9).alias("cosine"))


def gram_sets(d: Domain) -> DataFrame:
    names = d.raw("part").select(F.col("p_name").alias("id")).distinct()
    return names.select("id", F.explode(search.trigrams(F.col("id"))).alias("token"))


@query("vec_01_tokens", f"WITH {GRAM_SETS} SELECT id, token FROM g")
def tokens(d: Domain) -> DataFrame:
    return gram_sets(d)


@query("vec_05_shift", f"WITH {PLAIN} SELECT vec_id, round(e[63], 6) AS first, round(e[62], 6) AS last FROM v")
def shifted(d: Domain) -> DataFrame:
    rows = plain(d).withColumn("s", vectors.shift(F.col("e"), 2))
    return rows.select("vec_id", F.round(F.element_at("s", 1), 6).alias("first"), F.round(F.element_at("s", -1), 6).alias("last"))


SIDES = "sides AS (SELECT plane, place, CASE WHEN strpos('02468ace', left(md5(plane || ':' || place), 1)) > 0 THEN 1 ELSE -1 END AS side FROM range(32) p(plane), range(64) q(place))"
CODES = f"{PLAIN}, {SIDES}, flat AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS place FROM v), dots AS (SELECT vec_id, plane, sum(x * side) AS s FROM flat JOIN sides USING (place) GROUP BY 1, 2), codes AS (SELECT vec_id, sum(CASE WHEN s >= 0 THEN 1::BIGINT << plane::INTEGER ELSE 0 END)::BIGINT AS code FROM dots GROUP BY 1)"


@query("vec_08_simhash", f"WITH {CODES} SELECT vec_id, code FROM codes")
def simhash(d: Domain) -> DataFrame:
    return plain(d).select("vec_id", vectors.simhash(F.col("e"), 32, 64).alias("code"))


@query("vec_09_band_pairs", f"WITH {CODES} SELECT x.vec_id AS a, y.vec_id AS b, bit_count(xor(x.code, y.code))::INTEGER AS apart FROM codes x JOIN codes y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.code, y.code)) <= 6 AND ((x.code & 255) = (y.code & 255) OR ((x.code >> 8) & 255) = ((y.code >> 8) & 255) OR ((x.code >> 16) & 255) = ((y.code >> 16) & 255) OR ((x.code >> 24) & 255) = ((y.code >> 24) & 255))")
def band_pairs(d: Domain) -> DataFrame:
    return vectors.band_pairs(simhash(d), "vec_id", "code", 4, 8, 6)


@query("vec_03_phase_vectors", "SELECT DISTINCT p_name, 1.0::DOUBLE AS own, 256 AS size FROM part")
def phase_vectors(d: Domain) -> DataFrame:
    names = d.raw("part").select("p_name").distinct().withColumn("tokens", search.trigrams(F.col("p_name")))
    rows = vectors.encode_phases(names, "tokens", 256)
    same = vectors.phase_similarity(F.col("re"), F.col("im"), F.col("re"), F.col("im"))
    return rows.select("p_name", F.round(same, 6).alias("own"), F.size("re").alias("size"))


@query("vec_02_phases", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token, 256.0::DOUBLE AS length FROM part")
def phases(d: Domain) -> DataFrame:
    """A single token's phasor: 256 numbers of length 1, before it is scaled to one."""
    tokens = d.raw("part").select(F.explode(F.split("p_name", " ")).alias("token")).distinct().withColumn("tokens", F.array("token"))
    rows = vectors.encode_phases(tokens, "tokens", 256)
    length = F.aggregate(F.zip_with("re", "im", lambda x, y: (x * x + y * y) * 256), F.lit(0.0), lambda t, x: t + x)
    return rows.select("token", F.round(length, 6).alias("length"))


@query("vec_05_bind", f"WITH {PLAIN} SELECT vec_id, true AS same FROM v")
def bound(d: Domain) -> DataFrame:
    """A vector bound to a unit phasor and unbound again."""
    rows = vectors.encode_phases(plain(d).withColumn("tokens", F.array(F.concat(F.lit("k"), "vec_id"))), "tokens", 64)
    key_re, key_im = vectors.scale(F.col("re"), 8.0), vectors.scale(F.col("im"), 8.0)
    zeros = F.transform("e", lambda x: x * 0)
    re, im = vectors.bind(F.col("e"), zeros, key_re, key_im)
    back, _ = vectors.bind(re, im, key_re, key_im, inverse=True)
    return rows.select("vec_id", vectors.close(back, F.col("e"), 1e-9).alias("same"))


@query("vec_06_rotated", f"WITH {PLAIN}, t AS (SELECT vec_id, unnest(e) AS x, unnest(range(64)) AS j FROM v) SELECT vec_id, round(sum(x * cos((vec_id % 5) * power(10000.0::DOUBLE, -j / 64.0::DOUBLE))), 6) AS re, round(sum(x * sin((vec_id % 5) * power(10000.0::DOUBLE, -j / 64.0::DOUBLE))), 6) AS im FROM t GROUP BY 1")
def rotated(d: Domain) -> DataFrame:
    re, im = vectors.rotated(F.col("e"), F.col("vec_id") % 5, 64)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda t, x: t + x), 6)
    return plain(d).select("vec_id", total(re).alias("re"), total(im).alias("im"))


@query(
    "vec_12_evaluation_set",
    """WITH surface AS (SELECT lower(p_name) AS query, min(p_partkey) AS target FROM part GROUP BY 1), witness AS (SELECT split_part(p_name, ' ', 1) AS query, min(p_partkey) AS target FROM part GROUP BY 1),
    merges AS (SELECT s_suppkey AS gone, s_suppkey // 3 * 3 AS kept, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0), kept AS (SELECT m.*, s_name AS kept_name FROM merges m JOIN supplier ON s_suppkey = kept)
    SELECT query, target, NULL AS own, 'surface' AS source FROM surface UNION ALL SELECT query, target, NULL, 'witness' FROM witness WHERE query NOT IN (SELECT query FROM surface)
    UNION ALL SELECT lower(name), kept, gone, 'merge' FROM kept WHERE lower(name) <> lower(kept_name)""",
)
def evaluation_set(d: Domain) -> DataFrame:
    """Queries by where they come from: names as written, witnesses that are no name, and names of entities that were merged into another; those
    leave out the entity's own old row (own)."""
    parts, none = d.raw("part"), F.lit(None).cast("long").alias("own")
    surface = parts.groupBy(F.lower("p_name").alias("query")).agg(F.min("p_partkey").alias("target"))
    witness = parts.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("query")).agg(F.min("p_partkey").alias("target")).join(surface, "query", "left_anti")
    suppliers = d.raw("supplier").select(F.col("s_suppkey").alias("gone"), F.lower("s_name").alias("query"))
    merges = suppliers.where("gone % 3 <> 0").withColumn("target", (F.floor(F.col("gone") / 3) * 3).cast("long"))
    kept = merges.join(suppliers.select(F.col("gone").alias("target"), F.col("query").alias("kept")), "target").where("query <> kept")
    told = [(surface, none, "surface"), (witness, none, "witness"), (kept, F.col("gone").alias("own"), "merge")]
    out = [rows.select("query", "target", own, F.lit(source).alias("source")) for rows, own, source in told]
    return out[0].union(out[1]).union(out[2])


@query(
    "vec_13_encoding_laws",
    """WITH names AS (SELECT DISTINCT p_name AS name FROM part), laws(law, fails) AS (VALUES ('bags have length 1', false), ('bags are order free', false), ('binding commutes', false), ('unbinding gives back', false), ('moving a sequence turns it', false), ('pairs are order free', true))
    SELECT law, count(*) AS tried, count(*) FILTER (fails AND string_split(name, ' ')[1] <> string_split(name, ' ')[-1]) AS broken FROM names, laws GROUP BY 1""",
)
def encoding_laws(d: Domain) -> DataFrame:
    """Laws of composed encodings over the names' trigrams and words; that pairs are free of order is none and breaks wherever words differ."""
    names = d.raw("part").select("p_name").distinct()
    return encodings.law_breaches(names.select(search.trigrams(F.col("p_name")).alias("grams"), F.split("p_name", " ").alias("words")), "grams", "words")


@query(
    "vec_03_titles",
    "WITH names AS (SELECT DISTINCT string_split(p_name, ' ') AS w FROM part) SELECT array_to_string(w, ' ') AS name, true AS same_bag, w[1] = w[-1] AS same_title FROM names",
)
def title_vectors(d: Domain) -> DataFrame:
    """A name and the same words the other way round: equal bags, other titles."""
    names = d.raw("part").select(F.col("p_name").alias("name")).distinct()
    names = names.withColumn("grams", search.trigrams(F.col("name"))).withColumn("words", F.split("name", " ")).withColumn("back", F.reverse(F.split("name", " ")))
    bags = names.withColumn("weighted", F.transform("grams", lambda g: F.struct(g.alias("token"), F.lit(1.0).alias("weight")))).withColumn("weighted_back", F.reverse("weighted"))

    def both(rows: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        close = vectors.phase_similarity(F.col("a_re"), F.col("a_im"), F.col("b_re"), F.col("b_im")) > 1 - 1e-9
        x, y = (r.select("name", F.col("re").alias(f"{n}_re"), F.col("im").alias(f"{n}_im")) for r, n in ((a, "a"), (b, "b")))
        return x.join(y, "name").select("name", close.alias("same"))

    bag = both(bags, encodings.encode_bags(bags, "weighted"), encodings.encode_bags(bags, "weighted_back"))
    titles = both(names, encodings.encode_titles(names, "grams", "words"), encodings.encode_titles(names, "grams", "back"))
    return bag.withColumnRenamed("same", "same_bag").join(titles.withColumnRenamed("same", "same_title"), "name")


LAWS = "SELECT * FROM (VALUES ('associates', 0::BIGINT), ('commutes', 0::BIGINT), ('scales', 0::BIGINT)) t(law, n)"


def triples(d: Domain) -> DataFrame:
    """Each vector with those of the next two ids."""
    rows = plain(d).select("vec_id", "e")
    b, c = (rows.select((F.col("vec_id") - k).alias("vec_id"), F.col("e").alias(name)) for k, name in ((1, "b"), (2, "c")))
    return rows.withColumnRenamed("e", "a").join(b, "vec_id").join(c, "vec_id")


@query("vec_13_laws", LAWS)
def laws(d: Domain) -> DataFrame:
    return vectors.law_breaches(triples(d), 1e-12)


@query("vec_22_embedding_laws", LAWS)
def embedding_laws(d: Domain) -> DataFrame:
    return vectors.law_breaches(triples(d), 1e-4)


@query("vec_14_bag_of_words", "WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) SELECT doc_id, count(*) FILTER (w = 'the') AS n_the, count(*) FILTER (w = 'de') AS n_de, count(*) FILTER (w = 'la') AS n_la FROM w GROUP BY 1")
def bag_of_words(d: Domain) -> DataFrame:
    """Counts over a vocabulary, as MLlib's CountVectorizerModel makes them."""
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    model = CountVectorizerModel.from_vocabulary(["the", "de", "la"], inputCol="words", outputCol="counts")
    rows = d.raw("documents").where("text is not null").select("doc_id", F.split(F.lower("text"), " ", -1).alias("words"))
    counts = vector_to_array(F.col("counts"))
    return model.transform(rows).select("doc_id", *(F.get(counts, F.lit(k)).cast("long").alias(f"n_{w}") for k, w in enumerate(("the", "de", "la"))))


@query(
    "vec_14_hashed_bags",
    "WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) SELECT doc_id, (('0x' || left(md5(w), 4))::INTEGER % 64)::INTEGER AS place, "
    "sum(CASE WHEN ('0x' || md5(w)[5])::INTEGER % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS value FROM w GROUP BY 1, 2 HAVING value <> 0",
)
def hashed_bags(d: Domain) -> DataFrame:
    """All words of all documents in 64 signed places."""
    words = d.raw("documents").select("doc_id", F.explode(F.split(F.lower("text"), " ", -1)).alias("word"))
    return vectors.hashed_bag(words, "doc_id", "word", 64)


@query(
    "vec_14_frequent_words",
    "WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents), v AS (SELECT w FROM w WHERE w <> '' GROUP BY 1 ORDER BY count(*) DESC, w LIMIT 200) SELECT w.w AS word, count(DISTINCT doc_id) AS documents, count(*) AS n FROM w JOIN v ON v.w = w.w GROUP BY 1",
)
def frequent_words(d: Domain) -> DataFrame:
    """A vocabulary of the most frequent words, with the bags that hold them."""
    counts = d.raw("documents").select("doc_id", F.explode(F.split(F.lower("text"), " ", -1)).alias("word")).where("word <> ''").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("word").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n"))
    return totals.orderBy(F.desc("n"), "word").limit(200)  # the vocabulary's size


@query("vec_15_kind_probe")
def kind_probe(d: Domain) -> DataFrame:
    """A linear probe of vectors for their label, and the same for control labels (a hash of the id): held-out accuracy, the majority's, selectivity."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = plain(d).select("vec_id", array_to_vector("e").alias("features"), F.col("label").cast("double").alias("label"), F.pmod(F.crc32(F.col("vec_id").cast("string").cast("binary")), F.lit(5)).cast("double").alias("control"))
    held = F.pmod(F.xxhash64("vec_id"), F.lit(4)) == 0
    found = {}
    for name in ("label", "control"):
        model = LogisticRegression(labelCol=name, maxIter=30, regParam=0.01).fit(rows.where(~held))
        found[name] = model.transform(rows.where(held)).agg(F.avg((F.col("prediction") == F.col(name)).cast("double")).alias("x")).withColumnRenamed("x", name)
    most = rows.where(held).groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("majority"))
    both = found["label"].crossJoin(found["control"]).crossJoin(most)  # one row each
    return both.select(F.col("label").alias("accuracy"), F.col("control").alias("control_accuracy"), "majority", (F.col("label") - F.col("control")).alias("selectivity"))


@query("vec_16_label_auc", f"WITH {PLAIN}, m AS (SELECT label, place, avg(x) AS x FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS place FROM v) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY place) AS e FROM m GROUP BY 1), s AS (SELECT c.label AS label, round(list_cosine_similarity(v.e, c.e), 9) AS score, v.label = c.label AS positive FROM v, c), r AS (SELECT *, avg(k) OVER (PARTITION BY label, score) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score) AS k FROM s)) SELECT label, round((sum(rank) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 6) AS auc FROM r GROUP BY 1")
def label_auc(d: Domain) -> DataFrame:
    """One against the rest: each label's mean vector scores all vectors, in lists of means."""
    means = vectors.mean_vector(plain(d), ["label"], "e").withColumnRenamed("label", "kind")
    rows = few.with_lists(plain(d), means, "means", 1000).select("label", "e", F.inline("means"))
    scored = rows.select(F.col("kind").alias("label"), F.round(vectors.cosine(F.col("e"), F.col("mean")), 9).alias("score"), (F.col("label") == F.col("kind")).alias("positive"))
    return vectors.auc(scored, "label").select("label", F.round("auc", 6).alias("auc"))


@query("vec_18_inheritance", "WITH m AS (SELECT kind_path AS term, link_id AS item, max(p) AS p FROM mentions JOIN entities USING (entity_id) GROUP BY 1, 2), z AS (SELECT term, sum(p) AS s FROM m GROUP BY 1), b AS (SELECT x.term AS a, y.term AS b, sum(least(x.p, y.p)) AS s FROM m x JOIN m y ON x.item = y.item AND x.term <> y.term GROUP BY 1, 2) SELECT b.a, b.b, round(b.s / za.s, 9) AS subset, round(b.s / (za.s + zb.s - b.s), 9) AS similarity FROM b JOIN z za ON za.term = b.a JOIN z zb ON zb.term = b.b")
def inheritance(d: Domain) -> DataFrame:
    """Kinds as fuzzy sets of the links that mention them: at most as many to a link as there are kinds."""
    members = d.mentions().join(d.entities(), "entity_id").groupBy(F.col("kind_path").alias("term"), F.col("link_id").alias("item")).agg(F.max("p").alias("p"))
    return vectors.inheritance(members).select("a", "b", F.round("subset", 9).alias("subset"), F.round("similarity", 9).alias("similarity"))


@query("vec_19_entity_graph", "SELECT p_partkey // 100 * 100 AS cluster, count(*) AS n, min(p_name) AS name, count(DISTINCT p_brand) > 1 AS conflicting FROM part GROUP BY 1")
def entity_graph(d: Domain) -> DataFrame:
    """Mentions linked as the same are clustered; a cluster is named by its least name; it conflicts where its kinds differ."""
    from tidemark.operators import aggregates

    key = F.col("p_partkey")
    links = d.raw("part").select(key.alias("a"), (F.floor(key / 10) * 10).cast("long").alias("b")).union(d.raw("part").select((F.floor(key / 10) * 10).cast("long"), (F.floor(key / 100) * 100).cast("long"))).distinct()
    found = aggregates.clusters(links).withColumnRenamed("id", "p_partkey")
    rows = d.raw("part").join(found, "p_partkey").groupBy("cluster")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("name"), (F.min("p_brand") != F.max("p_brand")).alias("conflicting"))


@query("vec_20_mention_windows", "WITH m AS (SELECT doc_id, strpos(documents.text, left(b.text, 40)) AS place FROM documents JOIN benchmark b ON contains(documents.text, left(b.text, 40))) SELECT doc_id, count(*) AS mentions, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs, min(place) AS first FROM m GROUP BY 1")
def mention_windows(d: Domain) -> DataFrame:
    """Where the first forty characters of benchmark texts stand in documents, and how many pairs of mentions that makes.

    Documents meet phrases by a phrase's first two words, so that no document is compared with all phrases.
    """

    def pairs(words: Column) -> Column:
        return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda x, y: F.concat_ws(" ", x, y))

    words = F.split("text", r"\s+")
    phrases = d.raw("benchmark").select(F.left("text", F.lit(40)).alias("phrase"), F.get(pairs(words), F.lit(0)).alias("head"))
    met = d.raw("documents").where("text is not null").select("doc_id", "text", F.explode(F.array_distinct(pairs(words))).alias("head")).join(phrases, "head")
    rows = met.select("doc_id", F.position(F.col("phrase"), F.col("text")).alias("at")).where("at > 0")
    n = F.count(F.lit(1))
    return rows.groupBy("doc_id").agg(n.alias("mentions"), (n * (n - 1) / 2).cast("long").alias("pairs"), F.min("at").cast("long").alias("first"))


@query("vec_21_forms", "WITH a AS (SELECT l_orderkey AS form, l_linenumber AS question, l_returnflag AS option, max(l_discount) AS p FROM lineitem GROUP BY 1, 2, 3) SELECT form, question, arg_max(option, (p, option)) AS answer, max(p) >= 0.05 AS sure FROM a GROUP BY 1, 2")
def forms(d: Domain) -> DataFrame:
    """Answers of a form from a table of probabilities: the likeliest option of each question, and whether it passes the threshold."""
    options = d.raw("lineitem").groupBy(F.col("l_orderkey").alias("form"), F.col("l_linenumber").alias("question"), F.col("l_returnflag").alias("option")).agg(F.max("l_discount").alias("p"))
    return options.groupBy("form", "question").agg(F.max_by("option", F.struct("p", "option")).alias("answer"), (F.max("p") >= 0.05).alias("sure"))
