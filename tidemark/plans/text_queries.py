"""Names, spans and readings of texts as queries, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import names
from tidemark.operators.search import ACCENTED, PLAIN
from tidemark.plans.domain import Domain
from tidemark.plans.expression_queries import SENTENCES
from tidemark.plans.registry import query

TOKEN = names.TOKEN.replace("'", "''")
CAPITAL = names.CAPITAL.replace("'", "''")


def folded(x: str) -> str:
    return f"replace(replace(replace(replace(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), '’', '''')"


#: DuckDB: the tokens of all documents.
TOKENS = rf"""said AS (SELECT doc_id, unnest(ss) AS said, generate_subscripts(ss, 1) AS sentence FROM (SELECT doc_id, {SENTENCES} AS ss FROM documents)),
  found AS (SELECT doc_id, sentence, said, regexp_extract_all(said, '{TOKEN}') AS t FROM said),
  listed AS (SELECT doc_id, sentence, unnest(t) AS word, generate_subscripts(t, 1) AS token, list_position(list_transform(t, lambda w: regexp_matches(w, '^\p{{L}}')), true) AS first FROM found),
  tokens AS (SELECT doc_id, sentence, token, word, {folded('word')} AS key, NOT regexp_matches(word, '^\p{{L}}') AS number, regexp_matches(word, '^\p{{L}}') AND regexp_matches(word, '{CAPITAL}') AS cap, token = first AS opens FROM listed)"""
COUNTS = rf"""lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents),
  parts AS (SELECT doc_id, lang, unnest(string_split(regexp_replace(line, '([.!?…])\s+', '\1' || chr(2), 'g'), chr(2))) AS said FROM lines WHERE NOT starts_with(line, '## ') AND len(regexp_split_to_array(trim(line), '\s+')) >= 8),
  words AS (SELECT doc_id, lang, unnest(regexp_extract_all(said, '\p{{L}}(?:[\p{{L}}\p{{N}}''’-]*[\p{{L}}\p{{N}}])?')[2:]) AS w FROM parts),
  wordcase AS (SELECT coalesce(lang, 'und') AS lang, {folded('w')} AS word, count(*) FILTER (left(w, 1) <> lower(left(w, 1))) AS capitalised, count(*) AS total FROM words WHERE length(w) BETWEEN 2 AND 40 GROUP BY 1, 2)"""
NAMES = "names AS (SELECT DISTINCT regexp_extract(text, '^[^ \\n]+ [^ \\n]+') AS name FROM benchmark)"
KNOWN = rf"""{NAMES}, keyed AS (SELECT name, list_transform(regexp_extract_all(name, '{TOKEN}'), lambda w: regexp_replace({folded('w')}, '^[dl]''', '')) AS p, list_transform(regexp_extract_all(name, '{TOKEN}'), lambda w: regexp_matches(w, '{CAPITAL}')) AS c FROM names),
  pairs AS (SELECT doc_id, sentence, token, regexp_replace(key, '^[dl]''', '') AS k1, regexp_replace(lead(key) OVER w, '^[dl]''', '') AS k2, cap AS c1, lead(cap) OVER w AS c2 FROM tokens WINDOW w AS (PARTITION BY doc_id, sentence ORDER BY token)),
  known AS (SELECT doc_id, name, sentence - 1 AS sentence, token - 1 AS token FROM pairs JOIN keyed ON k1 = p[1] AND (len(p) = 1 OR k2 = p[2]) WHERE (c1 OR (len(p) > 1 AND c2)) AND NOT (len(p) > 1 AND c[2] AND NOT c2))"""


def names_of(d: Domain) -> DataFrame:
    """(name): the first two words of each benchmark text."""
    return d.raw("benchmark").select(F.regexp_extract("text", r"^[^ \n]+ [^ \n]+", 0).alias("name")).distinct()


@query(
    "txt_01_sections",
    "SELECT doc_id, length(text) + CASE WHEN doc_id % 2 = 0 THEN length('## Part ' || doc_id) + 1 ELSE 0 END + length(replace(text, chr(10) || chr(10), chr(10))) * 0 + 2 + length('## End' || chr(10)) AS chars, TRUE AS same FROM (SELECT doc_id, regexp_replace(text, '\\n+', chr(10), 'g') AS text FROM documents)",
)
def sections(d: Domain) -> DataFrame:
    rows = d.raw("documents").select("doc_id", F.regexp_replace("text", r"\n+", "\n").alias("text"))
    heading = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Part "), "doc_id"))
    made = F.array(F.struct(heading.alias("heading"), F.col("text").alias("text")), F.struct(F.lit("End").alias("heading"), F.lit("").alias("text")))
    rows = rows.select("doc_id", made.alias("made")).withColumn("page", names.page_text(F.col("made")))
    return rows.select("doc_id", F.length("page").cast("long").alias("chars"), (names.parse_sections(F.col("page")) == F.col("made")).alias("same"))


@query("txt_02_tokens", f"WITH {TOKENS} SELECT doc_id, count(*) AS n, count(*) FILTER (cap) AS caps, count(*) FILTER (opens) AS opening, count(*) FILTER (number) AS numbers, md5(string_agg(key, ' ' ORDER BY sentence, token)) AS keys FROM tokens GROUP BY 1")
def token_rows(d: Domain) -> DataFrame:
    found = names.tokens(d.raw("documents"))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("sentence", "token", "key"))), lambda x: x["key"])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("cap").alias("caps"), F.count_if("opens").alias("opening"), F.count_if("number").alias("numbers"), F.md5(F.array_join(keys, " ")).alias("keys"))


@query("txt_03_text_words", f"WITH {TOKENS}, marked AS (SELECT *, cap OR coalesce(lead(cap) OVER (PARTITION BY doc_id, sentence ORDER BY token), false) AS starts FROM tokens) SELECT doc_id, count(DISTINCT key) AS words, count(DISTINCT key) FILTER (starts) AS starts FROM marked WHERE NOT number GROUP BY 1")
def text_words(d: Domain) -> DataFrame:
    found = names.text_words(names.tokens(d.raw("documents")))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.count_if("starts").alias("starts"))


def counts_of(d: Domain) -> DataFrame:
    return names.case_counts(d.raw("documents").withColumn("lang", text.language_key(F.col("lang"))), ["lang"])


@query("txt_04_word_case_counts", f"WITH {COUNTS} SELECT * FROM wordcase")
def word_case_counts(d: Domain) -> DataFrame:
    return counts_of(d)


@query("txt_05_case_rates", f"WITH {COUNTS}, {TOKENS} SELECT word, sum(capitalised)::DOUBLE / sum(total) AS rate FROM wordcase WHERE word IN (SELECT key FROM tokens WHERE doc_id = (SELECT min(doc_id) FROM documents)) GROUP BY 1 HAVING sum(total) >= 5")
def case_rates(d: Domain) -> DataFrame:
    """The words of one page, the first document."""
    docs = d.raw("documents")
    page = docs.orderBy("doc_id").limit(1)
    return names.case_rates(counts_of(d), names.tokens(page).select(F.col("key").alias("word")))


@query(
    "txt_06_name_hints",
    f"""WITH {COUNTS}, {TOKENS}, {NAMES}, rates AS (SELECT word, sum(capitalised)::DOUBLE / sum(total) AS rate FROM wordcase GROUP BY 1 HAVING sum(total) >= 5),
    marked AS (SELECT *, cap OR coalesce(lead(cap) OVER (PARTITION BY doc_id, sentence ORDER BY token), false) AS starts FROM tokens), w AS (SELECT doc_id, key, bool_or(starts) AS starts FROM marked WHERE NOT number GROUP BY 1, 2),
    firsts AS (SELECT {folded("regexp_extract(name, '^[^ ]+')")} AS word, count(*) AS n FROM names GROUP BY 1)
    SELECT doc_id, count(rate) AS rated, count(*) FILTER (rate >= 0.5) AS mostly_names, coalesce(sum(n) FILTER (starts), 0)::BIGINT AS known FROM w LEFT JOIN rates ON rates.word = key LEFT JOIN firsts ON firsts.word = key GROUP BY 1""",
)
def name_hints(d: Domain) -> DataFrame:
    words = names.words_of_texts(d.raw("documents")).withColumnRenamed("key", "word")
    rates = names.case_rates(counts_of(d))
    firsts = names_of(d).groupBy(names.fold(F.regexp_extract("name", "^[^ ]+", 0)).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    rows = words.join(rates.join(firsts, "word", "full"), "word", "left")  # the words of texts are shuffled once
    return rows.groupBy("doc_id").agg(F.count("rate").alias("rated"), F.count_if(F.col("rate") >= names.NAME_RATE).alias("mostly_names"), F.coalesce(F.sum(F.when(F.col("starts"), F.col("n"))), F.lit(0)).alias("known"))


@query("txt_07_known_names", f"WITH {TOKENS}, {KNOWN} SELECT doc_id, name, sentence, token FROM known")
def known_names(d: Domain) -> DataFrame:
    return names.known_names(d.raw("documents"), names_of(d))


PARTICLES = ", ".join(f"'{p}'" for p in names.PARTICLES)
RUNS = rf"""spelled AS (SELECT doc_id, sentence, regexp_extract_all(said, '({TOKEN})([^\p{{L}}\p{{N}}]*)', 1) AS w, regexp_extract_all(said, '({TOKEN})([^\p{{L}}\p{{N}}]*)', 2) AS g FROM found),
  marked AS (SELECT doc_id, sentence, array_to_string(list_transform(list_zip(w, g), lambda z: CASE WHEN NOT regexp_matches(z[1], '^\p{{L}}') THEN 'N' WHEN regexp_matches(z[1], '{CAPITAL}') THEN 'C' WHEN {folded('z[1]')} IN ({PARTICLES}) THEN 'P' ELSE 'O' END
    || '‹' || z[1] || '›' || CASE WHEN regexp_matches(z[2], '^\s+$|^\s*&\s*$') OR (regexp_matches(z[1], '^\p{{Lu}}$') AND regexp_matches(z[2], '^[.]\s+$')) THEN '' ELSE '|' END), '') AS m FROM spelled),
  runs AS (SELECT doc_id, sentence, m, unnest(regexp_extract_all(m, '{names.RUN}')) AS f, generate_subscripts(regexp_extract_all(m, '{names.RUN}'), 1) AS run FROM marked),
  spoken AS (SELECT doc_id, sentence, run, trim(regexp_replace(f, '[CPN]‹([^›]*)›', '\1 ', 'g')) AS words, run = 1 AND starts_with(m, f) AS opens FROM runs)"""


@query("txt_08_capital_runs", f"WITH {TOKENS}, {RUNS} SELECT doc_id, count(*) AS n, count(*) FILTER (opens) AS opening, max(length(words)) AS longest, md5(string_agg(words, '|' ORDER BY sentence, run)) AS said FROM spoken GROUP BY 1")
def capital_runs(d: Domain) -> DataFrame:
    found = names.capital_runs(d.raw("documents"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("sentence", "run", "words"))), lambda x: x["words"])
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("opens").alias("opening"), F.max(F.length("words")).cast("long").alias("longest"), F.md5(F.array_join(said, "|")).alias("said"))


CALENDAR = ", ".join(f"'{w}'" for w in names.CALENDAR + names.PARTICLES)
LINES = "documents AS (SELECT doc_id * 1000000 + n AS doc_id, line AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM main.documents))"


@query(
    "txt_09_page_candidates",
    f"""WITH whole_known AS (WITH {TOKENS}, {KNOWN} SELECT * FROM known), spoken_lines AS (WITH {LINES}, {TOKENS}, {RUNS} SELECT * FROM spoken),
    r AS (SELECT doc_id // 1000000 AS doc_id, lower(words) AS surface, count(*) AS n, min(doc_id % 1000000) AS section FROM spoken_lines WHERE length(words) BETWEEN 3 AND 60 AND len(list_filter(string_split(lower(words), ' '), lambda w: w NOT IN ({CALENDAR}))) > 0
      GROUP BY 1, 2 HAVING NOT bool_and(opens AND NOT contains(words, ' '))),
    k AS (SELECT doc_id, surface, 'known' AS kind, 0 AS round, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, surface) AS turn FROM (SELECT doc_id, lower(name) AS surface, count(*) AS n FROM whole_known GROUP BY 1, 2) QUALIFY turn <= 25),
    o AS (SELECT doc_id, surface, 'run' AS kind, row_number() OVER (PARTITION BY doc_id, section ORDER BY n DESC, surface) AS round, section AS turn FROM r WHERE (doc_id, surface) NOT IN (SELECT (doc_id, surface) FROM k)),
    placed AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round, turn) AS rank, surface, kind FROM (SELECT * FROM k UNION ALL SELECT * FROM o))
    SELECT doc_id, rank, surface, kind FROM placed WHERE rank <= 80""",
)
def page_candidates(d: Domain) -> DataFrame:
    return names.page_candidates(d.raw("documents"), names_of(d))


@query("txt_12_sentences_with_names", f"WITH {TOKENS}, {KNOWN}, firsts AS (SELECT doc_id, name, min(sentence) AS n FROM known GROUP BY 1, 2) SELECT f.doc_id, name, md5(s.said) AS said FROM firsts f JOIN said s ON s.doc_id = f.doc_id AND s.sentence = n + 1")
def sentences_with_names(d: Domain) -> DataFrame:
    first = names.known_names(d.raw("documents"), names_of(d)).groupBy("doc_id", "name").agg(F.min("sentence").alias("sentence"))
    said = d.raw("documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sentence", "said"))
    return said.join(first, ["doc_id", "sentence"]).select("doc_id", "name", F.md5("said").alias("said"))


@query(
    "txt_19_scores",
    "WITH g AS (SELECT DISTINCT p_brand AS b, p_name AS name FROM part WHERE p_partkey % 2 = 0), f AS (SELECT DISTINCT p_brand AS b, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE split_part(p_name, ' ', 1) END AS name FROM part WHERE p_partkey % 2 = 1), "
    "near AS (SELECT g.b, g.name AS gold, f.name AS got FROM g JOIN f USING (b) WHERE contains(' ' || g.name || ' ', ' ' || f.name || ' ') OR contains(' ' || f.name || ' ', ' ' || g.name || ' ')) "
    "SELECT b AS p_brand, count(*) AS n, count(*) FILTER ((b, name) IN (SELECT (b, name) FROM f)) AS exact, count(*) FILTER ((b, name) IN (SELECT (b, gold) FROM near)) AS overlapping, (SELECT count(DISTINCT got) FROM near WHERE near.b = g.b) AS relevant FROM g GROUP BY 1",
)
def scores(d: Domain) -> DataFrame:
    parts = d.raw("part")
    gold = parts.where("p_partkey % 2 = 0").select("p_brand", F.split("p_name", " ").alias("words"))
    got = parts.where("p_partkey % 2 = 1").select("p_brand", F.split(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))), " ").alias("words"))
    return names.scores(gold, got, "p_brand")


@query("txt_30_calendar_words", f"WITH {TOKENS} SELECT doc_id, count(*) AS n FROM tokens WHERE key IN ({', '.join(repr(w) for w in names.CALENDAR)}, 'on', 'de') GROUP BY 1")
def calendar_words(d: Domain) -> DataFrame:
    """Month and weekday names, with two words of the documents' own so that there are rows."""
    words = d.spark.createDataFrame([(w,) for w in [*names.CALENDAR, "on", "de"]], "key string")
    return names.tokens(d.raw("documents")).join(F.broadcast(words), "key", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "txt_31_phrases",
    f"""WITH {TOKENS}, {KNOWN}, {RUNS}, page AS (SELECT DISTINCT doc_id, lower(words) AS phrase FROM spoken WHERE NOT opens OR contains(words, ' ')), title AS (SELECT DISTINCT doc_id, lower(name) AS phrase FROM known)
    SELECT doc_id, count(*) AS n, count(*) FILTER (origin = 'title') AS from_title FROM (SELECT doc_id, phrase, 'page' AS origin FROM page UNION ALL SELECT doc_id, phrase, 'title' FROM title WHERE (doc_id, phrase) NOT IN (SELECT (doc_id, phrase) FROM page)) GROUP BY 1""",
)
def phrases(d: Domain) -> DataFrame:
    page = names.capital_runs(d.raw("documents")).where("not opens or contains(words, ' ')").select("doc_id", F.lower("words").alias("phrase")).distinct()
    title = names.known_names(d.raw("documents"), names_of(d)).select("doc_id", F.lower("name").alias("phrase")).distinct()
    both = page.withColumn("origin", F.lit("page")).union(title.join(page, ["doc_id", "phrase"], "left_anti").withColumn("origin", F.lit("title")))
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("origin") == "title").alias("from_title"))
