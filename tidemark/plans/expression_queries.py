"""Projections and scalar functions as queries, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text, urls
from tidemark.operators import fulltext, hierarchy, search
from tidemark.plans import oracle_text
from tidemark.plans.domain import Domain
from tidemark.plans.registry import query

#: DuckDB: the host of a url without www.
HOST = "regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '^www[.]', '')"
#: Urls of pages, with odd ones made from them by their id.
ODD = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'https://www.youtube.com/watch?list=a&v=abcde' || lpad(page_id::VARCHAR, 6, '0') || '#t' WHEN 2 THEN 'https://youtu.be/ABCDE_' || lpad(page_id::VARCHAR, 5, '0') || '?t=1'
  WHEN 3 THEN 'https://notyoutube.com/shorts/abcdefghij' || page_id % 10 WHEN 4 THEN 'http://user:pw@' || substr(url, strpos(url, '://') + 3) WHEN 5 THEN 'http://10.0.0.' || page_id || '/x' WHEN 6 THEN replace(url, '/', '/ ') ELSE 'https://shop.name' || page_id || '.co.uk:8080/a#b' END AS url, html FROM pages"""


def odd_urls(d: Domain) -> DataFrame:
    n, url = F.col("page_id") % 8, F.col("url")
    rest = F.expr("substr(url, instr(url, '://') + 3)")
    made = F.when(n == 0, url).when(n == 1, F.concat(F.lit("https://www.youtube.com/watch?list=a&v=abcde"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit("#t")))
    made = made.when(n == 2, F.concat(F.lit("https://youtu.be/ABCDE_"), F.lpad(F.col("page_id").cast("string"), 5, "0"), F.lit("?t=1")))
    made = made.when(n == 3, F.concat(F.lit("https://notyoutube.com/shorts/abcdefghij"), F.col("page_id") % 10)).when(n == 4, F.concat(F.lit("http://user:pw@"), rest))
    made = made.when(n == 5, F.concat(F.lit("http://10.0.0."), "page_id", F.lit("/x"))).when(n == 6, F.replace(url, F.lit("/"), F.lit("/ ")))
    return d.raw("pages").select("page_id", made.otherwise(F.concat(F.lit("https://shop.name"), "page_id", F.lit(".co.uk:8080/a#b"))).alias("url"), "html")


@query("prj_01_search_text", f"SELECT page_id, lower('Page ' || page_id || ' ' || {HOST}) AS search_text FROM pages")
def search_text(d: Domain) -> DataFrame:
    return d.raw("pages").select("page_id", F.lower(F.concat(F.lit("Page "), "page_id", F.lit(" "), text.host(F.col("url")))).alias("search_text"))


#: A page's title, host and first paragraph; a document's first line and what follows.
PAGE_FIELDS = [fulltext.Field("title", "A"), fulltext.Field("host", "B", ("simple",)), fulltext.Field("description", "C")]
DOCUMENT_FIELDS = [fulltext.Field("title", "A"), fulltext.Field("body", "C")]
PAGE_TEXTS = f"""page_texts AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, replace({HOST}, '.', ' ') AS host,
  regexp_replace(regexp_extract(html, '(?is)<p>(.*?)</p>', 1), '<[^>]*>', ' ', 'g') AS description FROM pages)"""
DOCUMENT_TEXTS = "document_texts AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body FROM documents)"


def page_texts(d: Domain) -> DataFrame:
    paragraph = F.regexp_replace(F.regexp_extract("html", r"(?is)<p>(.*?)</p>", 1), "<[^>]*>", " ")
    return d.raw("pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.replace(text.host(F.col("url")), F.lit("."), F.lit(" ")).alias("host"), paragraph.alias("description"))


def document_texts(d: Domain) -> DataFrame:
    end = F.instr(F.col("text"), "\n")
    return d.raw("documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.when(end > 0, F.substring(F.col("text"), end + 1, F.length("text"))).otherwise("").alias("body"))


@query("prj_02_weighted_tokens", f"WITH {PAGE_TEXTS}, {oracle_text.vectors('page_texts', 'page_id', PAGE_FIELDS)} SELECT page_id, n_tokens, n_places, md5(vector) AS vector FROM vectors")
def weighted_tokens(d: Domain) -> DataFrame:
    return fulltext.vectors(page_texts(d), "page_id", PAGE_FIELDS).withColumn("vector", F.md5("vector"))


@query("prj_02_document_tokens", f"WITH {DOCUMENT_TEXTS}, {oracle_text.vectors('document_texts', 'doc_id', DOCUMENT_FIELDS)} SELECT doc_id, n_tokens, n_places, md5(vector) AS vector FROM vectors")
def document_tokens(d: Domain) -> DataFrame:
    return fulltext.vectors(document_texts(d), "doc_id", DOCUMENT_FIELDS).withColumn("vector", F.md5("vector"))


VIDEO = "CASE page_id % 8 WHEN 1 THEN 'abcde' || lpad(page_id::VARCHAR, 6, '0') WHEN 2 THEN 'ABCDE_' || lpad(page_id::VARCHAR, 5, '0') END"


@query("prj_04_video_id", f"SELECT page_id, {VIDEO} AS video FROM pages")
def video_ids(d: Domain) -> DataFrame:
    return odd_urls(d).select("page_id", text.video_id(F.col("url")).alias("video"))


@query("prj_05_thumbnail", f"SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN 'own.png' END, 'https://i.ytimg.com/vi/' || {VIDEO} || '/hqdefault.jpg') AS image FROM pages")
def thumbnails(d: Domain) -> DataFrame:
    own = F.when(F.col("page_id") % 3 == 0, F.lit("own.png"))
    return odd_urls(d).select("page_id", F.coalesce(own, F.concat(F.lit("https://i.ytimg.com/vi/"), text.video_id(F.col("url")), F.lit("/hqdefault.jpg"))).alias("image"))


@query(
    "prj_06_kind_path",
    """SELECT c_custkey, CASE c_custkey % 13 WHEN 0 THEN 'entity.agent.person' WHEN 1 THEN 'entity.agent.org.company' WHEN 2 THEN 'entity.agent.org.nonprofit' WHEN 3 THEN 'entity.agent.org.public_body' WHEN 4 THEN 'entity.agent.org' WHEN 5 THEN 'entity.artifact.product'
      WHEN 6 THEN 'entity.artifact.work' WHEN 7 THEN 'entity.place' WHEN 8 THEN 'entity.event' WHEN 9 THEN 'entity.source' ELSE 'entity' END AS path FROM customer""",
)
def kind_paths(d: Domain) -> DataFrame:
    """Every kind in turn, by a customer's number; an unknown one, another spelling and none at last."""
    kinds = F.array(*[F.lit(k) for k in hierarchy.KIND_PATHS], F.lit("other"), F.lit("Person"), F.lit(None).cast("string"))
    kind = F.get(kinds, (F.col("c_custkey") % 13).cast("int"))
    return d.raw("customer").select("c_custkey", hierarchy.kind_to_path(kind).alias("path"))


LABEL = "CASE c_custkey % 5 WHEN 0 THEN 'Luma: ' || c_name WHEN 1 THEN c_mktsegment || ': about ' || c_name || ': x' WHEN 2 THEN '  : no name' WHEN 3 THEN c_name || ':  ' ELSE c_name END"


def labelled_sources(d: Domain) -> DataFrame:
    n, name = F.col("c_custkey") % 5, F.col("c_name")
    label = F.when(n == 0, F.concat(F.lit("Luma: "), name)).when(n == 1, F.concat("c_mktsegment", F.lit(": about "), name, F.lit(": x"))).when(n == 2, F.lit("  : no name")).when(n == 3, F.concat(name, F.lit(":  ")))
    return d.raw("customer").select("c_custkey", "c_name", "c_mktsegment", label.otherwise(name).alias("label"), F.concat(F.lit("id"), "c_custkey").alias("identifier"))


@query("prj_07_source_name", "SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN c_mktsegment WHEN 2 THEN 'id' || c_custkey ELSE c_name END AS name FROM customer")
def source_names(d: Domain) -> DataFrame:
    return labelled_sources(d).select("c_custkey", text.source_name(F.col("label"), F.col("identifier")).alias("name"))


@query("prj_08_source_description", "SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'about ' || c_name || ': x' WHEN 2 THEN 'no name' END AS description FROM customer")
def source_descriptions(d: Domain) -> DataFrame:
    return labelled_sources(d).select("c_custkey", text.source_description(F.col("label")).alias("description"))


@query("prj_11_first_words", "SELECT p_partkey, regexp_replace(regexp_extract(lower('d''' || p_name), '[a-z](?:[a-z0-9''-]*[a-z0-9])?', 0), '^[dl]''', '') AS word FROM part")
def first_words(d: Domain) -> DataFrame:
    return d.raw("part").select("p_partkey", text.name_first_word(F.concat(F.lit("d’"), "p_name")).alias("word"))


@query("prj_12_source_types", f"SELECT page_id, CASE WHEN regexp_matches({HOST}, '(^|[.])example[.]com$') THEN 'shop' WHEN regexp_matches({HOST}, '(^|[.])example[.]net$') THEN 'news' ELSE 'direct_link' END AS kind FROM pages")
def source_types(d: Domain) -> DataFrame:
    names = d.raw("pages").withColumn("domain", urls.registrable(F.col("url")))
    kinds = d.spark.createDataFrame([("example.com", "shop"), ("example.net", "news")], "domain string, kind string")
    return names.join(F.broadcast(kinds), "domain", "left").select("page_id", F.coalesce("kind", F.lit("direct_link")).alias("kind"))


@query("prj_13_shown_domains", f"SELECT page_id, regexp_replace({HOST}, '[.][^.]*$', '') AS domain FROM ({ODD})")
def shown_domains(d: Domain) -> DataFrame:
    return odd_urls(d).select("page_id", urls.shown_domain(F.col("url")).alias("domain"))


@query("prj_14_posted_labels", "SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1998 THEN strftime(o_orderdate, '%b %-d') ELSE strftime(o_orderdate, '%b %-d, %Y') END || CASE WHEN o_orderkey % 3 = 0 THEN ' @user' || o_custkey ELSE ' shop · user' || o_custkey END AS label FROM orders")
def posted_labels(d: Domain) -> DataFrame:
    at = F.col("o_orderdate")
    day = F.when(F.year(at) == 1998, F.date_format(at, "MMM d")).otherwise(F.date_format(at, "MMM d, yyyy"))
    author = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("@user"), "o_custkey")).otherwise(F.concat(F.lit("user"), "o_custkey"))
    return d.raw("orders").select("o_orderkey", F.concat(day, F.lit(" "), F.when(author.startswith("@"), author).otherwise(F.concat(F.lit("shop · "), author))).alias("label"))


@query("prj_15_handle_kinds", "SELECT page_id, CASE WHEN page_id % 8 IN (1, 2) THEN 'entity.channel' WHEN page_id % 5 = 0 THEN 'entity.account' END AS kind FROM pages")
def handle_kinds(d: Domain) -> DataFrame:
    return odd_urls(d).select("page_id", F.when(text.video_id(F.col("url")).isNotNull(), "entity.channel").when(F.col("page_id") % 5 == 0, "entity.account").alias("kind"))


@query(
    "prj_17_public_https",
    """SELECT page_id, CASE page_id % 8 WHEN 0 THEN regexp_replace(regexp_replace(url, '^http:', 'https:'), '#.*$', '') WHEN 1 THEN 'https://www.youtube.com/watch?list=a&v=abcde' || lpad(page_id::VARCHAR, 6, '0')
      WHEN 2 THEN 'https://youtu.be/ABCDE_' || lpad(page_id::VARCHAR, 5, '0') || '?t=1' WHEN 3 THEN 'https://notyoutube.com/shorts/abcdefghij' || page_id % 10 END AS clean FROM pages""",
)
def public_links(d: Domain) -> DataFrame:
    return odd_urls(d).select("page_id", urls.public_https(F.col("url")).alias("clean"))


#: Work that a step still has to do, by its name.
STEPS = {"topics": "event_type = 'view'", "entities": "event_type = 'click' AND value > 50", "relations": "event_type IN ('view', 'click')", "none": "FALSE"}


@query("prj_18_step_filters", " UNION ALL ".join(f"SELECT '{k}' AS step, event_id FROM events WHERE {v}" for k, v in STEPS.items()))
def step_filters(d: Domain) -> DataFrame:
    case = F.lit(False)
    for name, condition in STEPS.items():
        case = F.when(F.col("step") == name, F.expr(condition)).otherwise(case)
    steps = d.raw("events").select("*", F.explode(F.array(*[F.lit(k) for k in STEPS])).alias("step"))
    return steps.where(case).select("step", "event_id")


@query("prj_19_null_safe", "SELECT page_id, nullif(page_id % 3, 0) IS NOT DISTINCT FROM nullif(page_id % 2, 0) AS same, nullif(page_id % 3, 0) IS DISTINCT FROM 1 AS other FROM pages")
def null_safe(d: Domain) -> DataFrame:
    a, b = F.nullif(F.col("page_id") % 3, F.lit(0)), F.nullif(F.col("page_id") % 2, F.lit(0))
    return d.raw("pages").select("page_id", a.eqNullSafe(b).alias("same"), (~a.eqNullSafe(F.lit(1))).alias("other"))


@query("prj_20_exactly_one", "SELECT page_id FROM pages WHERE (page_id % 2 = 0) <> (page_id % 3 = 0)")
def exactly_one(d: Domain) -> DataFrame:
    rows = d.raw("pages").select("page_id", F.when(F.col("page_id") % 2 == 0, 1).alias("a"), F.when(F.col("page_id") % 3 == 0, 1).alias("b"))
    return rows.where(F.col("a").isNull() != F.col("b").isNull()).select("page_id")


@query("prj_21_escaped_like", "SELECT event_id FROM events WHERE props || '50%_' LIKE '%: 1%0\\%\\_' ESCAPE '\\' AND contains(props || '50%_', '1}50%_')")
def escaped_like(d: Domain) -> DataFrame:
    said = F.concat("props", F.lit("50%_"))
    return d.raw("events").where(said.contains("1}50%_") & said.like("%: 1%0\\%\\_")).select("event_id")


@query("prj_22_implications", "SELECT o_orderkey FROM orders WHERE NOT ((o_orderstatus = 'O') = (o_totalprice > 200000))")
def implications(d: Domain) -> DataFrame:
    return d.raw("orders").where(~((F.col("o_orderstatus") == "O") == (F.col("o_totalprice") > 200000))).select("o_orderkey")


@query("prj_23_present", "SELECT page_id, concat_ws(';', CASE WHEN page_id % 2 = 0 THEN 'a=' || page_id END, CASE WHEN page_id % 3 = 0 THEN 'c=x' END) AS present FROM pages")
def present(d: Domain) -> DataFrame:
    row = F.create_map(F.lit("a"), F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")), F.lit("b"), F.lit(""), F.lit("c"), F.when(F.col("page_id") % 3 == 0, "x"))
    kept = F.map_filter(row, lambda k, v: v.isNotNull() & (v != ""))
    return d.raw("pages").select("page_id", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("present"))


@query("prj_25_web_url_past_date", f"SELECT page_id, CASE WHEN regexp_matches(trim(url), '(?i)^https?://[^/\\s]+') THEN trim(url) END AS url, CASE WHEN page_id % 4 < 2 THEN TIMESTAMP '2024-01-01' - to_days(page_id::INTEGER) END AS at FROM ({ODD})")
def past_dates(d: Domain) -> DataFrame:
    day = F.date_sub(F.lit("2024-01-01").cast("date"), F.col("page_id").cast("int"))
    said = F.when(F.col("page_id") % 4 < 2, day.cast("string")).when(F.col("page_id") % 4 == 2, F.lit("soon")).otherwise(F.lit("2999-01-01"))
    at = F.try_to_timestamp(said, F.lit("yyyy-MM-dd"))
    return odd_urls(d).select("page_id", urls.web_url(F.col("url")).alias("url"), F.when(at <= F.lit("2024-01-01").cast("timestamp"), at).alias("at"))


@query("prj_26_may_follow", "SELECT c_custkey, c_custkey % 4 <> 0 AS permanent, c_custkey % 4 <> 0 OR coalesce(allowed, FALSE) AS may_follow FROM customer LEFT JOIN (SELECT DISTINCT o_custkey, TRUE AS allowed FROM orders WHERE o_orderpriority LIKE '1%') ON o_custkey = c_custkey")
def may_follow(d: Domain) -> DataFrame:
    allowed = d.raw("orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("allowed")).distinct()
    permanent = F.col("c_custkey") % 4 != 0
    return d.raw("customer").join(allowed, "c_custkey", "left").select("c_custkey", permanent.alias("permanent"), (permanent | F.coalesce("allowed", F.lit(False))).alias("may_follow"))


@query("prj_27_host_of", f"SELECT page_id, {HOST} AS host FROM ({ODD})")
def host_of(d: Domain) -> DataFrame:
    return odd_urls(d).select("page_id", text.host(F.col("url")).alias("host"))


@query("prj_28_merge_fields", """SELECT s_suppkey, '{"name":"' || s_name || '"' || CASE WHEN s_acctbal > 3000 THEN ',"nation":' || s_nationkey ELSE '' END || '}' AS fields FROM supplier""")
def merge_fields(d: Domain) -> DataFrame:
    return d.raw("supplier").select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 3000, F.col("s_nationkey")).alias("nation"))).alias("fields"))


@query("fn_02_marks_stripped", "SELECT doc_id, md5(replace(replace(replace(lower(strip_accents(replace(text, '’', ''''))), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')) AS folded FROM documents")
def marks_stripped(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", F.md5(text.without_marks(F.col("text"))).alias("folded"))


@query("fn_03_compatible_fold", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def compatible_fold(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", F.md5(text.compatible(F.col("text"))).alias("folded"))


@query("fn_04_strings", "SELECT p_partkey, left(trim('  ' || p_name || ' '), 5) AS head, substr(p_name, 3, 4) AS middle, strpos(p_type, 'O') AS at, split_part(p_name, ' ', 2) AS second, replace(p_brand, '#', '-') AS brand, upper(p_name) || '!' AS loud FROM part")
def strings(d: Domain) -> DataFrame:
    name = F.col("p_name")
    return d.raw("part").select("p_partkey", F.left(F.trim(F.concat(F.lit("  "), name, F.lit(" "))), F.lit(5)).alias("head"), F.substring(name, 3, 4).alias("middle"), F.instr("p_type", "O").cast("long").alias("at"),
        F.split_part(name, F.lit(" "), F.lit(2)).alias("second"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), F.concat(F.upper(name), F.lit("!")).alias("loud"))


@query("fn_05_regular_expressions", "SELECT p_partkey, regexp_extract(p_brand, '#([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]+', '*', 'g') AS stars, regexp_matches(p_name, '^[a-m]') AS early, regexp_matches(p_type, '(?i)economy') AS economy FROM part")
def regular_expressions(d: Domain) -> DataFrame:
    return d.raw("part").select("p_partkey", F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("digits"), F.regexp_replace("p_name", "[aeiou]+", "*").alias("stars"), F.col("p_name").rlike("^[a-m]").alias("early"), F.col("p_type").rlike("(?i)economy").alias("economy"))


@query("fn_06_split_and_match", "SELECT doc_id, len(regexp_split_to_array(text, '\\n')) AS lines, len(regexp_extract_all(text, '[0-9]+')) AS numbers FROM documents")
def split_and_match(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", F.size(F.split("text", "\\n", -1)).cast("long").alias("lines"), F.regexp_count("text", F.lit("[0-9]+")).cast("long").alias("numbers"))


@query("fn_07_lengths_and_slices", "SELECT doc_id, length(text) AS chars, len(string_split(text, ' ')) AS words, array_to_string(string_split(text, ' ')[1:12], ' ') AS head FROM documents")
def lengths_and_slices(d: Domain) -> DataFrame:
    words = F.split("text", " ", -1)
    return d.raw("documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.size(words).cast("long").alias("words"), F.array_join(F.slice(words, 1, 12), " ").alias("head"))


@query("fn_09_entities_decoded", "SELECT page_id, 'A&B <i> ' || chr((65 + page_id % 20)::INTEGER) || ' \"q\" é' AS decoded FROM pages")
def entities_decoded(d: Domain) -> DataFrame:
    said = F.concat(F.lit("<t>A&amp;B &lt;i&gt; &#"), 65 + F.col("page_id") % 20, F.lit("; &quot;q&quot; &#xe9;</t>"))
    return d.raw("pages").select("page_id", text.decoded(text.tag_content(said, "t")).alias("decoded"))


@query("fn_10_calendar_lines", "SELECT page_id, 'Line ' || page_id || ', with; marks' || chr(10) || 'and \\ more' AS line FROM pages")
def calendar_lines(d: Domain) -> DataFrame:
    said = F.concat(F.lit("Li\r\n ne "), "page_id", F.lit("\\, with\\; ma\n\trks\\nand \\\\ more"))
    return d.raw("pages").select("page_id", text.calendar_text(said).alias("line"))


@query("fn_11_one_line", "SELECT p_partkey, 'a ' || p_name || ' b' AS line, '\\*' || replace(p_name, ' ', '\\_') || '\\[x\\]' AS escaped, replace(p_name, ' ', '%20') || '%2Fx' AS encoded FROM part")
def one_lines(d: Domain) -> DataFrame:
    name = F.col("p_name")
    return d.raw("part").select("p_partkey", text.one_line(F.concat(F.lit(" a\n\t"), name, F.lit("  b "))).alias("line"), text.markdown_escaped(F.concat(F.lit("*"), F.replace(name, F.lit(" "), F.lit("_")), F.lit("[x]"))).alias("escaped"), F.replace(F.url_encode(F.concat(name, F.lit("/x"))), F.lit("+"), F.lit("%20")).alias("encoded"))


@query("fn_12_contained_names", "SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = w[2] AND w[i + 1] = w[3])) > 0 AS inside, len(w) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(replace(lower(text), '’', ''''), '''s\\b', '', 'g'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)")
def contained_names(d: Domain) -> DataFrame:
    rows = d.raw("documents").select("doc_id", text.name_words(F.col("text")).alias("w"))
    return rows.select("doc_id", (F.size("w") > 2).__and__(text.contains_words(F.col("w"), F.slice("w", 2, 2))).alias("inside"), F.size("w").cast("long").alias("n"))


ABBREVIATED = r"(^|[^\p{L}])(\p{Lu}|" + "|".join(text.ABBREVIATIONS) + ")[.]"
#: DuckDB: the sentences of a text, as text.sentences cuts them.
SENTENCES = rf"""list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(text, '{ABBREVIATED}', '\1\2' || chr(1), 'g'), '{ABBREVIATED}', '\1\2' || chr(1), 'g'), '[.]+(?:\s+|$)|[!?;]+(?:\s+|$)|\n+'),
  lambda x: regexp_replace(replace(x, chr(1), '.'), '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""


@query("fn_13_sentences", f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS said FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def sentences(d: Domain) -> DataFrame:
    rows = d.raw("documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("said"))


GRAMS = "list_distinct(flatten(list_transform(string_split(p_name, ' '), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("fn_14_trigram_similarity", f"SELECT p_partkey, len({GRAMS}) AS n, len(list_intersect({GRAMS}, {GRAMS.replace('p_name', 'lower(p_type)')}))::DOUBLE / len(list_distinct(list_concat({GRAMS}, {GRAMS.replace('p_name', 'lower(p_type)')}))) AS similarity FROM part")
def trigram_similarity(d: Domain) -> DataFrame:
    a, b = search.trigrams(F.col("p_name")), search.trigrams(F.col("p_type"))
    return d.raw("part").select("p_partkey", F.size(a).cast("long").alias("n"), search.similarity(a, b).alias("similarity"))


@query("fn_15_dates", "SELECT event_id, epoch_us(ts) AS micros, (epoch_us(ts) // 60000000)::BIGINT AS minute, date_trunc('day', ts)::DATE AS day, (date_trunc('day', ts)::DATE - DATE '2024-01-01')::BIGINT AS days, ts + INTERVAL 36 HOUR AS later FROM events")
def dates(d: Domain) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return d.raw("events").select("event_id", F.unix_micros(at).alias("micros"), F.floor(F.unix_micros(at) / 60_000_000).cast("long").alias("minute"), F.to_date(at).alias("day"), F.datediff(F.to_date(at), F.lit("2024-01-01")).cast("long").alias("days"), (at + F.expr("INTERVAL 36 HOURS")).alias("later"))


@query("fn_16_as_of", "SELECT count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-15'")
def as_of(d: Domain) -> DataFrame:
    """The time of a query is an argument, never the clock, so that reruns agree."""
    now = F.lit("2024-01-15").cast("timestamp")
    return d.raw("events").where(F.col("ts").cast("timestamp") <= now).agg(F.count(F.lit(1)).alias("n"))


@query("fn_17_wall_clock", "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris' AS paris, (ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS from_new_york FROM events")
def wall_clock(d: Domain) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return d.raw("events").select("event_id", F.from_utc_timestamp(at, "Europe/Paris").alias("paris"), F.to_utc_timestamp(at, "America/New_York").alias("from_new_york"))


@query(
    "fn_18_nearest_year",
    """WITH c AS (SELECT o_orderkey, make_date((year(o_orderdate) + k)::BIGINT, ((o_orderkey % 12) + 1)::BIGINT, ((o_orderkey % 28) + 1)::BIGINT) AS day, CAST(o_orderdate AS DATE) AS ref, k FROM orders, (VALUES (0), (1), (-1)) t(k))
    SELECT o_orderkey, arg_min(day, (abs(day - ref), CASE WHEN day >= ref THEN 0 ELSE 1 END)) AS day FROM c GROUP BY 1""",
)
def nearest_year(d: Domain) -> DataFrame:
    ref = F.to_date("o_orderdate")
    return d.raw("orders").select("o_orderkey", text.nearest_date((F.col("o_orderkey") % 12 + 1).cast("int"), (F.col("o_orderkey") % 28 + 1).cast("int"), ref).alias("day"))


@query("fn_19_numbers", "SELECT s_suppkey, power(s_acctbal / 1000, 2) AS square, exp(-s_nationkey / 10.0::DOUBLE) AS decay, ln(1 + s_nationkey) AS log, least(s_nationkey, 9) AS least, greatest(s_acctbal, 0) AS greatest, coalesce(nullif(s_nationkey, 1), -1) AS other FROM supplier")
def numbers(d: Domain) -> DataFrame:
    n, b = F.col("s_nationkey"), F.col("s_acctbal")
    return d.raw("supplier").select("s_suppkey", F.pow(b / 1000, F.lit(2)).alias("square"), F.exp(-n / 10.0).alias("decay"), F.log(1 + n).alias("log"), F.least(n, F.lit(9)).alias("least"), F.greatest(b, F.lit(0.0)).alias("greatest"), F.coalesce(F.nullif(n, F.lit(1)), F.lit(-1)).alias("other"))


@query("fn_20_shares", "SELECT p_brand, count(*) FILTER (p_size > 25) AS large, CASE WHEN count(*) FILTER (p_size > 49) > 0 THEN count(*) FILTER (p_size > 25)::DOUBLE / count(*) FILTER (p_size > 49) END AS share FROM part GROUP BY 1")
def shares(d: Domain) -> DataFrame:
    return d.raw("part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 25).alias("large"), F.try_divide(F.count_if(F.col("p_size") > 25), F.count_if(F.col("p_size") > 49)).alias("share"))


@query("fn_21_bits", "SELECT event_id, (event_id >> 3) AS shifted, bit_count(xor(event_id, user_id))::BIGINT AS apart FROM events")
def bits(d: Domain) -> DataFrame:
    return d.raw("events").select("event_id", F.shiftright("event_id", 3).alias("shifted"), F.bit_count(F.col("event_id").bitwiseXOR(F.col("user_id"))).cast("long").alias("apart"))


@query("fn_22_hashes", "SELECT c_custkey, sha256(c_name) AS sha256, md5(c_name) AS md5 FROM customer")
def hashes(d: Domain) -> DataFrame:
    return d.raw("customer").select("c_custkey", F.sha2("c_name", 256).alias("sha256"), F.md5("c_name").alias("md5"))


@query("fn_23_paths", "SELECT link_id, len(string_split(topic, '.')) AS levels, split_part(topic, '.', 1) AS root, array_to_string(string_split(topic, '.')[2:], '.') AS rest, starts_with(topic || '.', 'ECONOMY.') AS economy, list_position(string_split(topic, '.'), 'Brand5') AS at FROM labelled")
def paths(d: Domain) -> DataFrame:
    parts = F.split("topic", r"\.")
    return d.labels().select("link_id", F.size(parts).cast("long").alias("levels"), F.get(parts, F.lit(0)).alias("root"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), ".").alias("rest"), F.concat("topic", F.lit(".")).startswith("ECONOMY.").alias("economy"), F.nullif(F.array_position(parts, "Brand5"), F.lit(0)).cast("int").alias("at"))


@query("fn_24_ranges", "SELECT event_id, coalesce(starts_on, DATE '0001-01-01') <= DATE '1998-12-31' AND coalesce(ends_on, starts_on, DATE '9999-12-31') >= DATE '1998-06-01' AS overlaps FROM calendar")
def ranges(d: Domain) -> DataFrame:
    lower, upper = F.coalesce("starts_on", F.lit("0001-01-01").cast("date")), F.coalesce("ends_on", "starts_on", F.lit("9999-12-31").cast("date"))
    return d.calendar().select("event_id", ((lower <= F.lit("1998-12-31").cast("date")) & (upper >= F.lit("1998-06-01").cast("date"))).alias("overlaps"))


@query("fn_25_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has_k, json_type(props) AS kind, '{"k":' || json_extract(props, '$.k') || ',"id":' || event_id || '}' AS built FROM events""")
def json_values(d: Domain) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    parsed = F.from_json("props", "k bigint")
    return d.raw("events").select("event_id", k.alias("k"), F.array_contains(F.json_object_keys("props"), "k").alias("has_k"), F.when(parsed.isNotNull(), "OBJECT").alias("kind"), F.to_json(F.struct(parsed["k"].alias("k"), F.col("event_id").alias("id"))).alias("built"))


@query("fn_26_arrays", "SELECT user_id, count(*) AS n, bool_or(event_type = 'error') AS any_error, bool_and(event_type <> 'signup') AS no_signup FROM events GROUP BY 1")
def arrays(d: Domain) -> DataFrame:
    rows = d.raw("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.sum("n").alias("n"), F.collect_list("event_type").alias("kinds"))
    return rows.select("user_id", "n", F.exists("kinds", lambda x: x == "error").alias("any_error"), F.forall("kinds", lambda x: x != "signup").alias("no_signup"))


@query("fn_27_formats", "SELECT c_custkey, 'Customer ' || c_custkey || ' of ' || c_mktsegment AS said, string_split(c_name, '#')[2] AS number FROM customer")
def formats(d: Domain) -> DataFrame:
    return d.raw("customer").select("c_custkey", F.format_string("Customer %d of %s", "c_custkey", "c_mktsegment").alias("said"), F.get(F.split("c_name", "#"), F.lit(1)).alias("number"))


@query("fn_29_casts", "SELECT event_id, TRY_CAST(value::VARCHAR AS DOUBLE) AS number, TRY_CAST(props AS INTEGER) AS none, CAST(value AS INTEGER)::BIGINT - CAST(value AS INTEGER) AS zero, CAST(strftime(ts, '%Y-%m-%d') AS DATE) AS day FROM events")
def casts(d: Domain) -> DataFrame:
    return d.raw("events").select("event_id", F.col("value").cast("string").try_cast("double").alias("number"), F.col("props").try_cast("int").alias("none"), (F.col("value").cast("int").cast("long") - F.col("value").cast("int")).alias("zero"), F.date_format("ts", "yyyy-MM-dd").cast("date").alias("day"))


@query("fn_30_guards", "SELECT count(*) AS n FROM events")
def guards(d: Domain) -> DataFrame:
    """must raises where a condition fails or is null, refuse where it holds; neither does here."""
    rows = d.raw("events").select(text.must(F.col("value").isNotNull(), F.col("event_id"), "an event needs a value").alias("event_id"))
    return rows.select(text.refuse(F.col("event_id") < 0, F.col("event_id"), "ids are not negative").alias("event_id")).agg(F.count("event_id").alias("n"))


@query("fn_31_maps", "SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END)::BIGINT AS views, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def maps(d: Domain) -> DataFrame:
    rows = d.raw("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return rows.select("user_id", F.coalesce(F.try_element_at("m", F.lit("view")), F.lit(0)).cast("long").alias("views"), F.size("m").cast("long").alias("kinds"))


@query("fn_32_tokens", "SELECT c_nationkey, count(*) AS ids, count(*) AS well_formed FROM customer GROUP BY 1")
def tokens(d: Domain) -> DataFrame:
    """Random ids: none twice in a group, all of version 4 and its variant."""
    rows = d.raw("customer").select("c_nationkey", F.expr("uuid()").alias("id"))
    good = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    each = rows.withColumn("good", good).groupBy("c_nationkey", "id").agg(F.sum(good.cast("long")).alias("good"))
    return each.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("ids"), F.sum("good").alias("well_formed"))


@query("fn_33_smoothing", "SELECT link_id, round((sum(CASE WHEN value = 1 THEN 1 ELSE 0 END) + 1)::DOUBLE / (count(*) + 2), 3) AS p FROM votes GROUP BY 1")
def smoothing(d: Domain) -> DataFrame:
    return d.votes().groupBy("link_id").agg(F.round((F.count_if(F.col("value") == 1) + 1) / (F.count(F.lit(1)) + 2), 3).alias("p"))


@query(
    "fn_35_sense_labels",
    """WITH g AS (SELECT n_regionkey AS g, list(n_name ORDER BY n_nationkey) AS names, list_distinct(list(r_name || '.' || (n_nationkey % 2))) AS kinds, min(r_name) AS root FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
    SELECT g, CASE WHEN len(list_distinct(names)) = 1 THEN names[1] || ' ×' || len(names) WHEN len(kinds) = 1 THEN kinds[1] || ' ×' || len(names) ELSE root || ' ×' || len(names) END AS label FROM g""",
)
def sense_labels(d: Domain) -> DataFrame:
    nations = d.raw("nation").join(d.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return text.sense_labels(nations.select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("name"), F.concat("r_name", F.lit("."), F.col("n_nationkey") % 2).alias("kind_path")), "g")


@query("fn_36_html_text", "SELECT page_id, 'A & B' AS plain, 'One Two é' AS blocks, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def html_text(d: Domain) -> DataFrame:
    return d.raw("pages").select("page_id", text.decoded(text.tags_cut(F.lit("A <b>&amp;</b> B"))).alias("plain"), text.html_to_text(F.lit("<p>One</p><p>Two&nbsp;<i>&eacute;</i></p>")).alias("blocks"), text.one_line(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


@query("fn_37_vectors", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: 3 * x::DOUBLE)) AS total, TRUE AS close FROM embeddings")
def vector_sums(d: Domain) -> DataFrame:
    from tidemark.operators import vectors

    rows = d.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    triple = vectors.add(F.col("v"), vectors.scale(F.col("v"), 2.0))
    return rows.select("vec_id", F.aggregate(triple, F.lit(0.0), lambda a, x: a + x).alias("total"), vectors.close(triple, vectors.scale(F.col("v"), 3.0), 1e-9).alias("close"))


@query("win_01_analytic", "SELECT event_id, lag(value) OVER w AS before, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three, rank() OVER (PARTITION BY user_id ORDER BY event_type) AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def analytic(d: Domain) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return d.raw("events").select("event_id", F.lag("value").over(w).alias("before"), F.sum("value").over(w.rowsBetween(-2, 0)).alias("three"), F.rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("long").alias("rank"))
