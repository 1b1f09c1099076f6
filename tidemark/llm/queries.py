"""The queries of this subpackage: each operator with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import sentencepiece_codec as codec

    model = codec.read_model(_tokenizer("piece_bpe_32k.model"))
    rows = codec.round_trip(_table(spark, sf_dir, "documents"), model)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import secret_scan

    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in secret_scan.BASE]

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import token_files

    with open(_tokenizer("word_bpe_49k.json"), encoding="utf-8") as file:
        spec = file.read()
    frames = token_files.write(_table(spark, sf_dir, "documents"), spec, end=1)
    return token_files.read(frames).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import near_dup

    return near_dup.find(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is held out: crc32 of its id as text has the remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import lang_id

    docs = _table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(~held_out()))
    return lang_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import line_dedup

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup(docs, min_docs=10, min_chars=1, keep_first=False)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
  FROM documents
), keyed AS (
  SELECT doc_id, n, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), fates AS (
  SELECT doc_id, n, line, key IN (SELECT key FROM repeated) AS gone FROM keyed
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM fates GROUP BY doc_id
"""


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import permutation_ann

    return permutation_ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import pivot_topk

    return pivot_topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP8_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import html_extract

    return html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import curriculum_mix

    mixed = curriculum_mix.by_position(curriculum_mix.mix(_table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source
), weighted AS (
  SELECT *, 1 + (n - 1) % 3 AS weight, CAST(3 * source_size AS DOUBLE) / (1 + (n - 1) % 3) AS by_weight FROM sources
), limits AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0)) AS rest,
         (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS rest_weight
  FROM weighted WINDOW w AS (ORDER BY by_weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cuts AS (
  SELECT *, 3 * source_size * rest_weight < weight * rest AS cut FROM limits
), aims AS (
  SELECT source, source_size, CASE WHEN cut THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(weight * (SELECT arg_min(rest, (by_weight, n)) FROM cuts WHERE NOT cut) AS DOUBLE)
              / CAST((SELECT arg_min(rest_weight, (by_weight, n)) FROM cuts WHERE NOT cut) AS DOUBLE) END AS target
  FROM cuts
), placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(CAST(s.doc_id AS VARCHAR)), s.doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
         CASE WHEN a.source_size > 0 THEN CAST(floor(a.target / a.source_size) AS BIGINT) ELSE 0 END AS rounds
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN size * (rounds + CASE WHEN CAST(2 * start + size AS DOUBLE) < 2 * (target - CAST(rounds * source_size AS DOUBLE)) THEN 1 ELSE 0 END)
            ELSE 0 END::BIGINT AS taken
FROM placed
"""

def op11_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import line_quality

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = line_quality.fit(docs, labels.where(~held))
    return line_quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "quality")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import turn_repair

    found = turn_repair.repair(turn_repair.damage(_table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))


#: By recursion over rows and the four endings, with moves and inserts as tables; the repaired turns come from running counts.
OP12_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT b, b AS crc, 0 AS step FROM (SELECT unnest(range(256)) AS b)
  UNION ALL
  SELECT b, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, step + 1 FROM bytes WHERE step < 8
), crcs AS (SELECT list(crc ORDER BY b) AS entries FROM bytes WHERE step = 8
), keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), keys AS (SELECT DISTINCT key FROM keyed
), hashes AS (
  SELECT key, 0 AS i, 4294967295 AS crc FROM keys
  UNION ALL
  SELECT key, i + 1, xor(crc >> 8, (SELECT entries FROM crcs)[1 + (xor(crc, ascii(substr(key, i + 1, 1))) & 255)]) FROM hashes WHERE i < length(key)
), kinds AS (SELECT key, xor(crc, 4294967295) % 20 AS kind FROM hashes WHERE i = length(key)
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM keyed JOIN kinds USING (key), unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER w AS n,
         substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), again AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS again FROM placed
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM again
), counted AS (
  SELECT c.conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(n) AS rows
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN judged j ON c.conv_id IS NOT DISTINCT FROM j.conv_id GROUP BY c.conv_id
), moves(prev, state, letter) AS (
  VALUES ('e', 'e', ''), ('s', 's', ''), ('u', 'u', ''), ('a', 'a', ''), ('e', 's', 's'), ('e', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')
), inserts(prev, state, added) AS (
  VALUES ('e', 'e', ''), ('s', 's', ''), ('u', 'u', ''), ('a', 'a', ''), ('e', 'u', 'I'), ('e', 'a', 'II'), ('s', 'u', 'I'), ('s', 'a', 'II'), ('u', 'a', 'I'), ('a', 'u', 'I')
), best AS (
  SELECT conv_id, 0 AS n, state, CAST(2 * length(added) AS BIGINT) AS cost, added AS audit FROM counted, inserts WHERE prev = 'e'
  UNION ALL
  SELECT conv_id, n, state, min(cost), arg_min(audit, (cost, audit)) FROM (
    SELECT b.conv_id, j.n, ins.state, b.cost + 2 * length(ins.added)
             + CASE WHEN m.letter = '' THEN 3 ELSE CAST(j.fault = 'truncated' AS BIGINT) + CASE WHEN m.letter = j.initial THEN 0 ELSE 2 END END AS cost,
           b.audit || CASE WHEN m.letter = '' THEN 'D' WHEN m.letter = j.initial THEN 'K' ELSE 'R' END || ins.added AS audit
    FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.n = b.n + 1
    JOIN moves m ON m.prev = b.state AND (m.letter = '' OR j.fault NOT IN ('blank', 'duplicate') AND (m.letter <> 's' OR j.initial = 's'))
    JOIN inserts ins ON ins.prev = m.state
  ) GROUP BY conv_id, n, state
), chosen AS (
  SELECT c.*, b.cost, b.audit FROM counted c JOIN (
    SELECT conv_id, n, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit FROM best WHERE state IN ('e', 'a') GROUP BY conv_id, n
  ) b ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.rows = b.n
), letters AS (
  SELECT conv_id, i, substr(audit, i, 1) AS letter FROM chosen, unnest(range(1, length(audit) + 1)) AS t(i)
), reads AS (
  SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS n, count(*) FILTER (WHERE letter <> 'D') OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), written AS (
  SELECT r.conv_id, r.i, place, letter, j.role, CASE WHEN letter = 'I' THEN '' ELSE j.text END AS text,
         max(CAST(place = 1 AND letter = 'K' AND j.initial = 's' AS INTEGER)) OVER (PARTITION BY r.conv_id) AS headed
  FROM reads r LEFT JOIN judged j ON r.conv_id IS NOT DISTINCT FROM j.conv_id AND r.n = j.n WHERE letter <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place + headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS body
  FROM written GROUP BY conv_id
)
SELECT c.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM chosen c LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import whitening

    vectors = whitening.integers(_table(spark, sf_dir, "embeddings"))
    return whitening.by_component(vectors, whitening.fit(vectors))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_files": op3_token_files,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language": op5_language,
    "op6_line_dedup": op6_line_dedup,
    "op7_nearest": op7_nearest,
    "op8_exact_topk": op8_exact_topk,
    "op9_html_text": op9_html_text,
    "op10_source_mix": op10_source_mix,
    "op11_line_quality": op11_line_quality,
    "op12_turn_repair": op12_turn_repair,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {"op6_line_dedup": OP6_SQL, "op8_exact_topk": OP8_SQL, "op10_source_mix": OP10_SQL, "op12_turn_repair": OP12_SQL}
