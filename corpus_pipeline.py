"""A training corpus from the documents table: the stages in order, each the next one's input.

Language id drops documents without a letter or without a clear language; line dedup leaves lines that
stand in many documents in the first of them only; near-dedup keeps one document of each group; mixing takes each source's
documents as often as its target asks; the last stage encodes what is left and decodes it again.

Odd rows: null texts and texts without a letter leave in the first stage. Rows without an id stay through all
stages (near-dedup never takes them for copies). Repeated rows are documents of their own: the second of two equal rows
keeps its lines and, as both carry the same id, both stay in near-dedup. Texts that lose all lines stay empty until the
mix, which never takes a document without words. Extra columns stay up to the mix whatever their names; n_chars
follows the text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, curriculum_mix, lang_id, line_dedup, near_dup
from tidemark.llm import sentencepiece_codec as codec

#: Documents whose best language has a smaller share than this are rejected.
CLEAR = 0.5
#: Lines in at least this many documents stay in the first of them only.
LINE_DOCUMENTS = 10
#: Near duplicates share this much of their five-word shingles.
SHINGLE, PERCENT = 5, 80


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the number of characters of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))
    return docs.select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a clear language; the model learns from the labelled ones."""
    model = lang_id.fit(docs)
    found = lang_id.identify(docs, model)
    return found.where((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= CLEAR)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; the first of them keeps its own."""
    return _with_text(line_dedup.dedup(docs, min_docs=LINE_DOCUMENTS), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.dedup(docs, SHINGLE, PERCENT).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in training order."""
    return curriculum_mix.training_order(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The SentencePiece ids of each document and the text they decode to."""
    import public_tokenizers

    model = codec.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    return codec.round_trip(docs, model)


STAGES = [
    ("language id", identify_language),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot express the learnt and hashed stages; tests hold run() against a pipeline of plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = common.staged(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
