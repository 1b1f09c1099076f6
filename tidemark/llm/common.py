"""What the operators of this subpackage share: batches and staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.session import shared_folder

#: The white space that separates words and is stripped from lines: \x20 and \x09-\x0D.
#: bytes.split() and bytes.strip() use exactly these.
WHITE = b" \t\n\r\x0b\x0c"

#: The same as a regular expression for one word, for Spark and DuckDB.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows in an Arrow batch, at most: whole texts are long, and both the JVM and Python hold a batch at a time.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, after lowering its session's Arrow batches to BATCH_ROWS where they are larger."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(setting)) <= BATCH_ROWS:
        conf.set(setting, str(BATCH_ROWS))
    return df


def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; after each one's use Arrow gives back what it no longer needs, as workers live on."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, name: str) -> str:
    """name, or the next one with more underscores that df has no column of (case does not tell columns apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Rows of keys and numbers that a task of a small table has, about; and of texts or sets.
TASK_ROWS, TASK_TEXTS = 100_000, 8_000


def staged(df: DataFrame, name: str, rows: int | None = None, each: int = TASK_ROWS) -> DataFrame:
    """Write df to a new table in the shared folder and read it back.

    This cuts the lineage: an executor lost later costs no recomputation of df,
    and both sides of a later join start from plain scans.

    rows is an upper bound of df's rows, where one is known: a small table is then written by a task for each
    `each` rows, not by one for every shuffle partition, each with a file of its own. Large tables stay as they are.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        tasks = max(1, -(-rows // each))
        if tasks < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
