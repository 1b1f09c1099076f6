"""Structured Streaming operators, each with a batch twin of the same name ending in _batch where it differs.

Sources are file streams; windows close by watermark, so state stays bounded. `finished` runs a stream
over what is there now (available-now trigger) and returns the result table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import shared_folder

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 1) -> DataFrame:
    """A stream of a folder's event files."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def staged_stream(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """A stream over tables written one after the other into a folder of the shared folder: files in the order of the parts."""
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    for part in parts:
        part.select(*(F.col(f.name).cast(f.dataType) for f in EVENTS)).write.mode("append").parquet(folder)
    return read_events(spark, folder, "*.parquet")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, user_id, n) of sliding windows, for rate limits."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "user_id")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n) of sessions that end with a gap."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return rows.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without repeats of their keys; state is kept for the watermark's delay only."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def retracting_counts(changes: DataFrame, key: str) -> DataFrame:
    """(key, n): counts of a change stream (key, sign), where sign -1 takes an earlier row back."""
    return changes.groupBy(key).agg(F.sum("sign").alias("n"))


def followed_by_state(events: DataFrame, timeout_minutes: int | None = None) -> DataFrame:
    """(user_id, event_type, n): each user's last action and how many came so far, by arbitrary state.

    With a timeout, users that are quiet for so long are forgotten; such a stream never ends by itself.
    """

    def step(key, batches, state):
        import pandas as pd

        n, last, at = state.get if state.exists else (0, "", datetime(1970, 1, 1))
        if state.hasTimedOut:
            state.remove()
            return
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"])
            if len(pdf):
                n += len(pdf)
                if pdf["ts"].iloc[-1].to_pydatetime() >= at:
                    last, at = pdf["event_type"].iloc[-1], pdf["ts"].iloc[-1].to_pydatetime()
        state.update((n, last, at))
        if timeout_minutes:
            state.setTimeoutDuration(timeout_minutes * 60_000)
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [last], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_type string, n long", "n long, last string, at timestamp", "update", "ProcessingTimeTimeout" if timeout_minutes else "NoTimeout")


def finished(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """The result of a stream over the data that is there now. Append leaves windows out that may still grow.

    Results and checkpoint are Parquet in the shared folder. Append goes to a file sink; each batch of the
    other modes is a version of its own, of which complete's last one counts, and update's all.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows, versions = f"{folder}/rows", []

    def version(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/{number}")  # a batch that is run again overwrites itself
        if f"{rows}/{number}" not in versions:
            versions.append(f"{rows}/{number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if each or mode != "append":
        running = writer.foreachBatch(each or version).start()
    else:
        running = writer.format("parquet").start(rows)
    running.awaitTermination()
    if each:
        return spark.range(0)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(rows)
    found = versions[-1:] if mode == "complete" else versions
    return spark.read.schema(stream.schema).parquet(*found) if found else spark.createDataFrame([], stream.schema)


def continued(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> None:
    """One scheduled run: what is new since the checkpoint under folder, then an end. A batch goes to folder/rows/batch=number.

    A run that breaks off in a batch leaves it uncommitted; the next run does that batch again and overwrites what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(each or write).start().awaitTermination()


def growing(spark: SparkSession, parts: list[DataFrame], run: Callable[[str, int], None]) -> None:
    """Writes each part into a growing folder and calls run(folder, number) after it."""
    folder = f"{shared_folder(spark)}/growing-{uuid.uuid4().hex}"
    for number, part in enumerate(parts):
        part.write.mode("append").parquet(folder)
        run(folder, number)


def upsert_into(spark: SparkSession, folder: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink: each batch makes a new version of the table under folder, the last row of each key winning.

    A version is named by its batch, so that a batch that is run again overwrites itself: exactly once.
    """
    from tidemark.operators.edits import latest_version

    def each(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/version={number - 1}").unionByName(batch)
        latest_version(rows, keys, *order).write.mode("overwrite").parquet(f"{folder}/version={number}")

    return each
