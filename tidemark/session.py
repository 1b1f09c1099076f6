"""A session with the settings that the operators assume, and the folder that its processes share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", partitions: int = 8, name: str = "tidemark") -> SparkSession:
    """UTC, adaptive execution, Arrow. On a cluster, set partitions to a few times its cores."""
    return (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset and driver and executors are one process, as in tests, a temporary folder takes its place;
    a cluster must name one, since a folder of one machine is not seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(spark, "_tidemark_folder", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
        spark._tidemark_folder = folder
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back.

    This cuts the lineage: an executor lost later costs no recomputation of df,
    and both sides of a later join start from plain scans.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
