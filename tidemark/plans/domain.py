"""The link-ranking domain built from star-schema tables, so that every operator runs on them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import staged

VIEWER = 1
AS_OF = datetime(2001, 12, 31)
HALF_LIFE_DAYS = 365.0


class Domain:
    """Lazily built tables of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._facts: DataFrame | None = None

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def with_facts(self) -> Domain:
        """The same domain with the join of lines and orders staged once, for queries that take several tables from it."""
        out = Domain(self.spark, self.sf_dir)
        out._facts = staged(self._sold().select("l_partkey", "o_custkey", "o_orderdate", "l_returnflag", "l_linenumber", "l_quantity"), "facts")
        return out

    def _sold(self) -> DataFrame:
        if self._facts is not None:
            return self._facts
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return self.raw("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def links(self) -> DataFrame:
        """(link_id, title, created_at, brand): parts that were ordered, since their first order."""
        first = self._sold().groupBy(F.col("l_partkey").alias("link_id")).agg(F.min("o_orderdate").alias("created_at"))
        parts = self.raw("part").select(F.col("p_partkey").alias("link_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))
        return parts.join(first, "link_id").select("link_id", "title", "created_at", "brand")

    def labels(self) -> DataFrame:
        """(link_id, topic, p): one path type.brand.name for each part."""
        topic = F.concat_ws(".", "p_type", F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("_")))
        return self.raw("part").select(F.col("p_partkey").alias("link_id"), topic.alias("topic"), (0.5 + (F.col("p_size") % 50) / 100.0).alias("p"))

    def suggestions(self) -> DataFrame:
        """(link_id, topic, p, suggested_by): customers' own labels from their seventh order lines."""
        sold = self._sold().where("l_linenumber = 7").join(self.labels().select(F.col("link_id").alias("l_partkey"), "topic"), "l_partkey")
        topic = F.when(F.col("l_quantity") < 25, F.col("topic")).otherwise(F.concat(F.split_part("topic", F.lit("."), F.lit(1)), F.lit(".Own")))
        rows = sold.select(F.col("l_partkey").alias("link_id"), topic.alias("topic"), F.col("o_custkey").alias("suggested_by"))
        return rows.distinct().withColumn("p", F.lit(0.9))

    def votes(self) -> DataFrame:
        """(voter, link_id, value): -1 for parts that a customer ever returned, else 1."""
        rows = self._sold().groupBy(F.col("o_custkey").alias("voter"), F.col("l_partkey").alias("link_id"))
        return rows.agg(F.min(F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("value"))

    def overrides(self) -> DataFrame:
        """(user_id, topic_id, score)."""
        rows = self.raw("customer").where("c_custkey % 3 = 1")
        return rows.select(F.col("c_custkey").alias("user_id"), F.lit("STANDARD").alias("topic_id"), ((F.col("c_custkey") % 10) / 10.0).alias("score"))

    def entities(self) -> DataFrame:
        """(entity_id, name, kind_path): suppliers under region.nation."""
        nations = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        path = F.concat_ws(".", F.replace("r_name", F.lit(" "), F.lit("_")), "n_name")
        rows = self.raw("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        return rows.select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), path.alias("kind_path"))

    def mentions(self) -> DataFrame:
        """(link_id, entity_id, p, in_title): a part's suppliers; in the title where the first line number is small."""
        rows = self.raw("lineitem").groupBy(F.col("l_partkey").alias("link_id"), F.col("l_suppkey").alias("entity_id"))
        return rows.agg((0.5 + F.max("l_discount")).alias("p"), (F.min("l_linenumber") <= 2).alias("in_title"))

    def mentioned(self) -> DataFrame:
        """(link_id, entity_id) of mentions, each as often as it is said: for callers that count what is distinct themselves."""
        return self.raw("lineitem").select(F.col("l_partkey").alias("link_id"), F.col("l_suppkey").alias("entity_id"))

    def evidence(self) -> DataFrame:
        """(subject, object, relation, p, status, created_at, seq): one row for each order line."""
        return self.raw("lineitem").select(
            F.col("l_suppkey").alias("subject"),
            F.col("l_partkey").alias("object"),
            F.col("l_linestatus").alias("relation"),
            (F.col("l_discount") * 5 + 0.1).alias("p"),
            F.col("l_returnflag").alias("status"),
            F.col("l_shipdate").alias("created_at"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        )

    def calendar(self) -> DataFrame:
        """(event_id, link_id, starts_on, ends_on, start_hour): order lines as events; some timed, some long, some open."""
        key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        day = F.to_date("l_shipdate")
        return self.raw("lineitem").select(
            key.alias("event_id"),
            F.col("l_partkey").alias("link_id"),
            F.when(key % 11 != 0, day).alias("starts_on"),
            F.when(key % 3 == 0, F.date_add(day, F.col("l_quantity").cast("int"))).alias("ends_on"),
            F.when(key % 2 == 0, (key % 24).cast("int")).alias("start_hour"),
        )
