"""Tables in versions: what changed is written, a manifest names what is valid, and only one writer makes the next version.

A manifest is a small JSON file named by its number. Publishing number n + 1 renames a draft to that name without overwriting: where two
writers start from version n, one of them finds the name taken and gets `Conflict`; it reads again and tries again. (Stores
without an exclusive rename need a lock beside it.) Readers take the highest number; parts are never changed once a manifest names them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.change_index import KEPT, MOST_BEHIND


class Conflict(RuntimeError):
    """Another writer has published the version that this one wanted to make."""


class Refused(RuntimeError):
    """The change may not be published."""


class Manifests:
    """Numbered JSON files under a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        place = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(place):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(place))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, number: int | None = None) -> dict | None:
        """The newest manifest, or the one of that number; None, if there is none."""
        if number is None:
            known = self.numbers()
            if not known:
                return None
            number = known[-1]
        file = self._fs.open(self._path(f"{self.folder}/manifests/{number}.json"))
        try:
            return json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def publish(self, manifest: dict, base: dict | None) -> dict:
        """manifest as the version after base. The file is written whole under another name first; the last step is exclusive."""
        number = base["version"] + 1 if base else 0
        manifest = manifest | {"version": number}
        target, draft = (self._path(f"{self.folder}/manifests/{name}") for name in (f"{number}.json", f".{uuid.uuid4().hex}"))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        plain = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # without leave to overwrite
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), plain)
        except Exception as taken:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                raise Conflict(f"version {number} is there already") from taken
            raise
        return manifest

    def drop(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def update(self, change: Callable[[dict | None], dict | None], tries: int = 20) -> dict | None:
        """Publishes change(newest manifest), again from the start after a conflict; a change that gives None publishes nothing."""
        for _ in range(tries):
            base = self.read()
            wanted = change(base)
            if wanted is None:
                return base
            try:
                return self.publish(wanted, base)
            except Conflict:
                continue
        raise Conflict(f"lost {tries} times")


class MaintainedView:
    """Count, sum and distinct items by key, kept up to date by signed changes.

    State: for each key and item how often it is there and its sum; for each key n, total and the number of items that are there.
    Both are cut into buckets by a hash of the key, and a batch rewrites only the buckets that it touches. Counts add up in
    any order: a row may be taken back before it comes. A batch's number is in the manifest, so that a batch that is run
    again changes nothing. Sums are decimals and exact.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[tuple[str, str]], item: tuple[str, str], buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.keys, self.item = [k for k, _ in keys], item[0]
        names = ", ".join(f"{k} {kind}" for k, kind in keys)
        self.schemas = {"items": f"{names}, {item[0]} {item[1]}, n bigint, total decimal(38,6)", "view": f"{names}, n bigint, total decimal(38,6), items bigint"}
        self.manifests = Manifests(spark, folder)

    def _read(self, manifest: dict | None, table: str, buckets: Sequence[int] | None = None) -> DataFrame:
        parts = manifest["parts"] if manifest else {}
        paths = [f"{folder}/{table}/bucket={b}" for b, folder in parts.items() if buckets is None or int(b) in buckets]
        # A bucket that has lost its last row has no files.
        return self.spark.read.schema(self.schemas[table]).option("ignoreMissingFiles", True).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[table])

    def read(self, version: int | None = None) -> DataFrame:
        """(keys, n, total, items) of keys with rows, as of a version."""
        return self._read(self.manifests.read(version), "view").where("n > 0")

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Adds a batch of changes (keys, item, value, sign); False if that batch is in already."""
        base = self.manifests.read()
        if base and batch <= base["batch"]:
            return False
        keys, item = self.keys, self.item
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")
        signed = F.col("sign") * F.col("value").cast("decimal(20,6)")
        delta = changes.groupBy(*keys, item).agg(F.sum("sign").cast("long").alias("_n"), F.sum(signed).cast("decimal(38,6)").alias("_total"))
        delta = delta.persist()
        try:
            touched = sorted(r[0] for r in delta.select(bucket).distinct().collect())  # at most `buckets` numbers
            zero, none = F.lit(0).cast("long"), F.lit(0).cast("decimal(38,6)")
            old = self._read(base, "items", touched)
            n, total = F.coalesce("n", zero) + F.coalesce("_n", zero), F.coalesce("total", none) + F.coalesce("_total", none)
            met = _null_safe_full(old, delta, [*keys, item])
            met = met.select(*keys, item, F.coalesce("n", zero).alias("was"), n.alias("n"), total.cast("decimal(38,6)").alias("total"), F.coalesce("_n", zero).alias("_n"), F.coalesce("_total", none).alias("_total"))
            items = met.where("n <> 0 or total <> 0").select(*keys, item, "n", "total")
            gained = F.when(F.col("n") > 0, 1).otherwise(0) - F.when(F.col("was") > 0, 1).otherwise(0)
            by_key = met.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_total").cast("decimal(38,6)").alias("_total"), F.sum(gained).alias("_items"))
            before = self._read(base, "view", touched)
            view = _null_safe_full(before, by_key, keys)
            view = view.select(*keys, n.alias("n"), total.cast("decimal(38,6)").alias("total"), (F.coalesce("items", zero) + F.coalesce("_items", zero)).alias("items")).where("n <> 0 or total <> 0 or items <> 0")
            folder = f"{self.folder}/parts/{uuid.uuid4().hex}"
            for name, rows in (("items", items), ("view", view)):
                rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{name}")
        finally:
            delta.unpersist()
        parts = {**(base["parts"] if base else {}), **{str(b): folder for b in touched}}
        self.manifests.publish({"batch": batch, "parts": parts}, base)
        return True


def _null_safe_full(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A full join on keys that may be null."""
    key = F.struct(*keys)
    both = left.withColumn("_key", key).drop(*keys).join(right.withColumn("_key", key).drop(*keys), "_key", "full")
    return both.select("_key.*", *[c for c in both.columns if c != "_key"])


class ChangeFeed:
    """A log of changes with a generation, snapshots that are published behind a fence, and readers that know when to start anew.

    The manifest holds: gen (one more with each change), reset_gen (the last generation that the log could not carry), seq (the last
    number given out), pruned (numbers up to it are gone), and the published snapshots, newest last. Log rows are
    files of their own by append; a row's number is given out with the manifest, so that no number is committed below one that a
    reader has passed.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, kept: int = KEPT, snapshots: int = 3):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self.kept, self.snapshots = kept, snapshots
        self.manifests = Manifests(spark, folder)

    @staticmethod
    def _begin() -> dict:
        return {"gen": 0, "reset_gen": 0, "seq": 0, "pruned": 0, "parts": [], "snapshots": []}

    def state(self) -> dict:
        return self.manifests.read() or self._begin()

    def append(self, rows: DataFrame, order: str) -> dict:
        """Rows behind the log, numbered by `order` without gaps."""
        from tidemark.operators.aggregates import numbered

        path = f"{self.folder}/log/{uuid.uuid4().hex}"
        numbered(rows, order, "_at").write.parquet(path)
        count = self.spark.read.parquet(path).count()

        def change(base: dict | None) -> dict | None:
            old = base or self._begin()
            part = {"path": path, "first": old["seq"] + 1, "last": old["seq"] + count}
            return old | {"gen": old["gen"] + 1, "seq": old["seq"] + count, "parts": [*old["parts"], part]} if count else None

        return self.manifests.update(change) or self._begin()

    def reset(self) -> dict:
        """A change that the log does not carry: every reader must start from a newer snapshot."""
        return self.manifests.update(lambda base: (base or self._begin()) | {"gen": (base or self._begin())["gen"] + 1, "reset_gen": (base or self._begin())["gen"] + 1})

    def publish(self, rows: DataFrame, gen: int, mark: int) -> dict:
        """A snapshot of the table as of gen and mark; refused where a newer one is out or a reset has come since. Prunes log and snapshots."""
        path = f"{self.folder}/snapshots/gen{gen}-{mark}-{uuid.uuid4().hex}"
        rows.write.option("compression", "gzip").json(path)
        gone: list[str] = []

        def change(base: dict | None) -> dict:
            old = base or self._begin()
            newest = old["snapshots"][-1] if old["snapshots"] else None
            if gen < old["reset_gen"] or (newest and (gen, mark) <= (newest["gen"], newest["mark"])) or mark > old["seq"]:
                raise Refused(f"a snapshot of generation {gen} at {mark} is not newer than what is there")
            kept = [*old["snapshots"], {"path": path, "gen": gen, "mark": mark}][-self.snapshots :]
            floor = max(old["pruned"], min(old["seq"] - self.kept, kept[0]["mark"]))  # never past the oldest snapshot that is kept
            parts = [p for p in old["parts"] if p["last"] > floor]
            gone[:] = [p["path"] for p in old["parts"] if p["last"] <= floor] + [s["path"] for s in old["snapshots"] if s not in kept]
            return old | {"snapshots": kept, "parts": parts, "pruned": floor}

        try:
            found = self.manifests.update(change)
        except (Refused, Conflict):
            self.manifests.drop(path)
            raise
        for old in gone:  # after the manifest no longer names them
            self.manifests.drop(old)
        return found

    def due(self, age_seconds: float, new_rows: int | None = None) -> bool:
        """Whether a snapshot should be made: the generation was reset, or there is something new and it is old or much is new."""
        state = self.state()
        newest = state["snapshots"][-1] if state["snapshots"] else None
        if newest is None or newest["gen"] < state["reset_gen"]:
            return True
        new = state["seq"] - newest["mark"] if new_rows is None else new_rows
        return new > 0 and (age_seconds >= 3600 or new >= 1000)

    def log(self) -> DataFrame:
        """The log that is left: the rows' columns and seq."""
        state, out = self.state(), None
        kind = T.StructType([*T._parse_datatype_string(self.schema), T.StructField("_at", T.LongType())])
        for p in state["parts"]:  # as many as appends since the oldest kept snapshot
            rows = self.spark.read.schema(kind).parquet(p["path"]).withColumn("seq", F.col("_at") + (p["first"] - 1)).drop("_at")
            out = rows if out is None else out.unionByName(rows)
        empty = self.spark.createDataFrame([], self.schema).withColumn("seq", F.lit(0).cast("long"))
        return (empty if out is None else out).where(F.col("seq") > state["pruned"])

    def readers(self, readers: DataFrame) -> DataFrame:
        """readers (reader, gen, mark) with reload, and how many log rows each must read otherwise."""
        state = self.state()
        behind = F.lit(state["seq"]) - F.col("mark")
        reload = (F.col("gen") < state["reset_gen"]) | (F.col("mark") < state["pruned"]) | (behind > MOST_BEHIND)
        return readers.withColumn("reload", reload).withColumn("behind", F.when(reload, 0).otherwise(F.greatest(behind, F.lit(0))))
