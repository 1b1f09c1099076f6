"""Maintained views, fenced snapshots, the state machine and restarts, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.session import shared_folder
from tidemark.streaming import machine
from tidemark.streaming.versions import ChangeFeed, Conflict, MaintainedView, Manifests, Refused


def folder(spark, tmp_path_factory, name):
    return "file://" + str(tmp_path_factory.mktemp(name))


def test_only_one_writer_makes_a_version(spark, tmp_path_factory):
    m = Manifests(spark, folder(spark, tmp_path_factory, "m"))
    assert m.read() is None and m.numbers() == []
    first = m.publish({"x": 1}, None)
    m.publish({"x": 2}, first)
    with pytest.raises(Conflict):
        m.publish({"x": 3}, first)
    assert m.read()["x"] == 2 and m.numbers() == [0, 1]
    tries = []

    def change(base):
        if not tries:
            m.publish({"x": 10}, base)  # another writer gets in between
        tries.append(base["version"])
        return {"x": base["x"] + 1}

    assert m.update(change)["x"] == 11 and tries == [1, 2]


def test_a_maintained_view_equals_the_batch_query_after_every_batch(spark, tmp_path_factory):
    rng, rows, live = random.Random(1), [], []
    view = MaintainedView(spark, folder(spark, tmp_path_factory, "v"), [("key", "string")], ("item", "long"), buckets=4)
    schema = "key string, item long, value double, sign int"
    assert view.read().collect() == []
    for n in range(6):
        batch = [(rng.choice(["a", "b", "c", "d", None]), rng.randint(0, 5), rng.randint(0, 400) / 4, 1) for _ in range(30)] if n != 3 else []
        gone = rng.sample(live, len(live) // 2) if n != 4 else list(live)
        live += batch
        for r in gone:
            live.remove(r)
        changes = batch + [(*r[:3], -1) for r in gone]
        rows.append(changes)
        df = spark.createDataFrame(changes, schema)
        assert view.apply(df, n) and not view.apply(df, n)  # a batch that is run again
        want = {}
        for key, item, value, _ in live:
            w = want.setdefault(key, [0, 0.0, set()])
            w[0], w[1] = w[0] + 1, w[1] + value
            w[2].add(item)
        got = {r["key"]: (r["n"], float(r["total"]), r["items"]) for r in view.read().collect()}
        assert got == {k: (a, b, len(c)) for k, (a, b, c) in want.items()}
        assert view.read(n).count() == len(want)
    early = MaintainedView(spark, folder(spark, tmp_path_factory, "early"), [("key", "string")], ("item", "long"))
    early.apply(spark.createDataFrame([("a", 1, 2.0, -1)], schema), 0)  # taken back before it comes
    assert early.read().collect() == []
    early.apply(spark.createDataFrame([("a", 1, 2.0, 1), ("a", 1, 3.0, 1)], schema), 1)
    assert [(r["n"], float(r["total"]), r["items"]) for r in early.read().collect()] == [(1, 3.0, 1)]


def test_snapshots_behind_a_fence(spark, tmp_path_factory):
    feed = ChangeFeed(spark, folder(spark, tmp_path_factory, "f"), "k long", kept=5, snapshots=2)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"))
    assert feed.due(0) and feed.log().count() == 0
    feed.append(rows(0, 10), "k")
    first = feed.state()
    feed.append(rows(10, 14), "k")
    feed.publish(rows(0, 14), feed.state()["gen"], 14)
    with pytest.raises(Refused):
        feed.publish(rows(0, 10), first["gen"], 10)  # slower, older publisher
    assert not feed.due(0) and not feed.due(9999)
    feed.append(rows(14, 20), "k")
    assert feed.due(3600) and not feed.due(3599) and feed.due(0, 1000)
    state = feed.publish(rows(0, 20), feed.state()["gen"], 20)
    assert [s["mark"] for s in state["snapshots"]] == [14, 20] and state["pruned"] == 14  # not past the older snapshot
    assert sorted((r["k"], r["seq"]) for r in feed.log().collect()) == [(k, k + 1) for k in range(14, 20)]
    reset = feed.reset()
    with pytest.raises(Refused):
        feed.publish(rows(0, 20), reset["gen"] - 1, 20)
    assert feed.due(0)
    readers = spark.createDataFrame([("new", reset["gen"], 18), ("old", reset["gen"] - 1, 20), ("far", reset["gen"], 3)], "reader string, gen long, mark long")
    assert {r["reader"]: (r["reload"], r["behind"]) for r in feed.readers(readers).collect()} == {"new": (False, 2), "old": (True, 0), "far": (True, 0)}
    done = feed.publish(rows(0, 20), reset["gen"], 20)
    assert [s["gen"] for s in done["snapshots"]] == [3, 4] and spark.read.json(done["snapshots"][-1]["path"]).count() == 20


def run(spark, source, target, patience=None, late="0 seconds"):
    """One run over the files that are new in source, from the checkpoint that is there."""
    rows = spark.readStream.schema("key long, edit long, action string, at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    out = machine.edits(rows, patience, late).writeStream.outputMode("update").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True)
    out.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/rows/{n}")).start().awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").schema(machine.OUTPUT).parquet(f"{target}/rows")
    return {r["key"]: (r["state"], r["applied"], r["refused"], r["refusals"]) for r in found.groupBy("key").agg(F.max_by(F.struct("state", "applied", "refused", "refusals"), F.struct("n", F.col("state") == "expired")).alias("s")).select("key", "s.*").collect()}


def test_a_restarted_state_machine_goes_on_and_timers_fire(spark, tmp_path_factory):
    source, target = (folder(spark, tmp_path_factory, x) for x in ("source", "target"))
    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)

    def put(*rows):
        spark.createDataFrame([(k, e, a, at(m)) for k, e, a, m in rows], "key long, edit long, action string, at timestamp").coalesce(1).write.mode("append").parquet(source)

    put((1, 10, "stage", 0), (1, 10, "apply", 1), (2, 20, "apply", 0), (2, 21, "stage", 1), (3, 30, "stage", 2))
    assert run(spark, source, target, 600_000) == {1: ("applied", 1, 0, ""), 2: ("staged", 0, 1, "apply:1"), 3: ("staged", 0, 0, "")}
    put((1, 10, "undo", 5), (1, 11, "undo", 6), (3, 30, "apply", 4))
    put((4, 40, "stage", 60))  # an hour later
    put((4, 40, "other", 61))
    got = run(spark, source, target, 600_000)
    assert got[1] == ("undone", 0, 1, "undo:1") and got[3] == ("applied", 1, 0, "") and got[4][:3] == ("staged", 0, 1)
    assert got[2] == ("expired", 0, 1, "apply:1")  # nothing came for key 2: its timer fired
    put((2, 21, "apply", 90), (2, 22, "stage", 91), (2, 22, "apply", 92))
    assert run(spark, source, target, 600_000)[2] == ("applied", 1, 2, "apply:2")
    assert shared_folder(spark)


def test_a_run_that_breaks_off_is_done_again(spark, tmp_path_factory):
    from tidemark.streaming import events

    target, ran = folder(spark, tmp_path_factory, "runs"), []

    def run(source, number):
        rows = spark.readStream.schema("k long").parquet(source)

        def broken(batch, n):
            batch.write.mode("overwrite").parquet(f"{target}/rows/batch={n}")
            raise RuntimeError("stopped in the middle")

        if number == 1:
            with pytest.raises(Exception, match="stopped in the middle"):
                events.continued(rows, target, each=broken)
        events.continued(rows, target)
        ran.append({(r["batch"], r["k"]) for r in spark.read.parquet(f"{target}/rows").collect()})
        events.continued(rows, target)  # nothing new, nothing written

    events.growing(spark, [spark.range(0, 3).withColumnRenamed("id", "k"), spark.range(3, 5).withColumnRenamed("id", "k")], run)
    assert ran == [{(0, 0), (0, 1), (0, 2)}, {(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)}]
    assert spark.read.parquet(f"{target}/rows").count() == 5
