"""Streams run to the end of the present data, against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.domain import Domain
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.streaming import events, machine
from tidemark.streaming.versions import ChangeFeed, MaintainedView


def stream(d: Domain) -> DataFrame:
    return events.read_events(d.spark, d.sf_dir)


@query("str_tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(d: Domain) -> DataFrame:
    rows = events.finished(events.tumbling(stream(d)), "complete")
    return rows.select(F.to_timestamp_ntz(F.col("start").cast("string")).alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("str_sliding_windows", "SELECT date_trunc('hour', ts) - to_hours(k::INTEGER) AS start, user_id, count(*) AS n FROM events, range(2) t(k) GROUP BY 1, 2")
def sliding_windows(d: Domain) -> DataFrame:
    rows = events.finished(events.sliding(stream(d)), "complete")
    return rows.select(F.to_timestamp_ntz(F.col("start").cast("string")).alias("start"), "user_id", "n")


@query(
    "str_session_windows",
    "WITH m AS (SELECT *, (epoch_us(ts) - epoch_us(coalesce(lag(ts) OVER w, TIMESTAMP '1970-01-01')) >= 1800000000)::INTEGER AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m) "
    'SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k',
)
def session_windows(d: Domain) -> DataFrame:
    rows = events.finished(events.sessions(stream(d)), "complete")
    return rows.select("user_id", *(F.to_timestamp_ntz(F.col(c).cast("string")).alias(c) for c in ("start", "end")), "n")


def thirds(d: Domain) -> list[DataFrame]:
    """The events of the first ten days, of the next ten, and of the rest."""
    rows, day = d.raw("events"), F.dayofmonth("ts")
    return [rows.where(day <= 10), rows.where((day > 10) & (day <= 20)), rows.where(day > 20)]


@query("str_08_late_dedup", "SELECT user_id, event_type, event_id FROM events")
def late_dedup(d: Domain) -> DataFrame:
    """Every event comes twice; with the last third come copies of the first under new ids, which are too late and are dropped."""
    one, two, three = thirds(d)
    late = one.withColumn("event_id", F.col("event_id") + 1_000_000_000)
    parts = [x.union(x) for x in (one, two, three)]
    rows = events.staged_stream(d.spark, [*parts, late])
    return events.finished(events.first_seen(rows, ["event_id"])).select("user_id", "event_type", "event_id")


@query("str_04_retractions", "SELECT event_type, (count(*) - count(*) FILTER (event_id % 5 = 0))::BIGINT AS n FROM events GROUP BY 1")
def retractions(d: Domain) -> DataFrame:
    """Every fifth event is taken back by a row of a later batch; those carry a negative id."""
    rows = d.raw("events")
    back = rows.where("event_id % 5 = 0").withColumn("event_id", -F.col("event_id") - 1)
    changes = events.staged_stream(d.spark, [rows, back]).withColumn("sign", F.when(F.col("event_id") < 0, -1).otherwise(1))
    return events.finished(events.retracting_counts(changes, "event_type"), "complete")


@query("str_23_keyed_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS n FROM events GROUP BY 1")
def keyed_state(d: Domain) -> DataFrame:
    rows = events.finished(events.followed_by_state(stream(d)), "update")
    return rows.groupBy("user_id").agg(F.max_by("event_type", "n").alias("event_type"), F.max("n").alias("n"))


@query("str_01_derived_columns", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'click'")
def derived_columns(d: Domain) -> DataFrame:
    return events.finished(stream(d).where("event_type = 'click'").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")))


def folder_of(d: Domain, name: str) -> str:
    return f"{shared_folder(d.spark)}/{name}-{uuid.uuid4().hex}"


@query("src_25_restarted", "SELECT CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END AS batch, event_type, count(*) AS n, min(event_id) AS least FROM events GROUP BY 1, 2")
def restarted(d: Domain) -> DataFrame:
    """Three scheduled runs over a growing folder and one checkpoint: each reads only what is new, as one batch."""
    target = folder_of(d, "scheduled")

    def run(source: str, number: int) -> None:
        rows = d.spark.readStream.schema("event_id long, event_type string").parquet(source)
        events.continued(rows, target)

    events.growing(d.spark, [part.select("event_id", "event_type") for part in thirds(d)], run)
    found = d.spark.read.schema("event_id long, event_type string, batch int").parquet(f"{target}/rows")
    return found.groupBy("batch", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))


@query("str_05_incremental", "SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(20, 6))) AS DOUBLE) AS total, count(DISTINCT user_id) AS users FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def incremental(d: Domain) -> DataFrame:
    """A view kept by a stream of signed changes: every event, then every fifth taken back, in batches; equal to the batch query."""
    view = MaintainedView(d.spark, folder_of(d, "view"), [("event_type", "string")], ("user_id", "long"))
    target = folder_of(d, "changes")
    parts = [x.select("event_type", "user_id", "value", F.lit(1).alias("sign")) for x in thirds(d)]
    parts.append(d.raw("events").where("event_id % 5 = 0").select("event_type", "user_id", "value", F.lit(-1).alias("sign")))

    def run(source: str, number: int) -> None:
        rows = d.spark.readStream.schema("event_type string, user_id long, value double, sign int").parquet(source)
        events.continued(rows, target, each=view.apply)

    events.growing(d.spark, parts, run)
    return view.read().select("event_type", "n", F.col("total").cast("double").alias("total"), F.col("items").alias("users"))


STEPS = """lambda acc, x: CASE WHEN x.event_type = 'click' AND acc.state <> 'staged' THEN {'event_type': '', 'state': 'staged', 'applied': acc.applied, 'refused': acc.refused}
  WHEN x.event_type = 'purchase' AND acc.state = 'staged' THEN {'event_type': '', 'state': 'applied', 'applied': acc.applied + 1, 'refused': acc.refused}
  WHEN x.event_type = 'error' AND acc.state = 'applied' THEN {'event_type': '', 'state': 'undone', 'applied': acc.applied - 1, 'refused': acc.refused}
  ELSE {'event_type': '', 'state': acc.state, 'applied': acc.applied, 'refused': acc.refused + 1} END"""


@query(
    "str_23_state_machine",
    f"WITH e AS (SELECT user_id, list({{'event_type': event_type, 'state': 'none', 'applied': 0::BIGINT, 'refused': 0::BIGINT}} ORDER BY ts, event_id) AS l, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase', 'error') GROUP BY 1), "
    f"r AS (SELECT user_id, n, list_reduce(list_prepend({{'event_type': '', 'state': 'none', 'applied': 0::BIGINT, 'refused': 0::BIGINT}}, l), {STEPS}) AS s FROM e) SELECT user_id, s.state AS state, s.applied AS applied, s.refused AS refused, n FROM r",
)
def state_machine(d: Domain) -> DataFrame:
    """Clicks stage, purchases apply, errors undo; three runs, each going on from the state that the last one left."""
    target = folder_of(d, "machine")
    action = F.create_map(*(F.lit(x) for pair in (("click", "stage"), ("purchase", "apply"), ("error", "undo")) for x in pair))
    rows = [part.where(F.col("event_type").isin("click", "purchase", "error")) for part in thirds(d)]
    rows = [x.select(F.col("user_id").alias("key"), F.col("event_id").alias("edit"), F.element_at(action, F.col("event_type")).alias("action"), F.col("ts").cast("timestamp").alias("at")) for x in rows]

    def run(source: str, number: int) -> None:
        stream = d.spark.readStream.schema("key long, edit long, action string, at timestamp").parquet(source)
        events.continued(machine.edits(stream), target, mode="update")

    events.growing(d.spark, rows, run)
    found = d.spark.read.schema(machine.OUTPUT + ", batch int").parquet(f"{target}/rows").drop("batch")
    last = found.groupBy("key").agg(F.max_by(F.struct("state", "applied", "refused"), "n").alias("s"), F.max("n").alias("n"))
    return last.select(F.col("key").alias("user_id"), "s.*", "n")


@query(
    "str_26_fenced_feed",
    """WITH numbered AS (SELECT user_id, day(ts) <= 20 AS early, row_number() OVER (ORDER BY CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END, event_id) AS seq FROM events),
    tops AS (SELECT max(seq) AS seq, greatest(0, max(seq) FILTER (early) - 10000) AS pruned FROM numbered),
    readers AS (SELECT user_id, 1 + user_id % 3 AS gen, coalesce(max(seq) FILTER (early), 0) AS mark FROM numbered GROUP BY user_id),
    told AS (SELECT r.*, r.gen < 2 OR mark < pruned OR seq - mark > 2000 AS reload, seq FROM readers r, tops)
    SELECT user_id, reload, CASE WHEN reload THEN 0 ELSE seq - mark END AS behind FROM told""",
)
def fenced_feed(d: Domain) -> DataFrame:
    """A log of events in three appends, a reset after the first and a snapshot after the second: who must load it, who reads on."""
    feed = ChangeFeed(d.spark, folder_of(d, "feed"), "event_id long, user_id long")
    for number, part in enumerate(thirds(d)):
        feed.append(part.select("event_id", "user_id"), "event_id")
        if number == 0:
            feed.reset()
        elif number == 1:
            state = feed.state()
            marks = feed.log().groupBy("user_id").agg(F.max("seq").alias("mark"))
            snapshot = f"{feed.folder}/marks"
            marks.write.parquet(snapshot)
            feed.publish(marks, state["gen"], state["seq"])
    marks = d.spark.read.parquet(snapshot)
    users = d.raw("events").select("user_id").distinct().join(marks, "user_id", "left")
    readers = users.select("user_id", (1 + F.col("user_id") % 3).alias("gen"), F.coalesce("mark", F.lit(0)).alias("mark"))
    return feed.readers(readers).select("user_id", "reload", F.col("behind").cast("long").alias("behind"))
