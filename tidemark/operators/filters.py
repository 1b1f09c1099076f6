"""Conjunctions of alternatives: links that match every filter, paged by key, seen ones last."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import hierarchy, intervals

MOST_FILTERS, MOST_SENSES, MOST_ROWS = 8, 8, 100


@dataclass(frozen=True)
class Sense:
    """One meaning of a filter: exactly one of its fields is set."""

    kind: str | None = None
    entity: int | None = None
    topic: str | None = None
    period: tuple[datetime, datetime] | None = None

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.kind, self.entity, self.topic, self.period)) != 1:
            raise ValueError("a sense has exactly one of kind, entity, topic, period")
        if self.period and self.period[0] >= self.period[1]:
            raise ValueError("a period ends after it starts")


#: What a filter may be given by: its sense, and the named times.
KEYS = ("entity", "kind", "topic", "period", "time")


def read_sense(given: dict, at: datetime) -> Sense:
    """The sense of a filter's arguments; a named time is resolved at a moment. Errors have fixed messages."""
    if len(given) != 1 or next(iter(given)) not in KEYS:
        raise ValueError("exactly one of entity, kind, topic and period")
    key, value = next(iter(given.items()))
    if key != "time":
        return Sense(**{key: value})
    if value not in intervals.PERIODS:
        raise ValueError(f"unknown time: {value}")
    return Sense(period=intervals.PERIODS[value].interval(at))


#: Paths of kinds and topics.
PATH = r"^[A-Za-z0-9_]+(\.[A-Za-z0-9_]+)*$"


def read_senses(given: Column, at: Column) -> Column:
    """(key, value, error) of stored filters: maps with one of KEYS, and the moment at which a named time is said.

    A period is `start|end`, as is what a named time becomes. Where something is wrong, key and value are null and error says what.
    """
    key, value = F.get(F.map_keys(given), F.lit(0)), F.get(F.map_values(given), F.lit(0))
    ends = F.transform(F.split(value, r"\|"), lambda x: F.try_to_timestamp(x).cast("timestamp_ntz"))
    start, end = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
    named = intervals.named(value, at)
    rules = [
        (given.isNull() | (F.size(given) != 1) | ~key.isin(*KEYS) | value.isNull(), F.lit("exactly one of entity, kind, topic and period")),
        ((key == "time") & ~value.isin(*intervals.PERIODS), F.concat(F.lit("unknown time: "), value)),
        ((key == "time") & at.isNull(), F.concat(F.lit("when is "), value)),
        ((key == "entity") & value.try_cast("long").isNull(), F.lit("an entity is a number")),
        (key.isin("kind", "topic") & ~value.rlike(PATH), F.concat(F.lit("bad path: "), value)),
        ((key == "period") & ((F.size(ends) != 2) | start.isNull() | end.isNull()), F.lit("a period has two ends")),
        ((key == "period") & (start >= end), F.lit("a period ends after it starts")),
    ]
    error = F.lit(None).cast("string")
    for holds, message in reversed(rules):
        error = F.when(F.coalesce(holds, F.lit(False)), message).otherwise(error)
    text = lambda moment: F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
    read = F.when(key == "time", F.concat_ws("|", text(named["starts"]), text(named["ends"]))).otherwise(value)
    name = F.when(key == "time", "period").otherwise(key)
    return F.struct(F.when(error.isNull(), name).alias("key"), F.when(error.isNull(), read).alias("value"), error.alias("error"))


def checked(filters: list[list[Sense]]) -> list[list[Sense]]:
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters are possible")
    if any(not 1 <= len(senses) <= MOST_SENSES for senses in filters):
        raise ValueError(f"a filter has 1 to {MOST_SENSES} senses")
    return filters


def matches(filters: list[list[Sense]], mentions: DataFrame, entities: DataFrame, labels: DataFrame, events: DataFrame) -> DataFrame:
    """(filter, link_id, entity_id): the log of matches. Only kinds and entities name an entity.

    mentions (link_id, entity_id), entities (entity_id, kind_path), labels (link_id, topic), events (link_id, start, end).
    """
    parts = []
    none = F.lit(None).cast("long")
    for n, senses in enumerate(checked(filters)):
        for s in senses:
            if s.entity is not None:
                found = mentions.where(F.col("entity_id") == s.entity).select("link_id", F.col("entity_id").cast("long"))
            elif s.kind is not None:
                kinds = entities.where(hierarchy.within(F.col("kind_path"), s.kind)).select("entity_id")
                found = mentions.join(kinds, "entity_id", "left_semi").select("link_id", F.col("entity_id").cast("long"))
            elif s.topic is not None:
                found = labels.where(hierarchy.within(F.col("topic"), s.topic)).select("link_id", none.alias("entity_id"))
            else:
                a, b = (F.lit(x).cast("timestamp_ntz") for x in s.period)
                found = events.where(intervals.overlaps(F.col("start"), F.col("end"), a, b)).select("link_id", none.alias("entity_id"))
            parts.append(found.withColumn("filter", F.lit(n)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def passing(log: DataFrame, n_filters: int) -> DataFrame:
    """(link_id, entity_ids): links with a match of every filter, and the distinct entities that matched."""
    passed = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("filter")))  # one bit for each filter: no row is expanded for a distinct count
    rows = log.groupBy("link_id").agg(passed.alias("passed"), F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))
    return rows.where(F.col("passed") == (1 << n_filters) - 1).drop("passed")


def seen_by(viewer: int, as_of: datetime, *interactions: DataFrame) -> DataFrame:
    """(link_id): what a viewer had seen by a moment, from tables (link_id, viewer, at)."""
    rows = interactions[0]
    for more in interactions[1:]:
        rows = rows.unionByName(more)
    return rows.where((F.col("viewer") == viewer) & (F.col("at") <= F.lit(as_of))).select("link_id").distinct()


def after(seen: Column, created: Column, key: Column, cursor: tuple[bool, datetime, int]) -> Column:
    """Whether a row comes after a cursor in the order (seen, created desc, key desc)."""
    c_seen, c_created, c_key = F.lit(cursor[0]), F.lit(cursor[1]), F.lit(cursor[2])
    same = seen == c_seen
    return (seen > c_seen) | (same & (created < c_created)) | (same & (created == c_created) & (key < c_key))


def keyset_page(df: DataFrame, cursor: tuple[bool, datetime, int] | None, size: int) -> DataFrame:
    """The rows (seen, created_at, link_id, ...) after a cursor, at most MOST_ROWS."""
    rows = df if cursor is None else df.where(after(F.col("seen"), F.col("created_at"), F.col("link_id"), cursor))
    return rows.orderBy("seen", F.desc("created_at"), F.desc("link_id")).limit(max(1, min(size, MOST_ROWS)))
