"""Calendar intervals, named periods and overlap joins.

An event without a start is unbounded below, without an end it lasts its day; null bounds of a range
mean unbounded. The overlap join buckets ranges by day spans so that it is an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import few

#: A day of events starts at 06:00; a timed event of one day lasts three hours.
DAY_STARTS_HOUR, TIMED_HOURS = 6, 3


@dataclass(frozen=True)
class Period:
    """A named period: when its day starts, and the offsets of its two ends from that day's midnight."""

    day_starts: timedelta
    after: timedelta
    until: timedelta

    def interval(self, at: datetime) -> tuple[datetime, datetime]:
        """[start, end) of the period as said at a moment; before the day starts it still means the day before."""
        day = datetime.combine((at - self.day_starts).date(), datetime.min.time())
        return day + self.after, day + self.until


#: Fixed values of the named periods.
PERIODS = {
    "tonight": Period(timedelta(hours=4), timedelta(hours=18), timedelta(hours=28)),
    "tomorrow": Period(timedelta(0), timedelta(hours=24), timedelta(hours=48)),
    "today": Period(timedelta(hours=4), timedelta(hours=0), timedelta(hours=28)),
}


def named(term: Column, at: Column) -> Column:
    """(starts, ends) of the period that a term names as said at a moment; null for other terms and without a moment."""
    out = F.lit(None)
    for name, period in PERIODS.items():
        day = (at - F.lit(period.day_starts)).cast("date").cast("timestamp_ntz")
        out = F.when(term == name, F.struct((day + F.lit(period.after)).alias("starts"), (day + F.lit(period.until)).alias("ends"))).otherwise(out)
    return out


def event_range(starts_on: Column, ends_on: Column, start_hour: Column) -> tuple[Column, Column]:
    """[start, end) of an event as timestamps; null start: unbounded below."""
    first = starts_on.cast("timestamp_ntz") + F.make_dt_interval(hours=F.coalesce(start_hour, F.lit(DAY_STARTS_HOUR)))
    one_day = ends_on.isNull() | (ends_on == starts_on)
    timed = start_hour.isNotNull() & starts_on.isNotNull() & one_day
    last = F.date_add(F.coalesce(ends_on, starts_on), 1).cast("timestamp_ntz")
    return first, F.when(timed, first + F.make_dt_interval(hours=F.lit(TIMED_HOURS))).otherwise(last)


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether [start_a, end_a) and [start_b, end_b) share a moment; null bounds are unbounded."""
    return (start_a.isNull() | end_b.isNull() | (start_a < end_b)) & (start_b.isNull() | end_a.isNull() | (start_b < end_a))


#: Periods, at most, that are listed in one row which every event compares itself with; buckets that hold periods, at most, for
#: events without a bound to be dealt to just these.
MOST_LISTED, MOST_BUCKETS = 256, 10_000


def overlap_join(events: DataFrame, start: str, end: str, periods: DataFrame, p_start: str, p_end: str, bucket_days: int = 32, most_listed: int = MOST_LISTED) -> DataFrame:
    """Events with every period that they overlap. Periods are bounded; events may be unbounded.

    Few periods (most_listed at most, which is checked) are one row of a list: an event keeps those that it overlaps, and neither side is
    shuffled or copied. More are joined by buckets: both kinds are equi-joins on buckets of days. An event with two bounds is in every
    bucket that it touches, and so is a period; a pair counts in the first bucket that both touch. An event without a bound goes to the
    buckets where periods start (no later than it ends) and meets each period there once.
    """
    listed = few.listed(periods, "_periods", most_listed)
    if listed is not None:
        rows = events.crossJoin(F.broadcast(listed))  # one row
        met = rows.select(*events.columns, F.inline("_periods"))  # generated and filtered in one stage, row by row
        return met.where(overlaps(F.col(start), F.col(end), F.col(p_start), F.col(p_end)))
    return bucketed(events, start, end, periods, p_start, p_end, bucket_days)


def bucketed(events: DataFrame, start: str, end: str, periods: DataFrame, p_start: str, p_end: str, bucket_days: int) -> DataFrame:
    """The overlap join by buckets, for any number of periods."""

    def bucket(at: Column) -> Column:
        return F.floor(F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")) / bucket_days).cast("int")

    def buckets(a: str, b: str) -> Column:
        return F.explode(F.sequence(bucket(F.col(a)), F.greatest(bucket(F.col(a)), bucket(F.col(b)))))

    condition = overlaps(F.col(start), F.col(end), F.col(p_start), F.col(p_end))
    bounded = events.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_bucket", buckets(start, end))
    spread = periods.withColumn("_bucket", buckets(p_start, p_end))
    first = F.greatest(bucket(F.col(start)), bucket(F.col(p_start))) == F.col("_bucket")  # a pair counts once
    met = bounded.join(spread, "_bucket").where(condition & first).drop("_bucket")
    open_ones = events.where(F.col(start).isNull() | F.col(end).isNull())
    held = periods.where(F.col(p_start).isNotNull()).select(bucket(F.col(p_start)).alias("b")).distinct()
    listed = sorted(r["b"] for r in held.limit(MOST_BUCKETS + 1).collect())  # bounded
    if len(listed) > MOST_BUCKETS:
        ends = held.agg(F.min("b"), F.max("b")).first()
        places = F.sequence(F.lit(ends[0]), F.lit(ends[1]))
    else:
        places = F.lit(listed) if listed else F.array().cast("array<int>")
    reach = F.filter(places, lambda b: F.col(end).isNull() | (b <= bucket(F.col(end))))
    late = open_ones.withColumn("_bucket", F.explode(reach)).join(periods.withColumn("_bucket", bucket(F.col(p_start))), "_bucket")
    return met.unionByName(late.where(condition).drop("_bucket"))
