"""Feeds, calendars and page metadata as sources: one file or string to many rows, inside Spark tasks."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED_ROWS, FEED_MOST = "source string, url string, title string, published string, description string", 10
CALENDAR_ROWS = "source string, uid string, summary string, starts string, starts_zone string, ends string, ends_zone string, status string, location string, url string"


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(source, content): whole text files of a folder, their path as source."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern)
    return rows.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def _tag(block: str, name: str) -> str:
    m = re.search(rf"<{name}\b[^>]*>(.*?)</{name}\s*>", block, re.S | re.I)
    if not m:
        return ""
    text = re.sub(r"^\s*<!\[CDATA\[(.*?)\]\]>\s*$", r"\1", m[1], flags=re.S)
    return html.unescape(text).strip()


def feed_items(content: str) -> Iterator[tuple[str, str, str, str]]:
    """(url, title, published, description) of an RSS 2.0 or Atom document's items that have url and title."""
    entries = re.findall(r"<entry\b.*?</entry\s*>", content, re.S | re.I)
    for block in entries or re.findall(r"<item\b.*?</item\s*>", content, re.S | re.I):
        if entries:
            links = [dict(re.findall(r"""([\w:]+)\s*=\s*["']([^"']*)["']""", x)) for x in re.findall(r"<link\b([^>]*)>", block, re.I)]
            url = next((x.get("href", "") for x in links if x.get("rel", "alternate") == "alternate"), "")
            published, text = _tag(block, "published") or _tag(block, "updated"), _tag(block, "summary") or _tag(block, "content")
        else:
            url = _tag(block, "link")
            published, text = _tag(block, "pubDate") or _tag(block, "dc:date"), _tag(block, "description") or _tag(block, "content:encoded")
        title = _tag(block, "title")
        if url and title:
            yield html.unescape(url), title, published, text


def parse_feeds(files: DataFrame, most: int = FEED_MOST) -> DataFrame:
    """Items of feed documents (source, content): the first `most` of each feed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(s, *item) for s, c in zip(part["source"], part["content"]) for item, _ in zip(feed_items(c or ""), range(most))]
            yield pd.DataFrame(rows, columns=["source", "url", "title", "published", "description"])

    return files.select("source", "content").mapInPandas(run, FEED_ROWS)


def calendar_events(content: str) -> Iterator[dict[str, str]]:
    """Events of an iCalendar document: lines unfolded, nested components skipped, start and summary required."""
    lines = re.sub(r"\r?\n[ \t]", "", content).splitlines()
    event, nested = None, 0
    for line in lines:
        name, _, value = line.partition(":")
        name, *parameters = name.split(";")
        name = name.upper()
        if name == "BEGIN":
            if value.upper() == "VEVENT" and event is None:
                event, nested = {}, 0
            elif event is not None:
                nested += 1
        elif name == "END" and event is not None:
            if nested:
                nested -= 1
            else:
                if event.get("DTSTART") and event.get("SUMMARY"):
                    yield event
                event = None
        elif event is not None and not nested:
            zone = next((p.partition("=")[2] for p in parameters if p.upper().startswith("TZID=")), "")
            event.setdefault(name, re.sub(r"\\(.)", lambda m: "\n" if m[1] in "nN" else m[1], value))
            event.setdefault(name + ".ZONE", zone)


def parse_calendars(files: DataFrame) -> DataFrame:
    """Events of calendar documents (source, content), times as written with their zone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["UID", "SUMMARY", "DTSTART", "DTSTART.ZONE", "DTEND", "DTEND.ZONE", "STATUS", "LOCATION", "URL"]
        for part in parts:
            rows = [(s, *(e.get(k, "") for k in keys)) for s, c in zip(part["source"], part["content"]) for e in calendar_events(c or "")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CALENDAR_ROWS.split(", ")])

    return files.select("source", "content").mapInPandas(run, CALENDAR_ROWS)


def wall_clock(value: Column, zone: Column, local: str) -> Column:
    """A calendar time on the clock of a zone: dates are midnight, Z is UTC, a zone is converted, floating stays."""
    plain = F.regexp_replace(value, "Z$", "")
    day = F.try_to_timestamp(F.when(F.length(plain) == 8, plain), F.lit("yyyyMMdd"))
    at = F.try_to_timestamp(F.when(F.length(plain) == 15, plain), F.lit("yyyyMMdd'T'HHmmss"))
    utc = F.when(value.endswith("Z"), at).when(zone != "", F.to_utc_timestamp(at, zone))
    return F.coalesce(day, F.from_utc_timestamp(utc, local), at)


def last_day(starts: Column, ends: Column, all_day: Column) -> Column:
    """The last day of an event: all-day ends are exclusive, and so is an end at midnight."""
    before = F.date_sub(ends.cast("date"), 1)
    midnight = F.date_trunc("day", ends) == ends
    return F.greatest(starts.cast("date"), F.coalesce(F.when(all_day | midnight, before).otherwise(ends.cast("date")), starts.cast("date")))


def first_listing(events: DataFrame, url: str, order: str) -> DataFrame:
    """Each event url from the first calendar that lists it."""
    from tidemark.operators.hierarchy import first_per_group

    return first_per_group(events, [url], [order]).drop("rank")
