"""Items, statuses and activities of public interfaces, read from dropped JSON files: JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import one_line, tags_cut, video_id

MOST_STORIES = 25
#: Days ahead that events are listed, and events of a calendar.
AHEAD_DAYS, MOST_UPCOMING = 45, 40


def stories(raw: DataFrame, most: int = MOST_STORIES, thread: str = "https://news.ycombinator.com/item?id=") -> DataFrame:
    """(id, title, url) of items as JSON (value, rank): stories with a title among the first; the thread's url where there is none."""
    item = F.from_json("value", "id bigint, type string, title string, url string")
    rows = raw.where(F.col("rank") <= most).select("rank", item.alias("i")).where((F.col("i.type") == "story") & (F.coalesce("i.title", F.lit("")) != ""))
    return rows.select(F.col("i.id").alias("id"), F.col("i.title").alias("title"), F.coalesce(F.nullif("i.url", F.lit("")), F.concat(F.lit(thread), F.col("i.id"))).alias("url"))


def videos(items: DataFrame) -> DataFrame:
    """Feed items (url, title, published) that are videos, without shorts, with their id."""
    return items.where(~F.col("url").contains("/shorts/")).withColumn("video", video_id(F.col("url"))).where("video is not null")


def statuses(raw: DataFrame, most: int = 141) -> DataFrame:
    """(url, title) of social posts as JSON (value): the card's url, else the first link that is no mention, else the post's own."""
    post = F.from_json("value", "url string, content string, account struct<acct:string>, card struct<url:string,title:string>")
    rows = raw.select(post.alias("s"))
    links = F.filter(F.regexp_extract_all("s.content", F.lit(r"(?is)<a\b([^>]*)>"), F.lit(1)), lambda a: ~a.rlike(r"""(?i)class=["'][^"']*\b(mention|hashtag)\b"""))
    linked = F.nullif(F.regexp_extract(F.get(links, F.lit(0)), r"""(?i)href=["']([^"']*)["']""", 1), F.lit(""))
    said = one_line(tags_cut(F.regexp_replace("s.content", r"(?i)</p>|<br\s*/?>", " ")))
    title = F.coalesce(F.nullif("s.card.title", F.lit("")), F.nullif(F.left(said, F.lit(most)), F.lit("")), F.concat(F.lit("Post by "), "s.account.acct"))
    return rows.select(F.coalesce("s.card.url", linked, "s.url").alias("url"), title.alias("title"))


def upcoming(events: DataFrame, feed: str, today: Column, most: int = MOST_UPCOMING) -> DataFrame:
    """events (feed, uid, starts, last, cancelled) that are not over and begin soon: the earliest of each feed."""
    rows = events.where(~F.col("cancelled") & (F.col("last") >= today) & (F.to_date("starts") <= F.date_add(today, AHEAD_DAYS)))
    order = Window.partitionBy(feed).orderBy("starts", "uid")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def best_claims(claims: DataFrame, key: str, ended: str = "ended") -> DataFrame:
    """(key, property, value) of claims (key, property, rank, position, value, ended): preferred before normal, never deprecated or ended; the first of equals."""
    live = claims.where((F.col("rank") != "deprecated") & ~F.col(ended))
    order = F.struct(F.when(F.col("rank") == "preferred", 0).otherwise(1).alias("r"), "position")
    return live.groupBy(key, "property").agg(F.min_by("value", order).alias("value"))


def items(raw: DataFrame, languages: tuple[str, ...] = ("en", "fr")) -> DataFrame:
    """(id, label, parent, country, iso, located) of items as JSON (value) with claims P17 country, P131 area, P297 code, P625 place."""
    claim = "array<struct<rank:string,mainsnak:struct<datavalue:struct<value:string>>,qualifiers:map<string,string>>>"
    item = F.from_json("value", f"id string, labels map<string,struct<value:string>>, claims map<string,{claim}>")
    rows = raw.select(item.alias("i")).select("i.id", "i.labels", F.explode_outer("i.claims").alias("property", "list"))
    flat = rows.select("id", "property", F.posexplode_outer("list").alias("position", "c"))
    value = F.coalesce(F.get_json_object("c.mainsnak.datavalue.value", "$.id"), F.col("c.mainsnak.datavalue.value"))
    ended = F.coalesce(F.map_contains_key("c.qualifiers", "P582"), F.lit(False))
    best = best_claims(flat.where("c is not null").select("id", "property", F.coalesce("c.rank", F.lit("normal")).alias("rank"), "position", value.alias("value"), ended.alias("ended")), "id")
    told = best.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("p"))
    labels = raw.select(item.alias("i")).select("i.id", F.coalesce(*[F.try_element_at("i.labels", F.lit(x))["value"] for x in languages]).alias("label"))
    got = lambda x: F.try_element_at("p", F.lit(x))
    nation = got("P297").isNotNull()
    parent = F.when(~F.coalesce(nation, F.lit(False)), F.coalesce(got("P131"), F.when(got("P17") != F.col("id"), got("P17"))))
    located = F.coalesce(nation, F.lit(False)) | got("P131").isNotNull() | got("P17").isNotNull() | got("P625").isNotNull()
    return labels.join(told, "id", "left").select("id", "label", parent.alias("parent"), F.when(F.coalesce(nation, F.lit(False)), F.col("id")).otherwise(got("P17")).alias("country"), got("P297").alias("iso"), F.coalesce(located, F.lit(False)).alias("located"))


def inbox(raw: DataFrame) -> DataFrame:
    """(kind, actor, object, text) of activities as JSON (value): likes and shares are upvotes, public replies replies; undone and deleted ones take back."""
    activity = "id string, type string, actor string, to array<string>, object string"
    rows = raw.select(F.from_json("value", activity).alias("a")).select("a.*")
    inner = F.from_json("object", "id string, type string, inReplyTo string, content string, object string")
    rows = rows.withColumn("o", F.when(F.col("object").startswith("{"), inner))
    public = F.exists("to", lambda x: x.endswith("#Public"))
    kind = (
        F.when(F.col("type").isin("Like", "Announce"), "upvote")
        .when((F.col("type") == "Create") & (F.col("o.type") == "Note") & F.col("o.inReplyTo").isNotNull() & public, "reply")
        .when((F.col("type") == "Undo") & F.col("o.type").isin("Like", "Announce"), "remove_upvote")
        .when((F.col("type") == "Undo") & (F.col("o.type") == "Follow"), "unfollow")
        .when(F.col("type") == "Delete", "remove_reply")
        .when(F.col("type") == "Follow", "follow")
    )
    target = F.when(F.col("type") == "Create", F.col("o.inReplyTo")).when(F.col("type") == "Undo", F.coalesce("o.object", "o.id")).otherwise(F.coalesce("o.id", "object"))
    return rows.select(kind.alias("kind"), "actor", target.alias("object"), F.when(kind == "reply", one_line(tags_cut(F.col("o.content")))).alias("text")).where("kind is not null")
