"""Text and url expressions; all inside whole-stage code generation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Combining marks.
MARKS = r"[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]"


def host(url: Column) -> Column:
    """Lower-case host without www.; empty where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(found, r"^www[.]", "")


def feed_host(url: Column) -> Column:
    """The host without one leading label of www, feed, feeds or rss."""
    whole = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.regexp_replace(whole, r"^(www|feeds?|rss)[.]", "")


def is_web_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/\s]+"), F.lit(False))


def is_slug(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


#: Where a video's id stands, by host: behind one of these paths, or as the parameter v of /watch.
VIDEO_HOSTS = ("youtube.com", "m.youtube.com", "music.youtube.com")
VIDEO_PATHS = ("shorts", "embed", "live")
SHORT_VIDEO_HOST = "youtu.be"


def video_id(url: Column) -> Column:
    """The 11 characters that name a video in the usual url forms; null for other hosts, paths and lengths."""
    site, path = host(url), F.regexp_extract(url, "^[^:/?#]+://[^/?#]*/([^?#]*)", 1)
    first, second = F.split_part(path, F.lit("/"), F.lit(1)), F.split_part(path, F.lit("/"), F.lit(2))
    asked = F.regexp_extract(url, "[?&]v=([^&#]*)", 1)
    found = F.when(site == SHORT_VIDEO_HOST, first).when(site.isin(*VIDEO_HOSTS), F.when(first == "watch", asked).when(first.isin(*VIDEO_PATHS), second))
    return F.when(found.rlike("^[A-Za-z0-9_-]{11}$"), found)


def language_key(lang: Column) -> Column:
    """The primary subtag in lower case; und for null or blank."""
    return F.coalesce(F.nullif(F.lower(F.split_part(F.trim(lang), F.lit("-"), F.lit(1))), F.lit("")), F.lit("und"))


#: The label prefix of calendars whose whole rest is a name, and the longest name.
CALENDAR_LABEL, LONGEST_NAME = "luma", 200


def label_parts(label: Column) -> Column:
    """A label's (name, description): it is cut at the first colon and blank; a calendar's label is all name."""
    parts = F.split(label, ": ", 2)
    head, rest = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    calendar = (F.lower(F.get(parts, F.lit(0))) == CALENDAR_LABEL) & rest.isNotNull()
    return F.struct(F.when(calendar, rest).otherwise(head).alias("name"), F.when(~calendar, rest).alias("description"))


def source_name(label: Column, identifier: Column) -> Column:
    """The name in a label, the identifier where that is blank."""
    return F.left(F.coalesce(F.nullif(label_parts(label)["name"], F.lit("")), identifier), F.lit(LONGEST_NAME))


def source_description(label: Column) -> Column:
    """The description in a label; null where there is none or it is blank."""
    return F.nullif(label_parts(label)["description"], F.lit(""))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, most: int) -> Column:
    """At most so many characters, the last an ellipsis where something was cut off."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…"))).otherwise(text)


def without_tags(html: Column) -> Column:
    """Text of markup: scripts and styles cut, tags become spaces, white space one space, five entities decoded."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return one_line(text)


def title_of(html: Column) -> Column:
    return F.nullif(one_line(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def meta_content(html: Column, name: str) -> Column:
    """The content of a meta tag by name or property, its attributes in either order."""
    a = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*(?:name|property)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*content=["']([^"']*)["'][^>]*(?:name|property)=["']{name}["']""", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def preview_image(html: Column) -> Column:
    """The first of the declared preview images, else the first image."""
    img = F.nullif(F.regexp_extract(html, r"""(?is)<img\s[^>]*src=["']([^"']+)["']""", 1), F.lit(""))
    return F.coalesce(meta_content(html, "og:image"), meta_content(html, "twitter:image"), img)


#: Short words whose full stop ends no sentence, besides single capitals.
ABBREVIATIONS = "Dr Mr Mrs Ms Mme Mlle St Ste Jr Sr Prof Gen Gov Sen Rep Lt Col Capt Inc Ltd Co Corp vs No".split()


def sentences(text: Column) -> Column:
    """Sentences: cut behind full stops, ! ? ; and at line ends; not behind an initial's or an abbreviation's full stop."""
    held = text
    for _ in range(2):  # neighbours share the character between them
        held = F.regexp_replace(held, rf"(^|[^\p{{L}}])(\p{{Lu}}|{'|'.join(ABBREVIATIONS)})[.]", "$1$2\x01")
    parts = F.split(held, r"[.]+(?:\s+|$)|[!?;]+(?:\s+|$)|\n+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(F.replace(s, F.lit("\x01"), F.lit(".")), r"^\s+|\s+$", "")), lambda s: s != "")


def contains_words(words: Column, name: Column) -> Column:
    """Whether an array of words has another as a run of neighbours."""
    n = F.size(name)
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    return (n > 0) & (n <= F.size(words)) & F.exists(starts, lambda i: F.slice(words, i, n) == name)


def canonical_key(values: Column) -> Column:
    """One text for a set: sorted distinct values joined by a bar."""
    return F.array_join(F.array_sort(F.array_distinct(values)), "|")


def name_first_word(name: Column) -> Column:
    """The folded first word of a name, without an elided article."""
    from tidemark.operators.search import fold

    return F.regexp_replace(F.regexp_extract(fold(name), "[a-z](?:[a-z0-9'-]*[a-z0-9])?", 0), "^[dl]'", "")


def name_words(name: Column) -> Column:
    """A name's lower-case words: letters and digits; a possessive's s is no word."""
    plain = F.regexp_replace(F.replace(F.lower(name), F.lit("’"), F.lit("'")), r"'s\b", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


@F.pandas_udf(StringType())
def without_marks(texts: pd.Series) -> pd.Series:
    """Lower case after canonical decomposition without its marks; ligatures and sharp s spelled out."""
    plain = texts.str.normalize("NFD").str.replace(MARKS, "", regex=True).str.replace("’", "'").str.lower()
    return plain.str.replace("œ", "oe").str.replace("æ", "ae").str.replace("ß", "ss")


@F.pandas_udf(StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Lower case after compatibility decomposition without its marks."""
    return texts.str.normalize("NFKD").str.replace(MARKS, "", regex=True).str.lower()


#: HTML's character names that feeds use.
CHARACTERS = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "hellip": "…", "ndash": "–", "mdash": "—", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "middot": "·", "copy": "©"}


def decoded(text: Column) -> Column:
    """Character references decoded, numbers in either base and the names above, the ampersand's last."""
    pieces = F.split(text, "(?=&#)|(?<=;)")

    def one(piece: Column) -> Column:
        number = F.regexp_extract(piece, "^&#([0-9]{1,7});$", 1)
        base16 = F.regexp_extract(piece, "^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        code = F.when(number != "", number.cast("int")).when(base16 != "", F.conv(base16, 16, 10).cast("int"))
        return F.when((code > 0) & (code < 0x110000), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(piece)

    out = F.array_join(F.transform(pieces, one), "")
    for name, character in CHARACTERS.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(character))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def tag_content(markup: Column, name: str) -> Column:
    """What stands in the first element of a name, without its CDATA marks; null without one."""
    inner = F.regexp_extract(markup, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1)
    found = markup.rlike(rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>")
    return F.when(found, F.trim(F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))


def tags_cut(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<[^>]*>", "")


def html_to_text(html: Column) -> Column:
    """Text of markup: block ends and line breaks are blanks, other tags nothing; references decoded."""
    spaced = F.regexp_replace(html, r"(?i)</(p|div|li|h[1-6]|blockquote)>|<br\s*/?>", " ")
    return one_line(decoded(tags_cut(spaced)))


def calendar_text(value: Column) -> Column:
    """A calendar's text value: folded lines joined, escaped marks and line ends restored."""
    joined = F.regexp_replace(value, r"\r?\n[ \t]", "")
    held = F.replace(joined, F.lit("\\\\"), F.lit("\x00"))
    return F.replace(F.regexp_replace(F.regexp_replace(held, r"\\[nN]", "\n"), r"\\([,;])", "$1"), F.lit("\x00"), F.lit("\\"))


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>#|])", r"\\$1")


def nearest_date(month: Column, day: Column, reference: Column) -> Column:
    """The date of a day and month whose year is nearest to a reference; forward where two are as near."""
    years = F.array(*[F.try_make_date(F.year(reference) + k, month, day) if hasattr(F, "try_make_date") else F.make_date(F.year(reference) + k, month, day) for k in (0, 1, -1)])
    ranked = F.transform(F.filter(years, lambda y: y.isNotNull()), lambda y: F.struct(F.abs(F.datediff(y, reference)).alias("far"), (y < reference).alias("back"), y.alias("day")))
    return F.get(F.array_sort(ranked), F.lit(0))["day"]


def must(condition: Column, value: Column, message: str) -> Column:
    """value; raises where the condition does not hold or is null."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(message))


def refuse(condition: Column, value: Column, message: str) -> Column:
    """value; raises where the condition holds; null passes."""
    return F.when(F.coalesce(condition, F.lit(False)), F.raise_error(message)).otherwise(value)


def common_path(paths: Column) -> Column:
    """The longest path that all of an array's paths begin with."""
    parts = F.transform(paths, lambda p: F.split(p, r"\."))
    first = F.get(parts, F.lit(0))
    shared = F.aggregate(parts, F.size(first), lambda n, p: F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(n, F.size(p)), F.lit(1))), lambda k: F.slice(p, F.lit(1), k) == F.slice(first, F.lit(1), k))))
    return F.array_join(F.slice(first, F.lit(1), shared), ".")


def sense_labels(senses: DataFrame, by: str) -> DataFrame:
    """(by, label) of senses (by, name, kind_path): the one name, else the kind path that all share, else `senses`, and how many."""
    groups = senses.groupBy(by).agg(F.collect_set("name").alias("names"), F.collect_set("kind_path").alias("kinds"), F.count(F.lit(1)).alias("n"))
    shared = F.nullif(common_path(F.col("kinds")), F.lit(""))
    label = F.when(F.size("names") == 1, F.get("names", F.lit(0))).otherwise(F.coalesce(shared, F.lit("senses")))
    return groups.select(by, F.concat(label, F.lit(" ×"), "n").alias("label"))
