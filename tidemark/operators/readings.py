"""Readings of texts: dates, event rows, names claimed by typed words, topic beams, claims between entities."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import nearest_date

#: Month names in English and French, with their numbers.
MONTHS = {name: k % 12 + 1 for k, name in enumerate("january february march april may june july august september october november december janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split())}
_MONTH = "|".join(MONTHS)
#: Dates: year first, numbers with the day first, day and month, month and day.
DATE = rf"(?i)\b(?:([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})|([0-9]{{1,2}})[./]([0-9]{{1,2}})[./]([0-9]{{4}})|([0-9]{{1,2}})(?:st|nd|rd|th|er)?\s+({_MONTH})(?:\s+([0-9]{{4}}))?|({_MONTH})\s+([0-9]{{1,2}})(?:st|nd|rd|th)?(?:,?\s+([0-9]{{4}}))?)\b"
MOST_DATES = 20
#: A topic's labels: paths kept at each level, the least score of a label, and how many labels.
BEAM, LEAST_SCORE, MOST_LABELS = 3, 0.5, 3
LEAST_CLAIM = 0.5


def date_candidates(sources: DataFrame, key: str, most: int = MOST_DATES) -> DataFrame:
    """(key, day, origin): dates said in sources (key, origin, text, reference); a day belongs to the first origin that says it.

    A date without a year gets the one that brings it nearest to the reference.
    """
    groups = [F.regexp_extract_all("text", F.lit(DATE), F.lit(k)) for k in range(13)]
    found = sources.select(key, "origin", "reference", F.posexplode(F.arrays_zip(*[g.alias(f"g{k}") for k, g in enumerate(groups)])).alias("at", "m"))
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def part(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col(f"m.g{n}"), F.lit("")).cast("int") for n in names])

    named = F.coalesce(*[F.try_element_at(months, F.lower(F.nullif(F.col(f"m.g{n}"), F.lit("")))) for n in (8, 10)])
    month, day, year = F.coalesce(part("2", "5"), named), part("3", "4", "7", "11"), part("1", "6", "9", "12")
    whole = F.when(year.isNotNull(), F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day))).otherwise(nearest_date(month, day, F.col("reference")))
    rows = found.select(key, "origin", "at", whole.alias("day")).where("day is not null")
    first = rows.groupBy(key, "day").agg(F.min(F.struct("origin", "at")).alias("place"))
    order = Window.partitionBy(key).orderBy("place", "day")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select(key, "day", F.col("place.origin").alias("origin"))


def unit_rows(dates: DataFrame, key: str) -> DataFrame:
    """(key, starts, ends, p) from dates (key, role, day, until, p): a period, else a start with an end, else a row for each day.

    A start behind its own end is a year earlier.
    """

    def best(role: str) -> Column:
        chosen = F.when(F.col("role") == role, F.struct(F.col("p"), F.col("day"), F.col("until")))
        return F.max(chosen).alias(role)

    units = dates.groupBy(key).agg(best("period"), best("start"), best("end"))
    starts, ends = F.col("start.day"), F.col("end.day")
    earlier = F.add_months(starts, -12)
    starts = F.when(starts > ends, F.when(earlier <= ends, earlier)).otherwise(starts)
    run = units.where("period is null and (start is not null or end is not null)").select(key, starts.alias("starts"), F.when(F.col("start.day").isNull() | (ends > F.coalesce(starts, F.lit("0001-01-01").cast("date"))), ends).alias("ends"), F.least(F.coalesce("start.p", F.lit(1.0)), F.coalesce("end.p", F.lit(1.0))).alias("p"))
    periods = units.where("period is not null").select(key, F.col("period.day").alias("starts"), F.col("period.until").alias("ends"), F.col("period.p").alias("p"))
    plain = units.where("period is null and start is null and end is null").select(key)
    days = dates.where("role = 'on'").join(plain, key, "left_semi").select(key, F.col("day").alias("starts"), F.lit(None).cast("date").alias("ends"), "p")
    return periods.union(run).union(days)


#: Kinds of events by what their declared type says, the first match first.
EVENT_KINDS = (("exhibition|visualarts", "exhibition"), ("music|concert", "concert"), ("festival", "festival"), ("conference|business", "conference"))


def declared_events(rows: DataFrame) -> DataFrame:
    """rows (name, type, start, end) as event rows: kind, starts_on, ends_on, start_time; rows without any date go."""
    kind = F.lit("other")
    for pattern, name in reversed(EVENT_KINDS):
        kind = F.when(F.col("type").rlike(f"(?i){pattern}"), name).otherwise(kind)
    day = lambda c: F.try_to_date(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})", 1))
    out = rows.select("name", kind.alias("kind"), day("start").alias("starts_on"), day("end").alias("last"), F.nullif(F.regexp_extract("start", r"T(\d{2}:\d{2})", 1), F.lit("")).alias("start_time"))
    ends = F.when(F.col("starts_on").isNull() | (F.col("last") > F.col("starts_on")), F.col("last"))
    return out.where("starts_on is not null or last is not null").select("name", "kind", "starts_on", ends.alias("ends_on"), "start_time")


def claimed_names(typed: DataFrame, lexicon: DataFrame, key: str, longest: int = 3) -> DataFrame:
    """(key, name): the names of a lexicon (name, words array) that typed words (key, words array) claim, longest first.

    Every word of a name must be typed and still open; a name takes its words from those after it. Names of a length
    are settled by place of their first word, so that rounds, one for each length, decide all texts side by side.
    """
    named = lexicon.groupBy("words").agg(F.min("name").alias("name")).withColumn("first", F.element_at("words", 1)).withColumn("n", F.size("words"))
    met = typed.select(key, F.col("words").alias("open"), F.explode(F.array_distinct("words")).alias("first")).join(named, "first")
    met = met.where(F.size(F.array_except("words", "open")) == 0).select(key, "name", "words", "n", F.array_position("open", F.col("first")).alias("at"))
    claims, taken = None, None
    for n in range(longest, 0, -1):
        rows = met.where(F.col("n") == n)
        if taken is not None:
            rows = rows.join(taken, key, "left").where(F.size(F.array_intersect("words", F.coalesce("taken", F.array().cast("array<string>")))) == 0).drop("taken")
        order = Window.partitionBy(key).orderBy("at", "name").rowsBetween(Window.unboundedPreceding, -1)
        before = F.flatten(F.collect_list("words").over(order))
        won = rows.withColumn("before", before).where(F.size(F.array_intersect("words", "before")) == 0).select(key, "name", "words")
        claims = won if claims is None else claims.union(won)
        taken = claims.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("taken"))
    return claims.select(key, "name")


def prefix_index(lexicon: DataFrame) -> DataFrame:
    """(prefix, anchor, names, n, name, others) of a lexicon (name, words array): which names a word's beginning may complete.

    A name stands under each beginning of each of its words with the words that do not begin so (others) and the first of them
    (anchor). Names that need no other word are one row for each prefix: how many there are, and the name where there is one.
    """
    named = lexicon.groupBy("words").agg(F.min("name").alias("name"))
    beginnings = F.transform("words", lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.substring(w, F.lit(1), k)))
    rows = named.select("name", "words", F.explode(F.array_distinct(F.flatten(beginnings))).alias("prefix"))
    rows = rows.withColumn("others", F.filter("words", lambda w: ~w.startswith(F.col("prefix"))))
    rows = rows.withColumn("anchor", F.coalesce(F.get("others", F.lit(0)), F.lit("")))
    alone = rows.where("anchor = ''").groupBy("prefix", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"), F.first("others").alias("others"))
    return alone.unionByName(rows.where("anchor <> ''").select("prefix", "anchor", F.lit(1).cast("long").alias("n"), "name", "others"))


def completed_names(typed: DataFrame, lexicon: DataFrame, key: str, longest: int = 3) -> DataFrame:
    """(key, name) of typed words (key, words array, partial): the names that whole words claim and, behind them, the one name that the word
    still being typed may finish. A beginning that several names share finishes none; nor does a word that a name has taken."""
    claims = claimed_names(typed, lexicon, key, longest)
    words = claims.join(lexicon.groupBy("name").agg(F.min("words").alias("words")), "name").groupBy(key).agg(F.flatten(F.collect_list("words")).alias("taken"))
    left = typed.join(words, key, "left").withColumn("open", F.array_except("words", F.coalesce("taken", F.array().cast("array<string>"))))
    left = left.where(F.array_contains("open", F.col("partial")) & (F.length("partial") > 0))
    anchors = F.array_union(F.array(F.lit("")), F.array_except("open", F.array("partial")))
    met = left.select(key, "open", F.col("partial").alias("prefix"), F.explode(anchors).alias("anchor")).join(prefix_index(lexicon), ["prefix", "anchor"])
    met = met.where(F.size(F.array_except("others", "open")) == 0)
    only = met.groupBy(key).agg(F.sum("n").alias("n"), F.min("name").alias("name")).where("n = 1")
    return claims.unionByName(only.select(key, "name"))


@dataclass(frozen=True)
class Filter:
    """A conjunction of terms; local is its form on a local index, None where it has none."""

    terms: tuple[str, ...] = ()
    local: tuple[str, ...] | None = ()
    seen_last: bool = False

    def __add__(self, other: Filter) -> Filter:
        local = None if self.local is None or other.local is None else self.local + other.local
        return Filter(self.terms + other.terms, local, self.seen_last or other.seen_last)

    def last(self) -> Filter:
        return replace(self, local=None, seen_last=True)

    def rows(self, df: DataFrame) -> DataFrame:
        for term in self.terms:
            df = df.where(term)
        return df


def beam_labels(probabilities: DataFrame, key: str, levels: int, width: int = BEAM, least: float = LEAST_SCORE, most: int = MOST_LABELS) -> DataFrame:
    """(key, node, score): a beam over a tree of probabilities (key, parent, node, p); parent is '' at the root.

    A path's score is the geometric mean of its decisions; a node's only child is no decision. Each level is one join.
    """
    rows = probabilities.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key, "parent")))
    beam = rows.select(key).distinct().select(key, F.lit("").alias("node"), F.lit(0.0).alias("logs"), F.lit(0).alias("decisions"), F.lit(1.0).alias("score"))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "node")
    for _ in range(levels):
        steps = rows.select(key, F.col("parent").alias("node"), F.col("node").alias("child"), "p", "n")
        grown = beam.join(steps, [key, "node"], "left")
        decided = F.col("child").isNotNull() & ((F.col("n") > 1) | (F.col("node") == ""))
        logs = F.col("logs") + F.when(decided, F.log(F.greatest("p", F.lit(1e-300)))).otherwise(0.0)
        decisions = F.col("decisions") + F.when(decided, 1).otherwise(0)
        grown = grown.select(key, F.coalesce("child", "node").alias("node"), logs.alias("logs"), decisions.alias("decisions"))
        grown = grown.withColumn("score", F.when(F.col("decisions") > 0, F.exp(F.col("logs") / F.col("decisions"))).otherwise(1.0))
        beam = grown.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= width).drop("rank")
    chosen = beam.where((F.col("node") != "") & (F.col("score") >= least)).withColumn("rank", F.row_number().over(best))
    return chosen.where(F.col("rank") <= most).select(key, "node", F.round("score", 3).alias("score"))


def beam_over_tree(links: DataFrame, tree: DataFrame, key: str, levels: int, answer: Callable[[Column, Column], Column], width: int = BEAM, least: float = LEAST_SCORE, most: int = MOST_LABELS) -> DataFrame:
    """The same over a tree (parent, node) whose questions are asked as the beam reaches them: answer(key, node) is a node's probability.

    At each level a path meets its own node's children, held as one row a node: what is joined grows with the links and the beam's width,
    never with the tree. Many links at one node (all are at the root) are a skewed key, which adaptive execution splits on the links' side.
    """
    children = tree.groupBy(F.col("parent").alias("node")).agg(F.sort_array(F.collect_set("node")).alias("children"))  # a node's children, as many as the taxonomy gives it
    beam = links.select(key).distinct().select(key, F.lit("").alias("node"), F.lit(0.0).alias("logs"), F.lit(0).alias("decisions"), F.lit(1.0).alias("score"))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "node")
    for _ in range(levels):
        grown = beam.join(children, "node", "left").withColumn("decided", (F.size("children") > 1) | (F.col("node") == ""))
        grown = grown.select(key, "node", "logs", "decisions", F.coalesce("decided", F.lit(False)).alias("decided"), F.explode_outer("children").alias("child"))
        asked = F.col("decided") & F.col("child").isNotNull()
        logs = F.col("logs") + F.when(asked, F.log(F.greatest(answer(F.col(key), F.col("child")), F.lit(1e-300)))).otherwise(0.0)
        grown = grown.select(key, F.coalesce("child", "node").alias("node"), logs.alias("logs"), (F.col("decisions") + asked.cast("int")).alias("decisions"))
        grown = grown.withColumn("score", F.when(F.col("decisions") > 0, F.exp(F.col("logs") / F.col("decisions"))).otherwise(1.0))
        beam = grown.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= width).drop("rank")
    chosen = beam.where((F.col("node") != "") & (F.col("score") >= least)).withColumn("rank", F.row_number().over(best))
    return chosen.where(F.col("rank") <= most).select(key, "node", F.round("score", 3).alias("score"))


@dataclass(frozen=True)
class Relation:
    """A relation and the kinds that may not be its subject or object; only: kinds that alone may be."""

    name: str
    subject_not: Sequence[str] = ()
    object_not: Sequence[str] = ()
    subject_only: Sequence[str] = ()
    object_only: Sequence[str] = ()
    symmetric: bool = False

    def allows(self, subject: Column, object_: Column) -> Column:
        ok = ~subject.isin(*self.subject_not, "") & ~object_.isin(*self.object_not, "")
        if self.subject_only:
            ok &= subject.isin(*self.subject_only)
        return ok & object_.isin(*self.object_only) if self.object_only else ok


#: Where people and places can't stand.
RELATIONS = (
    Relation("acquires", ("person", "place"), ("person", "place")),
    Relation("invests_in", ("place",), ("person", "place")),
    Relation("customer_of", object_not=("person", "place")),
    Relation("part_of", ("person",), ("person",)),
    Relation("makes", ("place",), ("person", "place")),
    Relation("leads", subject_only=("person",), object_not=("person", "place")),
    Relation("works_for", subject_only=("person",), object_not=("place",)),
    Relation("sues"),
    Relation("regulates", ("person",)),
    Relation("criticizes"),
    Relation("located_in", object_only=("place",)),
    Relation("partners_with", ("person", "place"), ("person", "place"), symmetric=True),
    Relation("competes_with", ("place",), ("place",), symmetric=True),
)


def claims(mentions: DataFrame, answers, most: int = 5, least: float = LEAST_CLAIM) -> DataFrame:
    """(link_id, subject, relation, object, p) from mentions (link_id, entity_id, kind, p): the likeliest allowed relation of each pair.

    answers(a, b, name) is the probability of a relation as a Column. A link's `most` surest mentions are paired; symmetric
    relations are stored with the smaller id first.
    """
    sure = Window.partitionBy("link_id").orderBy(F.desc("p"), "entity_id")
    top = mentions.withColumn("n", F.row_number().over(sure)).where(F.col("n") <= most).select("link_id", F.struct("n", "entity_id", "kind").alias("e"))
    groups = top.groupBy("link_id").agg(F.array_sort(F.collect_list("e")).alias("all"))  # at most `most` to a link
    pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b["n"] > a["n"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = groups.select("link_id", F.explode(pairs).alias("pair"))
    a, b = F.col("pair.a"), F.col("pair.b")
    options = []
    for k, r in enumerate(RELATIONS):
        for s, o in ((a, b),) if r.symmetric else ((a, b), (b, a)):
            allowed = r.allows(s["kind"], o["kind"]) & (r.allows(o["kind"], s["kind"]) if r.symmetric else F.lit(True))
            low = F.least(s["entity_id"], o["entity_id"]) if r.symmetric else s["entity_id"]
            high = F.greatest(s["entity_id"], o["entity_id"]) if r.symmetric else o["entity_id"]
            options.append(F.when(allowed, F.struct(answers(s["entity_id"], o["entity_id"], r.name).alias("p"), F.lit(-k).alias("order"), low.alias("subject"), F.lit(r.name).alias("relation"), high.alias("object"))))
    rows = rows.select("link_id", F.array_max(F.array(*options)).alias("c"))
    return rows.where(F.col("c.p") >= least).select("link_id", "c.subject", "c.relation", "c.object", "c.p")
