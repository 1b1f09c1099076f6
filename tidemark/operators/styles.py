"""Closed schemas of declared values and their checks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of values that a declaration may have.
KINDS = {"color": r"^#[0-9a-f]{6}$", "size": r"^[0-9]{1,3}(px|rem|%)$", "word": r"^[a-z][a-z-]{0,30}$"}
MOST_TYPES, MOST_STYLES = 10, 50


@dataclass(frozen=True)
class Declaration:
    name: str
    kind: str

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind}")
        if not re.fullmatch(r"[a-z][a-z_]{0,30}", self.name):
            raise ValueError(f"bad name {self.name}")


def compiled(declared: dict[str, str]) -> dict:
    """The closed JSON Schema of a style type: its names and kinds, nothing else allowed."""
    rows = [Declaration(name, kind) for name, kind in declared.items()]
    return {"type": "object", "additionalProperties": False, "properties": {d.name: {"type": "string", "pattern": KINDS[d.kind]} for d in rows}}


#: What a declared name looks like, and how many a type has at most.
NAME, MOST_NAMES = r"^[a-z][a-z0-9_]{0,31}$", 64


def compiled_type(declared: Column) -> tuple[Column, Column]:
    """(schema, refusal) of declared types, maps from names to kinds: the closed JSON Schema as text, every name required, names in order.

    Refused, by the first of: no name or too many, a name of another shape, an unknown kind; of several the least is told.
    """
    entries = F.array_sort(F.map_entries(declared))
    names = F.transform(entries, lambda e: e["key"])
    bad = F.get(F.filter(names, lambda n: ~n.rlike(NAME)), F.lit(0))
    unknown = F.get(F.array_sort(F.filter(F.transform(entries, lambda e: F.coalesce(e["value"], F.lit("null"))), lambda k: ~k.isin(*KINDS))), F.lit(0))
    refusal = F.when(declared.isNull() | ~F.size(entries).between(1, MOST_NAMES), f"a type declares 1 to {MOST_NAMES} names").when(bad.isNotNull(), F.concat(F.lit("bad name: "), bad)).when(unknown.isNotNull(), F.concat(F.lit("unknown kind: "), unknown))
    patterns = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    properties = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], F.struct(F.lit("string").alias("type"), F.try_element_at(patterns, F.coalesce(e["value"], F.lit(""))).alias("pattern")))))
    schema = F.to_json(F.struct(F.lit("object").alias("type"), F.lit(False).alias("additionalProperties"), properties.alias("properties"), names.alias("required")))
    return F.when(refusal.isNull(), schema), refusal


def changed_schemas(old: DataFrame, new: DataFrame) -> DataFrame:
    """(type_id) of types (type_id, schema) whose schema is no longer what it was: schemas are immutable."""
    return old.alias("o").join(new.alias("n"), "type_id").where("o.schema <> n.schema").select("type_id")


def matches_schema(value: Column, schema: dict) -> Column:
    """Whether a JSON object has only a closed schema's names, each with a value of its pattern; anything else fails."""
    names = F.json_object_keys(value)
    ok = names.isNotNull() & F.forall(names, lambda n: n.isin(*schema["properties"]))
    for name, rule in schema["properties"].items():
        said = F.get_json_object(value, f"$.{name}")
        ok = ok & (said.isNull() | said.rlike(rule["pattern"]))
    return F.coalesce(ok, F.lit(False))


def tokens_of(value: Column) -> Column:
    """Name and value pairs of a JSON object whose values hold no unsafe character."""
    pairs = F.map_entries(F.from_json(value, "map<string,string>"))
    return F.filter(pairs, lambda e: e["value"].rlike(r"^[A-Za-z0-9#%. ,_-]*$"))


def offending(values: DataFrame, schema: list[Declaration]) -> DataFrame:
    """(style_id, name, value) of rows that the closed schema does not allow: unknown names and ill-formed values."""
    ok = F.lit(False)
    for d in schema:
        ok = ok | ((F.col("name") == d.name) & F.col("value").rlike(KINDS[d.kind]))
    return values.where(~F.coalesce(ok, F.lit(False)))


def over_quota(styles: DataFrame) -> DataFrame:
    """(owner, n) of owners with more styles than they may have."""
    return styles.groupBy("owner").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_STYLES)


def declarations(values: DataFrame, schema: list[Declaration]) -> DataFrame:
    """(style_id, css): allowed declarations, names with - for _, in name order."""
    good = values.join(offending(values, schema).select("style_id", "name"), ["style_id", "name"], "left_anti")
    line = F.concat(F.replace("name", F.lit("_"), F.lit("-")), F.lit(": "), "value")
    return good.groupBy("style_id").agg(F.array_join(F.sort_array(F.collect_set(line)), "; ").alias("css"))
