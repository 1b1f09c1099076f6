"""Arguments read from JSON columns by declared fields: one declaration gives the JSON Schema that callers see, the typed value and the error.

A missing or null value takes the field's default and is an error where there is none. The first error, in the order of the fields, is told;
where there is one, the value is null. Text that is no JSON reads as an object without fields.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: The greatest whole number that a double holds exactly with all before it.
MOST_WHOLE = 2**53 - 1
NUMBER = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)$"


@dataclass(frozen=True)
class Field:
    """schema: the JSON Schema; read(value, at): (typed value, error) of a variant column at a path."""

    schema: dict
    read: Callable[[Column, Column], tuple[Column, Column]]
    required: bool = True


def _missing(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _scalar(kind: str, schema: dict, type_name: str, ok: Callable[[Column, Column], Column], must: str, default: object = None, clean: Callable[[Column], Column] = lambda x: x) -> Field:
    """A field whose value is of a SQL type; ok(variant, typed) says whether it will do, must what it has to be."""

    def read(value: Column, at: Column) -> tuple[Column, Column]:
        typed = F.try_variant_get(value, "$", type_name)
        good = F.coalesce(ok(value, typed), F.lit(False))
        error = F.when(~good, F.concat(at, F.lit(f" must be {must}")))
        if default is not None:
            good, error = good | _missing(value), F.when(~_missing(value), error)
            typed = F.when(_missing(value), F.lit(default)).otherwise(typed)
        return F.when(good, clean(typed)), error

    shown = {"type": kind, **{k: v for k, v in schema.items() if v is not None}}
    return Field(shown if default is None else shown | {"default": default}, read, default is None)


def integer(minimum: int | None = None, maximum: int | None = None, default: int | None = None) -> Field:
    low, high = -MOST_WHOLE if minimum is None else minimum, MOST_WHOLE if maximum is None else maximum
    ok = lambda v, x: _kind(v).rlike(NUMBER) & (F.try_variant_get(v, "$", "double") == x) & x.between(low, high)
    return _scalar("integer", {"minimum": minimum, "maximum": maximum}, "bigint", ok, f"an integer from {low} to {high}", default)


def number(minimum: float | None = None, above: float | None = None, maximum: float | None = None, default: float | None = None) -> Field:
    def ok(v: Column, x: Column) -> Column:
        out = _kind(v).rlike(NUMBER)
        for bound, holds in ((minimum, lambda b: x >= b), (above, lambda b: x > b), (maximum, lambda b: x <= b)):
            if bound is not None:
                out &= holds(bound)
        return out

    start = f"({above}" if above is not None else f"[{'-Infinity' if minimum is None else minimum}"
    must = f"a number in {start}, {'Infinity)' if maximum is None else f'{maximum}]'}"
    return _scalar("number", {"minimum": minimum, "exclusiveMinimum": above, "maximum": maximum}, "double", ok, must, default)


def boolean(default: bool | None = None) -> Field:
    return _scalar("boolean", {}, "boolean", lambda v, x: _kind(v) == "BOOLEAN", "true or false", default)


def string(least: int = 1, most: int | None = None, default: str | None = None) -> Field:
    """Trimmed, and never blank."""
    least = max(least, 1)

    def ok(v: Column, x: Column) -> Column:
        out = (_kind(v) == "STRING") & (F.length(F.trim(x)) >= least)
        return out if most is None else out & (F.length(x) <= most)

    if most is None:
        must = f"a string of at least {least} characters" if least > 1 else "a non-empty string"
    else:
        must = f"a string of {least} to {most} characters" if least > 1 else f"a non-empty string of at most {most} characters"
    return _scalar("string", {"minLength": least, "maxLength": most}, "string", ok, must, default, F.trim)


def uuid() -> Field:
    return _scalar("string", {"format": "uuid"}, "string", lambda v, x: (_kind(v) == "STRING") & x.rlike(UUID), "an id (a UUID)")


def one_of(values: Sequence[str], default: str | None = None) -> Field:
    return _scalar("string", {"enum": list(values)}, "string", lambda v, x: (_kind(v) == "STRING") & x.isin(*values), f"one of {', '.join(values)}", default)


def array(items: Field, least: int, most: int) -> Field:
    """Items are named by their place; the first item's error is told."""

    def read(value: Column, at: Column) -> tuple[Column, Column]:
        rows = F.try_variant_get(value, "$", "array<variant>")
        good = F.coalesce(_kind(value).startswith("ARRAY") & F.size(rows).between(least, most), F.lit(False))
        read_all = F.transform(rows, lambda x, n: F.struct(*(c.alias(name) for c, name in zip(items.read(x, F.concat(at, F.lit("["), n.cast("string"), F.lit("]"))), ("value", "error")))))
        wrong = F.get(F.filter(F.transform(read_all, lambda r: r["error"]), lambda e: e.isNotNull()), F.lit(0))
        error = F.when(~good, F.concat(at, F.lit(f" must list {least}-{most} items"))).otherwise(wrong)
        return F.when(error.isNull(), F.transform(read_all, lambda r: r["value"])), error

    return Field({"type": "array", "minItems": least, "maxItems": most, "items": items.schema}, read)


def record(fields: Mapping[str, Field]) -> Field:
    """Fields of an object, in order, each named by its path; what is no object has none of them."""

    def read(value: Column, at: Column) -> tuple[Column, Column]:
        found = {}
        for name, field in fields.items():
            path = F.when(F.length(at) > 0, F.concat(at, F.lit(f".{name}"))).otherwise(F.lit(name))
            found[name] = field.read(F.try_variant_get(value, f"$.{name}", "variant"), path)
        error = F.coalesce(*(e for _, e in found.values()))
        return F.when(error.isNull(), F.struct(*(v.alias(name) for name, (v, _) in found.items()))), error

    must = [name for name, field in fields.items() if field.required]
    return Field({"type": "object", "properties": {name: f.schema for name, f in fields.items()}} | ({"required": must} if must else {}), read)


def optional(field: Field) -> Field:
    """Null or left out reads as null; anything else must do."""

    def read(value: Column, at: Column) -> tuple[Column, Column]:
        typed, error = field.read(value, at)
        return F.when(~_missing(value), typed), F.when(~_missing(value), error)

    return Field(field.schema, read, False)


def parsed(text: Column, fields: Mapping[str, Field]) -> tuple[Column, Column]:
    """(value, error) of JSON text by fields."""
    return record(fields).read(F.try_parse_json(text), F.lit(""))
