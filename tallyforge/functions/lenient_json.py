"""Lenient access to JSON of unknown shape (VARIANT): what is not a number counts as 0, what is not a string as ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def kind(v: Column, path: str) -> Column:
    """The type at the path as Spark names it, null if there is nothing."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def is_number(v: Column, path: str) -> Column:
    return F.coalesce(F.regexp_like(kind(v, path), F.lit(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")), F.lit(False))


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(F.startswith(kind(v, path), F.lit("OBJECT")), F.lit(False))


def is_array(v: Column, path: str) -> Column:
    return F.coalesce(F.startswith(kind(v, path), F.lit("ARRAY")), F.lit(False))


def num(v: Column, path: str) -> Column:
    """A double; text and booleans are not converted."""
    return F.coalesce(F.when(is_number(v, path), F.try_variant_get(v, path, "double")), F.lit(0.0))


def long(v: Column, path: str) -> Column:
    """A whole number, cut towards zero."""
    return whole(num(v, path))


def whole(x: Column) -> Column:
    """A double as a whole number, cut towards zero."""
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")


def text(v: Column, path: str) -> Column:
    """A string, only if it is one in the JSON."""
    return F.coalesce(F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string")), F.lit(""))


def truthy(v: Column, path: str) -> Column:
    k = kind(v, path)
    out = (
        F.when(k.isNull() | (k == "VOID"), False)
        .when(k == "STRING", F.try_variant_get(v, path, "string") != "")
        .when(k == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
        .when(is_number(v, path), F.try_variant_get(v, path, "double") != 0)
        .otherwise(True)
    )
    return F.coalesce(out, F.lit(False))


def shown(v: Column, path: str) -> Column:
    """A value as text the way scripts print it; objects and lists as their JSON."""
    from .scalars import js_number_text

    k = kind(v, path)
    return F.when(is_number(v, path), js_number_text(F.try_variant_get(v, path, "double"))).when(
        k.isNotNull() & (k != "VOID"), F.try_variant_get(v, path, "string")
    )


def first_text(v: Column, *paths: str) -> Column:
    """The first truthy value as text, or ''."""
    out = F.lit("")
    for path in reversed(paths):
        out = F.when(truthy(v, path), shown(v, path)).otherwise(out)
    return out
