"""Dotted paths into JSON values, and what a page's payload gives."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def variant_path(dotted: str) -> str:
    """a.0.b as $.a[0].b."""
    out = "$"
    for part in filter(None, dotted.strip().split(".")):
        out += f"[{part}]" if part.isdigit() else f".{part}" if part.isidentifier() else f"['{part}']"
    return out


def at_path(payload: Column, dotted: str, kind: str = "string") -> Column:
    """The value at a path of JSON text; null where it leads nowhere or the text is no JSON."""
    return F.try_variant_get(F.try_parse_json(payload), variant_path(dotted), kind)


def elements(payload: Column, dotted: str) -> Column:
    """The value at a path as an array of JSON texts: an array's elements, nothing for null, else the value alone."""
    v = F.try_variant_get(F.try_parse_json(payload), variant_path(dotted), "variant")
    text = F.to_json(v)
    array = F.try_variant_get(v, "$", "array<variant>")
    listed = F.transform(array, lambda x: F.to_json(x))
    return F.when(v.isNull() | (text == "null"), F.array().cast("array<string>")).when(text.startswith("["), listed).otherwise(F.array(text))


def positive_number(payload: Column, dotted: str) -> Column:
    """The value at a path as a number if it is finite and above 0."""
    n = at_path(payload, dotted).try_cast("double")
    return F.when((n > 0) & (n < float("inf")) & ~F.isnan(n), n)


def get(value: Any, dotted: str) -> Any:
    """The same path in Python objects: digits index arrays, and are keys of objects."""
    for part in filter(None, dotted.strip().split(".")):
        if isinstance(value, list):
            value = value[int(part)] if part.isdigit() and int(part) < len(value) else None
        elif isinstance(value, dict):
            value = value.get(part)
        else:
            return None
    return value


def as_list(value: Any) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]
