"""Qualifiers: JSON objects kept as text, so that types and key order stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: Keys that the engine itself writes; they never make two facts differ.
SYSTEM_KEYS = ["_entity", "printedPage", "quoteMismatch", "sourcePage", "visionOnly"]


def keys_of(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.coalesce(json, F.lit("{}"))), F.array().cast("array<string>"))


def value_of(json: Column, key: Column) -> Column:
    """The value of a key as text: a text itself, other types as compact JSON."""
    return F.call_function("get_json_object", json, F.concat(F.lit("$['"), key, F.lit("']")))


def comparable(json: Column, key: Column) -> Column:
    """Missing is '', and texts are trimmed and lower-cased."""
    return F.coalesce(F.lower(trimmed(value_of(json, key))), F.lit(""))


def differing_keys(a: Column, b: Column) -> Column:
    """Keys, first a's and then b's, whose values differ."""
    keys = F.array_except(F.array_union(keys_of(a), keys_of(b)), F.array(*map(F.lit, SYSTEM_KEYS)))
    return F.filter(keys, lambda k: comparable(a, k) != comparable(b, k))


def formatted(json: Column, key: Column) -> Column:
    """A value for an explanation; a missing one is ``undefined``, a null one ``null``."""
    has = F.array_contains(keys_of(json), key)
    return F.coalesce(value_of(json, key), F.when(has, "null").otherwise("undefined"))


def with_entry(json: Column, key: str, value: Column | str) -> Column:
    """The object with one more entry (raw JSON text), in last place."""
    body = F.regexp_replace(F.coalesce(json, F.lit("{}")), "\\s*\\}\\s*$", "")
    comma = F.when(F.size(keys_of(json)) > 0, ",").otherwise("")
    return F.concat(body, comma, F.lit(f'"{key}":'), F.lit(value) if isinstance(value, str) else value, F.lit("}"))
