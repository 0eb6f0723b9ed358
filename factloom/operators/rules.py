"""Rule reconciliation of fact pairs: a ladder of conditions, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import numbers_equal, parse_numeric
from ..functions.periods import compared, normalize_period
from ..functions.qualifiers import differing_keys, formatted
from ..functions.text import js_number, let, normalize_value, trimmed

#: Why a pair needs a judge.
NO_PERIOD = "Missing time scope on one of the facts prevents deterministic reconciliation"
SAME_PERIOD = "Values differ under matching time scope and qualifiers; requires LLM judge"


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.coalesce(c, F.lit("undefined")), F.lit('"'))


def parsed(value: Column, raw_value: Column, unit: Column, currency: Column, time_scope: Column) -> Column:
    """What the ladder compares of a fact: struct<value, raw, period, number>."""
    return F.struct(
        normalize_value(value).alias("value"),
        F.lower(trimmed(raw_value)).alias("raw"),
        normalize_period(time_scope).alias("period"),
        parse_numeric(value, unit, currency).alias("number"),
    )


def rule_reconcile(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` of struct columns (predicate, value, raw_value, unit, currency, time_scope, qualifiers) with
    relation_type, confidence, method, explanation, escalate, reason. Escalated pairs have no decision. Sides that bring
    ``parsed`` are not parsed again."""
    x, y = F.col(a), F.col(b)
    own = lambda c, name: c["parsed"] if "parsed" in pairs.schema[name].dataType.names else parsed(*(c[k] for k in ("value", "raw_value", "unit", "currency", "time_scope")))
    # each side is parsed once: the ladder refers to the parts many times
    parts = F.struct(own(x, a).alias("a"), own(y, b).alias("b"), F.get(differing_keys(x["qualifiers"], y["qualifiers"]), 0).alias("key"))
    steps = pairs.withColumn("__d", let(parts, lambda s: decision(x, y, s["a"], s["b"], s["key"])))
    return steps.select(*pairs.columns, "__d.*")


def decision(x: Column, y: Column, px: Column, py: Column, key: Column) -> Column:
    t, na, nb = compared(px["period"], py["period"]), px["number"], py["number"]
    other_period = ~(t["both_missing"] | t["one_missing"] | t["same"])
    same_text = ((px["value"] != "") & (px["value"] == py["value"])) | F.coalesce((px["raw"] != "") & (px["raw"] == py["raw"]), F.lit(False))
    equal = na.isNotNull() & nb.isNotNull() & F.coalesce(numbers_equal(na, nb), F.lit(False))
    currencies = F.coalesce(na["currency"] != nb["currency"], F.lit(False))
    rung = (
        F.when(~other_period & same_text, 1)
        .when(~other_period & equal & currencies, 2)
        .when(~other_period & equal, 3)
        .when(other_period, 4)
        .when(key.isNotNull(), 5)
        .when(t["one_missing"], 6)
        .otherwise(7)
    )
    va, vb = quoted(x["value"]), quoted(y["value"])
    # The sentences
    said = lambda r: (
        F.when(r == 1, F.concat(F.lit("Both documents report identical values of "), va, F.lit(" for "), x["predicate"], F.lit(".")))
        .when(r == 2, F.concat(F.lit("Values are numerically identical ("), js_number(na["value"]), F.lit(") but reported in different currencies: "), na["currency"], F.lit(" vs "), nb["currency"], F.lit(".")))
        .when(r == 3, F.concat(F.lit("Values are numerically equivalent after unit normalization: "), va, F.lit(" matches "), vb, F.lit(" for "), x["predicate"], F.lit(".")))
        .when(r == 4, F.concat(F.lit("Values differ ("), va, F.lit(" vs "), vb, F.lit(") because they cover different time periods: "), quoted(x["time_scope"]), F.lit(" vs "), quoted(y["time_scope"]), F.lit(".")))
        .when(r == 5, F.concat(F.lit("Values differ ("), va, F.lit(" vs "), vb, F.lit(") due to different "), key, F.lit(" qualifier: "), quoted(formatted(x["qualifiers"], key)), F.lit(" vs "), quoted(formatted(y["qualifiers"], key)), F.lit(".")))
    )
    return let(
        rung,
        lambda r: F.struct(
            F.when(r.isin(1, 3), "corroborates").when(r.isin(2, 4, 5), "reconciled").alias("relation_type"),
            F.when(r.isin(1, 3), 0.95).when(r.isin(2, 4, 5), 0.90).alias("confidence"),
            F.when(r <= 5, "rule").alias("method"),
            said(r).alias("explanation"),
            (r > 5).alias("escalate"),
            F.when(r == 6, NO_PERIOD).when(r == 7, SAME_PERIOD).alias("reason"),
        ),
    )
