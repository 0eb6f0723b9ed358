"""Numbers within texts: currency, multiplier, unit and value; equality across units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalize_value, trimmed

#: Multiplier words.
MULTIPLIERS = {"b": 1e9, "billion": 1e9, "bn": 1e9, "cr": 1e7, "crore": 1e7, "crores": 1e7, "k": 1e3, "l": 1e5, "lac": 1e5, "lacs": 1e5, "lakh": 1e5, "lakhs": 1e5, "m": 1e6, "million": 1e6, "mn": 1e6, "t": 1e12, "thousand": 1e3, "trillion": 1e12}
#: Currency words and signs; the first in this order that is found counts.
CURRENCIES = {"$": "USD", "dollar": "USD", "dollars": "USD", "eur": "EUR", "euro": "EUR", "gbp": "GBP", "inr": "INR", "jpy": "JPY", "pound": "GBP", "pounds": "GBP", "rs": "INR", "rupee": "INR", "rupees": "INR", "usd": "USD", "yen": "JPY", "£": "GBP", "¥": "JPY", "€": "EUR", "₹": "INR"}
TOLERANCE = 1e-6

BY_LENGTH = sorted(MULTIPLIERS, key=len, reverse=True)


def detect_currency(normal: Column, hint: Column) -> Column:
    """The first currency, in the order of the table, whose word stands in the text or whose code is the hint; else what the
    hint says."""
    signs = "|".join(f"\\Q{sign}\\E" for sign in CURRENCIES)
    found = F.regexp_extract_all(F.lower(normal), F.lit(f"(?:^|[\\s\\d])({signs})(?=[\\s\\d]|$)"), 1)
    hinted = F.coalesce(hint != "", F.lit(False))
    upper = F.when(hinted, F.upper(hint))
    table = F.array(*[F.struct(F.lit(sign).alias("sign"), F.lit(code).alias("code")) for sign, code in CURRENCIES.items()])
    words = F.create_map(*[F.lit(x) for pair in CURRENCIES.items() for x in pair])
    first = let(found, lambda f: F.get(F.filter(table, lambda x: F.array_contains(f, x["sign"]) | F.coalesce(upper == x["code"], F.lit(False))), 0)["code"])
    return F.coalesce(first, F.when(hinted, F.coalesce(F.try_element_at(words, F.lower(hint)), upper)))


def detect_multiplier(normal: Column, hint: Column) -> Column:
    """The multiplier word: in the text after a digit or space, longest first, else one that the unit hint begins with."""
    words = "|".join(BY_LENGTH)
    found = F.regexp_extract_all(F.lower(normal), F.lit(f"(?:^|[\\d\\s])({words})\\b"), 1)
    within = let(found, lambda f: F.get(F.filter(F.array(*map(F.lit, BY_LENGTH)), lambda w: F.array_contains(f, w)), 0))
    return F.coalesce(within, F.nullif(F.regexp_extract(F.lower(trimmed(hint)), f"^(?:{words})", 0), F.lit("")))


def parse_numeric(value: Column, unit: Column, currency: Column) -> Column:
    """struct<value, multiplier, explicit, currency, unit, physical_unit>, or null where no number is found."""
    factors = F.create_map(*[F.lit(x) for pair in MULTIPLIERS.items() for x in pair])
    percent = lambda normal: F.contains(normal, F.lit("%")) | F.coalesce(unit.rlike("(?i)percent|pct|%"), F.lit(False))
    parts = lambda normal: F.struct(
        normal.alias("normal"),
        F.regexp_extract(normal, "[-+]?\\d+(?:\\.\\d+)?", 0).alias("number"),
        detect_multiplier(normal, unit).alias("word"),
        percent(normal).alias("percent"),
        trimmed(unit).alias("own"),
    )

    def made(p: Column) -> Column:
        factor = F.coalesce(F.try_element_at(factors, p["word"]), F.lit(1.0))
        number = p["number"].try_cast("double")
        own = F.when((p["own"] != "") & ~F.lower(p["own"]).isin(*MULTIPLIERS), p["own"])
        return F.when(
            ~p["normal"].isin("", "n/a", "none", "-", "null", "undefined") & (p["number"] != ""),
            F.struct(
                F.when(p["percent"], number).otherwise(number * factor).alias("value"),
                factor.alias("multiplier"),
                p["word"].isNotNull().alias("explicit"),
                detect_currency(p["normal"], currency).alias("currency"),
                F.when(p["percent"], "percent").otherwise(F.coalesce(p["word"], F.when(unit != "", unit))).alias("unit"),
                F.when(p["percent"], "percent").otherwise(own).alias("physical_unit"),
            ),
        )

    return let(normalize_value(value), lambda normal: let(parts(normal), made))


def numbers_equal(a: Column, b: Column) -> Column:
    """Equality of two parsed numbers within a relative tolerance; false where units say that they cannot be compared."""
    differ = lambda x, y: F.coalesce(x != y, F.lit(False))
    percent = lambda n: F.coalesce((n["unit"] == "percent") | (n["physical_unit"] == "percent"), F.lit(False))
    apart = (percent(a) != percent(b)) | differ(a["physical_unit"], b["physical_unit"]) | (differ(a["unit"], b["unit"]) & ~(a["explicit"] & b["explicit"]))
    x, y = a["value"], b["value"]
    near = F.abs(x - y) <= TOLERANCE * F.greatest(F.abs(x), F.abs(y))
    return F.coalesce(~apart & near, F.lit(False))
