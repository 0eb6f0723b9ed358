"""Period labels: normal forms and comparison. A fiscal-year form wins over a quarter; a range names its end year."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, let, trimmed

#: Label patterns, tried in this order on the upper-case label.
FISCAL = "(?:FY|FISCAL(?:\\s+YEAR)?)\\s*['’]?(\\d{2,4})"
RANGE = f"(?:{FISCAL}|(?:\\b(19\\d{{2}}|20\\d{{2}})))\\s*[-–/]\\s*['’]?(\\d{{2,4}})\\b(?!\\s*[-–/]\\s*\\d)"
QUARTER = "([1-4]Q|Q[1-4])\\s*(?:FY\\s*)?['’]?(\\d{2,4})"
CALENDAR = "CY\\s*(\\d{4})"
YEAR = "\\b(19\\d{2}|20\\d{2})\\b"


def full_year(year: Column, century: Column | None = None) -> Column:
    """Two digits get a century: the given one, or 19 from 70 on and 20 below. Others stay."""
    own = F.when(year.try_cast("int") >= 70, F.lit("19")).otherwise(F.lit("20"))
    return F.when(F.length(year) == 2, F.concat(own if century is None else century, year)).otherwise(year)


def normalize_period(label: Column) -> Column:
    def read(s: Column) -> Column:
        part = lambda pattern, k: F.nullif(F.regexp_extract(s, pattern, k), F.lit(""))
        start = full_year(F.coalesce(part(RANGE, 1), part(RANGE, 2)))
        by_range = F.concat(F.lit("FY"), full_year(part(RANGE, 3), F.substring(start, 1, 2)))
        by_fiscal = F.concat(F.lit("FY"), full_year(part(FISCAL, 1)))
        quarter = F.concat(F.lit("Q"), F.regexp_extract(part(QUARTER, 1), "[1-4]", 0))
        by_quarter = F.concat(quarter, F.lit("-FY"), full_year(part(QUARTER, 2)))
        by_calendar = F.concat(F.lit("CY"), part(CALENDAR, 1))
        return F.coalesce(by_range, by_fiscal, by_quarter, by_calendar, part(YEAR, 1), F.lower(s))

    return let(F.upper(collapsed(trimmed(F.coalesce(label, F.lit(""))))), read)


def compared(x: Column, y: Column) -> Column:
    """struct<both_missing, one_missing, same> of two normal forms: with one missing nothing is the same, with both
    missing everything."""
    both, one = (x == "") & (y == ""), (x == "") != (y == "")
    return F.struct(both.alias("both_missing"), one.alias("one_missing"), (x == y).alias("same"))


def compare_periods(a: Column, b: Column) -> Column:
    return let(F.struct(normalize_period(a).alias("x"), normalize_period(b).alias("y")), lambda s: compared(s["x"], s["y"]))
