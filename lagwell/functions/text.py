"""Parsing and formatting expressions for raw text, innings notation and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagwell.functions.rates import _c, dbl


def first_int(x) -> Column:
    """First run of digits as double, NULL when there is none."""
    digits = F.nullif(F.regexp_extract(_c(x).cast("string"), r"(\d+)", 1), F.lit(""))
    return digits.try_cast("double")


def part(x, sep: str, index: int) -> Column:
    """0-based piece of a split string, NULL when out of range."""
    return F.get(F.split(_c(x), sep), index)


def height_inches(x) -> Column:
    """6' 3" -> 75."""
    feet = F.nullif(F.regexp_extract(_c(x), r"(\d+)\s*'", 1), F.lit(""))
    inch = F.nullif(F.regexp_extract(_c(x), r"'\s*(\d+)", 1), F.lit(""))
    return feet.try_cast("int") * 12 + inch.try_cast("int")


def innings(x, on_bad: str = "keep") -> Column:
    """Innings notation (6.1 = 6 1/3) to decimal.

    on_bad: 'keep' converts any fraction, 'raise' stops the job on a fraction other
    than 0, .1, .2 and 'null' blanks it so the row can be quarantined.
    """
    ip = dbl(x)
    whole = F.floor(ip)
    tenths = F.rint((ip - whole) * 10) / 10
    value = whole + tenths / 0.3
    ok = tenths.isin(0.0, 0.1, 0.2)
    if on_bad == "keep":
        return value
    if on_bad == "null":
        return F.when(ok, value)
    if on_bad == "raise":
        msg = F.concat(F.lit("unexpected innings fraction: "), ip.cast("string"))
        return F.when(ip.isNull() | ok, value).otherwise(F.raise_error(msg).cast("double"))
    raise ValueError(f"on_bad must be keep, null or raise, got {on_bad!r}")


def whole_thirds(x) -> Column:
    """A sum of innings put back on the nearest third, so that its rounding error, and any
    tie it would flip further on, does not depend on the order of the sum."""
    v = dbl(x)
    thirds = F.rint(v * 3)
    return F.when(F.abs(v * 3 - thirds) < 1e-6, thirds / 3).otherwise(v)


def order_slot(x) -> Column:
    """Lineup code (e.g. 301) to slot (1)."""
    return _c(x).cast("string").try_cast("double").cast("int") % 100


def local_clock(ts, zone: str = "America/Chicago") -> Column:
    """UTC wall-clock timestamp to 'h:mm AM/PM' in a zone."""
    ntz = _c(ts).cast("timestamp_ntz")
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz), "h:mm a")


def parse_utc(x) -> Column:
    """ISO-8601 text with a trailing Z to a zone-free UTC timestamp."""
    return F.to_timestamp_ntz(F.regexp_replace(_c(x), "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def numbered(items: Column, field: str) -> Column:
    """Array to array of (batting_order from 1, field)."""
    return F.transform(
        items, lambda v, i: F.struct((i + 1).cast("int").alias("batting_order"), v.alias(field))
    )
