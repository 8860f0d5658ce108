"""Timestamp expressions.  Results are ``TIMESTAMP_NTZ`` so they never depend
on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside.functions.text import bound

# offset only after a clock time, so a bare date ``2024-01-01`` has none
_OFFSET_RE = r"\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(Z|[+-]\d{2}(?::?\d{2})?)$"


def parse_local_wall_clock(c: Column, formats: tuple[str, ...] = ()) -> Column:
    """Parse timestamp text keeping its wall clock; a trailing UTC offset is
    discarded (``2023-11-20 00:28:46+05:30`` → ``2023-11-20 00:28:46``).
    ISO text is tried first, then each declared ``formats`` pattern (Spark
    datetime patterns, e.g. ``dd/MM/yyyy HH:mm``), then the common written forms
    (``parse_written``).  Unparseable text (``NULL``, junk) → null."""
    out = _try_ntz(c)
    for fmt in formats:
        # parsed and converted back in the same session zone: the wall clock is kept
        out = F.coalesce(out, F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz"))
    return F.coalesce(out, parse_written(c))


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NAME = r"(" + "|".join(_MONTHS) + r")[a-z]*"
_WEEKDAY = r"^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
#: Date shapes: regular expression and the groups of year, month, day (``None``: by value).
_DATES = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)", (1, 2, 3)),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)", None),
    (r"^(\d{1,2})(?:st|nd|rd|th)?[\s./-]*" + _NAME + r"[\s.,/-]*(\d{4}|\d{2})(?!\d)", (3, 2, 1)),
    (r"^" + _NAME + r"[\s./-]*(\d{1,2})(?:st|nd|rd|th)?[\s.,/-]+(\d{4}|\d{2})(?!\d)", (3, 1, 2)),
    (r"^(\d{4})(\d{2})(\d{2})(?!\d)", (1, 2, 3)),
)
#: What may follow a date: a clock time, 12 or 24 hours, and an offset.
_TIME = r"^[\st,]*(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?)\d*)?\s*([ap])?(?:\.?m\.?)?\s*(?:z|utc|gmt|[+-]\d{2}(?::?\d{2})?)?$"


def parse_written(c: Column) -> Column:
    """Dates as people and exports write them, decided value by value: ``20/11/2023 00:28``
    (of two numbers before the year the first is the month unless it is above 12),
    ``Nov 20, 2023 00:28``, ``20 November 2023 12:28 AM``, ``2023/11/20``, ``20231120``,
    with or without weekday, seconds and offset (discarded).  Two-digit years are the
    nearest ones.  Anything else → null.  One expression over regular expressions:
    nothing is looked up and no second pass is needed."""
    return bound(F.regexp_replace(F.lower(F.trim(c)), _WEEKDAY, ""), _written)


def _written(text: Column) -> Column:
    out = F.lit(None).cast("timestamp_ntz")
    for shape, groups in reversed(_DATES):
        out = F.when(text.rlike(shape), bound(F.regexp_replace(text, shape, ""), lambda rest: _dated(text, shape, groups, rest))).otherwise(out)  # noqa: B023
    return out


def _dated(text: Column, shape: str, groups: tuple[int, int, int] | None, rest: Column) -> Column:
    """The timestamp of a text that has a date shape and ``rest`` after it."""
    part = lambda i: F.regexp_extract(text, shape, i)
    if groups is None:
        a, b, year = part(1).try_cast("int"), part(2).try_cast("int"), part(3)
        month, day = F.when(a > 12, b).otherwise(a), F.when(a > 12, a).otherwise(b)
    else:
        year, month, day = part(groups[0]), part(groups[1]), part(groups[2]).try_cast("int")
        named = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.substring(month, 1, 3)).cast("int")
        month = F.coalesce(month.try_cast("int"), F.nullif(named, F.lit(0)))
    hour, minute, second, half = (F.regexp_extract(rest, _TIME, i) for i in (1, 2, 3, 4))
    hour = hour.try_cast("int")
    # twelve hours: 12 AM is midnight, 12 PM is noon, and an hour above 12 has no half
    hour = F.when(half == "", hour).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(half == "p", 12).otherwise(0))
    zero = F.lit(0).cast("decimal(8,6)")
    seconds = F.coalesce(second.try_cast("decimal(8,6)"), zero)
    return F.when(rest.rlike(_TIME), F.try_make_timestamp_ntz(_full_year(year), month, day, hour, minute.try_cast("int"), seconds)).when(
        F.trim(rest) == "", F.try_make_timestamp_ntz(_full_year(year), month, day, F.lit(0), F.lit(0), zero))


def _full_year(text: Column) -> Column:
    """Four digits as they are; two digits as the year within 50 years of this one."""
    y, now = text.try_cast("int"), F.year(F.current_date())
    near = y + now - F.pmod(now, F.lit(100))
    return F.when(F.length(text) > 2, y).when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)


def _try_ntz(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def parse_utc(c: Column, formats: tuple[str, ...] = ()) -> Column:
    """Parse timestamp text and convert it to UTC wall clock: the trailing
    offset (``Z``, ``+hh``, ``+hh:mm``, ``+hhmm``) is subtracted; text without an
    offset is taken as UTC.  Independent of the session time zone.  Declared
    ``formats`` are tried after ISO text (without offset)."""
    wall = parse_local_wall_clock(c, formats)
    return F.timestamp_add("SECOND", -bound(F.regexp_extract(c, _OFFSET_RE, 1), _offset_seconds), wall)


def _offset_seconds(off: Column) -> Column:
    sign = F.when(F.substring(off, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hh = F.substring(off, 2, 2).try_cast("int")
    mm = F.regexp_extract(off, r"^[+-]\d{2}:?(\d{2})$", 1).try_cast("int")
    return F.when(off.isin("", "Z"), F.lit(0)).otherwise(
        sign * (F.coalesce(hh, F.lit(0)) * 3600 + F.coalesce(mm, F.lit(0)) * 60)
    )


def minutes_between(start: Column, end: Column) -> Column:
    """(end − start) in fractional minutes, microsecond exact; negatives kept."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(6e7)
