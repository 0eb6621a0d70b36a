"""Clock columns. Times are wall-clock microseconds (long) without a zone; differences are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000


def micros(ts: Column) -> Column:
    """Wall-clock microseconds since 1970 of a zoneless timestamp, whatever the session's time zone."""
    ntz = ts.cast("timestamp_ntz")
    within = (F.hour(ntz) * 3600 + F.minute(ntz) * 60).cast("long") * SECOND + (F.extract(F.lit("SECOND"), ntz) * SECOND).cast("long")
    return F.unix_date(ntz.cast("date")).cast("long") * DAY + within


def parsed_micros(text: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """micros of a text; null where it doesn't parse."""
    return F.unix_micros(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(form + " xx")))


def seconds(us: Column) -> Column:
    return us / SECOND


def hour_of(us: Column) -> Column:
    """Hour of the day, 0 to 23."""
    return F.pmod(F.floor(us / HOUR), F.lit(24)).cast("int")


def day_of(us: Column) -> Column:
    """Days since 1970."""
    return F.floor(us / DAY).cast("long")


def is_daytime(hour: Column, start: int, end: int) -> Column:
    """Hour in [start, end), modulo 24 and around midnight if start > end; never if they are equal."""
    start, end = start % 24, end % 24
    if start == end:
        return F.lit(False)
    if start < end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def duration_text(s: Column) -> Column:
    """HH:MM:SS.mmm of seconds; hours are unbounded, milliseconds half-even."""
    ms = F.bround(s * 1000, 0).cast("long")
    part = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(F.when(hours < 100, part(hours)).otherwise(hours.cast("string")), F.lit(":"), part(F.floor(ms / 60_000) % 60), F.lit(":"), part(F.floor(ms / 1000) % 60), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def list_literal(text: Column) -> Column:
    """A list or tuple literal of strings as an array; null where it doesn't parse."""
    return F.from_json(F.translate(text, "()", "[]"), "array<string>")


def trailing_number(names: Column) -> Column:
    """The number behind the last _ of the first name of an array that has one."""
    numbers = F.filter(F.transform(names, lambda x: F.element_at(F.split(x, "_"), -1).try_cast("int")), lambda n: n.isNotNull())
    return F.try_element_at(numbers, F.lit(1))


def trailing_digits(text: Column) -> Column:
    """A text as a number: the whole of it or else its last digits; null without any."""
    return F.coalesce(text.try_cast("long"), F.regexp_extract(text, r"(\d+)\D*$", 1).try_cast("long"))


def rounded(x: Column, digits: int = 3) -> Column:
    """Half-even rounding."""
    return F.bround(x, digits)
