"""Dates and times on columns; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolore.functions.text import strip


def message_ts(c: Column) -> Column:
    """'seconds.micros' as a timestamp; what follows the point is a whole number of microseconds."""
    parts = F.split(c, r"\.", 2)
    return F.timestamp_micros(parts[0].cast("long") * 1_000_000 + F.coalesce(F.get(parts, F.lit(1)).cast("long"), F.lit(0)))


def cue_offset_ms(c: Column) -> Column:
    """'[HH:]MM:SS.mmm' (or with a comma) in milliseconds."""
    parts = F.reverse(F.split(strip(F.replace(c, F.lit(","), F.lit("."))), ":"))
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)).cast("double"), F.lit(0.0))
    return F.round((part(0) + part(1) * 60 + part(2) * 3600) * 1000).cast("long")


def date_of(c: Column) -> Column:
    """The date in the first ten characters, or null."""
    day = F.substring(strip(c), 1, 10)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))


def instant_of(c: Column) -> Column:
    """An ISO instant; a bare date is its first moment; else null."""
    text = strip(c)
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?Z$"), F.try_to_timestamp(text))
    return F.coalesce(full, date_of(c).cast("timestamp"))


def as_of(day: str | None) -> Column:
    """The moment that an as-of day (yyyy-mm-dd, or an instant) stands for; null for no as-of."""
    return F.lit(None).cast("timestamp") if day is None else F.lit(day).cast("timestamp")


def day(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def closed_at(valid_from: Column, moment: Column) -> Column:
    """The end of an interval closed at a moment: never before its start."""
    return F.greatest(valid_from, moment)
