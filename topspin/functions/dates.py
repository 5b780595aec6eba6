"""Dates and times out of the texts of sources; null where a text doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topspin.functions.domain import chain


def _date(day: Column, month: Column, year: Column) -> Column:
    text = F.concat_ws(" ", F.nullif(day, F.lit("")), F.nullif(month, F.lit("")), F.nullif(year, F.lit("")))
    return F.coalesce(F.try_to_date(text, "d MMMM yyyy"), F.try_to_date(text, "d MMM yyyy"))


def date_range(text: Column) -> Column:
    """``struct<start, end>`` of ``1 - 7 January, 2024``, ``29 January - 4 February, 2024``, ``30 December, 2023 - 7 January, 2024`` and a single day."""
    t = F.regexp_replace(F.trim(text), "[–—]", "-")
    forms = (
        (r"^(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})\s*-\s*(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})$", (1, 2, 3), (4, 5, 6)),
        (r"^(\d{1,2})\s+([A-Za-z]+)\s*-\s*(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})$", (1, 2, 5), (3, 4, 5)),
        (r"^(\d{1,2})\s*-\s*(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})$", (1, 3, 4), (2, 3, 4)),
        (r"^(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})$", (1, 2, 3), (1, 2, 3)),
    )
    pick = lambda form, at: _date(*[F.regexp_extract(t, form, k) for k in at])
    start = chain(*[(t.rlike(f), pick(f, a)) for f, a, _ in forms])
    end = chain(*[(t.rlike(f), pick(f, b)) for f, _, b in forms])
    # without a year of its own the start may lie in the year before
    start = F.when(start > end, F.add_months(start, -12)).otherwise(start)
    return F.struct(start.alias("start"), end.alias("end"))


def span_with_to(text: Column) -> Column:
    """``struct<start, end>`` of ``01 Jan to 07 Jan 2024``; the start may lie in the year before."""
    form = r"^(\d{1,2})\s+([A-Za-z]+)\s+to\s+(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"
    part = lambda k: F.regexp_extract(F.trim(text), form, k)
    start, end = _date(part(1), part(2), part(5)), _date(part(3), part(4), part(5))
    return F.struct(F.when(start > end, F.add_months(start, -12)).otherwise(start).alias("start"), end.alias("end"))


def day_header(text: Column) -> Column:
    """The date of ``Sun, 11 January, 2026Day (9)`` or ``Monday 12 January 2026``."""
    form = r"(\d{1,2})\s+([A-Za-z]+),?\s+(\d{4})"
    return _date(*[F.regexp_extract(text, form, k) for k in (1, 2, 3)])


def clock(text: Column) -> Column:
    """``HH:mm`` of a time in twelve or twenty-four hours."""
    form = r"(?i)(\d{1,2})[:.](\d{2})\s*([ap]m)?"
    hour, minute, half = F.regexp_extract(text, form, 1).try_cast("int"), F.regexp_extract(text, form, 2), F.lower(F.regexp_extract(text, form, 3))
    hour = chain((half == "pm", hour % 12 + 12), (half == "am", hour % 12), otherwise=hour)
    return F.when(hour < 24, F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute))


def local_time(utc: Column, offset_hours: Column) -> Column:
    return utc + F.make_interval(hours=offset_hours.cast("int"), mins=(offset_hours * 60 % 60).cast("int"))


def schedule_time(date: Column, time: Column) -> Column:
    """Date and time of day together; three forms are tried in order."""
    both = F.concat_ws(" ", date, time)
    return F.coalesce(*[F.try_to_timestamp(both, F.lit(f)) for f in ("yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd h:mm a")]).cast("timestamp_ntz")


def typed_date(text: Column) -> Column:
    return F.try_to_date(text, "yyyy-MM-dd")
