"""Clock, duration and date functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def clock(seconds: Column) -> Column:
    """m:ss with any number of minutes; negative times are 0:00."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), _two(s % 60))


def timecode(seconds: Column) -> Column:
    """h:mm:ss from an hour on, else m:ss."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    hours = F.floor(s / 3600).cast("long")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), _two(F.floor(s / 60) % 60), F.lit(":"), _two(s % 60))).otherwise(clock(s))


def duration_text(seconds: Column) -> Column:
    """A dash for unknown or zero durations, else a timecode."""
    return F.when(F.coalesce(seconds, F.lit(0)) <= 0, "—").otherwise(timecode(seconds))


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "dd.MM.yyyy")


def plural_form(n: Column) -> Column:
    """0, 1 or 2: the forms for 1 (not 11), for 2 to 4 (not 12 to 14) and for the rest."""
    ten, hundred = F.abs(n) % 10, F.abs(n) % 100
    return F.when((ten == 1) & (hundred != 11), 0).when(ten.between(2, 4) & ~hundred.between(12, 14), 1).otherwise(2)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def size_text(size: Column) -> Column:
    """— for none, whole MB (1 at least) below a GB, else GB with one decimal."""
    gb = F.lit(1 << 30)
    return (
        F.when(F.coalesce(size, F.lit(0)) <= 0, "—")
        .when(size < gb, F.concat(F.greatest(F.lit(1), F.round(size / (1 << 20)).cast("long")).cast("string"), F.lit(" MB")))
        .otherwise(F.concat(F.format_number(size / gb, 1), F.lit(" GB")))
    )
