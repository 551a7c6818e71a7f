"""Commercial days of Europe/Rome as UTC instants, printed periods, and time states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promoforge.functions.text import normalized, text_map
from promoforge.values import HIDDEN_SECONDS, MONTHS, STALE_SECONDS, TIMEZONE


def day_start(day: Column) -> Column:
    """Instant at which a commercial day begins, whatever the session time zone."""
    return F.make_timestamp(
        F.year(day), F.month(day), F.dayofmonth(day), F.lit(0), F.lit(0),
        F.lit(0).cast("decimal(8,6)"), F.lit(TIMEZONE),
    )


def day_end_exclusive(day: Column) -> Column:
    """Instant at which a commercial day is over: the next midnight in Rome, DST included."""
    return day_start(F.date_add(day, 1))


def rome_day(instant: Column) -> Column:
    """Commercial day of an instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(TIMEZONE), F.to_timestamp_ntz(
        F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    )).cast("date")


def month_number(name: Column) -> Column:
    """Number of an Italian month name; null for any other word."""
    table = text_map({month: str(number) for number, month in enumerate(MONTHS, 1)})
    return table[normalized(name)].cast("int")


def inferred_start_year(start_month: Column, end_month: Column, end_year: Column) -> Column:
    """Year of a start printed without one: the year before if its month is past the end's."""
    return end_year - (start_month > end_month).cast("int")


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """Calendar date, or null if there is no such day."""
    return F.try_to_date(
        F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
                    F.lpad(day.cast("string"), 2, "0")),
        "yyyy-MM-dd",
    )


def temporal_status(start: Column, end: Column, now: Column) -> Column:
    """expired, future, active or unknown; an offer without a start is unknown until it ends."""
    return (
        F.when(end <= now, "expired")
        .when(start > now, "future")
        .when(start.isNotNull(), "active")
        .otherwise("unknown")
    )


def freshness(verified: Column, now: Column) -> Column:
    """hidden after 48 h, stale after 12 h, both strictly."""
    age = F.unix_micros(now) - F.unix_micros(verified)
    return (
        F.when(age > HIDDEN_SECONDS * 1_000_000, "hidden")
        .when(age > STALE_SECONDS * 1_000_000, "stale")
        .otherwise("fresh")
    )


def epoch_seconds(value: Column) -> Column:
    return F.timestamp_seconds(value)


def epoch_millis(value: Column) -> Column:
    return F.timestamp_millis(value)


def compact_date(text: Column) -> Column:
    """Day of a ``yyyyMMddHHmmss`` text, null if it is not one."""
    return F.try_to_date(F.regexp_extract(text, r"^([0-9]{8})[0-9]{6}$", 1), "yyyyMMdd")


def iso_instant(text: Column) -> Column:
    """ISO instant with offset or Z, with or without seconds; null if it is not one."""
    whole = F.regexp_replace(text, r"^(.{16})(Z|[+-][0-9]{2}:[0-9]{2})$", "$1:00$2")
    return whole.try_cast("timestamp")
