"""Time functions on naive UTC timestamps, none of which depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000

# Accepted spellings of a time, in the order they are tried, and what completes each one.
TIME_SPELLINGS = (
    (r"^\d{4}$", "-01-01 00:00:00"),
    (r"^\d{4}-\d{1,2}$", "-01 00:00:00"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", " 00:00:00"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}$", ":00:00"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", ":00"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", ""),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", ""),
)


def parse_time(text: Column) -> Column:
    """Text in one of the accepted spellings as a timestamp; null if none fits."""
    completed = F.lit(None).cast("string")
    for pattern, rest in reversed(TIME_SPELLINGS):
        completed = F.when(text.rlike(pattern), F.concat(text, F.lit(rest))).otherwise(completed)
    return completed.try_cast("timestamp_ntz")


def parse_time_strict(text: Column) -> Column:
    """Like :func:`parse_time`, but text that fits no spelling fails the query."""
    parsed = parse_time(text)
    bad = F.raise_error(F.concat(F.lit("not a valid time: "), text)).cast("timestamp_ntz")
    return F.when(parsed.isNull() & text.isNotNull(), bad).otherwise(parsed)


def epoch_micros(time: Column) -> Column:
    """Microseconds since 1970-01-01 of a naive timestamp."""
    days = F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = days * 86400 + F.hour(time) * 3600 + F.minute(time) * 60
    return seconds * MICROS + (F.extract(F.lit("SECOND"), time) * MICROS).cast("bigint")


def from_epoch_micros(micros: Column) -> Column:
    """Inverse of :func:`epoch_micros`."""
    day = F.floor(micros / (86400 * MICROS))
    in_day = (micros - day * (86400 * MICROS)).cast("decimal(18,0)")
    seconds = (in_day / F.lit(MICROS).cast("decimal(8,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(day.cast("int"), zero, zero, seconds)


def hour_of(time: Column) -> Column:
    """Start of the hour."""
    zero = F.lit(0)
    return F.make_timestamp_ntz(F.year(time), F.month(time), F.dayofmonth(time), F.hour(time), zero, zero)


def to_naive_utc(text: Column) -> Column:
    """Timestamp text with or without a zone as naive UTC; text without a zone is UTC, text that is no time fails."""
    offset = r"([+-]\d{2}):?(\d{2})$"
    has_zone = text.rlike(r"\d(Z|\s?[+-]\d{2}:?\d{2})$") & text.rlike(":")
    zoned = F.regexp_replace(text, r"\s?" + offset, "$1:$2")
    assumed = (
        F.when(text.rlike(r":\d{1,2}:"), F.concat(text, F.lit("Z")))
        .when(text.rlike(":"), F.concat(text, F.lit(":00Z")))
        .otherwise(F.concat(text, F.lit("T00:00:00Z")))
    )
    zoned = F.regexp_replace(zoned, r"([T ]\d{1,2}:\d{2})(Z|[+-])", "$1:00$2")
    instant = F.when(has_zone, zoned).otherwise(assumed).try_cast("timestamp")
    failed = F.raise_error(F.concat(F.lit("no time: "), text)).cast("timestamp")
    instant = F.when(text.isNotNull() & instant.isNull(), failed).otherwise(instant)
    return from_epoch_micros(F.unix_micros(instant))


def date_in_name(name: Column, pattern: str = r"(\d{8})", layout: str = "yyyyMMdd") -> Column:
    """Date found in a file name."""
    return F.to_date(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")), layout)


def year_in_name(name: Column, pattern: str = r"((?:19|20)\d{2})") -> Column:
    """Year found in a file name."""
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("int")


def clock_text(time: Column) -> Column:
    """``yyyy-MM-dd_HH:mm:ss`` text used for 15-minute slices."""
    return F.date_format(time, "yyyy-MM-dd_HH:mm:ss")
