"""Date, time and zone expressions over ISO strings and UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted time formats and account/property formats.
WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})$"
NAIVE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"
DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"
ACCOUNT = "^[a-z0-9_-]{1,64}$"
PROPERTY = "^[^=]+=[^=]+$"
_UTC_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"
COMPACT_UTC = "yyyyMMdd'T'HHmmss'Z'"

# Zone abbreviations shown for United States zones (standard, daylight).
ZONE_ABBREVIATIONS = {
    "America/New_York": ("EST", "EDT"), "America/Chicago": ("CST", "CDT"), "America/Denver": ("MST", "MDT"),
    "America/Los_Angeles": ("PST", "PDT"), "America/Anchorage": ("AKST", "AKDT"), "Pacific/Honolulu": ("HST", "HDT"),
}


def matches(col: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(col, F.lit(pattern)), F.lit(False))


def has_offset(text: Column) -> Column:
    return matches(text, WITH_OFFSET)


def instant(text: Column) -> Column:
    """ISO date, naive or offset time to a UTC timestamp; null when it does not parse."""
    return F.try_to_timestamp(text)


def to_rfc3339(text: Column, zone: Column) -> Column:
    """Local time in ``zone`` to UTC. An offset is kept as it is, other text gets a ``Z``."""
    local = F.when(matches(text, NAIVE), F.try_to_timestamp(text))
    utc = F.date_format(F.to_utc_timestamp(local, zone), _UTC_SECONDS)
    return F.when(has_offset(text), text).otherwise(F.coalesce(utc, F.concat(text, F.lit("Z"))))


def time_object(text: Column, explicit_zone: Column, calendar_zone: Column) -> Column:
    """All-day, offset or zoned time as a struct; explicit zone, then calendar zone, then UTC."""
    zone = F.coalesce(explicit_zone, calendar_zone, F.lit("UTC"))
    none = F.lit(None).cast("string")
    timed = F.contains(text, F.lit("T"))
    return F.struct(
        F.when(timed, text).alias("dateTime"), F.when(~timed, text).alias("date"),
        F.when(timed & ~has_offset(text), zone).otherwise(none).alias("timeZone"),
    )


def weekday(text: Column, zone: Column) -> Column:
    """Weekday name: in ``zone`` if given, else of the local date when an offset is present, else UTC."""
    local_date = F.try_to_timestamp(F.substring(text, 1, 10))
    zoned = F.from_utc_timestamp(instant(text), F.coalesce(zone, F.lit("UTC")))
    offset_end = F.rlike(text, F.lit(r"[+-]\d{2}:\d{2}$"))
    return F.date_format(F.when(zone.isNull() & offset_end, local_date).otherwise(zoned), "EEEE")


def offset_minutes(ts: Column, zone: Column) -> Column:
    return ((F.unix_timestamp(F.from_utc_timestamp(ts, zone)) - F.unix_timestamp(ts)) / 60).cast("int")


def offset_text(minutes: Column) -> Column:
    size = F.abs(minutes)
    return F.when(minutes == 0, "Z").otherwise(F.format_string(
        "%s%02d:%02d", F.when(minutes >= 0, "+").otherwise("-"), F.floor(size / 60), size % 60
    ))


def local_iso(ts: Column, zone: Column) -> Column:
    local = F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.concat(local, offset_text(offset_minutes(ts, zone)))


def is_dst(ts: Column, zone: Column) -> Column:
    """Daylight time: January and July offsets differ and the larger one applies."""
    january = F.make_timestamp(F.year(ts), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    july = F.make_timestamp(F.year(ts), F.lit(7), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    a, b = offset_minutes(january, zone), offset_minutes(july, zone)
    return (a != b) & (offset_minutes(ts, zone) == F.greatest(a, b))


def duration_text(millis: Column) -> Column:
    """``2 days 3 hours``, ``1 hour 30 minutes`` or ``45 minutes``."""
    minutes = F.floor(millis / 60_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)

    def counted(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""))

    def pair(big: Column, big_unit: str, small: Column, small_unit: str) -> Column:
        return F.concat_ws(" ", counted(big, big_unit), F.when(small > 0, counted(small, small_unit)))

    return (
        F.when(days > 0, pair(days, "day", hours % 24, "hour"))
        .when(hours > 0, pair(hours, "hour", minutes % 60, "minute"))
        .otherwise(counted(minutes, "minute"))
    )


def _zone_name(ts: Column, zone: Column) -> Column:
    minutes = offset_minutes(ts, zone)
    size = F.abs(minutes)
    generic = F.concat(
        F.lit("GMT"), F.when(minutes >= 0, "+").otherwise("-"), F.floor(size / 60).cast("string"),
        F.when(size % 60 > 0, F.format_string(":%02d", size % 60)).otherwise(""),
    )
    expr = F.when(zone == "UTC", "UTC")
    for name, (standard, daylight) in ZONE_ABBREVIATIONS.items():
        expr = expr.when(zone == name, F.when(is_dst(ts, zone), daylight).otherwise(standard))
    return expr.when(minutes == 0, "GMT").otherwise(generic)


def display_date(text: Column) -> Column:
    return F.date_format(F.try_to_timestamp(text), "EEE, MMM d, yyyy")


def display_time(time: Column) -> Column:
    """Human text of an event time struct (dateTime | date, timeZone)."""
    zone = F.coalesce(time["timeZone"], F.lit("UTC"))
    ts = instant(time["dateTime"])
    timed = F.concat(
        F.date_format(F.from_utc_timestamp(ts, zone), "EEE, MMM d, yyyy, h:mm a"), F.lit(" "), _zone_name(ts, zone)
    )
    return (
        F.when(time["dateTime"].isNotNull(), F.coalesce(timed, time["dateTime"]))
        .when(time["date"].isNotNull(), display_date(time["date"]))
        .otherwise("unspecified")
    )


def valid_datetime(text: Column) -> Column:
    return matches(text, WITH_OFFSET) | matches(text, NAIVE)


def valid_date_or_datetime(text: Column) -> Column:
    return matches(text, DATE_ONLY) | valid_datetime(text)
