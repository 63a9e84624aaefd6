"""Reading calendars: ranges, text search, properties, projection, free/busy, display."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import times as tm
from riskloom.operators.intervals import merged

# Selectable event fields and the ones always returned.
ALLOWED_FIELDS = (
    "id", "summary", "description", "start", "end", "location", "attendees", "colorId", "transparency",
    "extendedProperties", "reminders", "conferenceData", "attachments", "status", "htmlLink", "created", "updated",
    "creator", "organizer", "recurrence", "recurringEventId", "originalStartTime", "visibility", "iCalUID", "sequence",
    "hangoutLink", "anyoneCanAddSelf", "guestsCanInviteOthers", "guestsCanModify", "guestsCanSeeOtherGuests",
    "privateCopy", "locked", "source", "eventType",
)
DEFAULT_FIELDS = (
    "id", "summary", "start", "end", "status", "htmlLink", "location", "attendees", "reminders", "recurrence",
)
FREE_BUSY_DAYS = 90
GUEST_STATUS = {"accepted": "accepted", "declined": "declined", "tentative": "tentative", "needsAction": "pending"}


def _ts(value: datetime) -> Column:
    return F.lit(value).cast("timestamp")


def in_range(time_min: datetime | None, time_max: datetime | None) -> Column:
    """Events that end after ``time_min`` and start before ``time_max``."""
    condition = F.lit(True)
    if time_min is not None:
        condition = condition & (F.col("end_ts") > _ts(time_min))
    if time_max is not None:
        condition = condition & (F.col("start_ts") < _ts(time_max))
    return condition


def list_events(
    events: DataFrame, calendars: list[str] | None = None, time_min: datetime | None = None,
    time_max: datetime | None = None,
) -> DataFrame:
    rows = events.where(in_range(time_min, time_max))
    return rows if calendars is None else rows.where(F.col("calendar_id").isin(calendars))


def search_events(
    events: DataFrame, query: str, time_min: datetime, time_max: datetime, calendars: list[str] | None = None
) -> DataFrame:
    """Every term of the query must occur in summary, description, location or attendees."""
    haystack = F.lower(F.concat_ws(
        "\n", "summary", "description", "location",
        F.array_join(F.transform("attendees", lambda a: F.concat_ws(" ", a["displayName"], a["email"])), "\n"),
    ))
    rows = list_events(events, calendars, time_min, time_max)
    for term in query.lower().split():
        rows = rows.where(F.contains(haystack, F.lit(term)))
    return rows


def with_properties(
    events: DataFrame, private: list[str] | None = None, shared: list[str] | None = None
) -> DataFrame:
    """Events carrying every ``key=value`` pair asked for."""
    for column, pairs in (("ext_private", private or []), ("ext_shared", shared or [])):
        for pair in pairs:
            key, sep, value = pair.partition("=")
            if not (key and sep and value) or "=" in value:
                raise ValueError(f"property filter must be key=value: {pair!r}")
            events = events.where(F.try_element_at(F.col(column), F.lit(key)) == value)
    return events


def field_selection(fields: list[str] | None, include_defaults: bool = True) -> list[str] | None:
    """Validated list of fields, defaults first; None when nothing was asked for."""
    if not fields:
        return None
    unknown = [f for f in fields if f not in ALLOWED_FIELDS]
    if unknown:
        raise ValueError(f"Invalid fields requested: {', '.join(unknown)}. Allowed fields: {', '.join(ALLOWED_FIELDS)}")
    return list(dict.fromkeys([*DEFAULT_FIELDS, *fields])) if include_defaults else list(fields)


def project_fields(events: DataFrame, fields: list[str] | None, include_defaults: bool = True) -> DataFrame:
    """Select the asked-for fields; columnar sources then read only those.

    ``id`` names the event id. An allowed field that the table lacks comes out as
    a null column, so the result always has every field that was asked for.
    """
    wanted = field_selection(fields, include_defaults)
    if wanted is None:
        return events
    have = {c: F.col(c) for c in events.columns}
    if "event_id" in have:
        have.setdefault("id", F.col("event_id"))
    return events.select(*(have.get(f, F.lit(None).cast("string")).alias(f) for f in wanted))


def get_events(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Events named by (calendar_id, event_id) rows."""
    return events.join(wanted.select("calendar_id", "event_id").distinct(), ["calendar_id", "event_id"], "left_semi")


def merge_sources(sources: list[tuple[str, DataFrame | Exception]]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Union of the sources that could be read, with an ``account_id`` column, and warnings for the rest."""
    good = [df.withColumn("account_id", F.lit(name)) for name, df in sources if isinstance(df, DataFrame)]
    warnings = [(name, str(problem)) for name, problem in sources if not isinstance(problem, DataFrame)]
    rows = None
    for df in good:
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    return rows, warnings


def start_text(start: Column) -> Column:
    return F.coalesce(start["dateTime"], start["date"], F.lit(""))


def sorted_by_start(events: DataFrame, by_instant: bool = False) -> DataFrame:
    """Chronological order by the start text, or by the instant when offsets are mixed."""
    return events.orderBy(F.col("start_ts") if by_instant else start_text(F.col("start")), "event_id")


def enriched(events: DataFrame) -> DataFrame:
    def day(time: str) -> Column:
        return tm.weekday(F.coalesce(F.col(f"{time}.dateTime"), F.col(f"{time}.date")), F.col(f"{time}.timeZone"))

    return events.withColumns({"start_weekday": day("start"), "end_weekday": day("end")})


def busy_slots(events: DataFrame, time_min: datetime, time_max: datetime) -> DataFrame:
    """Disjoint busy slots per calendar inside the range, which spans at most 90 days.

    Cancelled and transparent events do not block time.
    """
    if time_max - time_min > timedelta(days=FREE_BUSY_DAYS):
        raise ValueError("The time gap between timeMin and timeMax must be less than 3 months")
    blocking = events.where(
        in_range(time_min, time_max) & (F.coalesce("status", F.lit("confirmed")) != "cancelled")
        & (F.coalesce("transparency", F.lit("opaque")) != "transparent")
    )
    clipped = blocking.select(
        "calendar_id", F.greatest("start_ts", _ts(time_min)).alias("start_ts"),
        F.least("end_ts", _ts(time_max)).alias("end_ts"),
    )
    return merged(clipped, ["calendar_id"])


def pick_results(asked: DataFrame, results: DataFrame) -> DataFrame:
    """Per asked calendar the first result without errors, else the first; ``notFound`` without any.

    ``results`` has calendar_id, ord (account order), error and a payload column.
    """
    best = results.groupBy("calendar_id").agg(F.min_by(
        F.struct("account_id", "error"), F.struct(F.col("error").isNotNull(), F.col("ord"))
    ).alias("r"))
    return asked.select("calendar_id").distinct().join(best, "calendar_id", "left").select(
        "calendar_id", "r.account_id",
        F.when(F.col("r").isNull(), "notFound").otherwise(F.col("r.error")).alias("error"),
    )


def event_url(event_id: Column, calendar_id: Column, base: str) -> Column:
    def part(col: Column) -> Column:
        return F.replace(F.url_encode(col), F.lit("+"), F.lit("%20"))

    return F.concat(F.lit(base), F.lit("?eid="), part(event_id), F.lit("&cid="), part(calendar_id))


def display_text(events: DataFrame, url_base: str) -> Column:
    """Readable description of an event, one fact per line."""
    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    start, end = F.col("start"), F.col("end")
    last_day = F.date_format(F.date_sub(F.try_to_timestamp(end["date"]).cast("date"), 1), "EEE, MMM d, yyyy")
    when = (
        F.when(start["date"].isNull(), F.concat(
            F.lit("Start: "), tm.display_time(start), F.lit("\nEnd: "), tm.display_time(end)))
        .when(end["date"].isNull(), F.concat(F.lit("Start Date: "), tm.display_time(start)))
        .when(start["date"] == end["date"], F.concat(F.lit("Date: "), tm.display_time(start)))
        .otherwise(F.concat(F.lit("Start Date: "), tm.display_time(start), F.lit("\nEnd Date: "), last_day))
    )
    shown = F.create_map(*(F.lit(part) for item in GUEST_STATUS.items() for part in item))
    guests = F.array_join(F.transform("attendees", lambda a: F.concat(
        F.coalesce(a["displayName"], a["email"], F.lit("unknown")), F.lit(" ("),
        F.coalesce(F.try_element_at(shown, a["responseStatus"]), F.lit("unknown")), F.lit(")"),
    )), ", ")
    return F.concat_ws(
        "\n",
        F.coalesce(line("Event: ", F.col("summary")), F.lit("Untitled Event")),
        line("Event ID: ", F.col("event_id")), line("Description: ", F.col("description")), when,
        line("Location: ", F.col("location")), line("Guests: ", guests),
        line("View: ", event_url(F.col("event_id"), F.col("calendar_id"), url_base)),
    )
