"""From nested events to one row per scannable text field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import email_domain, is_blank, is_external


def field_array() -> Column:
    """Scannable fields of an event in scan order, with empty ones left out."""
    def entry(name, kind, content) -> Column:
        return F.struct(name.alias("field_name"), F.lit(kind).alias("field_type"), content.alias("content"))

    def listed(array: str, member: str, kind: str) -> Column:
        items = F.transform(array, lambda item, i: entry(
            F.concat(F.lit(f"{array}["), i.cast("string"), F.lit(f"].{member}")), kind, item[member],
        ))
        return F.coalesce(items, F.array().cast("array<struct<field_name:string,field_type:string,content:string>>"))

    fixed = F.array(
        entry(F.lit("summary"), "title", F.col("summary")),
        entry(F.lit("description"), "description", F.col("description")),
        entry(F.lit("location"), "location", F.col("location")),
    )
    every = F.concat(fixed, listed("attendees", "displayName", "attendee_name"), listed("attachments", "title", "attachment"))
    return F.filter(every, lambda f: ~is_blank(f["content"]))


def with_organizer(events: DataFrame, owner_domain: str | None) -> DataFrame:
    domain = email_domain(F.col("organizer.email"))
    return events.withColumns({
        "organizer_email": F.col("organizer.email"),
        "organizer_domain": domain,
        "is_external": is_external(domain, F.lit(owner_domain).cast("string")),
    })


def event_hash() -> Column:
    """Tells deliveries of one event with different texts apart."""
    return F.xxhash64("summary", "description", "location")


def explode_fields(
    events: DataFrame, owner_domain: str | None = None, keep_empty: bool = False, extra: tuple[str, ...] = ()
) -> DataFrame:
    """One row per non-blank field; only the key, the scan context and ``extra`` columns travel along.

    With ``keep_empty`` an event without such a field keeps one row of nulls.
    """
    context = ["calendar_id", "id", "organizer_email", "organizer_domain", "is_external", "event_hash", *extra]
    opened = with_organizer(events, owner_domain).withColumns(
        {"calendar_id": F.coalesce("calendarId", F.lit("")), "event_hash": event_hash()})
    fields = opened.select(*context, F.posexplode_outer(field_array()).alias("field_no", "f"))
    fields = fields.select(*context, "field_no", "f.*")
    return fields if keep_empty else fields.where("field_no is not null")
