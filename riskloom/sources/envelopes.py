"""Responses as text to event rows and back: JSON envelopes and a plain-text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import strip
from riskloom.schemas import SCAN_EVENT, ddl

# Sources whose responses hold events.
SCANNABLE = ("list-events", "search-events", "get-event", "create-event", "update-event")
HANDLER_SOURCES = {
    "ListEventsHandler": "list-events", "SearchEventsHandler": "search-events", "GetEventHandler": "get-event",
    "CreateEventHandler": "create-event", "UpdateEventHandler": "update-event",
}
_ONE, _MANY = ddl(SCAN_EVENT), f"array<{ddl(SCAN_EVENT)}>"
_WRAPPED = f"struct<id:string,events:{_MANY},event:{_ONE}>"
_PLAIN_FIELDS = {
    "summary": r"(?:Summary|Title):\s*([^\n\r]+)", "location": r"Location:\s*([^\n\r]+)",
    "organizer": r"Organizer:\s*([^\n\r]+)",
}


def scannable(df: DataFrame, source: str = "source") -> DataFrame:
    """Only responses of sources that carry events."""
    return df.where(F.col(source).isin(*SCANNABLE))


def source_of_handler(handler: Column) -> Column:
    names = F.create_map(*(F.lit(part) for item in HANDLER_SOURCES.items() for part in item))
    return F.try_element_at(names, handler)


def _has_id(e: Column) -> Column:
    return F.coalesce(e["id"], F.lit("")) != ""


def json_events(body: Column, wrapped_event: bool = True) -> Column:
    """Events of a JSON body: an array, one object with an id, or ``{events: [...]}``.

    ``wrapped_event`` also accepts ``{event: {...}}``. Null when the body is no JSON.
    """
    wrapper = F.from_json(body, _WRAPPED)
    no_events = F.array().cast(_MANY)
    is_array = F.startswith(F.ltrim(body), F.lit("["))
    listed = F.coalesce(F.from_json(body, _MANY), no_events)
    single = F.when(wrapped_event & _has_id(wrapper["event"]), F.array(wrapper["event"])) if wrapped_event else None
    objects = (
        F.when(_has_id(wrapper), F.array(F.from_json(body, _ONE)))
        .when(wrapper["events"].isNotNull(), wrapper["events"])
    )
    if single is not None:
        objects = F.coalesce(objects, single)
    valid = F.try_parse_json(body).isNotNull()
    found = F.filter(F.when(is_array, listed).otherwise(F.coalesce(objects, no_events)), lambda e: e.isNotNull() & _has_id(e))
    return F.when(valid, found)


def plain_events(body: Column) -> Column:
    """Events of a plain-text body: one block per ``Event ID:`` line."""
    blocks = F.split(body, "(?=Event ID:|---)", -1)

    def grab(block: Column, pattern: str) -> Column:
        return F.when(F.rlike(block, F.lit(pattern)), strip(F.regexp_extract(block, pattern, 1)))

    def event(block: Column) -> Column:
        none = F.lit(None)
        organizer = grab(block, _PLAIN_FIELDS["organizer"])
        return F.struct(
            grab(block, r"Event ID:\s*([^\n\r]+)").alias("id"), none.cast("string").alias("calendarId"),
            grab(block, _PLAIN_FIELDS["summary"]).alias("summary"),
            grab(block, r"(?s)Description:\s*(.*?)(?=\n\w+:|\z)").alias("description"),
            grab(block, _PLAIN_FIELDS["location"]).alias("location"),
            F.when(organizer.isNotNull(), F.struct(organizer.alias("email"))).alias("organizer"),
            none.cast(ddl(SCAN_EVENT["attendees"].dataType)).alias("attendees"),
            none.cast(ddl(SCAN_EVENT["attachments"].dataType)).alias("attachments"),
        )

    return F.filter(F.transform(blocks, event), lambda e: e["id"].isNotNull())


def parse_responses(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per event in a response, in order (``event_no``)."""
    events = F.coalesce(json_events(F.col(body)), plain_events(F.col(body)))
    return df.select(*keep, F.posexplode(events).alias("event_no", "e")).select(
        *keep, "event_no", F.coalesce("e.id", F.lit("unknown")).alias("id"),
        *(f"e.{name}" for name in SCAN_EVENT.names if name != "id"),
    )


def rewritten(bodies: DataFrame, fixes: DataFrame, body: str = "body", key: str = "response_id") -> DataFrame:
    """Write replacement texts back into JSON bodies, whatever the envelope.

    ``fixes`` has the response key, the event ``id`` and columns summary,
    description, location (null = unchanged). Members not named keep their JSON
    value; a body that is no JSON is returned as it is.
    """
    texts = ("summary", "description", "location")
    changes = F.map_filter(
        F.create_map(*(c for n in texts for c in (F.lit(n), F.col(n)))), lambda _, v: v.isNotNull()
    )
    per_event = fixes.groupBy(key, "id").agg(*(F.max(n).alias(n) for n in texts)).select(
        key, F.struct("id", changes.alias("changes")).alias("fix")
    )
    # As many fixes as the body has events, and the body is one row already.
    per_body = per_event.groupBy(key).agg(F.map_from_entries(F.collect_list("fix")).alias("__fixes"))
    obj, objs = "map<string,variant>", "array<map<string,variant>>"

    def id_of(event: Column) -> Column:
        return F.try_variant_get(event["id"], "$", "string")

    def patch(event: Column) -> Column:
        change = F.try_element_at(F.col("__fixes"), id_of(event))
        kept = F.map_filter(event, lambda k, _: ~F.array_contains(F.map_keys(change), k))
        values = F.transform_values(change, lambda _, v: v.cast("variant"))
        return F.when(change.isNull(), event).otherwise(F.map_concat(kept, values))

    text = F.col(body)
    as_object = F.from_json(text, obj)
    listed = F.to_json(F.transform(F.from_json(text, objs), patch))
    inner = F.from_json(F.to_json(as_object["events"]), objs)
    inner_json = F.parse_json(F.to_json(F.transform(inner, patch)))
    wrapped = F.to_json(F.map_concat(
        F.map_filter(as_object, lambda k, _: k != "events"), F.create_map(F.lit("events"), inner_json)
    ))
    one = F.from_json(F.to_json(as_object["event"]), obj)
    wrapped_one = F.to_json(F.map_concat(
        F.map_filter(as_object, lambda k, _: k != "event"), F.create_map(F.lit("event"), F.parse_json(F.to_json(patch(one))))
    ))
    single = F.to_json(patch(as_object))
    result = (
        F.when(F.col("__fixes").isNull() | F.try_parse_json(text).isNull(), text)
        .when(F.startswith(F.ltrim(text), F.lit("[")), listed)
        .when(F.coalesce(id_of(as_object), F.lit("")) != "", single)
        .when(as_object["events"].isNotNull(), wrapped)
        .when(F.coalesce(id_of(one), F.lit("")) != "", wrapped_one)
        .otherwise(text)
    )
    return bodies.join(per_body, key, "left").withColumn(body, result).drop("__fixes")
