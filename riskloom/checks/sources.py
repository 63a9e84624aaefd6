"""Registered queries of response parsing and rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.checks import check
from riskloom.checks.views import V_EVENTS, v_events, with_views
from riskloom.sources.envelopes import SCANNABLE, parse_responses, rewritten, scannable

_KINDS = ("list-events", "search-events", "get-event", "list-colors")


def _bodies(spark, sf):
    """Events as JSON bodies: array, single object, ``{events}`` and ``{event}`` by turns."""
    d = F.col("id").cast("long")
    event = F.struct("id", "calendarId", "summary", "location", "organizer", F.lit(7).alias("extra"))
    one, no_id = F.to_json(event), F.lit('{"summary":"no id"}')
    body = (
        F.when(d % 4 == 0, F.concat(F.lit("["), one, F.lit(","), no_id, F.lit("]"))).when(d % 4 == 1, one)
        .when(d % 4 == 2, F.concat(F.lit('{"events":['), one, F.lit('],"total":1}')))
        .otherwise(F.concat(F.lit('{"event":'), one, F.lit("}")))
    )
    kind = F.get(F.array(*map(F.lit, _KINDS)), (d % 5 % 4).cast("int"))
    return v_events(spark, sf).select(d.alias("response_id"), kind.alias("source"), body.alias("body"))


@check("src_1_parse_json", with_views("SELECT doc_id AS response_id, id, summary FROM v_events", V_EVENTS))
def src_1(spark, sf):
    return parse_responses(_bodies(spark, sf), keep=("response_id",)).select("response_id", "id", "summary")


@check("src_2_plain_text", with_views("""
 SELECT doc_id AS response_id, id, trim(regexp_replace(split_part(summary, chr(10), 1), '^[\\s]+', '')) AS summary, 'Room ' || (doc_id % 9) AS location,
 'first line' || chr(10) || 'second ' || doc_id AS description, organizer_email FROM v_events WHERE NOT regexp_matches(summary, '---|Event ID:|\\w+:|^\\s')""", V_EVENTS))
def src_2(spark, sf):
    """Responses written as plain text; titles that look like markup of the format are left out."""
    e = v_events(spark, sf).where(~F.rlike("summary", F.lit(r"---|Event ID:|\w+:|^\s")))
    n = F.col("id").cast("long")
    body = F.concat(
        F.lit("Found it\n---\nEvent ID: "), F.col("id"), F.lit("\nTitle: "), F.col("summary"),
        F.lit("\nDescription: first line\nsecond "), F.col("id"), F.lit("\nLocation: Room "), n % 9,
        F.coalesce(F.concat(F.lit("\nOrganizer: "), F.col("organizer.email")), F.lit("")),
    )
    rows = e.select(n.alias("response_id"), body.alias("body"))
    return parse_responses(rows, keep=("response_id",)).select(
        "response_id", "id", "summary", "location", "description", F.col("organizer.email").alias("organizer_email"))


@check("src_3_normalized", with_views("""
 SELECT doc_id AS response_id, CAST(0 AS BIGINT) AS event_no, id, calendar_id, location, organizer_email FROM v_events""", V_EVENTS))
def src_3(spark, sf):
    return parse_responses(_bodies(spark, sf), keep=("response_id",)).select(
        "response_id", F.col("event_no").cast("long").alias("event_no"), "id", F.col("calendarId").alias("calendar_id"), "location",
        F.col("organizer.email").alias("organizer_email"))


@check("src_4_scannable", with_views(f"""
 SELECT source, CAST(count(*) AS BIGINT) AS n FROM (SELECT {list(_KINDS)}[doc_id % 5 % 4 + 1] AS source FROM v_events)
 WHERE source IN {SCANNABLE} GROUP BY source""", V_EVENTS))
def src_4(spark, sf):
    return scannable(_bodies(spark, sf)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@check("src_6_rewritten", with_views("""
 SELECT doc_id AS response_id, CASE WHEN doc_id % 3 = 0 THEN 'clean ' || doc_id ELSE summary END AS summary, location, '7' AS extra,
 CASE WHEN doc_id % 4 = 2 THEN '1' END AS total FROM v_events""", V_EVENTS))
def src_6(spark, sf):
    """Replace the summary of every third event inside its body, whatever the envelope, then read it again."""
    bodies = _bodies(spark, sf)
    fixes = v_events(spark, sf).where(F.col("id").cast("long") % 3 == 0).select(
        F.col("id").cast("long").alias("response_id"), "id", F.concat(F.lit("clean "), "id").alias("summary"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("location"))
    body = F.col("body")
    first = F.coalesce(
        F.get_json_object(body, "$[0]"), F.get_json_object(body, "$.events[0]"), F.get_json_object(body, "$.event"), F.when(~F.startswith(body, F.lit("[")), body))
    return rewritten(bodies, fixes).select(
        "response_id", F.get_json_object(first, "$.summary").alias("summary"), F.get_json_object(first, "$.location").alias("location"),
        F.get_json_object(first, "$.extra").alias("extra"), F.get_json_object(body, "$.total").alias("total"))
