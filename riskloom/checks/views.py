"""Derived inputs of the registered queries, as DataFrames and as SQL views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.checks.payloads import CYCLE, PAYLOADS
from riskloom.functions.text import literal
from riskloom.sources.tables import read_table

OWNER_DOMAIN = "home.example"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


SQL_PAYLOADS = sql_list(PAYLOADS)


_SPARK_PAYLOADS = f"array({', '.join(map(literal, PAYLOADS))})"


def payload(number: Column) -> Column:
    return F.get(F.expr(_SPARK_PAYLOADS), (number % CYCLE).cast("int"))


def sql_payload(number: str) -> str:
    return f"({SQL_PAYLOADS})[(({number}) % {CYCLE}) + 1]"


def _planted() -> Column:
    extra, turn = payload(F.col("doc_id")), F.floor(F.col("doc_id") / CYCLE) % 2
    return (
        F.when(extra.isNull(), F.col("text")).when(turn == 0, F.concat("text", F.lit("\n"), extra))
        .otherwise(F.concat(extra, F.lit("\n"), F.col("text")))
    )


SQL_PLANTED = f"""CASE WHEN {sql_payload('doc_id')} IS NULL THEN text
 WHEN (doc_id // {CYCLE}) % 2 = 0 THEN text || chr(10) || {sql_payload('doc_id')}
 ELSE {sql_payload('doc_id')} || chr(10) || text END"""


def v_text(spark: SparkSession, sf: str) -> DataFrame:
    """All text tables, one text per row; documents with planted payloads."""
    docs = read_table(spark, sf, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("item_id"),
        F.when(F.col("doc_id") % 4 == 1, "attendee_name").when(F.col("doc_id") % 4 == 2, "title")
        .otherwise("description").alias("field_type"),
        (F.col("doc_id") % 3 == 0).alias("is_external"), _planted().alias("text"),
    )
    pages = read_table(spark, sf, "pages").select(
        F.concat(F.lit("page:"), F.col("page_id")).alias("item_id"), F.lit("title").alias("field_type"),
        (F.col("page_id") % 5 == 0).alias("is_external"), F.col("html").alias("text"),
    )
    talk = read_table(spark, sf, "conversations").select(
        F.concat(F.lit("conv:"), F.col("conv_id"), F.lit(":"), F.col("turn")).alias("item_id"),
        F.lit("location").alias("field_type"), F.lit(False).alias("is_external"), "text",
    )
    return docs.unionByName(pages).unionByName(talk)


V_TEXT = f"""v_src AS MATERIALIZED (
 SELECT 'doc:' || doc_id AS item_id,
  CASE doc_id % 4 WHEN 1 THEN 'attendee_name' WHEN 2 THEN 'title' ELSE 'description' END AS field_type,
  doc_id % 3 = 0 AS is_external, {SQL_PLANTED} AS text FROM documents
 UNION ALL SELECT 'page:' || page_id, 'title', page_id % 5 = 0, html FROM pages
 UNION ALL SELECT 'conv:' || conv_id || ':' || turn, 'location', false, text FROM conversations)"""


def v_events(spark: SparkSession, sf: str) -> DataFrame:
    """Scan-input events from the documents: every field kind, some of them dirty."""
    return events_of(read_table(spark, sf, "documents"))


def events_of(docs: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    domain = F.when(d % 3 == 0, "outside.example").otherwise(OWNER_DOMAIN)
    return docs.select(
        d.cast("string").alias("id"), F.col("source").alias("calendarId"),
        F.coalesce(payload(d + 7), F.concat(F.lit("Note "), d)).alias("summary"),
        _planted().alias("description"),
        F.when(d % 5 == 0, payload(d + 31)).when(d % 5 == 1, F.lit("  ")).alias("location"),
        F.when(d % 13 > 0, F.struct(F.concat(F.lit("U"), d, F.lit("@"), domain).alias("email"))).alias("organizer"),
        F.when(d % 4 > 0, F.array(
            F.struct(F.concat(F.lit("Guest "), d % 7).alias("displayName"), F.lit("g@home.example").alias("email")),
            F.struct(payload(d + 3).alias("displayName"), F.lit("h@home.example").alias("email")),
        )).alias("attendees"),
        F.when(d % 6 == 0, F.array(F.struct(F.concat(F.lit("file "), d).alias("title")))).alias("attachments"),
    )


_DOMAIN = f"CASE WHEN doc_id % 3 = 0 THEN 'outside.example' ELSE '{OWNER_DOMAIN}' END"
V_EVENTS = f"""v_events AS MATERIALIZED (
 SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source AS calendar_id,
  coalesce({sql_payload('doc_id + 7')}, 'Note ' || doc_id) AS summary,
  {SQL_PLANTED} AS description,
  CASE WHEN doc_id % 5 = 0 THEN {sql_payload('doc_id + 31')} WHEN doc_id % 5 = 1 THEN '  ' END AS location,
  CASE WHEN doc_id % 13 > 0 THEN 'U' || doc_id || '@' || {_DOMAIN} END AS organizer_email,
  CASE WHEN doc_id % 13 > 0 THEN {_DOMAIN} END AS organizer_domain,
  CASE WHEN doc_id % 4 > 0 THEN 'Guest ' || (doc_id % 7) END AS guest0,
  CASE WHEN doc_id % 4 > 0 THEN {sql_payload('doc_id + 3')} END AS guest1,
  CASE WHEN doc_id % 6 = 0 THEN 'file ' || doc_id END AS attachment0
 FROM documents),
v_fields AS MATERIALIZED (
 SELECT calendar_id, id, organizer_email, organizer_domain,
  coalesce(organizer_domain <> '{OWNER_DOMAIN}', false) AS is_external, pos, field_name, field_type, content,
  row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS field_no
 FROM (
  SELECT *, 0 AS pos, 'summary' AS field_name, 'title' AS field_type, summary AS content FROM v_events
  UNION ALL SELECT *, 1, 'description', 'description', description FROM v_events
  UNION ALL SELECT *, 2, 'location', 'location', location FROM v_events
  UNION ALL SELECT *, 3, 'attendees[0].displayName', 'attendee_name', guest0 FROM v_events
  UNION ALL SELECT *, 4, 'attendees[1].displayName', 'attendee_name', guest1 FROM v_events
  UNION ALL SELECT *, 5, 'attachments[0].title', 'attachment', attachment0 FROM v_events)
 WHERE content IS NOT NULL AND trim(content) <> ''),
v_src AS MATERIALIZED (SELECT id || '#' || field_name AS item_id, field_type, is_external, content AS text FROM v_fields)"""


def v_cal(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar events from the event stream: one calendar per user."""
    e = F.col("event_id")
    raw = read_table(spark, sf, "events")
    day_start = F.date_trunc("day", "ts")
    all_day = e % 23 == 0
    minute = F.date_trunc("minute", "ts")
    start = F.when(all_day, day_start).otherwise(minute)
    end = F.when(all_day, day_start + F.expr("interval 1 day")).otherwise(
        F.timestamp_seconds(F.unix_timestamp(minute) + 900 * (1 + e % 8))
    )
    topic = F.when(e % 5 == 0, "Weekly planning").when(e % 5 == 1, "weekly planning session").when(
        e % 5 == 2, "Budget review meeting").when(e % 5 == 3, "Budget talk review").otherwise(F.lit(None))

    def time(ts: Column) -> Column:
        return F.struct(
            F.when(~all_day, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("dateTime"),
            F.when(all_day, F.date_format(ts, "yyyy-MM-dd")).alias("date"),
            F.when(e % 3 == 0, "America/New_York").when(e % 3 == 1, "Asia/Tokyo").alias("timeZone"),
        )

    attendee = F.struct(
        F.concat(F.lit("User"), F.col("user_id"), F.lit("@home.example")).alias("email"),
        F.concat(F.lit("User "), F.col("user_id")).alias("displayName"),
        F.when(e % 2 == 0, "accepted").otherwise("needsAction").alias("responseStatus"),
        F.lit(None).cast("string").alias("comment"), (e % 7 > 0).alias("self"), (e % 6 == 0).alias("organizer"),
    )
    guest = F.struct(
        F.concat(F.lit("guest"), e % 9, F.lit("@out.example")).alias("email"), F.lit(None).cast("string").alias("displayName"),
        F.lit("declined").alias("responseStatus"), F.lit(None).cast("string").alias("comment"),
        F.lit(None).cast("boolean").alias("self"), F.lit(None).cast("boolean").alias("organizer"),
    )
    return raw.select(
        F.concat(F.lit("ev"), e).alias("event_id"), e.alias("event_no"),
        F.concat(F.lit("cal"), F.col("user_id")).alias("calendar_id"), topic.alias("summary"),
        F.concat(F.lit("about "), F.col("event_type")).alias("description"),
        F.when(e % 4 == 0, F.concat(F.lit("Room "), e % 10)).alias("location"),
        time(start).alias("start"), time(end).alias("end"), start.alias("start_ts"), end.alias("end_ts"),
        all_day.alias("is_all_day"), F.when(e % 17 == 0, "cancelled").otherwise("confirmed").alias("status"),
        F.when(e % 11 == 0, "transparent").alias("transparency"), F.lit(None).cast("string").alias("visibility"),
        F.when(e % 10 == 0, F.array(F.lit("EXDATE:20240103"), F.concat(
            F.when(e % 3 == 0, "RRULE:FREQ=DAILY;INTERVAL=2").when(e % 3 == 1, "RRULE:FREQ=WEEKLY").otherwise(
                "RRULE:FREQ=MONTHLY"),
            F.when(e % 20 == 0, ";COUNT=5").otherwise(";UNTIL=20240301T000000Z"),
        ))).alias("recurrence"),
        F.when(e % 19 == 0, F.concat(F.lit("ev"), e - 1)).alias("recurring_event_id"),
        F.array(attendee, guest).alias("attendees"),
        F.create_map(F.lit("team"), F.concat(F.lit("t"), e % 3), F.lit("kind"), F.col("event_type")).alias("ext_private"),
        F.create_map(F.lit("room"), F.concat(F.lit("r"), e % 2)).alias("ext_shared"),
    )


V_CAL = """v_cal AS MATERIALIZED (
 SELECT *, CASE WHEN is_all_day THEN NULL ELSE strftime(start_ts, '%Y-%m-%dT%H:%M:%SZ') END AS start_datetime,
  CASE WHEN is_all_day THEN strftime(start_ts, '%Y-%m-%d') END AS start_date,
  CASE WHEN is_all_day THEN NULL ELSE strftime(end_ts, '%Y-%m-%dT%H:%M:%SZ') END AS end_datetime,
  CASE WHEN is_all_day THEN strftime(end_ts, '%Y-%m-%d') END AS end_date
 FROM (SELECT 'ev' || event_id AS event_id, event_id AS event_no, 'cal' || user_id AS calendar_id, user_id, event_type,
  CASE event_id % 5 WHEN 0 THEN 'Weekly planning' WHEN 1 THEN 'weekly planning session'
   WHEN 2 THEN 'Budget review meeting' WHEN 3 THEN 'Budget talk review' END AS summary,
  'about ' || event_type AS description,
  CASE WHEN event_id % 4 = 0 THEN 'Room ' || (event_id % 10) END AS location,
  CASE event_id % 3 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Tokyo' END AS zone,
  event_id % 23 = 0 AS is_all_day,
  CASE WHEN event_id % 23 = 0 THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('minute', ts)::TIMESTAMP END AS start_ts,
  CASE WHEN event_id % 23 = 0 THEN date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY
   ELSE date_trunc('minute', ts)::TIMESTAMP + to_minutes(15 * (1 + event_id % 8)) END AS end_ts,
  CASE WHEN event_id % 17 = 0 THEN 'cancelled' ELSE 'confirmed' END AS status,
  CASE WHEN event_id % 11 = 0 THEN 'transparent' END AS transparency,
  CASE WHEN event_id % 10 = 0 THEN (CASE event_id % 3 WHEN 0 THEN 'RRULE:FREQ=DAILY;INTERVAL=2'
   WHEN 1 THEN 'RRULE:FREQ=WEEKLY' ELSE 'RRULE:FREQ=MONTHLY' END)
   || (CASE WHEN event_id % 20 = 0 THEN ';COUNT=5' ELSE ';UNTIL=20240301T000000Z' END) END AS rrule,
  CASE WHEN event_id % 19 = 0 THEN 'ev' || (event_id - 1) END AS recurring_event_id
  FROM events))"""

ACCOUNTS = ["home", "lab", "work"]


def v_access(spark: SparkSession, sf: str) -> DataFrame:
    """Access of three accounts to calendars made from the customers."""
    c = F.col("c_custkey")
    raw = read_table(spark, sf, "customer")
    unfolded = raw.select(c, "c_name", "c_mktsegment", F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("a"))
    a = F.col("a")
    return unfolded.where((c + a) % 3 < 2).select(
        F.get(F.array(*map(F.lit, ACCOUNTS)), a).alias("account_id"), F.concat(F.lit("c"), c, F.lit("@cal.example")).alias("calendar_id"),
        F.when((c + a) % 4 == 0, "owner").when((c + a) % 4 == 1, "writer").when((c + a) % 4 == 2, "freeBusyReader")
        .alias("access_role"),
        ((c + a) % 7 == 0).alias("primary"),
        F.when(c % 9 > 0, F.concat(F.col("c_mktsegment"), F.lit(" "), c % 50)).alias("summary"),
        F.when((c + a) % 5 == 0, F.concat(F.lit("My "), F.col("c_name"))).when((c + a) % 5 == 1, "").alias("summary_override"),
        (a * 1_000_000_000 + c).alias("ord"),
    )


V_ACCESS = """v_access AS MATERIALIZED (
 SELECT ['home','lab','work'][a + 1] AS account_id, 'c' || c || '@cal.example' AS calendar_id,
  CASE (c + a) % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'writer' WHEN 2 THEN 'freeBusyReader' ELSE 'reader' END AS access_role,
  CASE (c + a) % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS rnk,
  (c + a) % 7 = 0 AS is_primary,
  CASE WHEN c % 9 > 0 THEN c_mktsegment || ' ' || (c % 50) ELSE 'c' || c || '@cal.example' END AS summary,
  CASE (c + a) % 5 WHEN 0 THEN 'My ' || c_name WHEN 1 THEN '' END AS summary_override,
  a * 1000000000 + c AS ord
 FROM (SELECT c_custkey AS c, c_name, c_mktsegment, unnest([0, 1, 2]) AS a FROM customer) WHERE (c + a) % 3 < 2),
v_unified AS MATERIALIZED (
 SELECT calendar_id, count(*) AS n_accounts, min(ord) AS first_ord,
  arg_min(account_id, -rnk * 10000000000 + ord) AS preferred_account,
  arg_min(access_role, -rnk * 10000000000 + ord) AS preferred_role,
  coalesce(nullif(arg_min(coalesce(summary_override, ''), ord) FILTER (WHERE is_primary), ''),
   nullif(arg_min(coalesce(summary_override, ''), -rnk * 10000000000 + ord), ''),
   arg_min(summary, -rnk * 10000000000 + ord)) AS display_name
 FROM v_access GROUP BY calendar_id)"""

RULE_IDS = [
    "CTX-001", "CTX-002", "CTX-003", "CTX-004", "CTX-006", "CTX-009", "STRUCT-001", "STRUCT-003", "STRUCT-009",
]


def v_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Threat reports from the event stream: few hashes, stretched time, some invalid rows."""
    return reports_of(read_table(spark, sf, "events"))


def reports_of(raw: DataFrame) -> DataFrame:
    e = F.col("event_id")
    rules = F.array(*map(F.lit, RULE_IDS))
    # Days are spread by a factor per hash, so that some hashes pause for more than 30 days.
    stretch = 1 + (F.col("user_id") % 40) * 20
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    return raw.select(
        e.alias("report_id"), F.when(e % 29 > 0, F.concat(F.lit("client"), F.col("user_id"))).alias("client_id"),
        F.when(e % 31 == 0, "nothash").when(e % 37 == 0, "").otherwise(
            F.sha2(F.concat(F.lit("c"), F.col("user_id") % 40).cast("string"), 256)).alias("content_hash"),
        F.sha2(F.concat(F.lit("s"), F.col("user_id") % 40).cast("string"), 256).alias("structural_hash"),
        F.array(F.get(rules, (e % 9).cast("int")), F.get(rules, (F.col("user_id") % 9).cast("int"))).alias("pattern_ids"),
        F.when(e % 41 == 0, F.lit(1.5)).otherwise((e * 7 % 101) / F.lit(100.0)).alias("risk_score"),
        F.when(e % 3 == 0, F.concat(F.lit("d"), e % 12, F.lit(".example"))).alias("organizer_domain"),
        F.timestamp_seconds(F.lit(1704067200) + seconds * stretch).alias("reported_at"),
    )


V_REPORTS = f"""v_reports AS MATERIALIZED (
 SELECT event_id AS report_id, CASE WHEN event_id % 29 > 0 THEN 'client' || user_id END AS client_id,
  CASE WHEN event_id % 31 = 0 THEN 'nothash' WHEN event_id % 37 = 0 THEN '' ELSE sha256('c' || (user_id % 40)) END AS content_hash,
  sha256('s' || (user_id % 40)) AS structural_hash,
  [({sql_list(RULE_IDS)})[event_id % 9 + 1], ({sql_list(RULE_IDS)})[user_id % 9 + 1]] AS pattern_ids,
  CASE WHEN event_id % 41 = 0 THEN 1.5::DOUBLE ELSE (event_id * 7 % 101) / 100.0::DOUBLE END AS risk_score,
  CASE WHEN event_id % 3 = 0 THEN 'd' || (event_id % 12) || '.example' END AS organizer_domain,
  make_timestamp((1704067200 + (epoch(date_trunc('second', ts))::BIGINT - 1704067200) * (1 + (user_id % 40) * 20)) * 1000000) AS reported_at
 FROM events)"""


def with_views(body: str, *views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
