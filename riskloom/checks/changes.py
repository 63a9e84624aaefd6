"""Registered queries of batch changes and recurrence."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from riskloom.checks import check
from riskloom.checks.calendar import _MATCH, _TS, _stamp
from riskloom.checks.views import V_CAL, v_cal, with_views
from riskloom.operators import changes as ch
from riskloom.operators import recurrence as rc

NOW = datetime(2024, 2, 1)
LOW, HIGH = datetime(2024, 1, 10), datetime(2024, 3, 10)

# New events made from the orders: some repeat an existing event, some move it by an hour.
_NEW = """v_new AS MATERIALIZED (SELECT 'new' || o_orderkey AS event_id, v.calendar_id, CASE WHEN o_orderkey % 3 = 0 THEN v.summary ELSE 'Order ' || o_orderkey END AS summary,
 v.start_ts + to_hours(CAST(o_orderkey % 2 AS INTEGER)) AS start_ts, v.end_ts + to_hours(CAST(o_orderkey % 2 AS INTEGER)) AS end_ts, v.is_all_day, 'confirmed' AS status,
 o_orderkey % 5 = 0 AS allow_duplicates, o_orderkey FROM orders o JOIN v_cal v ON v.event_no = o.o_orderkey)"""
_NEW_PAIRS = """v_np AS MATERIALIZED (SELECT a.event_id AS a_id, b.event_id AS b_id, a.summary AS a_sum, b.summary AS b_sum, a.start_ts AS a_start, a.end_ts AS a_end, b.start_ts AS b_start,
 b.end_ts AS b_end, a.is_all_day AS a_day, b.is_all_day AS b_day FROM v_new a JOIN v_cal b ON a.calendar_id = b.calendar_id AND b.status <> 'cancelled'
 AND a.start_ts < b.end_ts AND b.start_ts < a.end_ts)"""
_GATE = """v_gate AS MATERIALIZED (SELECT n.*, coalesce(g.c, 0) AS n_conflicts, coalesce(g.d, 0) AS n_duplicates, coalesce(m, 0) < 0.95 OR allow_duplicates AS accepted FROM v_new n LEFT JOIN (
 SELECT a_id, count(*) AS c, count(*) FILTER (WHERE similarity >= 0.7) AS d, max(similarity) AS m FROM v_sim GROUP BY a_id) g ON g.a_id = n.event_id)"""


def _new(spark, sf):
    o = F.col("o_orderkey")
    shift = F.make_dt_interval(F.lit(0), (o % 2).cast("int"))
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(o)
    joined = orders.join(v_cal(spark, sf), orders.o_orderkey == F.col("event_no"))
    return joined.select(
        F.concat(F.lit("new"), o).alias("event_id"), "calendar_id",
        F.when(o % 3 == 0, F.col("summary")).otherwise(F.concat(F.lit("Order "), o)).alias("summary"),
        (F.col("start_ts") + shift).alias("start_ts"), (F.col("end_ts") + shift).alias("end_ts"), "is_all_day",
        F.lit("confirmed").alias("status"), (o % 5 == 0).alias("allow_duplicates"), o)


@check("mu_1_insert_gate", with_views("""
 SELECT event_id, accepted, CAST(n_conflicts AS BIGINT) AS n_conflicts, CAST(n_duplicates AS BIGINT) AS n_duplicates FROM v_gate""", V_CAL, _NEW, _NEW_PAIRS, _MATCH.format("v_np"), _GATE))
def mu_1(spark, sf):
    return ch.gate_inserts(_new(spark, sf), v_cal(spark, sf)).select("event_id", "accepted", "n_conflicts", "n_duplicates")


_TYPED = """v_typed AS (SELECT *, ['focusTime', 'outOfOffice', 'workingLocation', 'default'][event_no % 4 + 1] AS etype, CASE event_no % 3 WHEN 0 THEN 'homeOffice' WHEN 1 THEN 'officeLocation' END AS place,
 CASE WHEN event_no % 5 = 0 THEN 'Desk ' || (event_no % 9) END AS label, CASE WHEN event_no % 2 = 0 THEN 'primary' ELSE calendar_id END AS cal FROM v_cal)"""


def _typed(spark, sf):
    e = F.col("event_no")
    return v_cal(spark, sf).withColumns({
        "event_type": F.get(F.array(*map(F.lit, ("focusTime", "outOfOffice", "workingLocation", "default"))), (e % 4).cast("int")),
        "place_type": F.when(e % 3 == 0, "homeOffice").when(e % 3 == 1, "officeLocation"),
        "place_label": F.when(e % 5 == 0, F.concat(F.lit("Desk "), e % 9)),
        "calendar_id": F.when(e % 2 == 0, "primary").otherwise(F.col("calendar_id")),
        "start_text": F.coalesce("start.dateTime", "start.date"), "end_text": F.coalesce("end.dateTime", "end.date"),
    })


@check("mu_2_type_defaults", with_views("""
 SELECT event_id, coalesce(transparency, CASE WHEN etype IN ('focusTime', 'outOfOffice') THEN 'opaque' WHEN etype = 'workingLocation' THEN 'transparent' END) AS transparency,
 CASE WHEN etype = 'workingLocation' THEN 'public' END AS visibility, CASE WHEN etype = 'workingLocation' AND summary IS NULL THEN
  CASE WHEN place = 'homeOffice' THEN 'Working from home' WHEN place = 'officeLocation' AND label IS NOT NULL THEN 'Working from ' || label WHEN place = 'officeLocation' THEN 'Working from office' ELSE 'Working location' END
  ELSE summary END AS summary, CASE WHEN etype = 'outOfOffice' THEN 'declineAllConflictingInvitations' END AS auto_decline,
 CASE WHEN etype IN ('focusTime', 'outOfOffice') AND is_all_day THEN 'all_day_not_allowed' WHEN etype IN ('outOfOffice', 'workingLocation') AND cal <> 'primary' THEN 'primary_calendar_required'
  WHEN etype = 'workingLocation' AND place IS NULL THEN 'working_location_required' END AS reject_reason FROM v_typed""", V_CAL, _TYPED))
def mu_2(spark, sf):
    made = ch.with_type_defaults(_typed(spark, sf))
    return made.select(
        "event_id", "transparency", "visibility", "summary", "auto_decline", ch.insert_reject_reason(made).alias("reject_reason"))


# Two patches per event; the later one counts.
_PATCHED = """v_patched AS MATERIALIZED (SELECT *, true AS hit, CASE event_no % 4 WHEN 0 THEN '2024-02-05' WHEN 1 THEN '2024-02-05T09:30:00' WHEN 2 THEN '2024-02-05T09:30:00Z' END AS txt FROM v_cal)"""


def _patches(spark, sf):
    e = F.col("event_no")
    cal = v_cal(spark, sf)
    base = cal.select(
        "calendar_id", "event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("change_no"), e, "start_ts")
    text = F.when(e % 4 == 0, "2024-02-05").when(e % 4 == 1, "2024-02-05T09:30:00").when(e % 4 == 2, "2024-02-05T09:30:00Z")
    return base.select(
        "calendar_id", "event_id", "change_no", F.when(e % 2 == 0, F.concat(F.lit("patched "), F.col("change_no"))).alias("summary"),
        F.lit("new place").alias("location"), text.alias("start_text"), F.lit("Asia/Tokyo").alias("zone"))


@check("mu_3_patch", with_views(f"""
 SELECT event_id, CASE WHEN hit AND event_no % 2 = 0 THEN 'patched 2' ELSE summary END AS summary, CASE WHEN hit THEN 'new place' ELSE location END AS location,
 CASE WHEN hit AND txt IS NOT NULL THEN CASE WHEN contains(txt, 'T') THEN txt END ELSE start_datetime END AS start_datetime,
 CASE WHEN hit AND txt IS NOT NULL THEN CASE WHEN NOT contains(txt, 'T') THEN txt END ELSE start_date END AS start_date,
 CASE WHEN hit AND txt IS NOT NULL THEN CASE WHEN event_no % 4 = 1 THEN 'Asia/Tokyo' END ELSE zone END AS start_zone,
 CASE WHEN hit AND txt IS NOT NULL THEN CASE event_no % 4 WHEN 0 THEN '2024-02-05 00:00:00' WHEN 1 THEN '2024-02-05 00:30:00' ELSE '2024-02-05 09:30:00' END ELSE {_TS.format('start_ts')} END AS start_at,
 CASE WHEN hit AND txt IS NOT NULL THEN event_no % 4 = 0 ELSE is_all_day END AS is_all_day FROM v_patched""", V_CAL, _PATCHED))
def mu_3(spark, sf):
    return ch.patched(v_cal(spark, sf), _patches(spark, sf)).select(
        "event_id", "summary", "location", F.col("start.dateTime").alias("start_datetime"), F.col("start.date").alias("start_date"),
        F.col("start.timeZone").alias("start_zone"), _stamp("start_ts", "start_at"), "is_all_day")


@check("mu_4_attendees", with_views("""
 SELECT event_id, 'USER' || user_id || '@home.example' AS asked, 'User' || user_id || '@home.example:' || CASE WHEN event_no % 2 = 0 THEN 'accepted' ELSE 'needsAction' END || ',fresh@out.example:new' AS attendees FROM v_cal""", V_CAL))
def mu_4(spark, sf):
    cal = v_cal(spark, sf)
    asked = F.upper(F.split_part(F.col("attendees")[0]["email"], F.lit("@"), F.lit(1)))
    asked = F.concat(asked, F.lit("@home.example"))
    merged = ch.merged_attendees(F.col("attendees"), F.array(asked, F.lit("fresh@out.example")))
    shown = F.array_join(F.transform(merged, lambda a: F.concat(a["email"], F.lit(":"), F.coalesce(a["responseStatus"], F.lit("new")))), ",")
    return cal.select("event_id", asked.alias("asked"), shown.alias("attendees"))


def _rule(df):
    return F.get(F.filter(df["recurrence"], lambda r: F.startswith(r, F.lit("RRULE:"))), F.lit(0))


@check("mu_5_split_series", with_views(f"""
 SELECT event_id, 'old' AS part, regexp_replace(regexp_replace(rrule, ';UNTIL=[0-9]{{8}}T[0-9]{{6}}Z', '', 'g'), ';COUNT=[0-9]+', '', 'g') || ';UNTIL=20240205T093000Z' AS rrule,
 {_TS.format('start_ts')} AS start_at, {_TS.format('end_ts')} AS end_at FROM v_cal WHERE rrule IS NOT NULL
 UNION ALL SELECT NULL, 'new', rrule, '2024-02-06 09:30:00', strftime(TIMESTAMP '2024-02-06 09:30:00' + (end_ts - start_ts), '%Y-%m-%d %H:%M:%S') FROM v_cal WHERE rrule IS NOT NULL""", V_CAL))
def mu_5(spark, sf):
    cal = v_cal(spark, sf)
    splits = cal.select("calendar_id", "event_id", F.lit("2024-02-06T09:30:00Z").alias("future_start"), F.lit("UTC").alias("zone"))
    done = rc.split_series(cal, splits)
    return done.select("event_id", "part", _rule(done).alias("rrule"), _stamp("start_ts", "start_at"), _stamp("end_ts", "end_at"))


@check("mu_6_event_kind", with_views("""
 SELECT event_id, CASE WHEN rrule IS NOT NULL OR recurring_event_id IS NOT NULL THEN 'recurring' ELSE 'single' END AS kind,
 event_id || '_' || strftime(start_ts, '%Y%m%dT%H%M%SZ') AS instance_id, event_id AS base_id FROM v_cal""", V_CAL))
def mu_6(spark, sf):
    made = rc.instance_id(F.col("event_id"), F.col("start_ts"))
    return v_cal(spark, sf).select(
        "event_id", rc.event_kind(F.col("recurrence"), F.col("recurring_event_id")).alias("kind"), made.alias("instance_id"),
        rc.base_id(made).alias("base_id"))


_INSTANCES = """v_steps AS (SELECT *, unnest(range(0, 400)) AS n FROM v_cal WHERE rrule IS NOT NULL),
v_inst AS (SELECT event_id, n, end_ts - start_ts AS len, rrule, start_ts AS first_ts, CASE WHEN contains(rrule, 'DAILY') THEN start_ts + to_days(CAST(2 * n AS INTEGER))
 WHEN contains(rrule, 'WEEKLY') THEN start_ts + to_days(CAST(7 * n AS INTEGER)) ELSE start_ts + to_months(CAST(n AS INTEGER)) END AS inst FROM v_steps),
v_valid AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n) AS nth FROM v_inst WHERE day(inst) = day(first_ts) OR NOT contains(rrule, 'MONTHLY'))"""


@check("mu_7_instances", with_views(f"""
 SELECT event_id, event_id || '_' || strftime(inst, '%Y%m%dT%H%M%SZ') AS instance_id, {_TS.format('inst')} AS start_at FROM v_valid
 WHERE (NOT contains(rrule, 'COUNT=5') OR nth <= 5) AND (NOT contains(rrule, 'UNTIL') OR inst <= TIMESTAMP '2024-03-01 00:00:00') AND inst + len > TIMESTAMP '2024-01-10' AND inst < TIMESTAMP '2024-03-10'
 UNION ALL SELECT event_id, event_id, {_TS.format('start_ts')} FROM v_cal WHERE rrule IS NULL AND end_ts > TIMESTAMP '2024-01-10' AND start_ts < TIMESTAMP '2024-03-10'""", V_CAL, _INSTANCES))
def mu_7(spark, sf):
    return rc.instances(v_cal(spark, sf), LOW, HIGH).select("event_id", "instance_id", _stamp("instance_start", "start_at"))


# One rule of each kind, by event number; the first EXDATE takes out the second instance of a daily series.
_RULES = (
    "RRULE:FREQ=WEEKLY;BYDAY=MO,WE,FR", "RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,SU;COUNT=5", "RRULE:FREQ=MONTHLY;BYMONTHDAY=1,31",
    "RRULE:FREQ=YEARLY", "RRULE:FREQ=DAILY;UNTIL=20240220T000000Z", "RRULE:FREQ=HOURLY;COUNT=3", "RRULE:FREQ=MONTHLY;BYMONTHDAY=-1",
    "RRULE:FREQ=MONTHLY;BYDAY=2TU",
)


# The twin walks all days after the start and asks of each whether the rule holds there.
@check("mu_7_rules", with_views(f"""
 SELECT event_id, kind, {_TS.format('inst')} AS start_at, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY inst) AS nth FROM (
   SELECT event_id, event_no % 8 AS kind, start_ts, end_ts - start_ts AS len, start_ts + to_days(CAST(d AS INTEGER)) AS inst, NULL AS reason
   FROM v_cal, (SELECT unnest(range(0, 500)) AS d)) WHERE CASE kind
    WHEN 0 THEN isodow(inst) IN (1, 3, 5)
    WHEN 1 THEN isodow(inst) IN (2, 7) AND date_diff('day', date_trunc('week', start_ts), date_trunc('week', inst)) % 14 = 0
    WHEN 2 THEN day(inst) IN (1, 31) WHEN 3 THEN month(inst) = month(start_ts) AND day(inst) = day(start_ts)
    WHEN 4 THEN inst <= TIMESTAMP '2024-02-20' WHEN 6 THEN day(inst + INTERVAL 1 DAY) = 1
    WHEN 7 THEN isodow(inst) = 2 AND day(inst) BETWEEN 8 AND 14 END)
 WHERE (kind <> 1 OR nth <= 5) AND (kind <> 4 OR nth <> 2) AND inst + len > TIMESTAMP '2024-01-10' AND inst < TIMESTAMP '2024-03-10'
 UNION ALL SELECT event_id, event_no % 8, {_TS.format('start_ts + to_hours(CAST(h AS INTEGER))')}, NULL FROM v_cal, (SELECT unnest(range(0, 3)) AS h)
 WHERE event_no % 8 = 5 AND end_ts + to_hours(CAST(h AS INTEGER)) > TIMESTAMP '2024-01-10' AND start_ts + to_hours(CAST(h AS INTEGER)) < TIMESTAMP '2024-03-10'""", V_CAL))
def mu_7_rules(spark, sf):
    kind = (F.col("event_no") % 8).cast("int")
    rule = F.get(F.array(*map(F.lit, _RULES)), kind)
    gone = F.concat(F.lit("EXDATE:"), F.date_format(F.col("start_ts") + F.expr("interval 1 day"), "yyyyMMdd'T'HHmmss'Z'"))
    planted = v_cal(spark, sf).withColumn("recurrence", F.when(kind == 4, F.array(rule, gone)).otherwise(F.array(rule)))
    return rc.instances(planted, LOW, HIGH).select(
        "event_id", (F.col("event_no") % 8).alias("kind"), _stamp("instance_start", "start_at"), F.col("unexpanded").alias("reason"))


# Sets of rules, by event number; the sixth also names a start 40 days and an hour after the first.
_SETS = (
    ("RRULE:FREQ=MONTHLY;BYDAY=2TU,-1FR",),
    ("RRULE:FREQ=YEARLY;BYMONTH=1,2;BYDAY=MO",),
    ("RRULE:FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1",),
    ("RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,SU;WKST=SU",),
    ("RRULE:FREQ=HOURLY;INTERVAL=7;COUNT=90",),
    ("RRULE:FREQ=WEEKLY;BYDAY=MO", "RRULE:FREQ=MONTHLY;BYMONTHDAY=15"),
    ("RRULE:FREQ=DAILY", "EXRULE:FREQ=WEEKLY;BYDAY=SA,SU"),
    ("RRULE:FREQ=YEARLY;BYYEARDAY=45,-320",),
    ("RRULE:FREQ=DAILY;BYMONTH=2;BYHOUR=6,18",),
    ("RRULE:FREQ=YEARLY;BYWEEKNO=5",),
)


# The twin walks days (or hours, or half days) after the start and asks of each whether the set holds there.
@check("mu_7_rule_sets", with_views(f"""
 SELECT event_id, kind, {_TS.format('inst')} AS start_at, NULL AS reason FROM (
  SELECT event_id, event_no % 10 AS kind, start_ts, end_ts - start_ts AS len, start_ts + to_days(CAST(d AS INTEGER)) AS inst FROM v_cal, (SELECT unnest(range(0, 500)) AS d)
  UNION ALL SELECT event_id, 14, start_ts, end_ts - start_ts, start_ts + to_hours(CAST(7 * n AS INTEGER)) FROM v_cal, (SELECT unnest(range(0, 90)) AS n) WHERE event_no % 10 = 4
  UNION ALL SELECT event_id, 15, start_ts, end_ts - start_ts, start_ts + INTERVAL 961 HOUR FROM v_cal WHERE event_no % 10 = 5
  UNION ALL SELECT event_id, 18, start_ts, end_ts - start_ts, date_trunc('day', start_ts) + to_days(CAST(d AS INTEGER)) + to_hours(CAST(h AS INTEGER)) + to_minutes(CAST(minute(start_ts) AS INTEGER))
   FROM v_cal, (SELECT unnest(range(0, 500)) AS d), (SELECT unnest([6, 18]) AS h) WHERE event_no % 10 = 8)
 WHERE inst >= start_ts AND inst + len > TIMESTAMP '2024-01-10' AND inst < TIMESTAMP '2024-03-10' AND CASE kind
  WHEN 0 THEN (isodow(inst) = 2 AND day(inst) BETWEEN 8 AND 14) OR (isodow(inst) = 5 AND month(inst + INTERVAL 7 DAY) <> month(inst))
  WHEN 1 THEN isodow(inst) = 1 AND month(inst) <= 2
  WHEN 2 THEN isodow(inst) <= 5 AND month(inst + to_days(CASE isodow(inst) WHEN 5 THEN 3 ELSE 1 END)) <> month(inst)
  WHEN 3 THEN isodow(inst) IN (2, 7) AND date_diff('day', date_trunc('week', start_ts + INTERVAL 1 DAY), date_trunc('week', inst + INTERVAL 1 DAY)) % 14 = 0
  WHEN 5 THEN isodow(inst) = 1 OR day(inst) = 15
  WHEN 6 THEN isodow(inst) <= 5
  WHEN 7 THEN dayofyear(inst) IN (45, CASE WHEN year(inst) % 4 = 0 THEN 47 ELSE 46 END)
  WHEN 14 THEN true WHEN 15 THEN true WHEN 18 THEN month(inst) = 2 ELSE false END
 UNION ALL SELECT event_id, 9, {_TS.format('start_ts')}, 'BYWEEKNO' FROM v_cal WHERE event_no % 10 = 9""", V_CAL))
def mu_7_rule_sets(spark, sf):
    kind = (F.col("event_no") % 10).cast("int")
    sets = F.array(*(F.array(*map(F.lit, rules)) for rules in _SETS))
    more = F.concat(F.lit("RDATE:"), F.date_format(F.col("start_ts") + F.expr("interval 961 hours"), "yyyyMMdd'T'HHmmss'Z'"))
    chosen = F.get(sets, kind)
    planted = v_cal(spark, sf).withColumn("recurrence", F.when(kind == 5, F.array_append(chosen, more)).otherwise(chosen))
    shown = F.when(F.col("unexpanded").isNull() & kind.isin(4, 8), kind + 10).otherwise(kind)
    named = rc.instances(planted, LOW, HIGH).withColumn("at", F.col("instance_start"))
    later = F.unix_timestamp("at") - F.unix_timestamp("start_ts") == 961 * 3600
    return named.select(
        "event_id", F.when((kind == 5) & later, 15).otherwise(shown).cast("long").alias("kind"), _stamp("at", "start_at"),
        F.col("unexpanded").alias("reason"))


@check("mu_8_scope", with_views("""
 SELECT event_id, CASE WHEN scope = 'bogus' THEN 'INVALID_MODIFICATION_SCOPE' WHEN scope = 'thisEventOnly' AND event_no % 5 = 0 THEN 'MISSING_ORIGINAL_START_TIME'
 WHEN scope = 'thisAndFollowing' AND event_no % 7 = 0 THEN 'MISSING_FUTURE_START_DATE' WHEN event_no % 7 <> 0 AND start_ts + INTERVAL 20 DAY <= TIMESTAMP '2024-02-01' THEN 'FUTURE_DATE_IN_PAST'
 WHEN scope <> 'all' AND rrule IS NULL AND recurring_event_id IS NULL THEN 'SCOPE_NOT_APPLICABLE_TO_SINGLE_EVENT' END AS reject_reason
 FROM (SELECT *, ['all', 'thisEventOnly', 'thisAndFollowing', 'bogus'][event_no % 4 + 1] AS scope FROM v_cal)""", V_CAL))
def mu_8(spark, sf):
    e = F.col("event_no")
    rows = v_cal(spark, sf).withColumns({
        "scope": F.get(F.array(*map(F.lit, ("all", "thisEventOnly", "thisAndFollowing", "bogus"))), (e % 4).cast("int")),
        "original_start": F.when(e % 5 > 0, F.col("start_ts")),
        "future_start": F.when(e % 7 > 0, F.col("start_ts") + F.expr("interval 20 days")),
    })
    return rows.select("event_id", ch.scope_reject_reason(rows, NOW).alias("reject_reason"))


@check("mu_9_respond", with_views("""
 SELECT event_id, CASE WHEN event_no % 7 = 0 THEN 'not_an_attendee' WHEN event_no % 6 = 0 THEN 'is_organizer' END AS reject_reason,
 CASE WHEN event_no % 7 > 0 AND event_no % 6 > 0 THEN 'tentative' WHEN event_no % 2 = 0 THEN 'accepted' ELSE 'needsAction' END AS my_status FROM v_cal""", V_CAL))
def mu_9(spark, sf):
    cal = v_cal(spark, sf)
    answers = cal.select(
        "calendar_id", "event_id", F.lit("tentative").alias("response"), F.lit("maybe").alias("response_comment"))
    return ch.responded(cal, answers).select("event_id", "reject_reason", F.col("attendees")[0]["responseStatus"].alias("my_status"))


@check("mu_10_delete", with_views("SELECT event_id FROM v_cal WHERE status <> 'cancelled'", V_CAL))
def mu_10(spark, sf):
    cal = v_cal(spark, sf)
    return ch.deleted(cal, cal.where("status = 'cancelled'")).select("event_id")


@check("mu_11_event_ids", """
 SELECT c_custkey, raw, regexp_matches(raw, '^[a-v0-9]+$') AND length(raw) BETWEEN 5 AND 1024 AS valid,
 CASE WHEN length(k) >= 5 THEN k ELSE 'short' END AS id, length(k) < 5 AS filled FROM (SELECT c_custkey, raw, regexp_replace(translate(lower(raw), 'wxyz', 'abcd'), '[^a-v0-9]', '', 'g') AS k FROM (
 SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'Wxyz ' || c_custkey WHEN 2 THEN '!' || (c_custkey % 10) ELSE 'abc' || c_custkey || 'def' END AS raw FROM customer))""")
def mu_11(spark, sf):
    c = F.col("c_custkey")
    raw = F.when(c % 4 == 0, F.col("c_name")).when(c % 4 == 1, F.concat(F.lit("Wxyz "), c)).when(
        c % 4 == 2, F.concat(F.lit("!"), c % 10)).otherwise(F.concat(F.lit("abc"), c, F.lit("def")))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(c, raw.alias("raw"))
    made = ch.sanitized_event_id(F.col("raw"))
    kept = F.length(F.regexp_replace(F.translate(F.lower("raw"), "wxyz", "abcd"), "[^a-v0-9]", "")) < 5
    return rows.select(
        c, "raw", ch.valid_event_id(F.col("raw")).alias("valid"),
        F.when(kept & ch.valid_event_id(made), "short").otherwise(made).alias("id"), kept.alias("filled"))


@check("mu_apply_changes", with_views("""
 SELECT event_id, summary FROM (SELECT event_id, CASE WHEN event_no % 2 = 0 THEN 'patched 2' ELSE summary END AS summary FROM v_cal WHERE status <> 'cancelled'
 UNION ALL SELECT event_id, summary FROM v_gate WHERE accepted)""", V_CAL, _NEW, _NEW_PAIRS, _MATCH.format("v_np"), _GATE))
def mu_apply(spark, sf):
    """Inserts, patches and deletes of one batch as the next table version."""
    cal = v_cal(spark, sf)
    return ch.apply_changes(cal, _new(spark, sf), _patches(spark, sf), cal.where("status = 'cancelled'")).select("event_id", "summary")
