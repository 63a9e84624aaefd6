"""Registered queries over calendar events and calendar access."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from riskloom.checks import check
from riskloom.checks.views import ACCOUNTS, V_ACCESS, V_CAL, v_access, v_cal, with_views
from riskloom.functions import times as tm
from riskloom.operators import calendar_query as cq
from riskloom.operators import conflicts as cf
from riskloom.operators.overlap_counts import check_counts
from riskloom.operators import registry as rg

LOW, HIGH = datetime(2024, 1, 5), datetime(2024, 1, 20)
_RANGE = "end_ts > TIMESTAMP '2024-01-05 00:00:00' AND start_ts < TIMESTAMP '2024-01-20 00:00:00'"
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _stamp(col, name):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(name)


@check("ca_1_list", with_views(f"SELECT calendar_id, event_id FROM v_cal WHERE {_RANGE} AND calendar_id IN ('cal1', 'cal2', 'cal3')", V_CAL))
def ca_1(spark, sf):
    return cq.list_events(v_cal(spark, sf), ["cal1", "cal2", "cal3"], LOW, HIGH).select("calendar_id", "event_id")


@check("ca_2_search", with_views(f"""
 SELECT event_id FROM v_cal WHERE {_RANGE} AND contains(lower(concat_ws(chr(10), summary, description, location, 'User ' || user_id || ' User' || user_id || '@home.example',
 'guest' || (event_no % 9) || '@out.example')), 'review') AND contains(lower(concat_ws(chr(10), summary, description, location, 'User ' || user_id || ' User' || user_id || '@home.example',
 'guest' || (event_no % 9) || '@out.example')), 'guest4@')""", V_CAL))
def ca_2(spark, sf):
    return cq.search_events(v_cal(spark, sf), "Review guest4@", LOW, HIGH).select("event_id")


@check("ca_3_properties", with_views(
    "SELECT event_id FROM v_cal WHERE event_no % 3 = 1 AND event_type = 'click' AND event_no % 2 = 0", V_CAL))
def ca_3(spark, sf):
    return cq.with_properties(v_cal(spark, sf), ["team=t1", "kind=click"], ["room=r0"]).select("event_id")


@check("ca_4_fields", with_views("""
 SELECT summary, start_datetime, end_date, status, location, rrule, transparency FROM v_cal""", V_CAL))
def ca_4(spark, sf):
    rows = cq.project_fields(v_cal(spark, sf), ["transparency"])
    rule = F.get(F.filter("recurrence", lambda r: F.startswith(r, F.lit("RRULE:"))), F.lit(0))
    return rows.select(
        "summary", F.col("start.dateTime").alias("start_datetime"), F.col("end.date").alias("end_date"), "status", "location",
        rule.alias("rrule"), "transparency")


@check("ca_5_get", with_views("SELECT event_id, summary FROM v_cal WHERE location IS NOT NULL", V_CAL))
def ca_5(spark, sf):
    cal = v_cal(spark, sf)
    return cq.get_events(cal, cal.where("location is not null").select("calendar_id", "event_id")).select("event_id", "summary")


@check("ca_6_merge_sources", with_views("""
 SELECT ['home','lab','work'][user_id % 3 + 1] AS account_id, event_id FROM v_cal WHERE user_id % 3 < 2
 UNION ALL SELECT 'work', 'failed: no access'""", V_CAL))
def ca_6(spark, sf):
    """Two readable accounts and one that fails, which turns into a warning row."""
    cal = v_cal(spark, sf)
    user = F.regexp_extract("calendar_id", r"(\d+)", 1).cast("int") % 3
    rows, warnings = cq.merge_sources([
        ("home", cal.where(user == 0)), ("lab", cal.where(user == 1)), ("work", PermissionError("no access"))])
    notes = spark.createDataFrame([(name, f"failed: {text}") for name, text in warnings], "account_id string, event_id string")
    return rows.select("account_id", "event_id").unionByName(notes)


@check("ca_7_sorted", with_views("SELECT coalesce(start_datetime, start_date, '') AS start_text, event_id FROM v_cal", V_CAL))
def ca_7(spark, sf):
    """All events in start-text order (the order itself is tested in tests/test_tables.py)."""
    return cq.sorted_by_start(v_cal(spark, sf)).select(cq.start_text(F.col("start")).alias("start_text"), "event_id")


@check("ca_8_weekdays", with_views("""
 SELECT event_id, dayname(CASE WHEN zone IS NULL THEN start_ts ELSE (start_ts AT TIME ZONE 'UTC') AT TIME ZONE zone END) AS start_weekday,
 dayname(CASE WHEN zone IS NULL THEN end_ts ELSE (end_ts AT TIME ZONE 'UTC') AT TIME ZONE zone END) AS end_weekday FROM v_cal""", V_CAL))
def ca_8(spark, sf):
    return cq.enriched(v_cal(spark, sf)).select("event_id", "start_weekday", "end_weekday")


@check("ca_9_unified", with_views(
    "SELECT calendar_id, CAST(n_accounts AS BIGINT) AS n_accounts, preferred_account, preferred_role, display_name FROM v_unified", V_ACCESS))
def ca_9(spark, sf):
    return rg.unified_calendars(v_access(spark, sf)).drop("first_ord")


@check("ca_10_write_account", with_views("""
 SELECT calendar_id, preferred_account AS account_id, preferred_role AS access_role FROM v_unified WHERE preferred_role IN ('owner', 'writer')""", V_ACCESS))
def ca_10(spark, sf):
    return rg.account_for(rg.unified_calendars(v_access(spark, sf)), "write")


@check("ca_11_accounts", with_views(
    "SELECT calendar_id, account_id, access_role FROM v_access WHERE calendar_id IN (SELECT calendar_id FROM v_access WHERE is_primary)", V_ACCESS))
def ca_11(spark, sf):
    access = v_access(spark, sf)
    return rg.accounts_with_access(access, access.where(F.col("primary"))).select("calendar_id", "account_id", "access_role")


_NAMES = """v_names AS MATERIALIZED (SELECT DISTINCT name FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || ' ' || (c_custkey % 50) WHEN 1 THEN lower(c_mktsegment) || ' ' || (c_custkey % 50)
 WHEN 2 THEN 'My ' || c_name WHEN 3 THEN 'c' || c_custkey || '@cal.example' ELSE 'MY ' || upper(c_name) END AS name FROM customer
 UNION ALL SELECT 'primary' UNION ALL SELECT 'no such calendar'))"""


def _names(spark, sf):
    c = F.col("c_custkey")
    name = (
        F.when(c % 5 == 0, F.concat("c_mktsegment", F.lit(" "), c % 50)).when(c % 5 == 1, F.concat(F.lower("c_mktsegment"), F.lit(" "), c % 50))
        .when(c % 5 == 2, F.concat(F.lit("My "), "c_name")).when(c % 5 == 3, F.concat(F.lit("c"), c, F.lit("@cal.example")))
        .otherwise(F.concat(F.lit("MY "), F.upper("c_name")))
    )
    extra = spark.createDataFrame([("primary",), ("no such calendar",)], "name string")
    return spark.read.parquet(f"{sf}/customer.parquet").select(name.alias("name")).unionByName(extra).distinct()


_RESOLVED = """v_cand AS (SELECT 1 AS pr, summary_override AS nm, a.calendar_id, u.first_ord FROM v_access a JOIN v_unified u USING (calendar_id)
 UNION ALL SELECT 3, display_name, calendar_id, first_ord FROM v_unified UNION ALL SELECT 5, a.summary, a.calendar_id, u.first_ord FROM v_access a JOIN v_unified u USING (calendar_id)),
v_match AS MATERIALIZED (SELECT n.name, arg_min(c.calendar_id, (c.pr + CASE WHEN c.nm = n.name THEN 0 ELSE 1 END) * 100000000000 + c.first_ord) AS calendar_id
 FROM v_names n JOIN v_cand c ON lower(c.nm) = lower(n.name) WHERE n.name <> 'primary' AND NOT contains(n.name, '@') GROUP BY n.name),
v_res AS MATERIALIZED (SELECT n.name, CASE WHEN n.name = 'primary' THEN 'primary' ELSE u.calendar_id END AS calendar_id,
 CASE WHEN n.name = 'primary' THEN 'home' ELSE u.preferred_account END AS account_id, CASE WHEN n.name = 'primary' THEN 'owner' ELSE u.preferred_role END AS access_role
 FROM v_names n LEFT JOIN v_match m USING (name) LEFT JOIN v_unified u ON u.calendar_id = CASE WHEN contains(n.name, '@') THEN n.name ELSE m.calendar_id END)"""


@check("ca_12_resolve", with_views("SELECT * FROM v_res", V_ACCESS, _NAMES, _RESOLVED))
def ca_12(spark, sf):
    return rg.resolve_names(_names(spark, sf), v_access(spark, sf), ACCOUNTS)


@check("ca_12_resolve_write", with_views("""
 SELECT name, CASE WHEN access_role IN ('owner', 'writer') THEN calendar_id END AS calendar_id, CASE WHEN access_role IN ('owner', 'writer') THEN account_id END AS account_id,
 CASE WHEN access_role IN ('owner', 'writer') THEN access_role END AS access_role FROM v_res""", V_ACCESS, _NAMES, _RESOLVED))
def ca_12_write(spark, sf):
    return rg.resolve_names(_names(spark, sf), v_access(spark, sf), ACCOUNTS, "write")


@check("ca_12_resolve_single", with_views("""
 SELECT n.name, CASE WHEN n.name = 'primary' OR contains(n.name, '@') THEN n.name ELSE m.calendar_id END AS calendar_id FROM v_names n LEFT JOIN (
 SELECT n.name, arg_min(c.calendar_id, (c.pr + CASE WHEN c.nm = n.name THEN 0 ELSE 1 END) * 100000000000 + c.ord) AS calendar_id FROM v_names n JOIN (
  SELECT 1 AS pr, summary_override AS nm, calendar_id, ord FROM v_access WHERE account_id = 'home' UNION ALL SELECT 5, summary, calendar_id, ord FROM v_access WHERE account_id = 'home') c
  ON lower(c.nm) = lower(n.name) GROUP BY n.name) m USING (name)""", V_ACCESS, _NAMES))
def ca_12_single(spark, sf):
    return rg.resolve_in_account(_names(spark, sf), v_access(spark, sf).where("account_id = 'home'"))


@check("ca_13_route", with_views("""
 SELECT DISTINCT account_id, calendar_id, NULL AS warning FROM v_res WHERE account_id IS NOT NULL
 UNION ALL SELECT NULL, NULL, 'Calendar "' || name || '" not found on any account' FROM v_res WHERE account_id IS NULL""", V_ACCESS, _NAMES, _RESOLVED))
def ca_13(spark, sf):
    routes, warnings = rg.route(_names(spark, sf), v_access(spark, sf), ACCOUNTS)
    none = F.lit(None).cast("string")
    return routes.withColumn("warning", none).unionByName(
        warnings.select(none.alias("account_id"), none.alias("calendar_id"), "warning"))


@check("ca_14_listing", with_views("""
 SELECT calendar_id, a.account_id, a.access_role, a.summary, u.display_name, u.preferred_account FROM v_access a JOIN v_unified u USING (calendar_id)""", V_ACCESS))
def ca_14(spark, sf):
    return rg.calendar_listing(v_access(spark, sf)).select(
        "calendar_id", "account_id", "access_role", "summary", "display_name", "preferred_account")


_BUSY = f"""v_busy AS MATERIALIZED (SELECT calendar_id, min(s) AS start_ts, max(e) AS end_ts FROM (
 SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY calendar_id ORDER BY s, e, event_no) AS grp FROM (
 SELECT *, max(e) OVER (PARTITION BY calendar_id ORDER BY s, e, event_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
 SELECT calendar_id, event_no, greatest(start_ts, TIMESTAMP '2024-01-05 00:00:00') AS s, least(end_ts, TIMESTAMP '2024-01-20 00:00:00') AS e FROM v_cal
 WHERE {_RANGE} AND status <> 'cancelled' AND coalesce(transparency, 'opaque') <> 'transparent'))) GROUP BY calendar_id, grp)"""


@check("ca_15_busy", with_views(
    f"SELECT calendar_id, {_TS.format('start_ts')} AS busy_start, {_TS.format('end_ts')} AS busy_end FROM v_busy", V_CAL, _BUSY))
def ca_15(spark, sf):
    return cq.busy_slots(v_cal(spark, sf), LOW, HIGH).select("calendar_id", _stamp("start_ts", "busy_start"), _stamp("end_ts", "busy_end"))


@check("ca_15_pick", with_views("""
 SELECT u.calendar_id, account_id, CASE WHEN account_id IS NULL THEN 'notFound' ELSE error END AS error FROM (SELECT DISTINCT unnest(['c' || c_custkey || '@cal.example', 'x' || c_custkey || '@cal.example']) AS calendar_id FROM customer) u
 LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY calendar_id ORDER BY error IS NOT NULL, ord) AS rn FROM (
  SELECT calendar_id, account_id, ord, CASE WHEN access_role = 'reader' THEN 'denied' END AS error FROM v_access)) r ON r.calendar_id = u.calendar_id AND rn = 1""", V_ACCESS))
def ca_15_pick(spark, sf):
    """Half of the calendars asked for are planted without any access."""
    asked = spark.read.parquet(f"{sf}/customer.parquet").select(F.explode(F.array(*(
        F.concat(F.lit(kind), "c_custkey", F.lit("@cal.example")) for kind in ("c", "x")))).alias("calendar_id"))
    access = rg.normalized_access(v_access(spark, sf))
    answers = access.select("calendar_id", "account_id", "ord", F.when(F.col("access_role") == "reader", "denied").alias("error"))
    return cq.pick_results(asked, answers)


_PAIRS = """v_pairs AS MATERIALIZED (SELECT a.calendar_id, a.event_id AS a_id, b.event_id AS b_id, a.summary AS a_sum, b.summary AS b_sum, a.start_ts AS a_start, a.end_ts AS a_end,
 b.start_ts AS b_start, b.end_ts AS b_end, a.is_all_day AS a_day, b.is_all_day AS b_day FROM v_cal a JOIN v_cal b ON a.calendar_id = b.calendar_id AND a.event_id <> b.event_id
 AND b.status <> 'cancelled' AND a.start_ts < b.end_ts AND b.start_ts < a.end_ts)"""
_MATCH = """v_alike AS MATERIALIZED (SELECT *, coalesce(x, false) AS t_exact, coalesce(x OR contains(t1, t2) OR contains(t2, t1)
  OR (least(len(w1), len(w2)) > 0 AND len(list_filter(w1, lambda w: list_contains(w2, w))) * 2 >= least(len(w1), len(w2))), false) AS t_similar FROM (
 SELECT *, t1 = t2 AS x, list_filter(string_split_regex(t1, '\\s+'), lambda w: length(w) > 3) AS w1, list_filter(string_split_regex(t2, '\\s+'), lambda w: length(w) > 3) AS w2
 FROM (SELECT *, trim(lower(a_sum)) AS t1, trim(lower(b_sum)) AS t2 FROM {0}))),
v_sim AS MATERIALIZED (SELECT *, CASE WHEN a_day <> b_day THEN 0.2 WHEN t_exact AND o THEN 0.95 WHEN t_similar AND o THEN 0.7 WHEN t_exact AND a_start::DATE = b_start::DATE THEN 0.6
 WHEN t_exact THEN 0.4 WHEN t_similar THEN 0.3 ELSE 0.1 END::DOUBLE AS similarity FROM (SELECT *, a_start < b_end AND b_start < a_end AS o FROM v_alike))"""
_NEIGHBOURS = """v_near AS MATERIALIZED (SELECT a.event_id AS a_id, b.event_id AS b_id, a.summary AS a_sum, b.summary AS b_sum, a.start_ts AS a_start, a.end_ts AS a_end,
 b.start_ts AS b_start, b.end_ts AS b_end, a.is_all_day AS a_day, b.is_all_day AS b_day FROM v_cal a JOIN v_cal b ON b.event_no = a.event_no + {0})"""


def _near(spark, sf, step):
    """Every event next to the event ``step`` numbers later: as many pairs as events."""
    cal = v_cal(spark, sf).select("event_no", "event_id", "summary", "start_ts", "end_ts", "is_all_day")
    a = cal.select(F.col("event_no").alias("n"), F.struct(*cal.columns).alias("a"))
    b = cal.select((F.col("event_no") - step).alias("n"), F.struct(*cal.columns).alias("b"))
    return a.join(b, "n").select("a", "b")


@check("ca_16_overlap", with_views(
    "SELECT a_id, b_id, a_start < b_end AND b_start < a_end AS overlap FROM v_near", V_CAL, _NEIGHBOURS.format(3)))
def ca_16(spark, sf):
    return _near(spark, sf, 3).select(
        F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"), cf.events_overlap(F.col("a"), F.col("b")).alias("overlap"))


@check("ca_17_conflicts", with_views("SELECT calendar_id, a_id AS event_id, b_id AS conflict_id FROM v_pairs", V_CAL, _PAIRS))
def ca_17(spark, sf):
    return cf.conflicts(cf.conflict_pairs(v_cal(spark, sf))).select("calendar_id", "event_id", "conflict_id")


_MS = "(epoch_ms(least(a_end, b_end)) - epoch_ms(greatest(a_start, b_start)))"


@check("ca_18_overlap_facts", with_views(f"""
 SELECT a_id AS event_id, b_id AS conflict_id, CAST({_MS} AS BIGINT) AS overlap_ms, CAST(round({_MS} * 100.0 / (epoch_ms(a_end) - epoch_ms(a_start))) AS BIGINT) AS overlap_percent,
 {_TS.format('greatest(a_start, b_start)')} AS overlap_start, {_TS.format('least(a_end, b_end)')} AS overlap_end FROM v_pairs""", V_CAL, _PAIRS))
def ca_18(spark, sf):
    return cf.conflicts(cf.conflict_pairs(v_cal(spark, sf))).select(
        "event_id", "conflict_id", "overlap_ms", "overlap_percent", _stamp("overlap_start", "overlap_start"), _stamp("overlap_end", "overlap_end"))


@check("ca_19_duration_text", """
 SELECT event_id, CASE WHEN d > 0 THEN d || ' day' || CASE WHEN d > 1 THEN 's' ELSE '' END || CASE WHEN h % 24 > 0 THEN ' ' || (h % 24) || ' hour' || CASE WHEN h % 24 > 1 THEN 's' ELSE '' END ELSE '' END
 WHEN h > 0 THEN h || ' hour' || CASE WHEN h > 1 THEN 's' ELSE '' END || CASE WHEN m % 60 > 0 THEN ' ' || (m % 60) || ' minute' || CASE WHEN m % 60 > 1 THEN 's' ELSE '' END ELSE '' END
 ELSE m || ' minute' || CASE WHEN m > 1 THEN 's' ELSE '' END END AS duration
 FROM (SELECT event_id, m, m // 60 AS h, m // 1440 AS d FROM (SELECT event_id, event_id * 37 % 5000 AS m FROM events))""")
def ca_19(spark, sf):
    minutes = F.col("event_id") * 37 % 5000
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", tm.duration_text(minutes * 60_000).alias("duration"))


@check("ca_20_title_match", with_views("SELECT a_id, b_id, t_exact AS exact_title, t_similar AS similar_title FROM v_sim", V_CAL, _NEIGHBOURS.format(7), _MATCH.format("v_near")))
def ca_20(spark, sf):
    m = cf.title_match(F.col("a.summary"), F.col("b.summary"))
    return _near(spark, sf, 7).select(F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"), m.alias("m")).select(
        "a_id", "b_id", F.col("m.exact").alias("exact_title"), F.col("m.similar").alias("similar_title"))


@check("ca_21_similarity", with_views("SELECT a_id, b_id, similarity FROM v_sim", V_CAL, _NEIGHBOURS.format(1), _MATCH.format("v_near")))
def ca_21(spark, sf):
    return _near(spark, sf, 1).select(
        F.col("a.event_id").alias("a_id"), F.col("b.event_id").alias("b_id"), cf.similarity(F.col("a"), F.col("b")).alias("similarity"))


@check("ca_22_duplicates", with_views(f"""
 SELECT calendar_id, a_id AS event_id, b_id AS duplicate_id, coalesce(nullif(b_sum, ''), 'Untitled Event') AS duplicate_title, similarity,
 CASE WHEN similarity >= 0.95 THEN '{cf.BLOCK_SUGGESTION}' ELSE '{cf.WARN_SUGGESTION}' END AS suggestion FROM v_sim WHERE similarity >= 0.7""", V_CAL, _PAIRS, _MATCH.format("v_pairs")))
def ca_22(spark, sf):
    return cf.duplicates(cf.conflict_pairs(v_cal(spark, sf)))


@check("ca_23_busy_conflicts", with_views(f"""
 SELECT v.calendar_id, event_id, {_TS.format('b.start_ts')} AS busy_start, {_TS.format('b.end_ts')} AS busy_end FROM v_cal v JOIN v_busy b ON v.calendar_id = b.calendar_id
 AND v.start_ts < b.end_ts AND b.start_ts < v.end_ts""", V_CAL, _BUSY))
def ca_23(spark, sf):
    cal = v_cal(spark, sf)
    return cf.busy_conflicts(cal, cq.busy_slots(cal, LOW, HIGH)).select(
        "calendar_id", "event_id", _stamp("busy_start", "busy_start"), _stamp("busy_end", "busy_end"))


@check("ca_24_full_check", with_views("""
 SELECT a_id AS event_id, CAST(count(*) AS BIGINT) AS n_conflicts, CAST(count(*) FILTER (WHERE similarity >= 0.7) AS BIGINT) AS n_duplicates, max(similarity) AS max_similarity,
 concat_ws('; ', CASE WHEN count(*) FILTER (WHERE similarity >= 0.7) > 0 THEN 'Found ' || count(*) FILTER (WHERE similarity >= 0.7) || ' potential duplicate(s)' END,
 'Found ' || count(*) || ' scheduling conflict(s)') AS warnings FROM v_sim GROUP BY a_id""", V_CAL, _PAIRS, _MATCH.format("v_pairs")))
def ca_24(spark, sf):
    cal = v_cal(spark, sf)
    return check_counts(cal, cal)


# Local times shaped from the event number: naive, with offset, date only, malformed.
_LOCAL = """v_local AS (SELECT event_id, zone, CASE event_id % 5 WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') || 'Z'
 WHEN 2 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') || '+05:30' WHEN 3 THEN strftime(t, '%Y-%m-%d') ELSE strftime(t, '%Y-%m-%dT%H:%M') END AS txt, event_id % 5 AS form, t FROM (
 SELECT event_id, ['America/New_York', 'Asia/Tokyo', 'Europe/Berlin'][event_id % 3 + 1] AS zone, make_timestamp((1704067200 + event_id * 3203 % 31536000) * 1000000) AS t FROM events))"""


def _local(spark, sf):
    e = F.col("event_id")
    t = F.timestamp_seconds(1704067200 + e * 3203 % 31536000)
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(e % 5 == 0, iso).when(e % 5 == 1, F.concat(iso, F.lit("Z"))).when(e % 5 == 2, F.concat(iso, F.lit("+05:30")))
        .when(e % 5 == 3, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm"))
    )
    zone = F.get(F.array(F.lit("America/New_York"), F.lit("Asia/Tokyo"), F.lit("Europe/Berlin")), (e % 3).cast("int"))
    return spark.read.parquet(f"{sf}/events.parquet").select(e, zone.alias("zone"), text.alias("txt"), t.alias("t"))


@check("ca_25_to_utc", with_views("""
 SELECT event_id, CASE form WHEN 0 THEN strftime((t AT TIME ZONE zone) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN txt WHEN 2 THEN txt ELSE txt || 'Z' END AS utc FROM v_local""", _LOCAL))
def ca_25(spark, sf):
    return _local(spark, sf).select("event_id", tm.to_rfc3339(F.col("txt"), F.col("zone")).alias("utc"))


@check("ca_26_time_object", with_views("""
 SELECT event_id, CASE WHEN form <> 3 THEN txt END AS date_time, CASE WHEN form = 3 THEN txt END AS date, CASE WHEN form IN (0, 4) THEN CASE WHEN event_id % 2 = 0 THEN zone ELSE 'UTC' END END AS time_zone FROM v_local""", _LOCAL))
def ca_26(spark, sf):
    none = F.lit(None).cast("string")
    made = tm.time_object(F.col("txt"), F.when(F.col("event_id") % 2 == 0, F.col("zone")), none)
    return _local(spark, sf).select("event_id", made.alias("o")).select(
        "event_id", F.col("o.dateTime").alias("date_time"), "o.date", F.col("o.timeZone").alias("time_zone"))


@check("ca_27_zone_facts", with_views("""
 SELECT event_id, strftime(l, '%Y-%m-%dT%H:%M:%S.000') || off AS local_iso, dayname(l) AS weekday, mins <> jan AND jan <> jul AS is_dst FROM (
 SELECT *, CASE WHEN mins = 0 THEN 'Z' ELSE CASE WHEN mins >= 0 THEN '+' ELSE '-' END || lpad(CAST(abs(mins) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(mins) % 60 AS VARCHAR), 2, '0') END AS off FROM (
 SELECT event_id, l, (epoch(l) - epoch(t))::BIGINT // 60 AS mins, (epoch((TIMESTAMP '2024-01-01' AT TIME ZONE 'UTC') AT TIME ZONE zone) - epoch(TIMESTAMP '2024-01-01'))::BIGINT // 60 AS jan,
  (epoch((TIMESTAMP '2024-07-01' AT TIME ZONE 'UTC') AT TIME ZONE zone) - epoch(TIMESTAMP '2024-07-01'))::BIGINT // 60 AS jul
 FROM (SELECT *, (t AT TIME ZONE 'UTC') AT TIME ZONE zone AS l FROM v_local)))""", _LOCAL))
def ca_27(spark, sf):
    t, zone = F.col("t"), F.col("zone")
    return _local(spark, sf).select(
        "event_id", tm.local_iso(t, zone).alias("local_iso"), F.date_format(F.from_utc_timestamp(t, zone), "EEEE").alias("weekday"),
        tm.is_dst(t, zone).alias("is_dst"))


@check("ca_28_display")
def ca_28(spark, sf):
    cal = v_cal(spark, sf)
    return cal.select("event_id", cq.display_text(cal, "https://calendar.example/event").alias("display_text"))


@check("ca_29_formats", with_views("""
 SELECT event_id, form IN (1, 2) AS has_offset, form IN (0, 1, 2) AS valid_datetime, form IN (0, 1, 2, 3) AS valid_date_or_datetime FROM v_local""", _LOCAL))
def ca_29(spark, sf):
    t = F.col("txt")
    return _local(spark, sf).select(
        "event_id", tm.has_offset(t).alias("has_offset"), tm.valid_datetime(t).alias("valid_datetime"),
        tm.valid_date_or_datetime(t).alias("valid_date_or_datetime"))
