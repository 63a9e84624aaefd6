"""Registered queries of scoring and actions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from riskloom.checks import check
from riskloom.checks.payloads import ATTACKS, BENIGN, CYCLE
from riskloom.checks.rule_sql import SCORES
from riskloom.checks.views import OWNER_DOMAIN, V_EVENTS, V_TEXT, quoted, v_events, v_text, with_views
from riskloom.config import ScanConfig
from riskloom.operators import actions, scoring
from riskloom.plans.quality import detection_quality
from riskloom.plans.scan import detect, scan_events, scan_fields
from riskloom.sources.fields import explode_fields

NOW = datetime(2024, 3, 1, 12, 0, 0)
LATER = datetime(2024, 3, 9, 12, 0, 0)


def _texts(spark, sf, config=ScanConfig()):
    return scan_fields(v_text(spark, sf), config, content="text")


def _events(spark, sf):
    events = v_events(spark, sf)
    return events, scan_events(events, OWNER_DOMAIN)


@check("sc_1_tier_score", with_views(
    "SELECT item_id, tier, round(tier_score, 6) AS tier_score FROM v_tier", V_TEXT, SCORES))
def sc_1(spark, sf):
    found = detect(v_text(spark, sf), content="text")
    return found.select("item_id", F.explode(F.array(*(
        F.struct(F.lit(t).alias("tier"), scoring.tier_score_of(F.col(t)).alias("s")) for t in ("structural", "contextual")
    ))).alias("x")).select("item_id", "x.tier", F.round("x.s", 6).alias("tier_score")).where("tier_score > 0")


@check("sc_2_composite", with_views(
    "SELECT item_id, round(st * 0.40::DOUBLE + ct * 0.45::DOUBLE, 6) AS weighted FROM v_score", V_TEXT, SCORES))
def sc_2(spark, sf):
    found = detect(v_text(spark, sf), content="text")
    w = ScanConfig().weights
    return found.select("item_id", F.round(
        scoring.tier_score_of(F.col("structural")) * w["structural"]
        + scoring.tier_score_of(F.col("contextual")) * w["contextual"], 6).alias("weighted"))


@check("sc_3_corroboration", with_views(
    "SELECT item_id, round(risk_score, 6) AS risk_score FROM v_score", V_TEXT, SCORES))
def sc_3(spark, sf):
    return _texts(spark, sf).select("item_id", F.round("risk_score", 6).alias("risk_score"))


@check("sc_4_level", with_views("SELECT item_id, risk_level FROM v_score", V_TEXT, SCORES))
def sc_4(spark, sf):
    return _texts(spark, sf).select("item_id", "risk_level")


@check("sc_5_action", with_views(
    "SELECT risk_level, action, CAST(count(*) AS BIGINT) AS n FROM v_score GROUP BY ALL", V_TEXT, SCORES))
def sc_5(spark, sf):
    return _texts(spark, sf).groupBy("risk_level", "action").agg(F.count(F.lit(1)).alias("n"))


_EVENT_SCORES = """v_event AS MATERIALIZED (
 SELECT *, CASE risk_level WHEN 'critical' THEN 'block' WHEN 'dangerous' THEN 'redact' WHEN 'suspicious' THEN 'flag' ELSE 'pass' END AS action
 FROM (SELECT *, CASE WHEN risk_score >= 0.85 THEN 'critical' WHEN risk_score >= 0.6 THEN 'dangerous' WHEN risk_score >= 0.3 THEN 'suspicious' ELSE 'safe' END AS risk_level
 FROM (SELECT e.id, e.calendar_id, e.organizer_email, e.organizer_domain, coalesce(e.organizer_domain <> 'home.example', false) AS is_external,
  coalesce(max(s.risk_score), 0::DOUBLE) AS risk_score, count(s.item_id) AS field_count
  FROM v_events e LEFT JOIN v_fields f USING (id) LEFT JOIN v_score s ON s.item_id = f.id || '#' || f.field_name
  GROUP BY ALL))),
v_field AS MATERIALIZED (SELECT f.*, s.risk_score AS field_score, s.action AS field_action FROM v_fields f
 JOIN v_score s ON s.item_id = f.id || '#' || f.field_name),
v_found AS MATERIALIZED (SELECT f.id, f.field_no, f.field_name, k.* FROM v_fields f JOIN v_kept k ON k.item_id = f.id || '#' || f.field_name)"""
EVENTS_SQL = (V_EVENTS, SCORES, _EVENT_SCORES)


@check("sc_6_conversation_score", with_views("""
 SELECT split_part(item_id, ':', 2) AS conv_id, round(max(risk_score), 6) AS risk_score, CAST(count(*) AS BIGINT) AS field_count
 FROM v_score WHERE item_id LIKE 'conv:%' GROUP BY 1""", V_TEXT, SCORES))
def sc_6(spark, sf):
    """Conversations as events: one field per turn, the event scores as its worst turn."""
    scored = scan_fields(
        v_text(spark, sf).where(F.startswith("item_id", F.lit("conv:"))), content="text"
    ).withColumn("conv_id", F.split_part("item_id", F.lit(":"), F.lit(2)))
    ids = scored.select("conv_id").distinct()
    return scoring.event_scores(ids, scored, ["conv_id"], ScanConfig()).select(
        "conv_id", F.round("risk_score", 6).alias("risk_score"), "field_count")


@check("sc_7_scan", with_views("""
 SELECT v.id, calendar_id, organizer_email, is_external, round(risk_score, 6) AS risk_score, risk_level, action, CAST(field_count AS BIGINT) AS field_count,
 coalesce(n, 0) AS detection_count, coalesce(ids, '') AS rule_ids
 FROM v_event v LEFT JOIN (SELECT id, CAST(count(*) AS BIGINT) AS n, string_agg(rule_id, ',' ORDER BY field_no, pos) AS ids FROM v_found GROUP BY id) d USING (id)""", *EVENTS_SQL))
def sc_7(spark, sf):
    _, results = _events(spark, sf)
    return results.select(
        "id", "calendar_id", "organizer_email", "is_external", F.round("risk_score", 6).alias("risk_score"), "risk_level",
        "action", "field_count", F.size("detections").cast("long").alias("detection_count"),
        F.array_join(F.transform("detections", lambda d: d["rule_id"]), ",").alias("rule_ids"),
    )


@check("sc_7_scan_texts", with_views("""
 SELECT s.item_id, round(risk_score, 6) AS risk_score, action, coalesce(n, 0) AS detection_count FROM v_score s
 LEFT JOIN (SELECT item_id, CAST(count(*) AS BIGINT) AS n FROM v_kept GROUP BY item_id) k USING (item_id)""", V_TEXT, SCORES))
def sc_7_texts(spark, sf):
    """The scan over plain texts: one narrow stage, no shuffle."""
    return _texts(spark, sf).select(
        "item_id", F.round("risk_score", 6).alias("risk_score"), "action",
        F.size("detections").cast("long").alias("detection_count"))


_PLANTED_KIND = f"""CASE WHEN doc_id % {CYCLE} < {len(ATTACKS)} THEN 'attack' WHEN doc_id % {CYCLE} < {len(ATTACKS) + len(BENIGN)} THEN 'lookalike' ELSE 'clean' END"""


@check("sc_8_quality", with_views(f"""
 SELECT kind, CAST(count(*) AS BIGINT) AS n_texts, round(avg(CASE WHEN risk_level <> 'safe' THEN 1.0 ELSE 0.0 END), 6) AS flagged_rate,
 round(avg(CASE WHEN len(list_filter(fired, lambda x: x = expected)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS expected_rule_rate
 FROM (SELECT {_PLANTED_KIND} AS kind, s.risk_level, coalesce(k.fired, []) AS fired,
  ({'[' + ', '.join(quoted(r) for r, _ in ATTACKS) + ']'})[doc_id % {CYCLE} + 1] AS expected
  FROM documents d JOIN v_score s ON s.item_id = 'doc:' || d.doc_id
  LEFT JOIN (SELECT item_id, list(rule_id) AS fired FROM v_kept GROUP BY item_id) k ON k.item_id = s.item_id) GROUP BY kind""", V_TEXT, SCORES))
def sc_8(spark, sf):
    slot = F.col("doc_id") % CYCLE
    docs = v_text(spark, sf).where(F.startswith("item_id", F.lit("doc:"))).withColumn(
        "doc_id", F.split_part("item_id", F.lit(":"), F.lit(2)).cast("long"))
    expected = F.get(F.array(*(F.lit(rule) for rule, _ in ATTACKS)), slot.cast("int"))
    labelled = docs.withColumns({
        "kind": F.when(slot < len(ATTACKS), "attack").when(slot < len(ATTACKS) + len(BENIGN), "lookalike").otherwise("clean"),
        "expected": F.when(expected.isNotNull(), F.array(expected)).otherwise(F.array().cast("array<string>")),
    })
    rates = detection_quality(scan_fields(labelled, content="text"), "kind", "expected")
    return rates.withColumns({n: F.round(n, 6) for n in ("flagged_rate", "expected_rule_rate")})


@check("sc_8_labels", with_views("""
 SELECT toxic, CAST(count(*) AS BIGINT) AS n_texts, round(avg(CASE WHEN risk_level <> 'safe' THEN 1.0 ELSE 0.0 END), 6) AS flagged_rate
 FROM labels l JOIN v_score s ON s.item_id = 'doc:' || l.doc_id GROUP BY toxic""", V_TEXT, SCORES))
def sc_8_labels(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(
        F.concat(F.lit("doc:"), "doc_id").alias("item_id"), "toxic")
    scored = _texts(spark, sf).select("item_id", "risk_level", "detections").join(labels, "item_id")
    return detection_quality(scored, "toxic").select("toxic", "n_texts", F.round("flagged_rate", 6).alias("flagged_rate"))


# ---- actions ----------------------------------------------------------------

# Overlapping detections are one stretch, named after its first; pieces of text between stretches are put together.
_REDACTED = """v_span AS MATERIALIZED (
 SELECT item_id, start_at, start_at + n_chars AS end_at, pos, rule_id,
  coalesce(max(start_at + n_chars) OVER (PARTITION BY item_id ORDER BY start_at, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach
 FROM v_kept WHERE n_chars > 0),
v_red AS MATERIALIZED (
 SELECT s.item_id, coalesce(string_agg(CASE WHEN d.start_at >= d.reach THEN s.text[CAST(d.reach + 1 AS BIGINT):CAST(d.start_at AS BIGINT)] || '[REDACTED:' || d.rule_id || ']' ELSE '' END, '' ORDER BY d.start_at, d.pos), '')
  || any_value(s.text)[CAST(coalesce(max(d.end_at), 0) + 1 AS BIGINT):] AS redacted
 FROM v_src s JOIN v_score c USING (item_id) LEFT JOIN v_span d USING (item_id) WHERE c.action = 'redact' GROUP BY s.item_id)"""


@check("ac_1_redacted", with_views("SELECT item_id, redacted FROM v_red", V_TEXT, SCORES, _REDACTED))
def ac_1(spark, sf):
    return _texts(spark, sf).where("action = 'redact'").select("item_id", F.col("sanitized").alias("redacted"))


_BLOCKED = "'[Content blocked: ' || n || ' threat(s) detected. Review the quarantine entry to inspect.]'"


@check("ac_2_blocked", with_views(f"""
 SELECT item_id, {_BLOCKED} AS message FROM v_score JOIN (SELECT item_id, count(*) AS n FROM v_kept GROUP BY item_id) USING (item_id)
 WHERE action = 'block'""", V_TEXT, SCORES))
def ac_2(spark, sf):
    return _texts(spark, sf).where("action = 'block'").select("item_id", F.col("sanitized").alias("message"))


_SANITIZED = f"""v_fix AS MATERIALIZED (SELECT f.id, f.field_name, CASE f.field_action WHEN 'redact' THEN r.redacted WHEN 'block' THEN {_BLOCKED} END AS fixed
 FROM v_field f LEFT JOIN v_red r ON r.item_id = f.id || '#' || f.field_name
 LEFT JOIN (SELECT item_id, count(*) AS n FROM v_kept GROUP BY item_id) k ON k.item_id = f.id || '#' || f.field_name
 WHERE f.field_action IN ('redact', 'block'))"""


@check("ac_3_sanitized_event", with_views("""
 SELECT e.id, coalesce(s.fixed, e.summary) AS summary, sha256(coalesce(d.fixed, e.description)) AS description_hash, coalesce(l.fixed, e.location) AS location
 FROM v_events e LEFT JOIN v_fix s ON s.id = e.id AND s.field_name = 'summary' LEFT JOIN v_fix d ON d.id = e.id AND d.field_name = 'description'
 LEFT JOIN v_fix l ON l.id = e.id AND l.field_name = 'location'""", *EVENTS_SQL, _REDACTED, _SANITIZED))
def ac_3(spark, sf):
    events, results = _events(spark, sf)
    return actions.sanitized_events(events, results).select(
        "id", "summary", F.sha2("description", 256).alias("description_hash"), "location")


_NOTICE = """v_notice AS MATERIALIZED (SELECT id, calendar_id, id || ': ' || risk_level || ' (' || printf('%.2f', risk_score) || '), ' || action || chr(10)
 || CASE WHEN is_external THEN '  sent from outside: ' || coalesce(organizer_email, 'unknown') || chr(10) ELSE '' END
 || coalesce(tops || chr(10), '')
 || CASE action WHEN 'redact' THEN '  text: risky passages were cut out' || chr(10)
  WHEN 'block' THEN '  text: withheld' || chr(10) || '  original: kept in quarantine' || chr(10) ELSE '' END AS notice
 FROM v_event LEFT JOIN (SELECT id, string_agg('  ' || rule_id || ' ' || rule_name || ', severity ' || printf('%.2f', severity), chr(10) ORDER BY rn) AS tops
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY severity DESC, field_no, pos) AS rn FROM v_found) WHERE rn <= 3 GROUP BY id) USING (id)
 WHERE risk_level <> 'safe')"""


@check("ac_4_event_notice", with_views("SELECT id, notice FROM v_notice", *EVENTS_SQL, _NOTICE))
def ac_4(spark, sf):
    _, results = _events(spark, sf)
    return actions.event_notices(results).select("id", "notice")


@check("ac_5_batch_notice", with_views(f"""
 SELECT calendar_id, 0 AS part, NULL AS part_order, 'Content warnings' || chr(10) || count(*) || ' event(s) with risky content' || chr(10) AS body
 FROM v_notice GROUP BY calendar_id
 UNION ALL SELECT calendar_id, 1, id, notice FROM v_notice
 UNION ALL SELECT DISTINCT calendar_id, 2, NULL, {quoted(chr(10).join(actions.NOTICE_FOOTER))} FROM v_notice""", *EVENTS_SQL, _NOTICE))
def ac_5(spark, sf):
    _, results = _events(spark, sf)
    return actions.batch_notice_parts(results, "calendar_id", "id")


# Quarantined twice: half of the entries are written again a day later.
_QUARANTINE = """v_quar AS MATERIALIZED (SELECT CASE WHEN v.calendar_id <> '' THEN regexp_replace(v.calendar_id, '[^a-zA-Z0-9_-]', '_', 'g') || '.' ELSE '' END || regexp_replace(v.id, '[^a-zA-Z0-9_-]', '_', 'g') AS entry_key, v.id AS event_id, v.calendar_id, v.organizer_email, v.risk_score, v.risk_level, v.action,
 e.summary, e.description, e.location, CAST(v.id AS BIGINT) % 2 AS odd,
 TIMESTAMP '2024-03-01 12:00:00' + to_days(CAST(CAST(v.id AS BIGINT) % 2 AS INTEGER)) AS quarantined_at,
 TIMESTAMP '2024-03-08 12:00:00' + to_days(CAST(CAST(v.id AS BIGINT) % 2 AS INTEGER)) AS expires_at,
 (SELECT count(*) FROM v_found d WHERE d.id = v.id) AS n
 FROM v_event v JOIN v_events e USING (id) WHERE v.action IN ('block', 'redact'))"""


def _entries(spark, sf):
    events, results = _events(spark, sf)
    first = actions.quarantine_rows(events, results, NOW)
    # The second writing comes from the same rows: as a branch of its own it would scan the texts again.
    times = F.when(F.col("event_id").cast("long") % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    written = first.withColumn("__days", F.explode(times)).withColumns({
        t: F.col(t) + F.col("__days") * F.expr("interval 1 day") for t in ("quarantined_at", "expires_at")})
    return actions.latest_entries(written.drop("__days"))


def _stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


_SQL_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


@check("snk_2_quarantine", with_views(f"""
 SELECT entry_key, event_id, calendar_id, round(risk_score, 6) AS risk_score, action, {_SQL_STAMP.format('quarantined_at')}, {_SQL_STAMP.format('expires_at')},
 CAST((summary <> '')::INT + (description <> '')::INT + coalesce((location <> '')::INT, 0) AS BIGINT) AS n_fields, summary, CAST(n AS BIGINT) AS n_detections FROM v_quar""",
    *EVENTS_SQL, _QUARANTINE))
def snk_2(spark, sf):
    return _entries(spark, sf).select(
        "entry_key", "event_id", "calendar_id", F.round("risk_score", 6).alias("risk_score"), "action", _stamp("quarantined_at"),
        _stamp("expires_at"), F.size("original_fields").cast("long").alias("n_fields"),
        F.try_element_at("original_fields", F.lit("summary")).alias("summary"), F.size("detections").cast("long").alias("n_detections"))


@check("ac_6_quarantine_list", with_views(f"""
 SELECT event_id, risk_level, {_SQL_STAMP.format('quarantined_at')} FROM v_quar WHERE expires_at >= TIMESTAMP '2024-03-09 12:00:00' AND risk_level = 'critical'""",
    *EVENTS_SQL, _QUARANTINE))
def ac_6(spark, sf):
    return actions.quarantine_list(_entries(spark, sf), LATER, "critical").select("event_id", "risk_level", _stamp("quarantined_at"))


@check("ac_7_quarantine_get", with_views(f"""
 SELECT event_id, risk_level, {_SQL_STAMP.format('expires_at')} FROM v_quar WHERE event_id = (SELECT min(id) FROM v_event WHERE action = 'block') AND expires_at >= TIMESTAMP '2024-03-01 12:00:00'""",
    *EVENTS_SQL, _QUARANTINE))
def ac_7(spark, sf):
    """The entry of the first blocked event (by id)."""
    entries = _entries(spark, sf)
    wanted = entries.where("action = 'block'").agg(F.min("event_id")).scalar()
    return actions.quarantine_get(entries, wanted, NOW).select("event_id", "risk_level", _stamp("expires_at"))


@check("ac_8_cleanup", with_views("""
 SELECT CASE WHEN expires_at < TIMESTAMP '2024-03-09 00:00:00' THEN 'expired' ELSE 'kept' END AS state, CAST(count(*) AS BIGINT) AS n
 FROM v_quar WHERE organizer_email IS NOT NULL GROUP BY 1""", *EVENTS_SQL, _QUARANTINE))
def ac_8(spark, sf):
    """Delete the entries of events without an organizer, then clean up expired ones."""
    entries = _entries(spark, sf)
    removed = v_events(spark, sf).where("organizer is null").select(F.col("id").alias("event_id"))
    kept, expired = actions.split_expired(actions.quarantine_without(entries, removed), datetime(2024, 3, 9))
    return kept.select(F.lit("kept").alias("state")).unionByName(
        expired.select(F.lit("expired").alias("state"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@check("ac_9_scan_report", with_views("""
 SELECT event_id, CAST(n AS BIGINT) AS detection_count, coalesce(lines, '') AS lines, CAST((SELECT count(*) FROM v_quar) AS BIGINT) AS total_quarantined
 FROM v_quar LEFT JOIN (SELECT id, string_agg('[' || rule_id || '] ' || rule_name || ' (' || field_name || ')', '; ' ORDER BY field_no, pos) AS lines FROM v_found GROUP BY id) d
 ON d.id = event_id""", *EVENTS_SQL, _QUARANTINE))
def ac_9(spark, sf):
    return actions.scan_report(_entries(spark, sf), NOW).select(
        "event_id", F.col("detection_count").cast("long").alias("detection_count"), F.array_join("detection_lines", "; ").alias("lines"),
        "total_quarantined")


@check("ac_10_review_view", with_views(r"""
 SELECT event_id, 'event = ' || event_id || chr(10) || 'calendar = ' || coalesce(nullif(calendar_id, ''), '-') || chr(10) || 'from = ' || coalesce(organizer_email, '-') || chr(10)
 || 'held since = ' || strftime(quarantined_at, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'held until = ' || strftime(expires_at, '%Y-%m-%dT%H:%M:%SZ') || chr(10)
 || 'risk = ' || risk_level || ' ' || printf('%.2f', risk_score) || ' ' || action || coalesce(chr(10) || lines, '')
 || list_aggregate(list_transform(flatten([CASE WHEN coalesce(x, '') <> '' THEN string_split(x, chr(10)) ELSE [] END for x in [summary, description, location]]), lambda y: chr(10) || ' > ' || y), 'string_agg', '') AS review_text
 FROM v_quar LEFT JOIN (SELECT id, string_agg('found ' || rule_id || ' in ' || field_name || ', severity ' || printf('%.2f', severity), chr(10) ORDER BY field_no, pos) AS lines
  FROM v_found GROUP BY id) d ON d.id = event_id""", *EVENTS_SQL, _QUARANTINE))
def ac_10(spark, sf):
    return actions.review_view(_entries(spark, sf))


@check("snk_1_audit", with_views("""
 SELECT '2024-03-01' AS date, id AS event_id, calendar_id, is_external, round(risk_score, 6) AS risk_score, action, CAST(field_count AS BIGINT) AS field_count,
 coalesce(n, 0) AS n_detections FROM v_event LEFT JOIN (SELECT id, CAST(count(*) AS BIGINT) AS n FROM v_found GROUP BY id) USING (id)""", *EVENTS_SQL))
def snk_1(spark, sf):
    _, results = _events(spark, sf)
    audit = actions.audit_rows(results, F.lit(NOW).cast("timestamp"))
    return audit.select(
        F.col("date").cast("string").alias("date"), "event_id", "calendar_id", "is_external", F.round("risk_score", 6).alias("risk_score"),
        "action", "field_count", F.size("detections").cast("long").alias("n_detections"))


_SUMMARY = """
 SELECT CAST(DATE '2024-03-01' + CAST(CAST(v.id AS BIGINT) % 3 AS INTEGER) AS VARCHAR) AS date, action, risk_level, coalesce(rule_id, '') AS rule_id, CAST(count(*) AS BIGINT) AS n
 FROM v_event v LEFT JOIN v_found d USING (id) GROUP BY ALL"""


@check("ac_11_audit_summary", with_views(_SUMMARY, *EVENTS_SQL))
def ac_11(spark, sf):
    _, results = _events(spark, sf)
    at = F.lit(NOW).cast("timestamp") + F.make_dt_interval((F.col("id").cast("long") % 3).cast("int"))
    return actions.audit_summary(actions.audit_rows(results, at)).withColumn("date", F.col("date").cast("string"))


@check("src_5_fields", with_views("""
 SELECT calendar_id, id, field_name, field_type, CAST(field_no AS BIGINT) AS field_no, is_external, sha256(content) AS content_hash FROM v_fields""", V_EVENTS))
def src_5(spark, sf):
    return explode_fields(v_events(spark, sf), OWNER_DOMAIN).select(
        "calendar_id", "id", "field_name", "field_type", F.col("field_no").cast("long").alias("field_no"), "is_external",
        F.sha2("content", 256).alias("content_hash"))


@check("ex_2_thresholds", with_views("""
 SELECT item_id, CASE WHEN risk_score >= 0.5 THEN 'critical' WHEN risk_score >= 0.3 THEN 'dangerous' WHEN risk_score >= 0.1 THEN 'suspicious' ELSE 'safe' END AS risk_level
 FROM (SELECT item_id, CASE WHEN st > 0 AND ct > 0 THEN least((st * 0.3::DOUBLE + ct * 0.6::DOUBLE) * 1.15::DOUBLE, 1.0::DOUBLE) ELSE st * 0.3::DOUBLE + ct * 0.6::DOUBLE END AS risk_score FROM v_score)""",
    V_TEXT, SCORES))
def ex_2(spark, sf):
    config = ScanConfig(
        thresholds={"suspicious": 0.1, "dangerous": 0.3, "critical": 0.5},
        weights={"structural": 0.3, "contextual": 0.6, "threat-intel": 0.1})
    return _texts(spark, sf, config).select("item_id", "risk_level")
