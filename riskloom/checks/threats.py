"""Registered queries of fingerprints, reports, threats, feed and lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from riskloom.checks import check
from riskloom.checks.rule_sql import SCORES, rx
from riskloom.checks.scalars import SQL_NORMALIZED
from riskloom.checks.scan import EVENTS_SQL, _events
from riskloom.checks.views import V_REPORTS, V_TEXT, v_reports, v_text, with_views
from riskloom.functions.text import BASE64_RUN, ZERO_WIDTH
from riskloom.operators import fingerprints as fp
from riskloom.operators import lookup, threats
from riskloom.plans.scan import scan_fields

AS_OF = datetime(2025, 6, 1)
_AS_OF_SQL = "TIMESTAMP '2025-06-01 00:00:00'"

_SHAPE = f"""v_shape AS MATERIALIZED (SELECT *, sha256(concat_ws('|', 'b64:' || b64, 'encoding:' || enc, 'html:' || html, 'len:' || len_bucket, 'lines:' || lines,
  'scripts:' || scripts, 'urls:' || urls, 'zwc:' || zwc)) AS structural_hash, sha256({SQL_NORMALIZED}) AS content_hash FROM (
 SELECT *, len(regexp_extract_all(text, '{BASE64_RUN}')) AS b64, len(regexp_extract_all(text, '%[0-9A-Fa-f]{{2}}')) AS enc,
  coalesce(nullif(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {rx(fp.TAG)}, 1), lambda x: lower(x)))), ','), ''), 'none') AS html,
  CASE WHEN length(text) < 100 THEN '0-100' WHEN length(text) < 500 THEN '100-500' WHEN length(text) < 2000 THEN '500-2000' WHEN length(text) < 10000 THEN '2000-10000' ELSE '10000+' END AS len_bucket,
  len(string_split(text, chr(10))) AS lines,
  {' + '.join(f"regexp_matches(text, {rx(p, True)})::INT" for p in fp.SCRIPT_FLAGS)} AS scripts,
  len(regexp_extract_all(text, {rx(fp.URL, True)})) AS urls, len(regexp_extract_all(text, '{ZERO_WIDTH}')) AS zwc FROM v_src))"""


@check("ti_1_content_hash", with_views("SELECT item_id, content_hash FROM v_shape", V_TEXT, _SHAPE))
def ti_1(spark, sf):
    return v_text(spark, sf).select("item_id", fp.content_hash(F.col("text")).alias("content_hash"))


@check("ti_2_shape", with_views("""
 SELECT item_id, CAST(b64 AS BIGINT) AS b64, CAST(enc AS BIGINT) AS encoding, html, len_bucket, CAST(lines AS BIGINT) AS lines,
 CAST(scripts AS BIGINT) AS scripts, CAST(urls AS BIGINT) AS urls, CAST(zwc AS BIGINT) AS zwc FROM v_shape""", V_TEXT, _SHAPE))
def ti_2(spark, sf):
    s = fp.shape(F.col("text"))
    return v_text(spark, sf).select(
        "item_id", s["html"].alias("html"), s["len"].alias("len_bucket"),
        *(s[k].cast("long").alias(k) for k in ("b64", "encoding", "lines", "scripts", "urls", "zwc")))


@check("ti_3_structural_hash", with_views("SELECT item_id, structural_hash FROM v_shape", V_TEXT, _SHAPE))
def ti_3(spark, sf):
    return v_text(spark, sf).select("item_id", fp.structural_hash(F.col("text")).alias("structural_hash"))


_COMBINED = """v_all AS MATERIALIZED (SELECT id, sha256(trim(regexp_replace(lower(t), {ws}, ' ', 'g'))) AS content_hash FROM (
 SELECT id, concat_ws(chr(10), nullif(summary, ''), nullif(description, ''), nullif(location, '')) AS t FROM v_events))""".format(ws=rx(r"\s+"))


@check("ti_4_fingerprint", with_views("""
 SELECT v.id, a.content_hash, round(v.risk_score, 6) AS risk_score, v.organizer_domain, coalesce(p.ids, '') AS pattern_ids FROM v_event v JOIN v_all a USING (id)
 LEFT JOIN (SELECT id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS ids FROM v_found GROUP BY id) p USING (id)""", *EVENTS_SQL, _COMBINED))
def ti_4(spark, sf):
    events, results = _events(spark, sf)
    return fp.event_fingerprints(events, results).select(
        "id", "content_hash", F.round("risk_score", 6).alias("risk_score"), "organizer_domain",
        F.array_join(F.array_sort("pattern_ids"), ",").alias("pattern_ids"))


@check("ti_16_reportable", with_views(
    "SELECT id, risk_level FROM v_event WHERE risk_level IN ('dangerous', 'critical')", *EVENTS_SQL))
def ti_16(spark, sf):
    events, results = _events(spark, sf)
    return fp.reportable(fp.event_fingerprints(events, results)).select("id", "risk_level")


@check("ti_17_duplicate_groups", with_views("""
 SELECT hash_type, hash, CAST(count(*) AS BIGINT) AS copies, min(item_id) AS first_key FROM (
 SELECT item_id, 'content' AS hash_type, content_hash AS hash FROM v_shape UNION ALL SELECT item_id, 'structural', structural_hash FROM v_shape)
 GROUP BY ALL""", V_TEXT, _SHAPE))
def ti_17(spark, sf):
    return fp.duplicate_groups(v_text(spark, sf), "text", "item_id")


_REASON = """CASE WHEN coalesce(client_id, '') = '' THEN 'Missing or invalid clientId' WHEN content_hash = '' OR structural_hash = '' THEN 'Missing fingerprint hashes'
 WHEN risk_score < 0 OR risk_score > 1 THEN 'Invalid riskScore (must be 0.0 - 1.0)'
 WHEN NOT regexp_matches(content_hash, '^[a-f0-9]{64}$') OR NOT regexp_matches(structural_hash, '^[a-f0-9]{64}$') THEN 'Invalid hash format (expected SHA-256 hex)' END"""


@check("snk_4_report_validation", with_views(f"SELECT report_id, {_REASON} AS reject_reason FROM v_reports", V_REPORTS))
def snk_4(spark, sf):
    reports = v_reports(spark, sf)
    return reports.select("report_id", threats.reject_reason(reports).alias("reject_reason"))


@check("snk_5_hash_format", with_views(
    "SELECT report_id, regexp_matches(content_hash, '^[a-f0-9]{64}$') AS valid FROM v_reports", V_REPORTS))
def snk_5(spark, sf):
    return v_reports(spark, sf).select("report_id", lookup.is_hash(F.col("content_hash")).alias("valid"))


# The store replayed row by row with window functions: sessions, running counts, snapshots.
_REPLAY = f"""v_upd AS MATERIALIZED (SELECT report_id, unnest([content_hash, structural_hash]) AS hash, pattern_ids, risk_score, organizer_domain, reported_at
 FROM v_reports WHERE {_REASON} IS NULL),
v_seq AS MATERIALIZED (SELECT *, sum(CASE WHEN gap > INTERVAL 30 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY hash ORDER BY reported_at, report_id) AS sess
 FROM (SELECT *, reported_at - lag(reported_at) OVER (PARTITION BY hash ORDER BY reported_at, report_id) AS gap FROM v_upd)),
v_live AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY reported_at, report_id) AS k FROM v_seq s
 WHERE sess = (SELECT max(sess) FROM v_seq t WHERE t.hash = s.hash)),
v_adm AS MATERIALIZED (SELECT hash, max(k) AS at_k FROM v_live WHERE k >= 2 AND least(least(k * 0.1, 0.5) + risk_score * 0.5, 1.0) >= 0.599999999 GROUP BY hash)"""


def _entry_sql(source: str, limit: str) -> str:
    return f"""SELECT hash, report_count, round(least(least(report_count * 0.1::DOUBLE, 0.5::DOUBLE) + risk * 0.5::DOUBLE, 1.0::DOUBLE), 6) AS confidence, first_seen, last_seen, domain AS organizer_domain, pats,
 CASE WHEN list_has_any(pats, ['CTX-001', 'CTX-005']) THEN 'prompt-injection' WHEN list_has_any(pats, ['CTX-003', 'CTX-008']) THEN 'code-execution'
  WHEN list_contains(pats, 'CTX-004') THEN 'tool-call-injection' WHEN list_contains(pats, 'CTX-009') THEN 'data-exfiltration'
  WHEN list_has_any(pats, ['STRUCT-003', 'STRUCT-004']) THEN 'xss-injection'
  WHEN c AND s THEN 'multi-vector' WHEN s THEN 'structural-attack' WHEN c THEN 'semantic-attack' ELSE 'unknown' END AS category
 FROM (SELECT *, len(list_filter(pats, lambda x: starts_with(x, 'CTX'))) > 0 AS c, len(list_filter(pats, lambda x: starts_with(x, 'STRUCT'))) > 0 AS s FROM (
 SELECT hash, CAST(count(*) AS BIGINT) AS report_count, arg_max(risk_score, k) AS risk, min(reported_at) AS first_seen, max(reported_at) AS last_seen,
  arg_max(organizer_domain, k) FILTER (WHERE organizer_domain IS NOT NULL) AS domain, list_sort(list_distinct(flatten(list(pattern_ids)))) AS pats
 FROM {source} {limit} GROUP BY hash))"""


_THREATS = f"v_threats AS MATERIALIZED ({_entry_sql('v_live', '')})"
_FEED = f"v_feed AS MATERIALIZED ({_entry_sql('v_live JOIN v_adm USING (hash)', 'WHERE k <= at_k')})"
_STAMPS = "strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen"
_ENTRY = f"hash, report_count, confidence, {_STAMPS}, organizer_domain, category, array_to_string(pats, ',') AS pattern_ids"


def _shown(df):
    return df.select(
        "hash", "report_count", F.round("confidence", 6).alias("confidence"),
        *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")),
        "organizer_domain", "category", F.array_join("pattern_ids", ",").alias("pattern_ids"))


def _threats(spark, sf):
    return threats.threat_table(threats.accepted(v_reports(spark, sf)))


def _feed(spark, sf, as_of=None):
    return threats.threat_feed(threats.accepted(v_reports(spark, sf)), as_of)


@check("ti_5_fan_out", with_views("SELECT hash, CAST(count(*) AS BIGINT) AS n FROM v_upd GROUP BY hash", V_REPORTS, _REPLAY))
def ti_5(spark, sf):
    return threats.fan_out(threats.accepted(v_reports(spark, sf))).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


@check("ti_6_threats", with_views(f"SELECT {_ENTRY} FROM v_threats", V_REPORTS, _REPLAY, _THREATS))
def ti_6(spark, sf):
    return _shown(_threats(spark, sf))


@check("ti_7_confidence", with_views(
    "SELECT report_id, round(least(least((report_id % 9) * 0.1::DOUBLE, 0.5::DOUBLE) + risk_score * 0.5::DOUBLE, 1.0::DOUBLE), 6) AS confidence FROM v_reports", V_REPORTS))
def ti_7(spark, sf):
    return v_reports(spark, sf).select(
        "report_id", F.round(threats.confidence(F.col("report_id") % 9, F.col("risk_score")), 6).alias("confidence"))


@check("ti_8_category", with_views(f"SELECT hash, category FROM ({_entry_sql('(SELECT *, report_id AS k, CAST(report_id AS VARCHAR) AS hash FROM v_reports)', '')})", V_REPORTS))
def ti_8(spark, sf):
    return v_reports(spark, sf).select(
        F.col("report_id").cast("string").alias("hash"), threats.category(F.col("pattern_ids")).alias("category"))


@check("ti_9_idle_expiry", with_views(f"""
 SELECT hash, strftime(last_seen + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS expires_at, last_seen + INTERVAL 30 DAY >= {_AS_OF_SQL} AS live FROM v_threats""", V_REPORTS, _REPLAY, _THREATS))
def ti_9(spark, sf):
    return _threats(spark, sf).select(
        "hash", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"),
        (F.col("expires_at") >= F.lit(AS_OF).cast("timestamp")).alias("live"))


@check("ti_10_feed", with_views(f"SELECT {_ENTRY} FROM v_feed", V_REPORTS, _REPLAY, _FEED))
def ti_10(spark, sf):
    return _shown(_feed(spark, sf))


@check("ti_11_feed_since", with_views(f"""
 SELECT hash, confidence, report_count, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS updated_at, category FROM v_feed WHERE last_seen > {_AS_OF_SQL}""", V_REPORTS, _REPLAY, _FEED))
def ti_11(spark, sf):
    return threats.feed_since(_feed(spark, sf), AS_OF).select(
        "hash", F.round("confidence", 6).alias("confidence"), "report_count",
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "category")


@check("ti_12_check", with_views("""
 SELECT user_id, t.hash IS NOT NULL AS known, coalesce(confidence, 0) AS confidence, coalesce(report_count, 0) AS report_count, category
 FROM (SELECT DISTINCT user_id, sha256('c' || (user_id % 60)) AS h FROM events) u LEFT JOIN v_threats t ON t.hash = u.h""", V_REPORTS, _REPLAY, _THREATS))
def ti_12(spark, sf):
    asked = spark.read.parquet(f"{sf}/events.parquet").select(
        "user_id", F.sha2(F.concat(F.lit("c"), F.col("user_id") % 60).cast("string"), 256).alias("hash")).distinct()
    return lookup.check(asked, _threats(spark, sf)).select(
        "user_id", "known", F.round("confidence", 6).alias("confidence"), "report_count", "category")


@check("snk_3_feed_import", with_views(f"""
 SELECT hash, true AS known, confidence, report_count, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, '2025-06-02 00:00:00' AS expires_at FROM v_feed""", V_REPORTS, _REPLAY, _FEED))
def snk_3(spark, sf):
    rows = threats.feed_since(_feed(spark, sf))
    return threats.import_feed(rows.unionByName(rows), AS_OF).select(
        "hash", "known", F.round("confidence", 6).alias("confidence"), "report_count",
        *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("last_seen", "expires_at")))


@check("ti_13_precedence", with_views(f"""
 SELECT r.report_id, CASE WHEN c.hash IS NOT NULL THEN 'content' WHEN s.hash IS NOT NULL THEN 'structural' ELSE 'none' END AS matched,
 coalesce(c.report_count, s.report_count) AS report_count
 FROM (SELECT report_id, structural_hash, CASE WHEN report_id % 3 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash FROM v_reports) r
 LEFT JOIN (SELECT * FROM v_threats WHERE last_seen + INTERVAL 30 DAY >= {_AS_OF_SQL} ) c ON c.hash = r.content_hash
 LEFT JOIN (SELECT * FROM v_threats WHERE last_seen + INTERVAL 30 DAY >= {_AS_OF_SQL} ) s ON s.hash = r.structural_hash""", V_REPORTS, _REPLAY, _THREATS))
def ti_13(spark, sf):
    """Every third report comes with a content hash that nobody knows, so its shape decides."""
    known = _threats(spark, sf)
    other = F.when(F.col("report_id") % 3 == 0, F.sha2("content_hash", 256)).otherwise(F.col("content_hash"))
    rows = v_reports(spark, sf).select("report_id", other.alias("content_hash"), "structural_hash")
    found = lookup.match_fingerprints(rows, known, AS_OF, 4, F.col("report_id"))
    by_content = found.join(
        lookup.unexpired(known, AS_OF).select(F.col("hash").alias("content_hash"), F.lit(True).alias("c")), "content_hash", "left")
    return by_content.select("report_id", F.when(F.col("c"), "content").when(
        F.col("hit").isNotNull(), "structural").otherwise("none").alias("matched"), F.col("hit.report_count").alias("report_count"))


@check("ti_14_prune", with_views(
    f"SELECT CAST(count(*) AS BIGINT) AS removed FROM v_threats WHERE last_seen + INTERVAL 30 DAY < {_AS_OF_SQL}", V_REPORTS, _REPLAY, _THREATS))
def ti_14(spark, sf):
    return lookup.expired_count(_threats(spark, sf), AS_OF)


@check("ti_15_feed_sync", with_views(f"""
 SELECT hash, report_count FROM v_feed WHERE last_seen > TIMESTAMP '2025-05-01 00:00:00'""", V_REPORTS, _REPLAY, _FEED))
def ti_15(spark, sf):
    rows, _ = threats.sync_feed(_feed(spark, sf), AS_OF, datetime(2025, 5, 1))
    return rows.select("hash", "report_count")


# Known threats for the scan: every fifth text by content, every ninth event description by shape.
def _planted_threats(spark, sf):
    texts = v_text(spark, sf).where(F.startswith("item_id", F.lit("doc:"))).withColumn(
        "n", F.split_part("item_id", F.lit(":"), F.lit(2)).cast("long"))
    by_content = texts.where("n % 5 = 0").select(fp.content_hash(F.col("text")).alias("hash"), "n")
    by_shape = texts.where("n % 9 = 0").select(fp.structural_hash(F.col("text")).alias("hash"), "n")
    merged = by_content.unionByName(by_shape).groupBy("hash").agg(F.max("n").alias("n"))
    return merged.select(
        "hash", ((F.col("n") % 50) / 100 + 0.5).alias("confidence"), (F.col("n") % 12).alias("report_count"),
        F.lit(AS_OF).cast("timestamp").alias("last_seen"), F.lit("planted").alias("category"),
        (F.lit(AS_OF).cast("timestamp") + F.make_dt_interval((F.col("n") % 3).cast("int") - 1)).alias("expires_at"))


_KNOWN = f"""v_known AS MATERIALIZED (SELECT hash, (n % 50) / 100.0::DOUBLE + 0.5 AS confidence, n % 12 AS report_count, n % 3 >= 1 AS live FROM (
 SELECT hash, max(n) AS n FROM (SELECT content_hash AS hash, CAST(split_part(item_id, ':', 2) AS BIGINT) AS n FROM v_shape WHERE item_id LIKE 'doc:%'
  AND CAST(split_part(item_id, ':', 2) AS BIGINT) % 5 = 0
 UNION ALL SELECT structural_hash, CAST(split_part(item_id, ':', 2) AS BIGINT) FROM v_shape WHERE item_id LIKE 'doc:%' AND CAST(split_part(item_id, ':', 2) AS BIGINT) % 9 = 0) GROUP BY hash)),
v_hit AS MATERIALIZED (SELECT s.item_id, coalesce(c.confidence, h.confidence) AS confidence, coalesce(c.report_count, h.report_count) AS report_count
 FROM v_shape s LEFT JOIN v_known c ON c.hash = s.content_hash AND c.live LEFT JOIN v_known h ON h.hash = s.structural_hash AND h.live)"""


@check("r_t001_known_hash", with_views("""
 SELECT item_id, round(least(confidence + least(report_count * 0.02::DOUBLE, 0.15::DOUBLE), 1.0::DOUBLE), 6) AS severity, round(confidence, 6) AS confidence, CAST(report_count AS VARCHAR) AS report_count,
 round(risk, 6) AS risk_score FROM (SELECT *, CASE WHEN firing >= 3 THEN least(two * 1.1::DOUBLE, 1.0::DOUBLE) ELSE two END AS risk FROM (
  SELECT *, CASE WHEN firing >= 2 THEN least(base * 1.15::DOUBLE, 1.0::DOUBLE) ELSE base END AS two FROM (
  SELECT *, st * 0.40::DOUBLE + ct * 0.45::DOUBLE + least(confidence + least(report_count * 0.02::DOUBLE, 0.15::DOUBLE), 1.0::DOUBLE) * 0.15::DOUBLE AS base,
   (st > 0)::INT + (ct > 0)::INT + 1 AS firing FROM v_hit JOIN v_score USING (item_id) WHERE confidence IS NOT NULL)))""", V_TEXT, SCORES, _SHAPE, _KNOWN))
def r_t001(spark, sf):
    scanned = scan_fields(v_text(spark, sf), content="text", threats=_planted_threats(spark, sf), as_of=AS_OF)
    hit = F.col("threat_intel")[0]
    return scanned.where(F.size("threat_intel") > 0).select(
        "item_id", F.round(hit["severity"], 6).alias("severity"), F.round(hit["confidence"], 6).alias("confidence"),
        hit["metadata"]["reportCount"].alias("report_count"), F.round("risk_score", 6).alias("risk_score"))
