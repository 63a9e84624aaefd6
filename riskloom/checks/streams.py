"""Registered queries of the streaming jobs: each runs over a table as a stream, to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.checks import SQL, check
from riskloom.checks.scan import _QUARANTINE, _SUMMARY, EVENTS_SQL, NOW, _events
from riskloom.checks.threats import _ENTRY, _REPLAY, _THREATS, AS_OF, _shown
from riskloom.checks.views import OWNER_DOMAIN, V_REPORTS, events_of, reports_of, v_events, v_reports, with_views
from riskloom.operators import actions, threats
from riskloom.operators.fingerprints import content_hash
from riskloom.sources.tables import latest_version, read_version
from riskloom.streaming import jobs


def work_folder(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder, or in the warehouse where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def streamed(rows: DataFrame, *parts) -> DataFrame:
    """The rows as a stream of one micro-batch per part, in the order of arrival.

    A part is a condition; rows that meet none of them, nulls too, are the last part.
    Each part is written by all tasks and read as one micro-batch: parts are dealt
    over equally many files, which is the number of files a micro-batch takes.
    """
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession)
    files, taken = max(1, spark.sparkContext.defaultParallelism), F.lit(False)
    for part in [*parts, F.lit(True)]:
        here = F.coalesce(part, F.lit(False)) & ~taken
        rows.where(here).repartition(files).write.option("maxRecordsPerFile", 0).mode("append").parquet(folder)
        taken = taken | F.coalesce(part, F.lit(False))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as three micro-batches: documents by id, events by time."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    if name == "events":
        day = F.dayofmonth("ts")
        return streamed(rows, day <= 10, day <= 20)
    return streamed(rows, *(F.col("doc_id") % 3 == k for k in range(2)))


def _audit_of(spark, sf, **options) -> DataFrame:
    folder = work_folder(spark)
    query = jobs.scan_to_audit(
        events_of(stream_of(spark, sf, "documents")), f"{folder}/audit", f"{folder}/checkpoint", lambda: NOW, OWNER_DOMAIN, **options)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/audit")


@check("st_1_scan_stream", SQL["snk_1_audit"])
def st_1(spark, sf):
    return _audit_of(spark, sf).select(
        F.col("date").cast("string").alias("date"), "event_id", "calendar_id", "is_external", F.round("risk_score", 6).alias("risk_score"),
        "action", "field_count", F.size("detections").cast("long").alias("n_detections"))


@check("st_2_threat_state", SQL["ti_6_threats"])
def st_2(spark, sf):
    """Time is stretched by hash here, up to centuries, so hashes never count as late or idle."""
    folder = work_folder(spark)
    jobs.threat_state(
        reports_of(stream_of(spark, sf, "events")), f"{folder}/state", f"{folder}/checkpoint", lateness="400000 days").awaitTermination()
    return _shown(jobs.read_threats(spark, f"{folder}/state"))


@check("st_2_late_reports", SQL["ti_6_threats"])
def st_2_late(spark, sf):
    """Reports arrive out of order: every third first, the rest in two batches by number."""
    folder = work_folder(spark)
    number = F.col("event_id")
    stream = streamed(spark.read.parquet(f"{sf}/events.parquet"), number % 3 == 1, number % 2 == 0)
    jobs.threat_state(reports_of(stream), f"{folder}/state", f"{folder}/checkpoint", lateness="400000 days").awaitTermination()
    return _shown(jobs.read_threats(spark, f"{folder}/state"))


@check("st_2_feed_state", SQL["ti_10_feed"])
def st_2_feed_state(spark, sf):
    folder = work_folder(spark)
    jobs.threat_feed_state(reports_of(stream_of(spark, sf, "events")), f"{folder}/state", f"{folder}/checkpoint").awaitTermination()
    return _shown(jobs.read_feed(spark, f"{folder}/state"))


@check("st_2_carried_state", with_views(f"SELECT {_ENTRY} FROM v_threats", V_REPORTS, _REPLAY, _THREATS))
def st_2_carried(spark, sf):
    """State after the early reports, carried on by the late ones, equals the state of all reports."""
    updates = threats.fan_out(threats.accepted(v_reports(spark, sf)))
    early = F.col("reported_at") < F.lit(AS_OF).cast("timestamp")
    state = threats.advance(updates.where(~early), prior=threats.advance(updates.where(early)))
    return _shown(threats.threats_of(state))


@check("st_2_carried_feed", SQL["ti_10_feed"])
def st_2_feed(spark, sf):
    updates = threats.fan_out(threats.accepted(v_reports(spark, sf)))
    early = F.col("reported_at") < F.lit(AS_OF).cast("timestamp")
    state = threats.advance(updates.where(~early), prior=threats.advance(updates.where(early)))
    return _shown(threats.feed_of(state))


@check("st_3_refreshed_feed", """
 SELECT CAST(doc_id AS VARCHAR) AS event_id, true AS known FROM documents WHERE doc_id % 6 = 0""")
def st_3(spark, sf):
    """A stream scanned against a feed that lists some attachment titles; the feed is read per batch."""
    def feed():
        titles = v_events(spark, sf).where("attachments is not null").select(F.col("attachments")[0]["title"].alias("t"))
        return titles.select(
            content_hash(F.col("t")).alias("hash"), F.lit(0.9).alias("confidence"), F.lit(3).alias("report_count"),
            F.lit(NOW).cast("timestamp").alias("last_seen"), F.lit("planted").alias("category"), F.lit(NOW).cast("timestamp").alias("expires_at"))

    audit = _audit_of(spark, sf, load_threats=feed)
    hit = F.exists("detections", lambda d: (d["rule_id"] == "THREAT-001") & (d["field_name"] == "attachments[0].title"))
    return audit.where(hit).select("event_id", F.lit(True).alias("known"))


@check("st_4_quarantine", with_views(
    "SELECT entry_key, event_id, action, '2024-03-08 12:00:00' AS expires_at FROM v_quar", *EVENTS_SQL, _QUARANTINE))
def st_4(spark, sf):
    folder = work_folder(spark)
    jobs.quarantine_upserts(
        events_of(stream_of(spark, sf, "documents")), f"{folder}/table", f"{folder}/checkpoint", lambda: NOW, OWNER_DOMAIN,
    ).awaitTermination()
    table = read_version(spark, f"{folder}/table", latest_version(spark, f"{folder}/table"))
    return table.select("entry_key", "event_id", "action", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@check("st_5_daily_counts", with_views(_SUMMARY, *EVENTS_SQL))
def st_5(spark, sf):
    """The audit table arrives in three micro-batches, each with rows of every day."""
    _, results = _events(spark, sf)
    number = F.col("event_id").cast("long")
    at = F.lit(NOW).cast("timestamp") + F.make_dt_interval((F.col("id").cast("long") % 3).cast("int"))
    folder = work_folder(spark)
    stream = streamed(actions.audit_rows(results, at), *(number % 5 % 3 == k for k in range(2)))
    jobs.daily_totals(stream, f"{folder}/totals", f"{folder}/checkpoint").awaitTermination()
    totals = read_version(spark, f"{folder}/totals", latest_version(spark, f"{folder}/totals"))
    return totals.withColumn("date", F.col("date").cast("string"))
