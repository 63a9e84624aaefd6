"""Continuous forms of the batch operators as Structured Streaming jobs.

Each job computes with the batch functions inside ``foreachBatch`` and writes
under the batch id, so a batch that is run again after a failure replaces its
own output.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.config import ScanConfig
from riskloom.operators import actions, threats
from riskloom.plans.scan import scan_events
from riskloom.sources.keyed import read_current, write_delta
from riskloom.sources.tables import latest_version, read_version, write_version
from riskloom.streaming.sessions import FACTS_SCHEMA, sessions_of

Clock = Callable[[], datetime]
_ENTRY = "entry_key"
_FACTS = ", ".join(c.replace(" ", ":", 1) for c in FACTS_SCHEMA.split(", "))


def _start(stream: DataFrame, handle, checkpoint: str, trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def scan_to_audit(
    events: DataFrame, out: str, checkpoint: str, now: Clock, owner_domain: str | None = None,
    config: ScanConfig = ScanConfig(), load_threats: Callable[[], DataFrame] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Scan arriving events and append audit rows.

    ``load_threats`` is called for every batch, so a feed table that was
    refreshed meanwhile is used at once; expired entries are left out.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        at = now()
        known = load_threats() if load_threats is not None else None
        results = scan_events(batch, owner_domain, config, threats=known, as_of=at)
        _put(actions.audit_rows(results, F.lit(at).cast("timestamp")), out, batch_id)

    return _start(events, handle, checkpoint, trigger or {"availableNow": True})


_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_SCHEMA = f"hash string, facts struct<{_FACTS}>, admitted struct<{_FACTS}>"
ENTRY_SCHEMA = f"hash string, facts struct<{_FACTS}>"


def threat_state(
    reports: DataFrame, state: str, checkpoint: str, trigger: dict | None = None, lateness: str = "90 days"
) -> StreamingQuery:
    """Keep the last session of every hash as a table by key, from keyed stream state with timers.

    Reports may arrive up to ``lateness`` behind the latest one; a hash idle for 30
    days beyond that leaves the state and the table.
    """
    spark = reports.sparkSession
    rows = sessions_of(threats.fan_out(threats.accepted(reports)), lateness)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # A hash can change and then expire within one batch: the expiry is the later of the two.
        last = batch.groupBy("hash").agg(F.max_by(F.struct("facts", "gone"), F.col("gone")).alias("r"))
        write_delta(last.select("hash", "r.facts", "r.gone"), state, batch_id, "hash")

    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKS)
    try:
        started = rows.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint)
        return started.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_STATE_STORE, before)


def read_threats(spark: SparkSession, state: str) -> DataFrame:
    """The entries of the table that :func:`threat_state` keeps."""
    rows = read_current(spark, state, ENTRY_SCHEMA, "hash")
    return threats.threats_of(rows.withColumn("admitted", F.lit(None).cast(f"struct<{_FACTS}>")))


def threat_feed_state(
    reports: DataFrame, state: str, checkpoint: str, trigger: dict | None = None, salt: int = 8
) -> StreamingQuery:
    """Keep sessions and feed snapshots per hash as a table by key; a batch reads and writes its own hashes only."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        # Read several times below; persisted rows are recomputed from the source if an executor is lost.
        updates = threats.fan_out(threats.accepted(batch)).persist()
        try:
            prior = read_current(batch.sparkSession, state, STATE_SCHEMA, "hash", below=batch_id, keys=updates)
            write_delta(threats.advance(updates, prior, salt), state, batch_id, "hash")
        finally:
            updates.unpersist()

    return _start(reports, handle, checkpoint, trigger or {"availableNow": True})


def read_feed(spark: SparkSession, state: str, as_of: datetime | None = None) -> DataFrame:
    """The feed of the table that :func:`threat_feed_state` keeps."""
    return threats.feed_of(read_current(spark, state, STATE_SCHEMA, "hash"), as_of)


def quarantine_upserts(
    events: DataFrame, table: str, checkpoint: str, now: Clock, owner_domain: str | None = None,
    config: ScanConfig = ScanConfig(), ttl_days: int = 7, trigger: dict | None = None,
) -> StreamingQuery:
    """Upsert quarantine entries by key and drop the expired ones, one table version per batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, at = batch.sparkSession, now()
        fresh = actions.quarantine_rows(batch, scan_events(batch, owner_domain, config), at, ttl_days)
        before = latest_version(spark, table, below=batch_id)
        every = fresh if before is None else read_version(spark, table, before).unionByName(fresh)
        kept, _ = actions.split_expired(actions.latest_entries(every), at)
        write_version(kept, table, batch_id)

    return _start(events, handle, checkpoint, trigger or {"availableNow": True})


def daily_totals(audit: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the daily counts of a growing audit table, one table version per batch.

    The state holds one number per (day, action, level, rule), however many rows arrive.
    """
    started = daily_counts(audit).writeStream.outputMode("complete").foreachBatch(
        lambda batch, batch_id: write_version(batch, table, batch_id))
    return started.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_counts(audit: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Streaming counts per UTC day, action, level and rule."""
    opened = audit.withWatermark("ts", watermark).select(
        "ts", "action", "risk_level", F.explode_outer("detections").alias("d")
    )
    return opened.groupBy(
        F.window("ts", "1 day").alias("w"), "action", "risk_level", F.coalesce("d.rule_id", F.lit("")).alias("rule_id")
    ).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("date"), "action", "risk_level", "rule_id", "n")
