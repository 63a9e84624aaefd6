"""Threat sessions under late, bridging and idle reports, and the tables kept by key."""

import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import threats
from riskloom.sources import keyed
from riskloom.streaming import jobs
from riskloom.streaming.sessions import merged

BASE = datetime(2024, 1, 1)
REPORT = (
    "report_id long, client_id string, content_hash string, structural_hash string, pattern_ids array<string>, "
    "risk_score double, organizer_domain string, reported_at timestamp")


def frame(spark, rows):
    """(id, hash letter, day) as reports that name one hash each twice; the second is dropped again by the caller."""
    return spark.createDataFrame(
        [(i, "c", h * 64, h * 64, ["CTX-001"], 0.9, f"d{i}.example", BASE + timedelta(days=day)) for i, h, day in rows], REPORT)


def updates(spark, rows):
    return threats.fan_out(frame(spark, rows)).dropDuplicates(["report_id"])


def entries(state):
    return {r.hash[0]: (r.report_count, (r.first_seen - BASE).days, (r.last_seen - BASE).days, r.organizer_domain) for r in state.collect()}


@pytest.mark.parametrize("batches, want", [
    ([[0, 20, 40], [5]], (4, 0, 40, "d2.example")), ([[0, 50], [25]], (3, 0, 50, "d1.example")),
    ([[0], [50], [100], [25], [75]], (5, 0, 100, "d2.example")), ([[0, 50], [10]], (1, 50, 50, "d1.example")),
    ([[40], [10]], (2, 10, 40, "d0.example")), ([[0], [31]], (1, 31, 31, "d1.example")), ([[0], [30]], (2, 0, 30, "d1.example"))])
def test_late_and_bridging_reports(spark, batches, want):
    state, i = None, 0
    for days in batches:
        state = threats.advance(updates(spark, [(i + k, "a", d) for k, d in enumerate(days)]), state, with_feed=False)
        i += len(days)
    assert entries(threats.threats_of(state)) == {"a": want}


def test_state_is_the_same_in_any_order(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("abc"), rng.randrange(400)) for i in range(60)]
    whole = threats.threats_of(threats.advance(updates(spark, rows)))
    state = None
    for part in range(3):
        state = threats.advance(updates(spark, [r for r in rows if r[0] % 3 == part]), state)
    split = threats.threats_of(state)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect()))


def test_idle_sessions_leave_the_state(spark):
    state = threats.advance(updates(spark, [(0, "a", 0), (1, "b", 60)]), idle_before=BASE + timedelta(days=31))
    assert set(entries(threats.threats_of(state))) == {"b"}


def test_merging_intervals_is_associative():
    rng = random.Random(4)
    day = 86_400_000_000
    rows = [{
        "report_count": 1, "first_seen": (t := rng.randrange(300) * day), "last_seen": t, "last_id": i, "last_risk": 0.5,
        "domain_at": t if i % 2 else None, "domain_id": i if i % 2 else None, "domain": f"d{i}" if i % 2 else None,
        "pattern_ids": [f"P{i % 4}"]} for i in range(40)]
    want = merged(rows)
    assert merged(merged(rows[:15]) + merged(rows[15:])) == want and merged(rows[::-1]) == want
    assert all(b["first_seen"] - a["last_seen"] > 30 * day for a, b in zip(want, want[1:], strict=False))


@pytest.fixture
def folder(spark):
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_work/{uuid.uuid4().hex}"


def arrivals(spark, folder, batches):
    """One micro-batch per list of reports."""
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(frame(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_stream_takes_late_reports_and_drops_idle_hashes(spark, folder):
    batches = [[(0, "a", 0), (1, "a", 20), (2, "a", 40), (3, "b", 0)], [(4, "a", 5), (5, "b", 50)], [(6, "b", 25), (7, "c", 90)]]
    jobs.threat_state(arrivals(spark, folder, batches), f"{folder}/state", f"{folder}/cp", lateness="60 days").awaitTermination()
    # content and structural hash are the same here, so every report counts twice
    assert {k: v[:3] for k, v in entries(jobs.read_threats(spark, f"{folder}/state")).items()} == {
        "a": (8, 0, 40), "b": (6, 0, 50), "c": (2, 90, 90)}
    later = arrivals(spark, folder, [[(8, "c", 160)], [(9, "c", 161)]])
    jobs.threat_state(later, f"{folder}/state", f"{folder}/cp", lateness="60 days").awaitTermination()
    assert {k: v[:3] for k, v in entries(jobs.read_threats(spark, f"{folder}/state")).items()} == {"c": (4, 160, 161)}


SCHEMA = "k string, v long"


def rows_of(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_table_by_key(spark, folder):
    put = lambda rows, n: keyed.write_delta(spark.createDataFrame(rows, SCHEMA), folder, n, "k")
    read = lambda **o: rows_of(keyed.read_current(spark, folder, SCHEMA, "k", **o))
    assert read() == [] and keyed.compact(spark, folder, SCHEMA, "k") is None
    put([("a", 1), ("b", 1), ("b", 2), ("c", 1)], 0)
    put([("b", 3)], 1)
    put([("b", 3)], 1)  # replayed
    gone = spark.createDataFrame([("c", None, True)], SCHEMA + ", gone boolean")
    keyed.write_delta(gone, folder, 2, "k")
    want = [("a", 1), ("b", 3)]
    assert read() == want and read(below=1) == [("a", 1), ("b", 1), ("b", 2), ("c", 1)]
    assert read(keys=spark.createDataFrame([("b",), ("zz",)], "k string")) == [("b", 3)]
    assert keyed.compact(spark, folder, SCHEMA, "k") == 2 and read() == want
    assert keyed.folders(spark, folder) == {"base": [2], "delta": []}
    put([("c", 9)], 3)
    assert read() == [*want, ("c", 9)]


def test_a_batch_writes_its_own_keys_only(spark, folder):
    many = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    keyed.write_delta(many, folder, 0, "k")
    keyed.write_delta(many.where("v < 10"), folder, 1, "k")
    assert spark.read.parquet(f"{folder}/delta=1").count() == 10
    assert keyed.read_current(spark, folder, SCHEMA, "k").count() == 5000
