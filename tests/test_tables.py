"""Joins, merges, threats and calendar functions against brute force and literals."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.functions import times as tm
from riskloom.operators import calendar_query as cq
from riskloom.operators import skew, threats
from riskloom.operators.intervals import merged, overlaps, self_overlaps
from riskloom.schemas import REPORT

BASE = datetime(2024, 1, 1)


def intervals(seed, n, hot=0.4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        key = "hot" if rng.random() < hot else f"k{rng.randrange(5)}"
        start = BASE + timedelta(minutes=rng.randrange(60 * 24 * 40))
        length = rng.choice([0, 15, 60, 600, 60 * 24, 60 * 24 * 9, 60 * 24 * 400])
        rows.append((key, i, start, start + timedelta(minutes=length)))
    return rows


@pytest.mark.parametrize("salt", [1, 16])
def test_overlaps_equal_brute_force(spark, salt):
    rows = intervals(3, 250)
    df = spark.createDataFrame(rows, "k string, id int, start_ts timestamp, end_ts timestamp")
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and b[2] < a[3])
    got = sorted((r[0], r[1]) for r in self_overlaps(df, ["k"], "id", salt).select("a.id", "b.id").collect())
    assert got == want
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    want = [p for p in want if p[0] % 2 == 0 and p[1] % 2 == 1]
    got = sorted((r[0], r[1]) for r in overlaps(left, right, ["k"], salt).select("a.id", "b.id").collect())
    assert got == want


def test_merged_equals_brute_force(spark):
    rows = [r for r in intervals(5, 120) if r[3] - r[2] < timedelta(days=20)]
    df = spark.createDataFrame(rows, "k string, id int, start_ts timestamp, end_ts timestamp")
    want = []
    for key in {r[0] for r in rows}:
        current = None
        for start, end in sorted((r[2], r[3]) for r in rows if r[0] == key and r[3] > r[2]):
            if current and start <= current[1]:
                current[1] = max(current[1], end)
            else:
                current = [start, end]
                want.append((key, current))
    got = sorted((r.k, r.start_ts, r.end_ts) for r in merged(df, ["k"]).collect())
    assert got == sorted((k, s, e) for k, (s, e) in want)


def test_salted_lookup_equals_join(spark):
    big = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("3", 2)], "k string, v int")
    plain = sorted(map(tuple, big.join(small, "k", "left").select("id", "k", "v").collect()))
    salted = skew.salted_lookup(big, small, "k", F.col("id"), 8).select("id", "k", "v")
    assert sorted(map(tuple, salted.collect())) == plain
    assert [r.k for r in skew.hot_keys(big, ["k"], one_in=10).collect()] == ["hot"]


def _store(reports):
    """The store of threats replayed one report at a time."""
    state, feed = {}, {}
    for rid, h, pats, risk, domain, at in sorted(reports, key=lambda r: (r[5], r[0])):
        old = state.get(h)
        if old and at - old["last"] > timedelta(days=30):
            old = None
            feed.pop(h, None)
        n = old["n"] + 1 if old else 1
        entry = {
            "n": n, "first": old["first"] if old else at, "last": at, "conf": min(min(n * 0.1, 0.5) + risk * 0.5, 1.0),
            "pats": sorted(set(old["pats"] if old else []) | set(pats)), "domain": domain or (old["domain"] if old else None),
        }
        state[h] = entry
        if n >= 2 and entry["conf"] >= 0.6 - 1e-9:
            feed[h] = entry
    return state, feed


def test_threats_equal_the_replayed_store(spark):
    rng, rows = random.Random(11), []
    for i in range(400):
        h = ("a" if rng.random() < 0.5 else rng.choice("bcdef")) * 64
        at = BASE + timedelta(hours=rng.randrange(24 * 30 * (1 if h[0] == "a" else 20)))
        rows.append((i, h, [rng.choice(["CTX-001", "CTX-009", "STRUCT-001"])], rng.randrange(11) / 10, rng.choice([None, "x.example", "y.example"]), at))
    state, feed = _store(rows)
    reports = spark.createDataFrame(
        [(i, "client", h, h, p, r, d, at) for i, h, p, r, d, at in rows], REPORT)
    updates = threats.fan_out(reports).dropDuplicates(["report_id"])
    cut = BASE + timedelta(days=15)
    early = F.col("reported_at") < F.lit(cut)
    whole = threats.advance(updates)
    carried = threats.advance(updates.where(~early), threats.advance(updates.where(early)))
    for result in (whole, carried):
        for frame, want in ((threats.threats_of(result), state), (threats.feed_of(result), feed)):
            got = {r.hash: {
                "n": r.report_count, "first": r.first_seen, "last": r.last_seen, "conf": pytest.approx(r.confidence),
                "pats": r.pattern_ids, "domain": r.organizer_domain} for r in frame.collect()}
            assert got == want


def test_confidence_goldens(spark):
    row = spark.range(1).select(
        threats.confidence(F.lit(1), F.lit(0.9)), threats.confidence(F.lit(2), F.lit(0.9)), threats.confidence(F.lit(2), F.lit(0.5))
    ).first()
    assert list(row) == pytest.approx([0.55, 0.65, 0.45])


def test_feed_sync_waits_for_its_interval(spark):
    assert threats.sync_feed(spark.range(1), BASE, BASE - timedelta(minutes=5)) is None


def test_free_busy_range_is_bounded(spark):
    with pytest.raises(ValueError):
        cq.busy_slots(spark.range(1), BASE, BASE + timedelta(days=91))


def test_field_selection():
    assert cq.field_selection(None) is None
    assert cq.field_selection(["colorId"])[-1] == "colorId" and len(cq.field_selection(["colorId"])) == 11
    with pytest.raises(ValueError):
        cq.field_selection(["nope"])


def test_time_texts(spark):
    row = spark.sql("select timestamp'2024-07-01 12:00:00' t").select(
        tm.local_iso(F.col("t"), F.lit("America/New_York")), tm.is_dst(F.col("t"), F.lit("America/New_York")),
        tm.to_rfc3339(F.lit("2024-03-10T02:30:00"), F.lit("America/Los_Angeles")), tm.duration_text(F.lit(26 * 3_600_000)),
        tm.duration_text(F.lit(61_000)),
    ).first()
    assert list(row) == ["2024-07-01T08:00:00.000-04:00", True, "2024-03-10T10:30:00Z", "1 day 2 hours", "1 minute"]


def test_display_text(spark):
    df = spark.sql("""select 'e1' event_id, 'cal a' calendar_id, 'Trip' summary, cast(null as string) description, 'Rome' location,
        named_struct('dateTime', cast(null as string), 'date', '2024-03-01', 'timeZone', cast(null as string)) start,
        named_struct('dateTime', cast(null as string), 'date', '2024-03-04', 'timeZone', cast(null as string)) `end`,
        array(named_struct('email', 'a@x.example', 'displayName', 'Ann', 'responseStatus', 'needsAction')) attendees""")
    assert df.select(cq.display_text(df, "https://c.example/event")).first()[0] == (
        "Event: Trip\nEvent ID: e1\nStart Date: Fri, Mar 1, 2024\nEnd Date: Sun, Mar 3, 2024\nLocation: Rome\n"
        "Guests: Ann (pending)\nView: https://c.example/event?eid=e1&cid=cal%20a")


def test_sorted_by_start(spark):
    rows = [("b", "2024-01-02T10:00:00Z", None), ("a", None, "2024-01-02"), ("c", None, None), ("d", "2024-01-01T10:00:00Z", None)]
    df = spark.createDataFrame(rows, "event_id string, t string, d string").select(
        "event_id", F.struct(F.col("t").alias("dateTime"), F.col("d").alias("date")).alias("start"))
    assert [r.event_id for r in cq.sorted_by_start(df).collect()] == ["c", "d", "a", "b"]


def test_one_pass_plans(spark):
    """The text scan has no shuffle; the early-report window is pruned before its shuffle."""
    from riskloom.plans.scan import scan_texts

    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = scan_texts(texts).select("doc_id", "risk_score", "action")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    updates = spark.createDataFrame([], "report_id long, hash string, reported_at timestamp, risk_score double")
    plan = threats.early_reports(updates)._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan
