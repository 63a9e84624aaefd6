"""Overlap counts from ranks equal the summary over all pairs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskloom.operators import conflicts as cf
from riskloom.operators.changes import apply_changes
from riskloom.operators.overlap_counts import alike_titles, check_counts

SCHEMA = "calendar_id string, event_id string, summary string, start_ts timestamp, end_ts timestamp, is_all_day boolean, status string"
BASE = datetime(2024, 3, 1)
TITLES = [None, "", " ", "a", "Team sync", "team SYNC ", "sync", "Weekly planning meeting", "planning", "Meeting notes", "ab", "b", "über plan", "plan"]


def rows(rng, n, ids):
    out = []
    for k in range(n):
        start = BASE + timedelta(minutes=15 * rng.randrange(300))
        length = rng.choice([0, 15, 30, 30, 60, 600, 6000])
        out.append((rng.choice("xyz"), f"e{ids(k)}", rng.choice(TITLES), start, start + timedelta(minutes=length),
                    rng.random() < 0.3, rng.choice(["confirmed", "cancelled", None])))
    return out


def shown(df):
    return sorted(tuple(r[c] for c in ("event_id", "n_conflicts", "n_duplicates", "max_similarity", "warnings")) for r in df.collect())


def test_counts_equal_the_pairs(spark):
    rng = random.Random(9)
    existing = rows(rng, 250, lambda k: k % 200)
    new = rows(rng, 120, lambda k: 150 + k % 100)
    given, asked = spark.createDataFrame(existing, SCHEMA), spark.createDataFrame(new, SCHEMA)
    want = shown(cf.check_summary(cf.conflict_pairs_with(asked, given)))
    assert len(want) > 60 and shown(check_counts(asked, given)) == want
    assert shown(check_counts(given, given)) == shown(cf.check_summary(cf.conflict_pairs_with(given, given)))


def test_a_crowded_slot(spark):
    """All events in one slot: every count is that of all others, and nothing is formed per pair."""
    n = 20_000
    crowd = spark.range(n).select(
        F.lit("x").alias("calendar_id"), F.concat(F.lit("e"), "id").alias("event_id"), F.lit("Same title").alias("summary"),
        F.lit(BASE).alias("start_ts"), F.lit(BASE + timedelta(hours=1)).alias("end_ts"), F.lit(False).alias("is_all_day"),
        F.lit("confirmed").alias("status"))
    found = check_counts(crowd, crowd)
    assert found.groupBy("n_conflicts", "n_duplicates", "max_similarity").count().collect() == [(n - 1, n - 1, 0.95, n)]


def test_nothing_overlaps_an_empty_calendar(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("x", "e", "t", BASE, BASE + timedelta(hours=1), False, None)], SCHEMA)
    backwards = spark.createDataFrame([("x", "f", "t", BASE + timedelta(hours=1), BASE, False, None)], SCHEMA)
    assert check_counts(one, none).collect() == [] == check_counts(none, one).collect() == check_counts(one, backwards).collect()


def test_alike_titles_against_all_pairs(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "go", "x", "planning", "plan", "übung"]
    titles = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(60)} | {"", "p", "pl", "alph"})
    table = spark.createDataFrame([(1, f"={t}") for t in titles] + [(1, "")], "k int, title string")
    got = {(r.title[1:], r.other[1:]) for r in alike_titles(table, table, ["k"]).collect()}

    def alike(a, b):
        wa, wb = ([w for w in t.split() if len(w) > 3] for t in (a, b))
        fewer = min(len(wa), len(wb))
        return a in b or b in a or (fewer > 0 and 2 * sum(w in wb for w in wa) >= fewer)

    # the shared words are counted from the first title's side, as in the comparison of two events
    assert got == {(a, b) for a in titles for b in titles if a != b and alike(a, b)}


def test_stretches_only_of_lengths_that_beginnings_have(spark):
    """Titles are cut into stretches of the lengths found beside them, and short or empty titles are still met."""
    new = spark.createDataFrame([(1, f"={t}") for t in ("order 123456", "xweekly planningx", "a b")], "k int, title string")
    for others, want in (
            (["weekly planning"], {("xweekly planningx", "weekly planning")}),
            (["weekly planning", "1", "pla", ""], {
                ("xweekly planningx", "weekly planning"), ("order 123456", "1"), ("xweekly planningx", "pla"),
                *((t, "") for t in ("order 123456", "xweekly planningx", "a b"))})):
        found = alike_titles(new, spark.createDataFrame([(1, f"={t}") for t in others], "k int, title string"), ["k"])
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_set") == 2
        assert {(r.title[1:], r.other[1:]) for r in found.collect()} == want


def test_small_and_crowded_calendars_equal_the_pairs(spark):
    """Most calendars hold few rows, one holds a fifth of them: both ways of counting give what the pairs give."""
    rng = random.Random(5)

    def spread(given):
        return [(rng.choice(["x", None, *(f"c{k}" for k in range(200))] + ["x"] * 50), *row[1:]) for row in given]

    existing = spread(rows(rng, 2500, lambda k: k % 2000))
    new = spread(rows(rng, 1200, lambda k: 1500 + k % 1000))
    given, asked = spark.createDataFrame(existing, SCHEMA), spark.createDataFrame(new, SCHEMA)
    for one, two in ((asked, given), (given, given)):
        want = shown(cf.check_summary(cf.conflict_pairs_with(one, two)))
        assert len(want) > 400 and {w[3] for w in want} >= {0.95, 0.7, 0.2, 0.1}
        assert shown(check_counts(one, two)) == want


def test_a_batch_of_changes_in_small_calendars(spark):
    """Inserts are refused as the pairs say, and no hours are folded for calendars that hold few rows."""
    rng = random.Random(11)
    titles = ["Weekly planning", "Budget", "Order 7", None]

    def made(n, sign):
        start = lambda: BASE + timedelta(minutes=15 * rng.randrange(40))
        return [(f"c{rng.randrange(200)}", f"{sign}{k}", rng.choice(titles), s, s + timedelta(hours=1), False, "confirmed")
                for k, s in ((k, start()) for k in range(n))]

    events, new = spark.createDataFrame(made(1500, "e"), SCHEMA), spark.createDataFrame(made(900, "n"), SCHEMA)
    inserts = new.withColumn("allow_duplicates", F.col("event_id").endswith("3"))
    patches = events.select("calendar_id", "event_id", F.lit(1).alias("change_no"), F.lit("patched").alias("summary")).where("event_id LIKE '%1'")
    gone = events.where("event_id LIKE '%2'")
    found = apply_changes(events, inserts, patches, gone).select("event_id", "summary")
    rows_found = sorted(found.collect(), key=lambda r: r.event_id)
    refused = {r.event_id for r in cf.duplicates(cf.conflict_pairs_with(new, events), cf.BLOCK_SIMILARITY).collect()}
    want = {r.event_id: "patched" if r.event_id.endswith("1") else r.summary for r in events.collect() if not r.event_id.endswith("2")}
    want |= {r.event_id: r.summary for r in new.collect() if r.event_id not in refused or r.event_id.endswith("3")}
    assert 50 < len(refused) < 900 and [(r.event_id, r.summary) for r in rows_found] == sorted(want.items())
    assert "hour#" not in found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_small_calendars_are_shuffled_once_for_their_ranks(spark):
    """Of 300 equal calendars none is crowded: no hours are folded, and every running sum reads one shuffle."""
    k = F.col("id")
    at = lambda minutes: F.timestamp_seconds(F.lit(1_709_251_200) + 60 * (k % 2000 + minutes))
    events = spark.range(6000).select(
        F.concat(F.lit("c"), k % 300).alias("calendar_id"), F.concat(F.lit("e"), k).alias("event_id"),
        F.when(k % 2 == 0, "Weekly planning").otherwise("weekly planning session").alias("summary"), at(0).alias("start_ts"),
        at(400).alias("end_ts"), (k % 7 == 0).alias("is_all_day"), F.lit("confirmed").alias("status"))
    found = check_counts(events, events)
    assert len(found.collect()) == 6000
    done = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert done.count("Window [") == 2 and "hour#" not in done
    assert done.count("REPARTITION_BY_COL") == 1
