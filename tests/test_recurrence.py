"""Recurrence rules on literal expectations."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators.recurrence import instances

SCHEMA = "event_id string, start_ts timestamp, end_ts timestamp, recurrence array<string>, zone string"


def starts(spark, rule, begin, low, high, place=None, **options):
    row = ("e", begin, begin.replace(minute=begin.minute + 30), rule, place)
    found = instances(spark.createDataFrame([row], SCHEMA), low, high, **options)
    return [(r["instance_start"], r["unexpanded"]) for r in found.orderBy("instance_start").collect()]


def test_three_weekdays_give_six_in_two_weeks(spark):
    got = starts(spark, ["RRULE:FREQ=WEEKLY;BYDAY=MO,WE,FR"], datetime(2024, 1, 1, 9), datetime(2024, 1, 1), datetime(2024, 1, 15))
    assert [t.day for t, _ in got] == [1, 3, 5, 8, 10, 12]


def test_local_time_stays_over_the_change_of_clocks(spark):
    got = starts(spark, ["RRULE:FREQ=DAILY"], datetime(2024, 3, 29, 8), datetime(2024, 3, 29), datetime(2024, 4, 2),
                 "Europe/Berlin", zone=F.col("zone"))
    assert [t.hour for t, _ in got] == [8, 8, 7, 7]


def test_excluded_dates_and_month_ends(spark):
    got = starts(spark, ["RRULE:FREQ=DAILY;COUNT=4", "EXDATE:20240102T090000Z,20240103T090000Z"],
                 datetime(2024, 1, 1, 9), datetime(2024, 1, 1), datetime(2024, 2, 1))
    assert [t.day for t, _ in got] == [1, 4]
    got = starts(spark, ["RRULE:FREQ=MONTHLY;BYMONTHDAY=-1"], datetime(2024, 1, 31, 9), datetime(2024, 1, 1), datetime(2024, 5, 1))
    assert [(t.month, t.day) for t, _ in got] == [(1, 31), (2, 29), (3, 31), (4, 30)]


def test_a_rule_that_is_not_worked_out_is_not_lost(spark):
    for rule, reason in (("RRULE:FREQ=MINUTELY", "FREQ=MINUTELY"), ("RRULE:FREQ=YEARLY;BYWEEKNO=1", "BYWEEKNO"),
                         ("RRULE:FREQ=WEEKLY;BYDAY=2TU", "BYDAY=2TU")):
        got = starts(spark, [rule], datetime(2020, 1, 1, 9), datetime(2024, 1, 1), datetime(2024, 2, 1))
        assert got == [(datetime(2020, 1, 1, 9), reason)]


def test_malformed_numbers_are_reasons(spark):
    for part in ("INTERVAL=0", "INTERVAL=x", "COUNT=abc", "COUNT=0", "COUNT=-3", "BYMONTHDAY=0", "BYMONTHDAY=1,x"):
        got = starts(spark, [f"RRULE:FREQ=MONTHLY;{part}"], datetime(2020, 1, 1, 9), datetime(2024, 1, 1), datetime(2024, 2, 1))
        assert got == [(datetime(2020, 1, 1, 9), part)]


def test_sets_of_rules(spark):
    day = datetime(2024, 1, 1, 9)
    low, high = datetime(2024, 1, 1), datetime(2024, 4, 1)

    def dates(*entries):
        return [(t.month, t.day) for t, why in starts(spark, list(entries), day, low, high) if why is None]

    assert dates("RRULE:FREQ=MONTHLY;BYDAY=2MO,-1FR") == [(1, 8), (1, 26), (2, 12), (2, 23), (3, 11), (3, 29)]
    assert dates("RRULE:FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1") == [(1, 31), (2, 29), (3, 29)]
    assert dates("RRULE:FREQ=YEARLY;BYMONTH=2;BYDAY=TH") == [(2, 1), (2, 8), (2, 15), (2, 22), (2, 29)]
    assert dates("RRULE:FREQ=MONTHLY;BYMONTHDAY=1", "RRULE:FREQ=WEEKLY;BYDAY=MO;COUNT=2", "RDATE:20240220T090000Z,20240101T090000Z") == [
        (1, 1), (1, 8), (2, 1), (2, 20), (3, 1)]
    assert dates("RRULE:FREQ=DAILY;COUNT=9", "EXRULE:FREQ=WEEKLY;BYDAY=SA,SU", "EXDATE:20240103T090000Z,garbage") == [
        (1, 1), (1, 2), (1, 4), (1, 5), (1, 8), (1, 9)]
    assert dates("RDATE;VALUE=PERIOD:20240105T090000Z/PT1H") == [(1, 1), (1, 5)]
    assert starts(spark, ["RDATE:soon"], day, low, high) == [(day, "RDATE")]


def test_rules_agree_with_an_independent_expansion(spark):
    rrule = pytest.importorskip("dateutil.rrule")
    rng, rules = random.Random(7), []
    parts = {
        "HOURLY": (("BYHOUR", (6, 9, 18)), ("BYDAY", ("MO", "TH", "SU")), ("BYMONTH", (1, 2, 12)), ("BYMINUTE", (0, 15, 59))),
        "DAILY": (("BYMONTHDAY", (1, 13, -1, -2, 31)), ("BYDAY", ("MO", "TH", "SU")), ("BYMONTH", (1, 2, 12)), ("BYHOUR", (6, 9, 18)),
                  ("BYSETPOS", (1, -1))),
        "WEEKLY": (("BYDAY", ("MO", "TH", "SU", "SA")), ("BYMONTH", (1, 2, 12)), ("WKST", ("SU", "WE")), ("BYSETPOS", (1, -1, 2))),
        "MONTHLY": (("BYDAY", ("1MO", "-1TH", "5SU", "+2SA")), ("BYMONTHDAY", (1, 13, -1, -30, 31)), ("BYMONTH", (1, 2, 12)), ("BYSETPOS", (1, -1))),
        "YEARLY": (("BYDAY", ("1MO", "-1TH", "7SU", "-45SA")), ("BYMONTH", (1, 2, 3)), ("BYYEARDAY", (1, 60, -1, -366, 200)),
                   ("BYMONTHDAY", (1, 29, -1)), ("BYSETPOS", (1, -1, 2))),
    }
    for n in range(150):
        freq = rng.choice(list(parts))
        rule = [f"FREQ={freq}"] + ([f"INTERVAL={rng.choice((2, 3, 7))}"] if rng.random() < 0.5 else [])
        for name, values in rng.sample(parts[freq], rng.randint(0, 2)):
            some = [rng.choice(values)] if name == "WKST" else rng.sample(values, rng.randint(1, len(values) - 1))
            rule.append(f"{name}={','.join(map(str, some))}")
        rule += rng.choice(([], ["COUNT=11"], ["UNTIL=20240301T000000Z"]))
        begin = datetime(2023, rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.choice((0, 15, 40)), 5)
        rules.append((str(n), begin, begin + timedelta(minutes=30), ["RRULE:" + ";".join(rule)], None))
    low, high = datetime(2024, 1, 1), datetime(2024, 6, 1)
    rows = instances(spark.createDataFrame(rules, SCHEMA), low, high).collect()
    assert [r["unexpanded"] for r in rows if r["unexpanded"]] == []
    for n, begin, _, (rule,), _ in rules:
        try:
            want = rrule.rrulestr(rule[6:].replace("000Z", "000"), dtstart=begin)
        except ValueError:  # the other side refuses rules that never come true
            want = []
        want = list(itertools.takewhile(lambda t: t < high, (t for t in want if t + timedelta(minutes=30) > low)))
        assert sorted(r["instance_start"] for r in rows if r["event_id"] == n) == want, (rule, begin)


def test_events_of_one_file_are_worked_out_by_several_tasks(spark):
    start = datetime(2024, 1, 8, 9)
    rows = [(str(k), start, start + timedelta(hours=1), ["RRULE:FREQ=DAILY;COUNT=2"]) for k in range(64)]
    events = spark.createDataFrame(rows, "event_id string, start_ts timestamp, end_ts timestamp, recurrence array<string>").coalesce(1)
    found = instances(events, datetime(2024, 1, 1), datetime(2024, 2, 1)).withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 128 and len({r.task for r in found}) > 1
