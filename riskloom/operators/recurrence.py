"""Recurrence rules: detection, instance ids, series splits, instances in a range."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.times import COMPACT_UTC, instant
from riskloom.operators.skew import spread_rows

# The part of a rule a split removes.
OLD_UNTIL, OLD_COUNT = r";UNTIL=\d{8}T\d{6}Z", r";COUNT=\d+"


def event_kind(recurrence: Column, recurring_event_id: Column) -> Column:
    many = (F.coalesce(F.size(recurrence), F.lit(0)) > 0) | (F.coalesce(recurring_event_id, F.lit("")) != "")
    return F.when(many, "recurring").otherwise("single")


def instance_id(event_id: Column, original_start: Column) -> Column:
    return F.concat(event_id, F.lit("_"), F.date_format(original_start, COMPACT_UTC))


def base_id(event_id: Column) -> Column:
    return F.split_part(event_id, F.lit("_"), F.lit(1))


def until_text(future_start: Column) -> Column:
    """End of the old series: exactly 24 hours before the new one starts."""
    return F.date_format(future_start - F.expr("interval 24 hours"), COMPACT_UTC)


def with_until(recurrence: Column, until: Column) -> Column:
    """Rules cut off at ``until``; entries that are no rule are kept as they are."""
    return F.transform(recurrence, lambda r: F.when(
        F.startswith(r, F.lit("RRULE:")),
        F.concat(F.regexp_replace(F.regexp_replace(r, OLD_UNTIL, ""), OLD_COUNT, ""), F.lit(";UNTIL="), until),
    ).otherwise(r))


def has_rule(recurrence: Column) -> Column:
    return F.coalesce(F.exists(recurrence, lambda r: F.startswith(r, F.lit("RRULE:"))), F.lit(False))


# Weekdays of a rule, Monday first; frequencies and parts of a rule that are worked out.
WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
FREQUENCIES = ("HOURLY", "DAILY", "WEEKLY", "MONTHLY", "YEARLY")
RULE_PARTS = (
    "FREQ", "INTERVAL", "COUNT", "UNTIL", "WKST", "BYMONTH", "BYYEARDAY", "BYMONTHDAY", "BYDAY", "BYHOUR", "BYMINUTE", "BYSETPOS")


def _listed(one: str) -> str:
    return f"^{one}(,{one})*$"


# What the value of a part may look like: numbers from 1 on, and lists of numbers in their bounds, some from either end.
_WEEKDAY = "(" + "|".join(WEEKDAYS) + ")"
_YEAR_DAY = "[+-]?(0{0,2}[1-9]|0?[1-9][0-9]|[12][0-9]{2}|3[0-5][0-9]|36[0-6])"
PART_VALUES = {
    "INTERVAL": "^0*[1-9][0-9]{0,4}$",
    "COUNT": "^0*[1-9][0-9]{0,4}$",
    "UNTIL": "^[0-9]{8}(T[0-9]{6}Z?)?$",
    "WKST": f"^{_WEEKDAY}$",
    "BYMONTH": _listed("(0?[1-9]|1[0-2])"),
    "BYYEARDAY": _listed(_YEAR_DAY),
    "BYMONTHDAY": _listed("[+-]?(0?[1-9]|[12][0-9]|3[01])"),
    "BYDAY": _listed(f"([+-]?(0?[1-9]|[1-4][0-9]|5[0-3]))?{_WEEKDAY}"),
    "BYHOUR": _listed("([01]?[0-9]|2[0-3])"),
    "BYMINUTE": _listed("[0-5]?[0-9]"),
    "BYSETPOS": _listed(_YEAR_DAY),
}
_FINE = "^FREQ=|" + "|".join(f"^{name}={pattern[1:]}" for name, pattern in PART_VALUES.items())
# Parts that the standard forbids, or gives no meaning, beside a frequency.
NOT_WITH = {"BYMONTHDAY": ("WEEKLY",), "BYYEARDAY": ("DAILY", "WEEKLY", "MONTHLY")}
_DAY, _HOUR, _MINUTE = 86_400_000_000, 3_600_000_000, 60_000_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _part(rule: Column, name: str) -> Column:
    value = F.regexp_extract(rule, rf"(?:^(?:RRULE|EXRULE):|;){name}=([^;]+)", 1)
    return F.when(value != "", value)


def _rules(recurrence: Column) -> Column:
    return F.coalesce(F.filter(recurrence, lambda r: F.rlike(r, F.lit("^(RRULE|EXRULE):"))), F.array().cast("array<string>"))


def _reason(rule: Column) -> Column:
    """Why one rule is not worked out; null when it is."""
    freq = _part(rule, "FREQ")
    parts = F.transform(F.split(F.regexp_replace(rule, "^(RRULE|EXRULE):", ""), ";"), lambda p: F.split(p, "=", 2))
    why = F.when(freq.isNull() | ~freq.isin(*FREQUENCIES), F.concat(F.lit("FREQ="), F.coalesce(freq, F.lit("?"))))
    other = F.array_except(F.transform(parts, lambda p: p[0]), F.array(*map(F.lit, RULE_PARTS)))
    why = why.when(F.size(other) > 0, F.array_join(other, ","))
    wrong = F.filter(parts, lambda p: F.coalesce(~F.rlike(F.array_join(p, "="), F.lit(_FINE)), F.lit(True)))
    why = why.when(F.size(wrong) > 0, F.array_join(F.get(wrong, F.lit(0)), "="))
    for name, frequencies in NOT_WITH.items():
        why = why.when(_part(rule, name).isNotNull() & freq.isin(*frequencies), F.lit(name))
    ordinal = F.coalesce(F.rlike(_part(rule, "BYDAY"), F.lit("[0-9]")), F.lit(False))
    return why.when(ordinal & ~freq.isin("MONTHLY", "YEARLY"), F.concat(F.lit("BYDAY="), _part(rule, "BYDAY")))


def unsupported(recurrence: Column, zone: Column) -> Column:
    """Why a set of rules is not worked out (the first reason); null when it is."""
    reasons = F.filter(F.transform(_rules(recurrence), _reason), lambda r: r.isNotNull())
    unread = F.exists(named_starts(recurrence, "RDATE", zone), lambda t: t.isNull())
    return F.coalesce(F.get(reasons, F.lit(0)), F.when(unread, "RDATE"))


def _stamp(text: Column, zone: Column) -> Column:
    """A UTC stamp, a local stamp or a whole day; null when it is none of them."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit(COMPACT_UTC)),
        F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss")), zone),
        F.to_utc_timestamp(F.try_to_timestamp(text, F.lit("yyyyMMdd")), zone))


def named_starts(recurrence: Column, name: str, zone: Column) -> Column:
    """Starts named by RDATE or EXDATE entries (local ones in the entry's zone, else the event's); null for a text that is no time.

    Of a period only the start is taken.
    """
    def stamps(entry: Column) -> Column:
        named = F.regexp_extract(entry, "TZID=([^:;]+)", 1)
        local = F.when(named != "", named).otherwise(zone)
        return F.transform(F.split(F.substring_index(entry, ":", -1), ","), lambda t: _stamp(F.split_part(t, F.lit("/"), F.lit(1)), local))

    entries = F.filter(recurrence, lambda r: F.rlike(r, F.lit(f"^{name}[:;]")))
    return F.coalesce(F.flatten(F.transform(entries, stamps)), F.array().cast("array<timestamp>"))


def _parsed(rule: Column, start: dict[str, Column], zone: Column) -> Column:
    """A rule as a struct, with the parts that follow from the start filled in."""
    def numbers(name: str) -> Column:
        return F.transform(F.split(_part(rule, name), ","), lambda v: v.try_cast("int"))

    freq, months, month_days = _part(rule, "FREQ"), numbers("BYMONTH"), numbers("BYMONTHDAY")
    order = F.array(*map(F.lit, WEEKDAYS))
    days = F.transform(F.split(_part(rule, "BYDAY"), ","), lambda v: F.struct(
        F.coalesce(F.regexp_extract(v, "^([+-]?[0-9]*)", 1).try_cast("int"), F.lit(0)).alias("nth"),
        (F.array_position(order, F.right(v, F.lit(2))) - 1).cast("int").alias("day")))
    named = F.coalesce(_part(rule, "BYDAY"), _part(rule, "BYMONTHDAY"), _part(rule, "BYYEARDAY")).isNotNull()
    own_week_day = F.array(F.struct(F.lit(0).alias("nth"), F.weekday(start["date"]).alias("day")))
    return F.struct(
        F.startswith(rule, F.lit("EXRULE")).alias("without"), freq.alias("freq"),
        F.coalesce(_part(rule, "INTERVAL").try_cast("int"), F.lit(1)).alias("every"),
        _part(rule, "COUNT").try_cast("int").alias("count"),
        # A whole day ends a series at its midnight in UTC.
        F.coalesce(
            F.try_to_timestamp(_part(rule, "UNTIL"), F.lit("yyyyMMdd")), _stamp(_part(rule, "UNTIL"), zone)).alias("until"),
        (F.array_position(order, F.coalesce(_part(rule, "WKST"), F.lit("MO"))) - 1).cast("int").alias("opens"),
        months.isNotNull().alias("by_month"),
        F.coalesce(months, F.when(freq == "YEARLY", F.when(~named, F.array(F.month(start["date"]))).when(
            month_days.isNotNull(), F.sequence(F.lit(1), F.lit(12))))).alias("months"),
        numbers("BYYEARDAY").alias("year_days"),
        F.when(freq.isin("MONTHLY", "YEARLY") & ~named, F.array(F.day(start["date"]))).otherwise(month_days).alias("month_days"),
        F.when((freq == "WEEKLY") & days.isNull(), own_week_day).otherwise(days).alias("days"),
        F.when((freq != "HOURLY") & _part(rule, "BYHOUR").isNull(), F.array(start["hour"])).otherwise(numbers("BYHOUR")).alias("hours"),
        F.coalesce(numbers("BYMINUTE"), F.array(start["minute"])).alias("minutes"),
        numbers("BYSETPOS").alias("places"), F.contains(rule, F.lit(";BY")).alias("limited"),
        # Parts that choose among the days of a period, besides those its days are made from.
        F.when(freq == "YEARLY", days.isNotNull() | numbers("BYYEARDAY").isNotNull()).when(freq == "MONTHLY", days.isNotNull() | months.isNotNull())
        .when(freq == "WEEKLY", months.isNotNull()).otherwise(named | months.isNotNull()).alias("chosen"))


def _day_fits(rule: Column, day: Column) -> Column:
    """A date holds what the parts of a rule ask of days; ordinals count in the month, or in the year of a yearly rule without months."""
    of_month, of_year = F.day(F.last_day(day)), F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    whole_year = (rule["freq"] == "YEARLY") & ~rule["by_month"]
    place = F.when(whole_year, F.dayofyear(day)).otherwise(F.day(day))
    size = F.when(whole_year, of_year).otherwise(of_month)

    def either_end(days: Column, n: Column, most: Column) -> Column:
        return days.isNull() | F.array_contains(days, n) | F.array_contains(days, n - most - 1)

    weekday = F.exists(rule["days"], lambda w: (w["day"] == F.weekday(day)) & (
        (w["nth"] == 0) | (w["nth"] == F.ceil(place / 7)) | (w["nth"] == -F.ceil((size - place + 1) / 7))))
    return (
        (rule["months"].isNull() | F.array_contains(rule["months"], F.month(day)))
        & (rule["days"].isNull() | weekday)
        & either_end(rule["month_days"], F.day(day), of_month)
        & either_end(rule["year_days"], F.dayofyear(day), of_year))


def _date(micros: Column) -> Column:
    return F.date_from_unix_date(F.floor(micros / _DAY).cast("int"))


def _index(rule: Column, micros: Column, start: dict[str, Column]) -> Column:
    """Number of the period (hour, day, week, month, year) a local time lies in."""
    return F.when(rule["freq"] == "HOURLY", F.floor(micros / _HOUR)).when(rule["freq"] == "DAILY", F.floor(micros / _DAY)).when(
        rule["freq"] == "WEEKLY", F.floor((F.unix_date(_date(micros)) - F.unix_date(_opening(rule, start))) / 7)).when(
        rule["freq"] == "MONTHLY", F.year(_date(micros)) * 12 + F.month(_date(micros)) - 1).otherwise(F.year(_date(micros))).cast("long")


def _opening(rule: Column, start: dict[str, Column]) -> Column:
    """First day of the week of the start."""
    return F.date_sub(start["date"], F.pmod(F.weekday(start["date"]) - rule["opens"], F.lit(7)))


def _period(rule: Column, number: Column, start: dict[str, Column]) -> Column:
    """Local starts (microseconds, sorted) that a rule names in the period of this number."""
    def of_month(first: Column) -> Column:
        """The days of a month that the rule counts from either end of it; all of them if it counts none."""
        counted = F.transform(rule["month_days"], lambda n: F.date_add(first, F.when(n > 0, n - 1).otherwise(F.day(F.last_day(first)) + n)))
        return F.when(rule["month_days"].isNull(), F.sequence(first, F.last_day(first))).otherwise(
            F.filter(counted, lambda d: (d >= first) & (d <= F.last_day(first))))

    year = F.when(rule["months"].isNotNull(), F.flatten(F.transform(
        rule["months"], lambda n: _let(F.make_date(number.cast("int"), n, F.lit(1)), of_month)))).otherwise(
        F.sequence(F.make_date(number.cast("int"), F.lit(1), F.lit(1)), F.make_date(number.cast("int"), F.lit(12), F.lit(31))))
    days = (
        F.when(rule["freq"] == "HOURLY", F.array(F.date_from_unix_date(F.floor(number / 24).cast("int"))))
        .when(rule["freq"] == "DAILY", F.array(F.date_from_unix_date(number.cast("int"))))
        .when(rule["freq"] == "WEEKLY", F.transform(rule["days"], lambda w: F.date_add(
            _opening(rule, start), (7 * number + F.pmod(w["day"] - rule["opens"], F.lit(7))).cast("int"))))
        .when(rule["freq"] == "MONTHLY", _let(F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1)), of_month))
        .otherwise(year))
    own_hour = F.pmod(number, F.lit(24)).cast("int")
    hours = F.when(rule["freq"] != "HOURLY", rule["hours"]).otherwise(
        F.when(rule["hours"].isNull() | F.array_contains(rule["hours"], own_hour), F.array(own_hour)).otherwise(F.array().cast("array<int>")))

    def times(day: Column) -> Column:
        return F.flatten(F.transform(hours, lambda h: F.transform(rule["minutes"], lambda m: (
            F.unix_date(day).cast("long") * _DAY + h.cast("long") * _HOUR + m.cast("long") * _MINUTE + start["rest"]))))

    days = F.when(rule["chosen"], F.filter(days, lambda d: _day_fits(rule, d))).otherwise(days)
    named = F.flatten(F.transform(days, times))
    return _let(F.array_sort(F.array_distinct(named)), lambda all_: F.when(rule["places"].isNull(), all_).otherwise(
        F.filter(all_, lambda v, i: F.array_contains(rule["places"], i + 1) | F.array_contains(rule["places"], i - F.size(all_)))))


def _series(rule: Column, start: dict[str, Column], low: Column, high: Column, zone: Column) -> Column:
    """Local starts of one rule from the first start on, up to its end or ``high``; without COUNT only from near ``low`` on."""
    until = F.least(F.unix_micros(F.from_utc_timestamp(rule["until"], zone)), high)
    opening = _index(rule, start["micros"], start)
    ahead = F.floor((_index(rule, low, start) - opening) / rule["every"])
    first = F.when(rule["count"].isNull(), F.greatest(F.lit(0), ahead)).otherwise(0).cast("long")
    last = F.floor((_index(rule, until, start) - opening) / rule["every"]).cast("long")
    # Each period of such a rule has a start: more periods than COUNT are not needed.
    regular = rule["count"].isNotNull() & ~rule["limited"] & rule["freq"].isin("HOURLY", "DAILY", "WEEKLY")
    last = F.when(regular, F.least(last, rule["count"].cast("long"))).otherwise(last)
    named = F.when(last >= first, F.flatten(F.transform(
        F.sequence(first, last), lambda k: _period(rule, opening + k * rule["every"], start)))).otherwise(F.array().cast("array<long>"))
    named = F.filter(named, lambda v: (v >= start["micros"]) & (v <= until))
    return F.slice(named, F.lit(1), F.coalesce(rule["count"], F.lit(2**31 - 1)))


def instances(events: DataFrame, time_min: datetime, time_max: datetime, zone: Column | None = None) -> DataFrame:
    """Instances of recurring events that fall in the range; single events pass through.

    The rules of an event are a set: the starts of all RRULE and RDATE entries,
    each once, less those of EXRULE and EXDATE entries; an event with dates but no
    RRULE keeps its own start too. A rule may have FREQ from HOURLY to YEARLY with
    INTERVAL, COUNT, UNTIL and WKST, and BYMONTH, BYYEARDAY, BYMONTHDAY, BYDAY (with
    ordinals in months and years), BYHOUR, BYMINUTE and BYSETPOS, which name more
    starts in a period or fewer, as the calendar standard has it. The start counts
    only if the rule names it. COUNT counts before anything is taken out. Steps are
    taken in the local time of ``zone`` (UTC if none is given); two local times that
    a change of clocks makes one give one instance. Series without COUNT jump
    straight to the range, however old they are. Days a month lacks are skipped.
    An event whose set is not worked out (seconds and minutes as frequencies,
    numbers of weeks, values out of bounds) keeps one row, whatever the range, with
    the first reason in ``unexpanded`` (null for all others).
    """
    low, high = F.lit(time_min).cast("timestamp"), F.lit(time_max).cast("timestamp")
    zone = F.lit("UTC") if zone is None else F.coalesce(zone, F.lit("UTC"))
    recurrence, seconds = F.col("recurrence"), F.unix_timestamp
    local = F.unix_micros(F.from_utc_timestamp("start_ts", F.col("__zone")))
    # Working out a set takes far longer than moving its event.
    parsed = spread_rows(events).withColumn("__zone", zone).withColumns({
        "unexpanded": unsupported(recurrence, F.col("__zone")),
        "__more": named_starts(recurrence, "RDATE", F.col("__zone")),
        "__out": named_starts(recurrence, "EXDATE", F.col("__zone")),
        "__length": seconds("end_ts") - seconds("start_ts"),
        "__micros": local, "__date": _date(local), "__hour": F.pmod(F.floor(local / _HOUR), F.lit(24)).cast("int"),
        "__minute": F.pmod(F.floor(local / _MINUTE), F.lit(60)).cast("int"), "__rest": F.pmod(local, F.lit(_MINUTE)),
    })
    # Columns and not a struct: fields of a struct are worked out anew wherever they are used.
    own = {name: F.col(f"__{name}") for name in ("micros", "date", "hour", "minute", "rest")}
    # Local and real time are at most a day or so apart, hence the margin; instances outside the range go below.
    earliest = F.timestamp_seconds(seconds(low) - 2 * 86_400 - F.coalesce(F.greatest("__length", F.lit(0)), F.lit(0)))
    ruled = parsed.withColumn("__rules", F.when(F.col("unexpanded").isNull(), F.transform(
        _rules(recurrence), lambda r: _parsed(r, own, F.col("__zone"))))).withColumns({
            "__low": F.unix_micros(F.from_utc_timestamp(earliest, F.col("__zone"))),
            "__high": F.unix_micros(F.from_utc_timestamp(high, F.col("__zone")))})

    def found(rule: Column) -> Column:
        local = _series(rule, own, F.col("__low"), F.col("__high"), F.col("__zone"))
        return F.struct(rule["without"].alias("without"), F.transform(
            local, lambda v: F.to_utc_timestamp(F.timestamp_micros(v), F.col("__zone"))).alias("starts"))

    def united(without: bool) -> Column:
        return F.flatten(F.transform(F.filter("__found", lambda f: f["without"] == without), lambda f: f["starts"]))

    alone = ((F.size(_rules(recurrence)) == 0) & (F.size("__more") == 0)) | F.col("unexpanded").isNotNull()
    ruled = ruled.withColumns({"__alone": alone, "__found": F.transform("__rules", found)})
    alone = F.col("__alone")
    first = F.when(has_rule(recurrence), F.array().cast("array<timestamp>")).otherwise(F.array("start_ts"))
    starts = F.array_except(F.array_except(F.concat(united(False), "__more", first), "__out"), united(True))
    opened = ruled.withColumn("instance_start", F.explode(F.when(alone, F.array("start_ts")).otherwise(starts)))
    opened = opened.withColumn("instance_end", F.timestamp_seconds(seconds("instance_start") + F.col("__length")))
    inside = (F.col("instance_end") > low) & (F.col("instance_start") < high)
    kept = opened.where(inside | F.col("unexpanded").isNotNull())
    hidden = [c for c in kept.columns if c.startswith("__") and c not in events.columns]
    return kept.withColumn("instance_id", F.when(alone, F.col("event_id")).otherwise(
        instance_id(F.col("event_id"), F.col("instance_start")))).drop(*hidden)


def split_series(events: DataFrame, splits: DataFrame) -> DataFrame:
    """Split series at a future start: the shortened old event and the new series.

    ``splits`` has calendar_id, event_id, future_start (ISO text) and zone. The
    new row has no id yet (``event_id`` null) and keeps duration and fields.
    """
    cut = events.join(splits.select("calendar_id", "event_id", "future_start", "zone"), ["calendar_id", "event_id"])
    cut = cut.where(has_rule(F.col("recurrence")))
    at = instant(F.col("future_start"))
    old = cut.withColumn("recurrence", with_until(F.col("recurrence"), until_text(at))).withColumn("part", F.lit("old"))
    end = F.timestamp_seconds(F.unix_timestamp(at) + F.unix_timestamp("end_ts") - F.unix_timestamp("start_ts"))

    def time(text: Column) -> Column:
        return F.struct(text.alias("dateTime"), F.lit(None).cast("string").alias("date"), F.col("zone").alias("timeZone"))

    new = cut.withColumns({
        "event_id": F.lit(None).cast("string"), "start": time(F.col("future_start")),
        "end": time(F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), "start_ts": at, "end_ts": end,
        "part": F.lit("new"),
    })
    return old.unionByName(new).drop("future_start", "zone")
