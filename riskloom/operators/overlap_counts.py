"""Numbers of overlapping events and of their likely duplicates, without forming the pairs.

Of intervals that do not end before they start, those that overlap [s, e) are the
ones that start before e, less the ones that end by s: a difference of two ranks.
A calendar's rows are shuffled once, and running sums over its starts and over its
ends give the ranks. Calendars that hold a large share of all events are few; their
ranks come from prefix sums over distinct times, taken in each hour first and then
over the hours, so a calendar or a slot that holds a third of all events is folded
before any window sees it.

Duplicates need the titles: alike titles are found once per distinct title, by the
words and beginnings they share, and each one's overlaps are counted in the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.text import strip, words
from riskloom.operators.conflicts import events_overlap, similarity, title_match, warning_text
from riskloom.operators.skew import hot_keys

_HOUR = 3_600_000_000
_SPAN = ("start_ts", "end_ts")
#: A calendar with more than one of so many rows is not worked on by one task.
_CROWDED = 128
#: Lengths of the beginnings by which a title is looked up inside others.
_PROBES = (8, 4, 2, 1, 0)
# Likelihoods of overlapping events (same title, alike, one of them lasts all day, else).
MEASURES = ("n_every", "n_kind", "n_exact", "n_alike")
LEVELS = {"n_exact": 0.95, "n_alike": 0.7, "n_other_kind": 0.2, "n_rest": 0.1}


def ranks(intervals: DataFrame, times: DataFrame, keys: list[str]) -> DataFrame:
    """Per (keys, t) of the ``times``: how many intervals of the key ``started`` before t, and ``ended`` by t;
    ``points`` are those without any length at t.

    ``intervals`` must not end before they start; times are microseconds.
    """
    mark = lambda t, s, e, z: F.struct(t.alias("t"), F.lit(s).alias("s"), F.lit(e).alias("e"), z.alias("z"))
    point = (F.col("start_ts") == F.col("end_ts")).cast("int")
    marks = intervals.select(*keys, F.explode(F.array(
        mark(F.unix_micros("start_ts"), 1, 0, F.lit(0)), mark(F.unix_micros("end_ts"), 0, 1, point))).alias("m")).select(*keys, "m.*")
    folded = marks.unionByName(times.select(*keys, "t", *(F.lit(0).alias(c) for c in "sez"))).groupBy(*keys, "t").agg(
        *(F.sum(c).alias(c) for c in "sez")).withColumn("hour", F.floor(F.col("t") / F.lit(_HOUR)))
    earlier = Window.unboundedPreceding
    inside = Window.partitionBy(*keys, "hour").orderBy("t")
    hours = Window.partitionBy(*keys).orderBy("hour").rowsBetween(earlier, -1)
    per_hour = folded.groupBy(*keys, "hour").agg(F.sum("s").alias("hs"), F.sum("e").alias("he")).select(
        *keys, "hour", F.coalesce(F.sum("hs").over(hours), F.lit(0)).alias("hs"), F.coalesce(F.sum("he").over(hours), F.lit(0)).alias("he"))
    return folded.withColumn("s", F.coalesce(F.sum("s").over(inside.rowsBetween(earlier, -1)), F.lit(0))).withColumn(
        "e", F.sum("e").over(inside.rowsBetween(earlier, 0))).join(per_hour, [*keys, "hour"]).select(
        *keys, "t", (F.col("s") + F.col("hs")).alias("started"), (F.col("e") + F.col("he")).alias("ended"), F.col("z").alias("points"))


def overlap_counts(spans: DataFrame, intervals: DataFrame, keys: list[str], group: list[str], measure: Column) -> DataFrame:
    """Per ``group``: sums of the overlapping intervals of the spans, one column for each value of ``measure``.

    A span [start_ts, end_ts) overlaps what started before its end, less what ended
    by its start: it looks up two ranks, and the sums take one with a plus, the
    other with a minus. A span without length has not met the points at its own time.
    """
    ends = F.array(
        F.struct(F.unix_micros("end_ts").alias("t"), F.lit(True).alias("is_end")),
        F.struct(F.unix_micros("start_ts").alias("t"), F.lit(False).alias("is_end")))
    asked = spans.select("*", measure.alias("__m"), F.inline(ends))
    found = asked.join(ranks(intervals, asked, keys), [*keys, "t"])
    n = F.when(F.col("is_end"), F.col("started")).otherwise(
        F.when(F.col("start_ts") == F.col("end_ts"), F.col("points")).otherwise(0) - F.col("ended"))
    return found.groupBy(*group).agg(*(
        F.coalesce(F.sum(F.when(F.col("__m") == name, n)), F.lit(0)).alias(name) for name in MEASURES))


def running_counts(asked: DataFrame, pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Per row of ``asked`` and mark of it: ``event_id`` and its shares in the ``LEVELS``, which sum to the counts.

    ``asked`` and ``held`` have a calendar, kind, title and proper span, ``pairs``
    alike titles. Starts and the ends asked for run in one order, ends and the starts
    asked for in another, so what lies before a mark are the intervals it counts.
    """
    slot = ["calendar_id", "is_all_day", "title"]
    row = [*slot, *_SPAN]
    own = asked.select(*row, "event_id", F.lit("own").alias("role"))
    alike = asked.join(pairs, slot).select(*slot[:2], F.col("other").alias("title"), *_SPAN, "event_id", F.lit("alike").alias("role"))
    none = F.lit(None).cast("string")
    rows = own.unionByName(alike).unionByName(held.select(*row, none.alias("event_id"), none.alias("role")))
    # At one time: an end asked for lies before the starts, a start asked for behind the ends. A point does not meet points at its own time.
    is_held, is_point = F.col("role").isNull(), F.col("start_ts") == F.col("end_ts")
    at_start = F.when(is_held, F.lit(1)).otherwise(F.when(is_point, 1).otherwise(3))
    at_end = F.when(is_held, F.when(is_point, 2).otherwise(0)).otherwise(F.lit(0))
    mark = lambda among, t, turn: F.struct(among.alias("of_starts"), F.col(t).alias("t"), turn.alias("turn"))
    marks = rows.repartition("calendar_id").select(*slot, "event_id", "role", F.inline(F.array(
        mark(is_held, "start_ts", at_start), mark(~is_held, "end_ts", at_end))))

    def before(*scope: str):
        return Window.partitionBy("calendar_id", "of_starts", *scope).orderBy("t", "turn").rowsBetween(Window.unboundedPreceding, 0)

    one = F.col("role").isNull().cast("long")
    ranked = marks.withColumns({
        "days": F.sum(F.when(F.col("is_all_day"), one).otherwise(0)).over(before()),
        "timed": F.sum(F.when(F.col("is_all_day"), 0).otherwise(one)).over(before()),
    }).withColumn("titled", F.sum(F.when(F.col("title") != "", one).otherwise(0)).over(before("is_all_day", "title")))
    kind, other = (F.when(F.col("is_all_day"), F.col(a)).otherwise(F.col(b)) for a, b in (("days", "timed"), ("timed", "days")))
    sign, is_own, zero = F.when(F.col("of_starts"), 1).otherwise(-1), F.col("role") == "own", F.lit(0).cast("long")
    shares = {
        "n_exact": F.when(is_own, F.col("titled")).otherwise(zero), "n_alike": F.when(is_own, zero).otherwise(F.col("titled")),
        "n_other_kind": F.when(is_own, other).otherwise(zero),
        "n_rest": F.when(is_own, kind - F.col("titled")).otherwise(-F.col("titled"))}
    return ranked.where("role IS NOT NULL").select("event_id", *((sign * shares[name]).alias(name) for name in LEVELS))


def _title() -> Column:
    """Key of a title: empty where it matches nothing, else the trimmed lower-case title behind a mark."""
    usable = F.coalesce("summary", F.lit("")) != ""
    return F.when(usable, F.concat(F.lit("="), strip(F.lower("summary")))).otherwise(F.lit(""))


def _text(key: Column) -> Column:
    return F.substring(key, F.lit(2), F.length(key))


def alike_titles(titles: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (keys, title, other) of distinct titles that are alike but not the same.

    Both sides hold distinct ``title`` keys per ``keys``. Titles meet where they
    share a word of more than three letters, or where one begins like some stretch
    of the other, of the lengths that beginnings have on that side; candidates are
    then compared in full.
    """
    used = titles.where("title <> ''")
    others = known.where("title <> ''").withColumnRenamed("title", "other")

    def probe(name: str) -> Column:
        t = _text(F.col(name))
        return reduce(lambda found, k: F.when(F.length(t) >= k, F.lit(k)).otherwise(found), sorted(_PROBES), F.lit(0))

    def asked_by(side: DataFrame, beside: DataFrame, name: str) -> DataFrame:
        """``side`` with the lengths that beginnings have ``beside`` it: one row, whatever the number of titles."""
        return side.crossJoin(F.broadcast(beside.agg(F.collect_set(probe(name)).alias("lengths"))))

    def stretches(name: str) -> Column:
        t, n = _text(F.col(name)), F.length(_text(F.col(name)))

        def of_length(k: int) -> Column:
            places = F.sequence(F.lit(1), n - k + 1)
            cut = F.transform(places, lambda i: t.substr(i, F.lit(k))) if k else F.array(F.lit(""))
            return F.when(F.array_contains("lengths", k) & (n >= k), cut).otherwise(F.array().cast("array<string>"))

        return F.array_distinct(F.concat(*map(of_length, _PROBES)))

    def beginning(name: str) -> Column:
        return F.substring(_text(F.col(name)), F.lit(1), probe(name))

    def marked(sign: str, found: Column) -> Column:
        return F.transform(found, lambda x: F.concat(F.lit(sign), x))

    def long_words(name: str) -> Column:
        return marked("w", F.array_distinct(F.filter(words(_text(F.col(name))), lambda w: F.length(w) > 3)))

    def met(name: str, holds: str, begins: str) -> Column:
        # As numbers, which take less room in a shuffle: what meets by chance alone is told apart below.
        return F.explode(F.transform(F.concat(
            marked(holds, stretches(name)), marked(begins, F.array(beginning(name))), long_words(name)), lambda x: F.xxhash64(x)))

    inner, outer = _text(F.col("other")), _text(F.col("title"))
    one = asked_by(used, others, "other").withColumn("key", met("title", "s", "b")).drop("lengths")
    two = asked_by(others, used, "title").withColumn("key", met("other", "b", "s")).drop("lengths")
    candidates = one.join(two, [*keys, "key"]).drop("key").distinct()
    pairs = candidates.where(F.contains(outer, inner) | F.contains(inner, outer) | title_match(outer, inner)["similar"])
    return pairs.where("title <> other")


def check_counts(new: DataFrame, existing: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per event of ``new`` with a hit: conflicts and likely duplicates among ``existing``, and the warning text.

    Equals the summary over all pairs of overlapping events of a calendar, leaving
    out cancelled ones and the event itself. Rows that end before they start take no
    part. Titles are compared between distinct titles only.
    """
    kind = F.coalesce("is_all_day", F.lit(False)).alias("is_all_day")
    columns = ["calendar_id", "event_id", "summary", "start_ts", "end_ts", kind, "status"]
    asked = new.select(*columns).withColumn("title", _title())
    known = existing.where(F.coalesce("status", F.lit("")) != "cancelled").select(*columns).withColumn("title", _title())
    proper = F.col("start_ts") <= F.col("end_ts")
    slot = ["calendar_id", "is_all_day", "title"]
    crowded = F.broadcast(hot_keys(asked.select("calendar_id").unionByName(known.select("calendar_id")), ["calendar_id"], _CROWDED))

    def of(df: DataFrame, how: str) -> DataFrame:
        return df.where(proper & F.col("calendar_id").isNotNull()).join(crowded, "calendar_id", how)

    pairs = alike_titles(asked.where(proper).select(*slot).distinct(), known.select(*slot).distinct(), slot[:2])
    few = running_counts(of(asked, "left_anti"), pairs, of(known, "left_anti"))
    slots = of(asked, "left_semi").select(*slot, *_SPAN).distinct()

    # One count serves all questions: a scope is the whole calendar, one kind of event, or one title of a kind.
    def scopes(title: str, *roles: tuple[str, Column]) -> Column:
        of_kind = F.when(F.col("is_all_day"), "d").otherwise("t")
        found = {"every": F.lit(""), "kind": of_kind, "titled": F.when(F.col(title) != "", F.concat(of_kind, F.col(title)))}
        each = F.array(*(F.struct(F.lit(name).alias("role"), found[scope].alias("scope")) for name, scope in roles))
        return F.explode(F.filter(each, lambda x: x["scope"].isNotNull()))

    plain = scopes("title", ("n_every", "every"), ("n_kind", "kind"), ("n_exact", "titled"))
    wanted = slots.select(*slot, *_SPAN, plain.alias("q")).unionByName(
        slots.join(pairs, slot).select(*slot, *_SPAN, scopes("other", ("n_alike", "titled")).alias("q"))).select(
        *slot, *_SPAN, "q.role", "q.scope")
    held = of(known, "left_semi").select("calendar_id", *_SPAN, plain.alias("q")).select("calendar_id", *_SPAN, "q.scope")
    sums = overlap_counts(wanted, held, ["calendar_id", "scope"], [*slot, *_SPAN], F.col("role"))
    per_slot = sums.select(
        *slot, *_SPAN, "n_exact", "n_alike", (F.col("n_every") - F.col("n_kind")).alias("n_other_kind"),
        (F.col("n_kind") - F.col("n_exact") - F.col("n_alike")).alias("n_rest"))

    names = list(LEVELS)
    counted = of(asked, "left_semi").join(per_slot, [*slot, *_SPAN]).select("event_id", *names).unionByName(few.select("event_id", *names))
    # What an event counted of itself is taken off again; only rows of one id meet here.
    sides = [df.where(proper).select("calendar_id", "event_id", F.struct(*columns[:5], "is_all_day").alias(n)) for df, n in ((asked, "a"), (known, "b"))]
    own = sides[0].join(sides[1], ["calendar_id", "event_id"]).where(events_overlap(F.col("a"), F.col("b"))).select(
        "event_id", F.round(similarity(F.col("a"), F.col("b")), 2).alias("level"))
    off = own.select("event_id", *(F.when(F.col("level") == level, -1).otherwise(0).cast("long").alias(name) for name, level in LEVELS.items()))
    total = counted.unionByName(off).groupBy("event_id").agg(*(F.sum(n).alias(n) for n in names))
    duplicate = [F.col(n) for n, level in LEVELS.items() if level >= threshold]
    return total.select(
        "event_id", sum((F.col(n) for n in names), F.lit(0)).cast("long").alias("n_conflicts"),
        sum(duplicate, F.lit(0)).cast("long").alias("n_duplicates"),
        F.greatest(*(F.when(F.col(n) > 0, F.lit(level)) for n, level in LEVELS.items())).alias("max_similarity"),
    ).where("n_conflicts > 0").withColumn("warnings", warning_text())
