"""Overlap conflicts, duplicate detection and busy-slot conflicts between events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import let, strip, words
from riskloom.functions.times import duration_text
from riskloom.operators.intervals import SALT_SLICES, overlaps, self_overlaps

# Fixed values of duplicate detection.
WARN_SIMILARITY, BLOCK_SIMILARITY = 0.7, 0.95
BLOCK_SUGGESTION = "This appears to be a duplicate. Consider updating the existing event instead."
WARN_SUGGESTION = "This event is very similar to an existing one. Is this intentional?"
UNTITLED = "Untitled Event"
_NEEDED = ("event_id", "summary", "start_ts", "end_ts", "is_all_day", "status")


def events_overlap(a: Column, b: Column) -> Column:
    return F.coalesce((a["start_ts"] < b["end_ts"]) & (b["start_ts"] < a["end_ts"]), F.lit(False))


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def overlap_millis(a: Column, b: Column) -> Column:
    span = F.least(_millis(a["end_ts"]), _millis(b["end_ts"])) - F.greatest(_millis(a["start_ts"]), _millis(b["start_ts"]))
    return F.greatest(span, F.lit(0))


def overlap_facts(a: Column, b: Column) -> dict[str, Column]:
    """Overlap of ``a`` (the new event) with ``b``; the percentage is of ``a``."""
    shared = overlap_millis(a, b)
    own = _millis(a["end_ts"]) - _millis(a["start_ts"])
    return {
        "overlap_ms": shared,
        "overlap_text": duration_text(shared),
        "overlap_percent": F.round(F.try_divide(shared * F.lit(100.0), own)).cast("long"),
        "overlap_start": F.greatest(a["start_ts"], b["start_ts"]),
        "overlap_end": F.least(a["end_ts"], b["end_ts"]),
    }


def title_match(one: Column, two: Column) -> Column:
    """Struct (exact, similar) of two titles; empty titles match nothing."""
    def compare(t: Column) -> Column:
        a, b = t["a"], t["b"]
        shared = F.size(F.filter(t["wa"], lambda w: F.array_contains(t["wb"], w)))
        fewer = F.least(F.size(t["wa"]), F.size(t["wb"]))
        exact = a == b
        similar = exact | F.contains(a, b) | F.contains(b, a) | ((fewer > 0) & (shared * 2 >= fewer))
        return F.struct(exact.alias("exact"), similar.alias("similar"))

    def prepared(title: Column) -> Column:
        return strip(F.lower(title))

    def long_words(title: Column) -> Column:
        return F.filter(words(prepared(title)), lambda w: F.length(w) > 3)

    both = F.struct(
        prepared(one).alias("a"), prepared(two).alias("b"), long_words(one).alias("wa"), long_words(two).alias("wb")
    )
    usable = (F.coalesce(one, F.lit("")) != "") & (F.coalesce(two, F.lit("")) != "")
    return F.when(usable, let(both, compare)).otherwise(
        F.struct(F.lit(False).alias("exact"), F.lit(False).alias("similar"))
    )


def similarity(a: Column, b: Column) -> Column:
    """Rule ladder of duplicate likelihood. Days are compared in UTC."""
    overlap = events_overlap(a, b)
    same_day = F.coalesce(F.to_date(a["start_ts"]) == F.to_date(b["start_ts"]), F.lit(False))

    def ladder(match: Column) -> Column:
        return (
            F.when(match["exact"] & overlap, 0.95)
            .when(match["similar"] & overlap, 0.7)
            .when(match["exact"] & same_day, 0.6)
            .when(match["exact"], 0.4)
            .when(match["similar"], 0.3)
            .otherwise(0.1)
        )

    return F.when(a["is_all_day"] != b["is_all_day"], 0.2).otherwise(let(title_match(a["summary"], b["summary"]), ladder))


def _narrow(events: DataFrame) -> DataFrame:
    return events.select("calendar_id", *_NEEDED)


def _alive(col: str) -> Column:
    return F.coalesce(F.col(f"{col}.status"), F.lit("")) != "cancelled"


def conflict_pairs(events: DataFrame, salt: int = SALT_SLICES) -> DataFrame:
    """Pairs (a, b) of a calendar that overlap; b is not cancelled and not a itself."""
    return self_overlaps(_narrow(events), ["calendar_id"], "event_id", salt).where(_alive("b"))


def conflict_pairs_with(new: DataFrame, existing: DataFrame, salt: int = SALT_SLICES) -> DataFrame:
    """Pairs of new events and existing events of the calendars they are checked against.

    ``new.calendar_id`` names the calendar to check; list a new event once per
    calendar to check several. A new event without an id skips nothing as itself.
    """
    pairs = overlaps(_narrow(new), _narrow(existing), ["calendar_id"], salt)
    itself = F.coalesce(F.col("a.event_id") == F.col("b.event_id"), F.lit(False))
    return pairs.where(_alive("b") & ~itself)


def conflicts(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    facts = overlap_facts(a, b)
    return pairs.select(
        "calendar_id", F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("conflict_id"),
        F.coalesce(F.when(F.col("b.summary") != "", F.col("b.summary")), F.lit(UNTITLED)).alias("conflict_title"),
        *(expr.alias(name) for name, expr in facts.items()),
    )


def duplicates(pairs: DataFrame, threshold: float = WARN_SIMILARITY) -> DataFrame:
    """Overlapping pairs at or above the similarity threshold."""
    scored = pairs.withColumn("similarity", similarity(F.col("a"), F.col("b")))
    return scored.where(F.col("similarity") >= threshold).select(
        "calendar_id", F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("duplicate_id"),
        F.coalesce(F.when(F.col("b.summary") != "", F.col("b.summary")), F.lit(UNTITLED)).alias("duplicate_title"),
        "similarity",
        F.when(F.col("similarity") >= BLOCK_SIMILARITY, BLOCK_SUGGESTION).otherwise(WARN_SUGGESTION).alias("suggestion"),
    )


def warning_text() -> Column:
    return F.concat_ws(
        "; ",
        F.when(F.col("n_duplicates") > 0, F.format_string("Found %d potential duplicate(s)", "n_duplicates")),
        F.when(F.col("n_conflicts") > 0, F.format_string("Found %d scheduling conflict(s)", "n_conflicts")),
    )


def check_summary(pairs: DataFrame, threshold: float = WARN_SIMILARITY) -> DataFrame:
    """Per event with a hit: numbers of conflicts and duplicates, and the warning text."""
    alike = F.col("__alike")
    counts = pairs.withColumn("__alike", similarity(F.col("a"), F.col("b"))).groupBy(F.col("a.event_id").alias("event_id")).agg(
        F.count(F.lit(1)).alias("n_conflicts"),
        F.sum((alike >= threshold).cast("long")).alias("n_duplicates"),
        F.max(alike).alias("max_similarity"),
    )
    return counts.withColumn("warnings", warning_text())


def busy_conflicts(events: DataFrame, busy: DataFrame, salt: int = SALT_SLICES) -> DataFrame:
    """Events that overlap a busy slot of their calendar; slot details stay hidden."""
    pairs = overlaps(_narrow(events), busy.select("calendar_id", "start_ts", "end_ts"), ["calendar_id"], salt)
    return pairs.select(
        "calendar_id", F.col("a.event_id").alias("event_id"), F.lit("busy-time").alias("conflict_id"),
        F.lit("Busy (details unavailable)").alias("conflict_title"),
        F.col("b.start_ts").alias("busy_start"), F.col("b.end_ts").alias("busy_end"),
    )
