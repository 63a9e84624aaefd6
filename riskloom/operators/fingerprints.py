"""Privacy-safe fingerprints: a hash of the normalised text and one of its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import text as tx
from riskloom.functions.regexes import for_spark
from riskloom.operators.scoring import level_rank

# Length buckets and shape patterns. Every script flag needs its mark in the text.
LENGTH_BUCKETS = ((100, "0-100"), (500, "100-500"), (2000, "500-2000"), (10000, "2000-10000"))
LENGTH_REST = "10000+"
TAG = r"<\s*([a-zA-Z][a-zA-Z0-9]*)\b"
URL = r"""https?://[^\s)<>"']+"""
PERCENT = "%[0-9A-Fa-f]{2}"
SCRIPT_MARKS = (":", ":", ";", "<", "=")
SCRIPT_FLAGS = ("javascript:", "vbscript:", r"data:\s*[^;]+;\s*base64", "<script", r"on\w+\s*=")
SHAPE_KEYS = ("b64", "encoding", "html", "len", "lines", "scripts", "urls", "zwc")


def content_hash(text: Column) -> Column:
    return F.sha2(tx.normalized(text), 256)


def _count(text: Column, pattern: str, guard: Column) -> Column:
    return F.when(guard, F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).otherwise(0)


def shape(text: Column) -> dict[str, Column]:
    """Shape features by key. Guards skip a pattern its literal rules out."""
    size = F.length(text)
    bucket = F
    for edge, name in LENGTH_BUCKETS:
        bucket = bucket.when(size < edge, name)
    tags = F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(for_spark(TAG)), F.lit(1)), lambda t: F.lower(t)
    )))
    flags = [
        (F.contains(text, F.lit(mark)) & F.rlike(text, F.lit(for_spark(p, ignore_case=True)))).cast("int")
        for mark, p in zip(SCRIPT_MARKS, SCRIPT_FLAGS)
    ]
    return {
        "b64": _count(text, tx.BASE64_RUN, tx.may_hold_base64(text)),
        "encoding": _count(text, PERCENT, F.contains(text, F.lit("%"))),
        "html": F.when(
            F.contains(text, F.lit("<")) & (F.size(tags) > 0), F.array_join(tags, ",")
        ).otherwise("none"),
        "len": bucket.otherwise(LENGTH_REST),
        "lines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1,
        "scripts": flags[0] + flags[1] + flags[2] + flags[3] + flags[4],
        "urls": _count(text, for_spark(URL, ignore_case=True), F.contains(text, F.lit("://"))),
        "zwc": _count(text, tx.ZERO_WIDTH, tx.has_non_ascii(text)),
    }


def shape_text(text: Column) -> Column:
    features = shape(text)
    return F.concat_ws("|", *(F.concat(F.lit(f"{k}:"), features[k].cast("string")) for k in SHAPE_KEYS))


def structural_hash(text: Column) -> Column:
    return F.sha2(shape_text(text), 256)


def event_fingerprints(events: DataFrame, results: DataFrame) -> DataFrame:
    """Both hashes over an event's fields joined by newlines, its rules, score and domain."""
    combined = F.concat_ws("\n", *(
        F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name)) for name in ("summary", "description", "location")
    ))
    hashes = events.select(
        F.coalesce("calendarId", F.lit("")).alias("calendar_id"), "id", combined.alias("__all")
    ).select("calendar_id", "id", content_hash(F.col("__all")).alias("content_hash"),
             structural_hash(F.col("__all")).alias("structural_hash"))
    facts = results.select(
        "calendar_id", "id", "risk_score", "risk_level", "organizer_domain",
        F.array_distinct(F.transform("detections", lambda d: d["rule_id"])).alias("pattern_ids"),
    )
    return facts.join(hashes, ["calendar_id", "id"])


def reportable(fingerprints: DataFrame) -> DataFrame:
    """Only dangerous or worse is reported."""
    return fingerprints.where(level_rank(F.col("risk_level")) >= level_rank(F.lit("dangerous")))


def duplicate_groups(df: DataFrame, text: str, key: str) -> DataFrame:
    """Groups of texts that share a content hash or a shape hash, with size and first key."""
    hashed = df.select(F.col(key).alias("key"), F.explode(F.array(
        F.struct(F.lit("content").alias("hash_type"), content_hash(F.col(text)).alias("hash")),
        F.struct(F.lit("structural").alias("hash_type"), structural_hash(F.col(text)).alias("hash")),
    )).alias("h"))
    return hashed.groupBy("h.hash_type", "h.hash").agg(
        F.count(F.lit(1)).alias("copies"), F.min("key").alias("first_key")
    )
