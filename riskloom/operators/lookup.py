"""Known-hash lookups: the third detection tier and the check/prune operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators import patterns as P
from riskloom.operators.rules import detection, no_detections
from riskloom.operators.skew import salted_lookup

SHA256_HEX = "^[a-f0-9]{64}$"
_FACTS = ("confidence", "report_count", "first_seen", "last_seen", "category")


def is_hash(col: Column) -> Column:
    return F.coalesce(F.rlike(col, F.lit(SHA256_HEX)), F.lit(False))


def unexpired(threats: DataFrame, as_of: datetime | None) -> DataFrame:
    """Entries still valid: an expiry equal to ``as_of`` counts as valid."""
    return threats if as_of is None else threats.where(F.col("expires_at") >= F.lit(as_of).cast("timestamp"))


def expired_count(entries: DataFrame, as_of: datetime) -> DataFrame:
    return entries.where(F.col("expires_at") < F.lit(as_of).cast("timestamp")).agg(
        F.count(F.lit(1)).alias("removed")
    )


def check(hashes: DataFrame, threats: DataFrame, key: str = "hash", salt: int = 8) -> DataFrame:
    """Known flag and facts per hash; unknown hashes get zeros; bad formats are rejected."""
    valid = hashes.where(is_hash(F.col(key)))
    known = threats.select(F.col("hash").alias(key), F.lit(True).alias("known"), *_FACTS)
    spread = F.struct(*(F.col(c) for c in hashes.columns))
    found = salted_lookup(valid, known, key, spread, salt)
    return found.withColumns({
        "known": F.coalesce("known", F.lit(False)),
        "confidence": F.coalesce("confidence", F.lit(0.0)),
        "report_count": F.coalesce("report_count", F.lit(0)),
    })


def _facts(threats: DataFrame, key: str, prefix: str) -> DataFrame:
    facts = [c for c in _FACTS if c in threats.columns]
    missing = {"first_seen": "timestamp"}
    columns = [F.col(c) if c in facts else F.lit(None).cast(missing[c]).alias(c) for c in _FACTS]
    return threats.select(F.col("hash").alias(key), F.struct(*columns).alias(prefix))


def match_fingerprints(
    df: DataFrame, threats: DataFrame, as_of: datetime | None, salt: int, spread: Column
) -> DataFrame:
    """Add ``hit``: the content-hash entry if known and valid, else the structural one, else null.

    The lookup side is never forced to broadcast; Spark does so when its size is
    known to be small, and otherwise copies of one text are spread by the salt.
    """
    live = unexpired(threats, as_of)
    df = salted_lookup(df, _facts(live, "content_hash", "__by_content"), "content_hash", spread, salt)
    df = salted_lookup(df, _facts(live, "structural_hash", "__by_shape"), "structural_hash", spread, salt)
    return df.withColumn("hit", F.coalesce("__by_content", "__by_shape")).drop("__by_content", "__by_shape")


def with_threat_detections(
    df: DataFrame, threats: DataFrame, as_of: datetime | None, spread: Column, salt: int = 8
) -> DataFrame:
    """Add the ``threat_intel`` detection array from the two hashes of each row."""
    matched = match_fingerprints(df, threats, as_of, salt, spread)
    hit = F.col("hit")
    bonus = F.least(hit["report_count"] * F.lit(P.REPORT_BONUS), F.lit(P.REPORT_BONUS_MAX))
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    found = F.array(detection(
        P.THREAT_INTEL, P.THREAT_RULE, P.THREAT_NAME, F.least(hit["confidence"] + bonus, F.lit(1.0)),
        F.concat(F.lit("Hash "), F.substring("content_hash", 1, 16), F.lit("... matched known threat")),
        0, 0, hit["confidence"],
        F.create_map(
            F.lit("reportCount"), hit["report_count"].cast("string"),
            F.lit("firstSeen"), F.date_format(hit["first_seen"], stamp),
            F.lit("lastSeen"), F.date_format(hit["last_seen"], stamp),
            F.lit("category"), hit["category"],
        ),
    ))
    return matched.withColumn(
        "threat_intel", F.when(hit.isNotNull(), found).otherwise(no_detections())
    ).drop("hit")
