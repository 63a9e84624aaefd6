"""Scores as column expressions over detection arrays: no shuffle per field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.config import LEVEL_ACTIONS, RISK_LEVELS, ScanConfig

# Fixed values of the score formula.
EXTRA_DETECTION_BONUS, EXTRA_DETECTION_MAX = 0.05, 0.15
TWO_TIER_FACTOR, THREE_TIER_FACTOR = 1.15, 1.10


def tier_score(worst: Column, count: Column) -> Column:
    """Highest severity plus a bonus per further detection; 0 when nothing fired."""
    bonus = F.least((count - 1) * F.lit(EXTRA_DETECTION_BONUS), F.lit(EXTRA_DETECTION_MAX))
    return F.when(count > 0, F.least(worst + bonus, F.lit(1.0))).otherwise(F.lit(0.0))


def tier_score_of(detections: Column) -> Column:
    return tier_score(F.array_max(F.transform(detections, lambda d: d["severity"])), F.size(detections))


def composite(tier_scores: dict[str, Column], config: ScanConfig) -> Column:
    """Weighted sum over the tiers, raised when tiers corroborate each other."""
    without = set(tier_scores) - set(config.weights)
    if without:
        raise ValueError(f"no weight for: {', '.join(sorted(without))}")
    weighted = reduce(
        lambda a, b: a + b,
        (F.coalesce(tier_scores[t], F.lit(0.0)) * F.lit(w) for t, w in config.weights.items() if t in tier_scores),
    )
    firing = reduce(
        lambda a, b: a + b, (F.when(F.coalesce(s, F.lit(0.0)) > 0, 1).otherwise(0) for s in tier_scores.values())
    )
    two = F.when(firing >= 2, F.least(weighted * TWO_TIER_FACTOR, F.lit(1.0))).otherwise(weighted)
    return F.when(firing >= 3, F.least(two * THREE_TIER_FACTOR, F.lit(1.0))).otherwise(two)


def level(score: Column, config: ScanConfig) -> Column:
    t = config.thresholds
    return (
        F.when(score >= t["critical"], "critical")
        .when(score >= t["dangerous"], "dangerous")
        .when(score >= t["suspicious"], "suspicious")
        .otherwise("safe")
    )


def action(risk_level: Column) -> Column:
    expr = F
    for name, act in LEVEL_ACTIONS.items():
        expr = expr.when(risk_level == name, act)
    return expr


def level_rank(risk_level: Column) -> Column:
    expr = F
    for rank, name in enumerate(RISK_LEVELS):
        expr = expr.when(risk_level == name, rank)
    return expr.otherwise(-1)


def event_scores(events: DataFrame, fields: DataFrame, keys: list[str], config: ScanConfig) -> DataFrame:
    """Event score = highest field score; an event without scanned fields scores 0."""
    best = fields.groupBy(*keys).agg(F.max("risk_score").alias("risk_score"), F.count(F.lit(1)).alias("field_count"))
    joined = events.join(best, keys, "left").withColumns({
        "risk_score": F.coalesce("risk_score", F.lit(0.0)),
        "field_count": F.coalesce("field_count", F.lit(0)),
    })
    joined = joined.withColumn("risk_level", level(F.col("risk_score"), config))
    return joined.withColumn("action", action(F.col("risk_level")))
