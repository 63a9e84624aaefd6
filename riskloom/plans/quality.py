"""Detection quality on labelled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detection_quality(scanned: DataFrame, label: str = "is_attack", expected: str | None = None) -> DataFrame:
    """Per label: number of texts, share flagged (not safe) and share with an expected rule."""
    fired = F.transform("detections", lambda d: d["rule_id"])
    hit = F.arrays_overlap(fired, F.col(expected)) if expected else F.lit(None).cast("boolean")
    return scanned.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.avg((F.col("risk_level") != "safe").cast("double")).alias("flagged_rate"),
        F.avg(F.coalesce(hit, F.lit(False)).cast("double")).alias("expected_rule_rate"),
    )
