"""Helpers for keys that hold a large share of all rows, and for rows that lie in few files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"


def salted_lookup(
    big: DataFrame, unique: DataFrame, key: str, spread: Column, salt: int, how: str = "left"
) -> DataFrame:
    """Join a big skewed side to a side with unique keys, spreading every key over ``salt`` slices.

    The unique side is repeated once per slice; ``spread`` (hashed) picks the
    slice of a big row, so a key holding a third of all rows is worked on by
    ``salt`` tasks. Results equal the plain join.
    """
    if salt <= 1:
        return big.join(unique, key, how)
    left = big.withColumn(SALT, F.pmod(F.xxhash64(spread), F.lit(salt)).cast("int"))
    right = unique.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return left.join(right, [key, SALT], how).drop(SALT)


def spread_rows(df: DataFrame) -> DataFrame:
    """The same rows dealt evenly over the shuffle partitions.

    For costly work on small rows: a table is read by at most one task per row
    group, and one may hold a million rows.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(df: DataFrame, keys: list[str], one_in: int = 2000) -> DataFrame:
    """Keys that hold more than one row in ``one_in``.

    There can be fewer than ``one_in`` of them whatever the data, so the result
    is safe to broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.where(F.col("__n") * one_in > total).select(*keys)


def salted_pairs(
    points: DataFrame, ranges: DataFrame, keys: list[str], spread: Column, salt: int, one_in: int = 2000
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi-join with only the hot keys split over ``salt`` slices."""
    if salt <= 1:
        return points, ranges, keys
    hot = F.broadcast(hot_keys(points, keys, one_in).withColumn("__hot", F.lit(True)))
    left = points.join(hot, keys, "left").withColumn(
        SALT, F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(salt)).cast("int")).otherwise(0)
    ).drop("__hot")
    right = ranges.join(hot, keys, "left").withColumn(
        SALT, F.explode(F.sequence(F.lit(0), F.when(F.col("__hot"), salt - 1).otherwise(0)))
    ).drop("__hot")
    return left, right, keys + [SALT]
