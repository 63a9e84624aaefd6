"""Interval joins and merges that stay equi-joins and bounded windows.

Two half-open intervals overlap exactly when the later start lies inside the
earlier interval. So one side is reduced to its start points and the other to
the time cells it covers, and the join is on (keys, level, cell). Short
intervals use narrow cells and long ones wide cells: an interval covers at most
nine cells of its level, a point has one cell per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.skew import salted_pairs

_SECOND = 1_000_000
CELL_SECONDS = (3600, 86_400, 32 * 86_400)
_CELLS_PER_INTERVAL = 8
SALT_SLICES = 16


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def _cell(micros: Column, level: int) -> Column:
    return F.floor(micros / F.lit(CELL_SECONDS[level] * _SECOND)).cast("long")


def _range_cells(start: Column, end: Column) -> Column:
    first, last = _micros(start), _micros(end) - 1
    duration = _micros(end) - _micros(start)
    def covered(level: int) -> Column:
        return F.transform(
            F.sequence(_cell(first, level), _cell(last, level)),
            lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")),
        )

    *narrow, widest = range(len(CELL_SECONDS))
    expr = F
    for level in narrow:
        expr = expr.when(duration <= CELL_SECONDS[level] * _CELLS_PER_INTERVAL * _SECOND, covered(level))
    expr = expr.otherwise(covered(widest))
    return F.when(duration > 0, expr)


def _point_cells(start: Column) -> Column:
    return F.array(*(
        F.struct(F.lit(level).alias("level"), _cell(_micros(start), level).alias("cell"))
        for level in range(len(CELL_SECONDS))
    ))


def _packed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.struct(*rest).alias(name))


def _starts_inside(points: DataFrame, ranges: DataFrame, keys: list[str], salt: int) -> DataFrame:
    """Rows (keys, p, r) with r.start_ts <= p.start_ts < r.end_ts."""
    p = _packed(points, keys, "p").withColumn("__c", F.explode(_point_cells(F.col("p.start_ts"))))
    r = _packed(ranges, keys, "r").withColumn("__c", F.explode(_range_cells(F.col("r.start_ts"), F.col("r.end_ts"))))
    p = p.select(*keys, "p", "__c.level", "__c.cell")
    r = r.select(*keys, "r", "__c.level", "__c.cell")
    p, r, on = salted_pairs(p, r, [*keys, "level", "cell"], F.col("p"), salt)
    inside = (F.col("p.start_ts") >= F.col("r.start_ts")) & (F.col("p.start_ts") < F.col("r.end_ts"))
    return p.join(r, on).where(inside).select(*keys, "p", "r")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], salt: int = SALT_SLICES) -> DataFrame:
    """Every overlapping pair of two sets as (keys, a, b); a from ``left``, b from ``right``.

    Both sides need ``start_ts`` and ``end_ts``. Each pair appears once.
    """
    a_later = _starts_inside(left, right, keys, salt).where(
        F.col("p.end_ts") > F.col("r.start_ts")
    ).select(*keys, F.col("p").alias("a"), F.col("r").alias("b"))
    b_later = _starts_inside(right, left, keys, salt).where(
        F.col("p.start_ts") > F.col("r.start_ts")
    ).select(*keys, F.col("r").alias("a"), F.col("p").alias("b"))
    return a_later.unionByName(b_later)


def self_overlaps(df: DataFrame, keys: list[str], id_col: str, salt: int = SALT_SLICES) -> DataFrame:
    """Overlapping pairs within one set, in both directions, as (keys, a, b)."""
    later = (F.col("p.start_ts") > F.col("r.start_ts")) | (
        (F.col("p.end_ts") > F.col("r.start_ts")) & (F.col(f"p.{id_col}") > F.col(f"r.{id_col}"))
    )
    once = _starts_inside(df, df, keys, salt).where(later)
    both = F.array(
        F.struct(F.col("p").alias("a"), F.col("r").alias("b")), F.struct(F.col("r").alias("a"), F.col("p").alias("b"))
    )
    return once.select(*keys, F.explode(both).alias("__pair")).select(*keys, "__pair.a", "__pair.b")


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Union of intervals per key as disjoint (keys, start_ts, end_ts) rows.

    Work is split by UTC day: equal starts are folded before the shuffle, days
    are merged on their own, and only islands touching a midnight (two per day
    at most) are stitched over days.
    """
    day = F.expr("interval 1 day")
    cut = df.where(F.col("end_ts") > F.col("start_ts")).select(
        *keys, "start_ts", "end_ts", F.explode(F.sequence(
            F.date_trunc("day", "start_ts"),
            F.date_trunc("day", F.col("end_ts") - F.expr("interval 1 microsecond")), day,
        )).alias("day"),
    )
    pieces = cut.groupBy(*keys, "day", F.greatest("start_ts", "day").alias("s")).agg(
        F.max(F.least(F.col("end_ts"), F.col("day") + day)).alias("e")
    )
    in_day = Window.partitionBy(*keys, "day").orderBy("s")
    reach = F.max("e").over(in_day.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        pieces.withColumn("fresh", (reach.isNull() | (F.col("s") > reach)).cast("int"))
        .withColumn("island", F.sum("fresh").over(in_day))
        .groupBy(*keys, "day", "island").agg(F.min("s").alias("start_ts"), F.max("e").alias("end_ts"))
    )
    at_edge = (F.col("start_ts") == F.col("day")) | (F.col("end_ts") == F.col("day") + day)
    inner = islands.where(~at_edge).select(*keys, "start_ts", "end_ts")
    along = Window.partitionBy(*keys).orderBy("start_ts")
    previous = F.lag("end_ts").over(along)
    stitched = (
        islands.where(at_edge)
        .withColumn("fresh", (previous.isNull() | (previous < F.col("start_ts"))).cast("int"))
        .withColumn("chain", F.sum("fresh").over(along))
        .groupBy(*keys, "chain").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
        .select(*keys, "start_ts", "end_ts")
    )
    return inner.unionByName(stitched)
