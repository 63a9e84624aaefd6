"""Whitening of embeddings with block matrices.

Entries become whole numbers (64ths, rounded down), so counts, sums and the
deviations from the mean are exact. The centred rows get a dense index and form
MLlib block matrices; the scatter is the transpose times the matrix, with the
products of the row blocks spread over tasks; its eigenvectors are found on the
driver (dimensions squared, whatever the rows); multiplying the block matrix by
the scaled eigenvectors projects every row.

MLlib deals a tall matrix over the square root of its input's partitions. Rows are
therefore split into panels of bounded size, each a block matrix dealt over enough
partitions; scatters of panels add up, and panels are projected each by itself.

Defined results: rows whose vector is null, empty, or holds null or non-finite
entries are left out, as are those of another length than most (the shorter one at
a tie); a null id stays; repeated rows are rows of their own; a component without
variance (a constant dimension, fewer rows than dimensions) gives 0.0 for every
row and takes no part in the identity error; a deviation beyond 64 bits is null;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.shared import kept, part_of

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """``components`` at most; steps per unit of an entry; rows of a block and of a panel; bytes of a panel per task."""

    components: int = 32
    steps: int = 64
    block_rows: int = 256
    panel_rows: int = 1 << 21
    task_bytes: int = 16 << 20


@dataclass(frozen=True)
class Space:
    """Rows, sums per dimension, eigenvalues (falling), unit eigenvectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """One over the root of each eigenvalue; 0 where there is no variance beyond rounding."""
        largest = self.values[0] if len(self.values) else 0.0
        solid = self.values > largest * len(self.values) * np.finfo(np.float64).eps
        return np.where(solid, 1 / np.sqrt(np.where(solid, self.values, 1.0)), 0.0)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def stepped(vectors: DataFrame, plan: Whitening, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """``vec_id, y`` (whole steps) of the rows that take part, kept as a table with ``__row``; and the dimensions."""
    rows = vectors.where(usable(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(vector, lambda c: F.floor(c.cast("double") * plan.steps)).alias("y"))
    widths = rows.groupBy(F.size("y").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    width = widths["w"] if widths else 0
    return kept(rows.where(F.size("y") == width).withColumn("__row", F.monotonically_increasing_id()), "stepped"), width


def _moments(rows: DataFrame) -> tuple[int, list[int], int]:
    """Rows, exact sums per dimension, and the widest spread of a dimension."""
    entries = rows.select(F.posexplode("y").alias("d", "v"))
    of_dim = entries.groupBy("d").agg(
        F.count(F.lit(1)).alias("n"), F.try_sum("v").alias("s"), F.min("v").alias("low"), F.max("v").alias("high"))
    found = of_dim.orderBy("d").collect()
    sums = [r["s"] for r in found]
    if None in sums:
        whole = entries.groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("d").collect()
        sums = [int(r["s"]) for r in whole]
    return found[0]["n"], sums, max(r["high"] - r["low"] for r in found)


def centred(rows: DataFrame, n: int, sums: list[int], spread: int, plan: Whitening) -> DataFrame:
    """Add the dense ``row``, its ``panel``, the exact ``deviation`` and the centred ``x``; kept as a table by panel."""
    fits = len(sums) * (n * max(spread, 1)) ** 2 < 1 << 62 and n * max(abs(s) for s in sums) < 1 << 62
    kind = "long" if fits else "decimal(38,0)"
    total = F.array(*(F.lit(s).cast(kind) for s in sums))
    count = F.lit(n).cast(kind)
    zero = F.lit(0).cast(kind)
    if fits:
        apart = F.zip_with("y", total, lambda y, s: y * count - s)
        deviation = F.aggregate("apart", zero, lambda a, x: a + x * x)
    else:
        apart = F.zip_with("y", total, lambda y, s: F.try_subtract(F.try_multiply(y.cast(kind), count).cast(kind), s).cast(kind))
        deviation = F.aggregate("apart", zero, lambda a, x: F.try_add(a, F.try_multiply(x, x).cast(kind)).cast(kind))
    sizes = rows.groupBy(part_of().alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    out = rows.withColumn("apart", apart).withColumn("__part", part_of()).join(starts, "__part").select(
        "vec_id", place.alias("row"), F.floor(place / F.lit(plan.panel_rows)).cast("int").alias("panel"),
        (deviation if fits else deviation.try_cast("long")).alias("deviation"),
        F.transform("apart", lambda x: x.cast("double") / F.lit(float(n))).alias("x"))
    return kept(out, "centred")


def block_matrix(rows: DataFrame, values: str, n: int, width: int, plan: Whitening) -> BlockMatrix:
    """Rows (``index`` from 0, an array of doubles) as blocks of whole rows, dealt over enough tasks.

    A block is gathered by its number and becomes a matrix in one call. Made from
    single rows instead, MLlib boxes and shuffles every entry by itself.
    """
    tasks = max(1, -(-n * width * 8 // plan.task_bytes))
    placed = rows.select(
        F.floor(F.col("index") / F.lit(plan.block_rows)).cast("long").alias("block"), "index", F.col(values).alias("x"))
    blocks = placed.repartition(tasks * tasks, "block").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("index", "x"))).alias("rows"))
    as_matrix = F.udf(lambda flat: DenseMatrix(len(flat) // width, width, flat, isTransposed=True), MatrixUDT())
    found = blocks.select(
        F.struct("block", F.lit(0).cast("long").alias("column")).alias("at"),
        as_matrix(F.flatten(F.transform("rows", lambda r: r["x"]))).alias("matrix"))
    return BlockMatrix(callMLlibFunc("createBlockMatrix", found, plan.block_rows, width, n, width), plan.block_rows, width)


def rows_of(matrix: BlockMatrix, plan: Whitening) -> DataFrame:
    """``index, w`` of the rows of a matrix of one column of blocks."""
    found = callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model).toDF("at", "matrix")
    as_rows = F.udf(lambda m: m.toArray().tolist(), "array<array<double>>")
    each = found.select(F.col("at._1").alias("block"), F.posexplode(as_rows("matrix")).alias("place", "w"))
    return each.select((F.col("block") * plan.block_rows + F.col("place")).alias("index"), "w")


def scatter(matrix: BlockMatrix, n: int, width: int, plan: Whitening) -> np.ndarray:
    """Transpose times matrix: partial products of the row blocks are added up in each task first."""
    splits = max(1, min(-(-n // plan.block_rows), -(-n * width * 8 // plan.task_bytes)))
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, width, width).toLocalMatrix().toArray()


def _panels(rows: DataFrame, n: int, plan: Whitening) -> list[tuple[DataFrame, int]]:
    out = []
    for p in range(-(-n // plan.panel_rows)):
        size = min(plan.panel_rows, n - p * plan.panel_rows)
        out.append((rows.where(F.col("panel") == p).withColumn("index", F.col("row") - p * plan.panel_rows), size))
    return out


def covariance(rows: DataFrame, values: str, n: int, width: int, plan: Whitening) -> np.ndarray:
    """Covariance (divisor n) of centred rows: the scatters of all panels, added up."""
    parts = (scatter(block_matrix(df, values, size, width, plan), size, width, plan) for df, size in _panels(rows, n, plan))
    return reduce(np.add, parts) / n


def space_of(rows: DataFrame, n: int, sums: list[int], plan: Whitening) -> Space:
    both = covariance(rows, "x", n, len(sums), plan)
    values, vectors = np.linalg.eigh((both + both.T) / 2)
    return Space(n, sums, values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(both)))


def projected(rows: DataFrame, space: Space, plan: Whitening) -> DataFrame:
    """``row, panel, w``: the block matrix of each panel times the scaled eigenvectors, kept as a table."""
    spark, width = rows.sparkSession, len(space.sums)
    used = min(plan.components, width)
    scaled = (space.vectors * space.scales)[:, :used]
    factor = BlockMatrix(spark.sparkContext.parallelize(
        [((0, 0), DenseMatrix(width, used, scaled.flatten(order="F")))], 1), width, used)
    out = []
    for p, (panel, size) in enumerate(_panels(rows, space.n, plan)):
        found = rows_of(block_matrix(panel, "x", size, width, plan).multiply(factor), plan)
        out.append(found.select((F.col("index") + p * plan.panel_rows).alias("row"), F.lit(p).alias("panel"), "w"))
    return kept(reduce(DataFrame.union, out), "projected")


def whitened(
    vectors: DataFrame, plan: Whitening = Whitening(), vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """One row per vector and component: its place on the component in units of the component's deviation."""
    spark = vectors.sparkSession
    rows, width = stepped(vectors, plan, vec_id, vector)
    if width == 0:
        return spark.createDataFrame([], RESULT)
    n, sums, spread = _moments(rows)
    table = centred(rows, n, sums, spread, plan)
    space = space_of(table, n, sums, plan)
    places = projected(table, space, plan)
    used = min(plan.components, width)
    solid = space.scales[:used] > 0
    off = covariance(places, "w", n, used, plan) - np.eye(used)
    error = float(np.abs(off[np.ix_(solid, solid)]).max()) if solid.any() else 0.0
    share = [float(v / space.trace) if space.trace > 0 else 0.0 for v in np.maximum(space.values[:used], 0.0)]
    each = table.select("vec_id", "row", "deviation").join(places.select("row", "w"), "row").select(
        "vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.lit(share), F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
