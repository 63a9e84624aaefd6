"""Helpers of the operators here: tables in the shared folder, a global order, groups of linked rows."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows are numbered ``partition << 33 | position`` by Spark.
_POSITION_BITS = 33


def work_root(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor sees.

    It is the one of ``spark.checkpoint.dir``; where that is unset, a folder in
    the warehouse. One sub-folder per application, to be removed with it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    root = shared or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work"
    return f"{root.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def kept(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it: lineage ends there, lost executors cost nothing."""
    path = f"{work_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Remove the files of tables of :func:`kept`. Only for those that no unfinished plan reads."""
    for one in tables:
        path = one.sparkSession._jvm.org.apache.hadoop.fs.Path(one.kept_at)
        path.getFileSystem(one.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def deliver(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python tasks can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_riskloom_sent", None) == context.applicationId:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="riskloom-")) / "riskloom_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._riskloom_sent = context.applicationId


def in_arrow(df: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand on every executor."""
    deliver(df.sparkSession)
    return df.mapInArrow(work, schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unit_noise(*cols: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def smallest_hashed(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest hashed keys.

    Rows that cannot be among them are left out before the sort, by the share of
    rows needed, so what tasks send to the driver does not grow with the input.
    """
    share = min(1.0, (n + 6 * n ** 0.5 + 10) / max(1, df.count()))
    noise = unit_noise(key, seed=seed)
    return df.where(noise <= share).orderBy(noise, key).limit(n)


def ordered(df: DataFrame, *keys: Column, name: str = "ordered") -> DataFrame:
    """Rows in one order over all partitions, kept as a table with ``__row``.

    ``keys`` should end in something nearly unique, so that one value cannot fill
    a partition. ``__row`` ascends in that order; the number of a row among all
    comes from :func:`group_starts`.
    """
    sliced = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return kept(sliced.withColumn("__row", F.monotonically_increasing_id()), name)


def part_of(row: str = "__row") -> Column:
    return F.shiftrightunsigned(F.col(row), _POSITION_BITS)


def ranked(rows: DataFrame, group: Column, rank: str) -> DataFrame:
    """Add the rank (from 0) of each row of :func:`ordered` in its group.

    The order must have ``group`` in front. Only counts per (partition, group) are
    windowed: their number is bounded by partitions plus groups.
    """
    tagged = rows.withColumn("__group", group).withColumn("__part", part_of())
    counts = tagged.groupBy("__group", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("__group").alias("__g"), F.col("__part").alias("__p"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    same = F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))
    return tagged.join(starts, same).withColumn(rank, F.col("__row") + F.col("__shift")).drop(
        "__group", "__part", "__g", "__p", "__shift")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every id that occurs in an edge: columns ``id``, ``root``.

    Every round each root takes its smallest neighbour, chains are shortened by
    pointer jumping, and edges are contracted; so rounds are logarithmic in the
    longest chain and no group is ever gathered. Ends when no edge is left.
    """
    pairs = kept(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels = kept(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().withColumn("root", F.col("id")), "labels")
    while not pairs.isEmpty():
        both = pairs.union(pairs.select("b", "a"))
        first = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("p"))
        up = first.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = kept(first.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p")), "parent")
        root_of = parent.select(F.col("v").alias("root"), F.col("p"))
        done = labels, parent, pairs
        labels = kept(labels.join(root_of, "root", "left").select("id", F.coalesce("p", "root").alias("root")), "labels")
        left = pairs.join(parent.select(F.col("v").alias("a"), F.col("p").alias("x")), "a")
        right = left.join(parent.select(F.col("v").alias("b"), F.col("p").alias("y")), "b")
        pairs = kept(right.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        removed(*done)
    removed(pairs)
    return labels
