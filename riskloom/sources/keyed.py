"""Tables that are kept by key and merged on read: each batch writes only the rows of the keys it touched.

A table is a folder with ``base=N`` (everything up to batch N) and ``delta=M``
folders (the rows of the keys that batch M touched). A key's rows are those of the
latest folder that holds it; a row marked ``gone`` says that the key was removed.
Folders are split by a hash of the key, so a batch reads only the parts its keys lie
in. Writing a batch again replaces its folder; a folder without ``_SUCCESS`` does
not count, so a failed write leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructType

BUCKETS = 64
GONE = "gone"
_BUCKET, _BATCH = "__bucket", "__batch"


def bucket_of(key: str) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _files(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the complete base and delta folders, ascending."""
    root, fs = _files(spark, path)
    out: dict[str, list[int]] = {"base": [], "delta": []}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        kind, _, number = status.getPath().getName().partition("=")
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if kind in out and fs.exists(done):
            out[kind].append(int(number))
    return {k: sorted(v) for k, v in out.items()}


def _write(df: DataFrame, path: str, key: str) -> None:
    df.withColumn(_BUCKET, bucket_of(key)).repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(path)


def write_delta(df: DataFrame, path: str, batch: int, key: str) -> None:
    """All rows of every key the batch touched; a removed key is one row with ``gone``."""
    marked = df if GONE in df.columns else df.withColumn(GONE, F.lit(False))
    _write(marked, f"{path}/delta={batch}", key)


def read_current(
    spark: SparkSession, path: str, schema: str, key: str, below: int | None = None, keys: DataFrame | None = None,
) -> DataFrame:
    """The table after all batches (below a bound), or its rows of some ``keys``.

    A replayed batch must not see what it wrote itself, hence the bound.
    """
    found = folders(spark, path)
    allowed = lambda ns: [n for n in ns if below is None or n < below]
    base = max(allowed(found["base"]), default=-1)
    parts = [("base", base)] * (base >= 0) + [("delta", n) for n in allowed(found["delta"]) if n > base]
    stored = StructType.fromDDL(schema).add(GONE, BooleanType())
    if not parts:
        return spark.createDataFrame([], stored).drop(GONE)
    buckets = None
    if keys is not None:
        # At most BUCKETS numbers: they prune the folders that are read.
        buckets = [r[0] for r in keys.select(bucket_of(key).alias("b")).distinct().collect()]
    rows = None
    for kind, n in parts:
        part = spark.read.schema(StructType([*stored.fields]).add(_BUCKET, IntegerType())).parquet(f"{path}/{kind}={n}")
        part = (part if buckets is None else part.where(F.col(_BUCKET).isin(buckets))).withColumn(_BATCH, F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    if keys is not None:
        rows = rows.join(keys.select(key).distinct(), key, "left_semi")
    newest = F.max(_BATCH).over(Window.partitionBy(key))
    return rows.withColumn("__newest", newest).where((F.col(_BATCH) == F.col("__newest")) & ~F.col(GONE)).drop(
        "__newest", _BATCH, _BUCKET, GONE)


def compact(spark: SparkSession, path: str, schema: str, key: str) -> int | None:
    """Write all batches as one base and remove the folders it stands for; the number of the base."""
    found = folders(spark, path)
    last = max([*found["base"], *found["delta"]], default=None)
    if last is None or (found["base"][-1:] == [last]):
        return last
    _write(read_current(spark, path, schema, key).withColumn(GONE, F.lit(False)), f"{path}/base={last}", key)
    _, fs = _files(spark, path)
    for kind, numbers in found.items():
        for n in numbers:
            if kind == "delta" or n < last:
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n}"), True)
    return last
