"""Reading and writing tables: audit and versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read a Parquet table. Its files and row groups decide the tasks; nothing is shuffled."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_audit(audit: DataFrame, path: str, form: str = "parquet") -> None:
    """Append audit rows, one folder per UTC day."""
    audit.write.mode("append").partitionBy("date").format(form).save(path)


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Write one version of a table; writing it again replaces it, so a retry is harmless."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def read_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """Highest complete version under ``path`` (below a bound), or None."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.removeprefix("version=")))
    fitting = [v for v in found if below is None or v < below]
    return max(fitting, default=None)
