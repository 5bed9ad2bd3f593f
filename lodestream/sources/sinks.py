"""Tables that are written: append-only logs, keyed snapshots, and their reading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_rows(df: DataFrame, path: str, run_id: str, keys: list[str] | None = None) -> None:
    """Append to a log partitioned by run; with ``keys``, only rows whose keys the log lacks."""
    new = df.dropDuplicates(keys) if keys else df
    if keys and _exists(df.sparkSession, path):
        new = new.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    new.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def runs(spark: SparkSession, path: str, time_col: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("run_id").agg(F.min(time_col).alias("began"), F.count(F.lit(1)).alias("n")).orderBy("began")


def upsert_snapshot(new: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """Merge rows into a keyed snapshot, the latest by ``order`` wins; the old version stays until the new one is whole.

    A snapshot is a folder of versions; readers take the highest.
    """
    spark = new.sparkSession
    last = _versions(spark, path)
    both = new.unionByName(spark.read.parquet(f"{path}/v{last[-1]:09d}")) if last else new
    rows = both.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), order).alias("r")).select(key, "r.*").select(*new.columns)
    number = (last[-1] if last else 0) + 1
    staged = f"{path}/_new-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    p = spark._jvm.org.apache.hadoop.fs.Path
    p(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(p(staged), p(f"{path}/v{number:09d}"))
    return read_snapshot(spark, path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v{_versions(spark, path)[-1]:09d}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _versions(spark: SparkSession, path: str) -> list[int]:
    if not _exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
