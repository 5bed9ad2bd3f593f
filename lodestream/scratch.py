"""Shared-folder scratch tables: the only way lineage is cut in this library.

Iterative operators write each state as a Parquet table below the folder that the
session names in ``spark.checkpoint.dir`` and read it back.  Such a table survives the
loss of any executor, keeps its schema and is pruned and pushed down like any scan.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is configured."""
    root = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="lodestream-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/lodestream/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that scans the copy."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "snappy")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # for release()
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a materialized DataFrame that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables of this application: for when every result has been written."""
    _delete(spark, _folder(spark))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
