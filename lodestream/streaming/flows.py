"""Structured Streaming versions of the operators that need order, time or state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodestream.operators.deliveries import message_identity
from lodestream.scratch import scratch_path


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet file or folder as a stream of its files."""
    if path.endswith(".parquet"):
        folder, _, name = path.rpartition("/")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet" if _is_folder(spark, path) else name).parquet(path if _is_folder(spark, path) else folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read back what it wrote (both below the shared folder).

    With ``update`` the latest micro-batch's rows of a key come last; read them by ``batch_no``.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/batch=*")


def first_deliveries_stream(signals: DataFrame, delay: str = "30 days") -> DataFrame:
    """One copy of every message among deliveries at most ``delay`` apart; keyless rows pass."""
    keyed = signals.withColumn("message", F.coalesce(message_identity(signals), F.concat(F.lit("own:"), F.col("delivery_no").cast("string"))))
    return keyed.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["message"])


def windowed_counts(events: DataFrame, time_col: str, keys: list[str], size: str = "1 day", delay: str = "30 days") -> DataFrame:
    """Counts per tumbling window and key; rows later than ``delay`` behind the latest are dropped."""
    return events.withWatermark(time_col, delay).groupBy(F.window(time_col, size), *keys).agg(F.count(F.lit(1)).alias("n"))


_EMA_STATE = "ema double, n long, peak double"


def ema_stream(events: DataFrame, key: str, time_col: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential average per key, kept in state; rows of a micro-batch are taken in order of time."""

    def fold(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ema, n, peak = state.get if state.exists else (None, 0, None)
        rows = pd.concat(list(frames)).sort_values([time_col, value], kind="stable")
        for v in rows[value].astype(float):
            if v == v:
                ema = v if ema is None else alpha * v + (1 - alpha) * ema
                peak, n = ema if peak is None else max(peak, ema), n + 1
        state.update((ema, n, peak))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "ema": [ema], "peak": [peak]})

    kind = dict(events.dtypes)[key]
    narrow = events.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, time_col, F.col(value).cast("double").alias(value))
    return narrow.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n long, ema double, peak double", _EMA_STATE, "update", GroupStateTimeout.NoTimeout)


def silence_stream(events: DataFrame, key: str, time_col: str, delay: str = "1 day", quiet_hours: int = 72) -> DataFrame:
    """Emits a row for a key of which nothing came for ``quiet_hours`` of event time (absence needs a timer)."""

    def watch(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        empty = pd.DataFrame({key: pd.Series([], dtype=object), "last_seen": pd.Series([], dtype="datetime64[ns]"), "n": pd.Series([], dtype="int64")})
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({key: [keys[0]], "last_seen": [pd.Timestamp(last, unit="ms")], "n": [n]})
            return
        last, n = state.get if state.exists else (0, 0)
        for frame in frames:
            times = pd.to_datetime(frame[time_col], utc=True)
            last, n = max(last, int(times.max().timestamp() * 1000)), n + len(frame)
        state.update((last, n))
        state.setTimeoutTimestamp(max(last + quiet_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        yield empty

    kind = dict(events.dtypes)[key]
    narrow = events.where(F.col(key).isNotNull() & F.col(time_col).isNotNull()).withWatermark(time_col, delay).select(key, time_col)
    return narrow.groupBy(key).applyInPandasWithState(watch, f"{key} {kind}, last_seen timestamp, n long", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
