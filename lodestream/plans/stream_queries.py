"""Streaming queries, run over everything there and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.plans.problems import SQL as DELIVERY_SQL
from lodestream.sources.tables import table
from lodestream.streaming import flows as S


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.stream_table(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema)


def stream_first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per source after streaming deduplication."""
    out = S.run_available(S.first_deliveries_stream(_stream(spark, sf_dir, "signals"), "1000 days").select("source", "message"), "dedup")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "signals").where("received_at IS NOT NULL")
    out = S.run_available(S.windowed_counts(s, "received_at", ["source"], delay="1000 days"), "daily", "update")
    latest = out.withColumn("k", F.row_number().over(Window.partitionBy("window", "source").orderBy(F.desc("batch_no")))).where("k = 1")
    return latest.select(F.to_date(F.col("window.start")).cast("string").alias("day"), "source", "n")


def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _stream(spark, sf_dir, "budget_entries").withColumn("series", F.concat_ws("/", "repo", "metric"))
    out = S.run_available(S.ema_stream(b, "series", "received_at", "value"), "ema", "update")
    latest = out.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("batch_no")))).where("k = 1")
    return latest.select("series", "n", F.round("ema", 6).alias("ema"))


def stream_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir, "signals").select(F.lower(F.trim("channel")).alias("channel"), "received_at")
    return S.run_available(S.silence_stream(s, "channel", "received_at"), "silence").select("channel", "last_seen", "n")


SQL = {
    "stream_first_deliveries": f"SELECT source, n_messages AS n FROM ({DELIVERY_SQL['p3_first_copies']})",
    "stream_daily_counts": "SELECT CAST(received_at AS DATE)::VARCHAR AS day, source, count(*) AS n FROM signals WHERE received_at IS NOT NULL GROUP BY 1, 2",
    "stream_ema": "WITH l AS (SELECT concat_ws('/', repo, metric) AS series, list(value::DOUBLE ORDER BY received_at, value) AS x FROM budget_entries WHERE value IS NOT NULL GROUP BY 1) SELECT series, len(x) AS n, round(list_reduce(x, lambda a, v: 0.3::DOUBLE * v + 0.7::DOUBLE * a), 6) AS ema FROM l",
}
QUERIES = {f.__name__: f for f in (stream_first_deliveries, stream_daily_counts, stream_ema, stream_silence)}
