"""State that outlives a run, as tables: annotations, discoveries, aliases, feedback, graphs, indexes.

A store is an append-only log or a keyed snapshot (``sinks``); what a reader restores is a query on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.sources.sinks import _exists, read_snapshot, upsert_snapshot

#: How much a discovery keeps from session to session, happy places more; below the threshold it is forgotten.
DECAY, HAPPY_DECAY, FORGOTTEN = 0.8, 0.95, 0.1


def annotation_summary(log: DataFrame, n: int = 3) -> DataFrame:
    """``resource, summary``: the latest annotations of every resource, oldest first, parted by bars."""
    w = Window.partitionBy("resource").orderBy(F.desc("at"), F.desc("note"))
    last = log.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return last.groupBy("resource").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "note"))), lambda s: s["note"]), " | ").alias("summary"))


def aged_discoveries(log: DataFrame, sessions: int = 1) -> DataFrame:
    """Discoveries after so many sessions: their weights have decayed, faint ones are gone."""
    kept = F.when(F.col("kind") == "happy_place", F.lit(HAPPY_DECAY)).otherwise(DECAY)
    return log.withColumn("weight", F.col("weight") * F.pow(kept, F.lit(float(sessions)))).where(F.col("weight") >= FORGOTTEN)


def merged_aliases(*tables: DataFrame) -> DataFrame:
    """``canonical, aliases``: the union of alias tables ``(canonical, alias)``, sorted; an alias equal to its canonical name is none."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.where("canonical IS NOT NULL AND alias IS NOT NULL AND canonical <> alias").groupBy("canonical").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def latest_records(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key in an append-only log."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), F.struct(*order)).alias("r")).select(key, "r.*")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_index(prints: DataFrame, path: str, **parameters) -> None:
    """Fingerprints ``(id, fp)`` together with the parameters they were made with."""
    prints.write.mode("overwrite").parquet(f"{path}/prints")
    prints.sparkSession.createDataFrame([(k, str(v)) for k, v in sorted(parameters.items())], "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")


def load_index(spark: SparkSession, path: str, **parameters) -> DataFrame | None:
    """The fingerprints, or None if there are none or they were made with other parameters."""
    if not _exists(spark, f"{path}/parameters"):
        return None
    held = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/parameters").limit(1000).collect()}
    return spark.read.parquet(f"{path}/prints") if held == {k: str(v) for k, v in parameters.items()} else None


def save_state(rows: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """Merge worker, agent or field state into its snapshot; the latest row of a key wins."""
    return upsert_snapshot(rows, path, key, order)


def restore_state(spark: SparkSession, path: str, seeds: DataFrame, key: str) -> DataFrame:
    """``seeds`` with the saved values where there are any; a missing snapshot restores nothing."""
    if not _exists(spark, path):
        return seeds
    saved = read_snapshot(spark, path)
    cols = [c for c in seeds.columns if c != key]
    joined = seeds.join(saved.select(key, *[F.col(c).alias(f"__{c}") for c in cols if c in saved.columns]), key, "left")
    return joined.select(key, *[F.coalesce(f"__{c}", c).alias(c) if c in saved.columns else F.col(c) for c in cols])


def archive_run(spark: SparkSession, path: str, run_id: str, archive: str) -> None:
    """A run's rows, moved as a partition of their own into an archive."""
    spark.read.parquet(path).where(F.col("run_id") == run_id).write.mode("overwrite").parquet(f"{archive}/run_id={run_id}")
