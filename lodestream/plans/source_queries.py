"""Queries that write the tables in the formats of the producers and read them back through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.scratch import scratch_path
from lodestream.sources import ownership as O, sinks
from lodestream.sources.tables import table


def source_psc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control records written as JSON lines, read as a graph: edges per type and owner type."""
    path = scratch_path(spark, "psc")
    e = table(spark, sf_dir, "ownership_edges").where("source_dataset = 'uk_psc' AND target_id IS NOT NULL")
    person = F.col("source_id").startswith("person_")
    e.select(
        F.col("target_id").alias("company_number"),
        F.struct(F.when(person, "individual-person-with-significant-control").otherwise("corporate-entity-person-with-significant-control").alias("kind"), F.col("source_id").alias("name"), F.array(F.coalesce("nature_of_control", F.lit(""))).alias("natures_of_control"), F.date_format("ceased_on", "yyyy-MM-dd").alias("ceased_on")).alias("data"),
    ).write.json(path)
    nodes, edges = O.read_psc(spark, path)
    owners = nodes.select(F.col("id").alias("source_id"), "entity_type")
    return edges.join(owners, "source_id").groupBy("edge_type", "entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target_id").alias("n_targets"))


SQL = {
    "source_psc": "SELECT CASE WHEN contains(coalesce(nature_of_control, ''), 'ownership-of-shares') OR contains(coalesce(nature_of_control, ''), 'voting-rights') THEN 'ownership' ELSE 'control' END AS edge_type, CASE WHEN starts_with(source_id, 'person_') THEN 'person' ELSE 'foreign_entity' END AS entity_type, count(*) AS n, count(DISTINCT target_id) AS n_targets FROM ownership_edges WHERE source_dataset = 'uk_psc' AND target_id IS NOT NULL AND target_id <> '' AND ceased_on IS NULL GROUP BY 1, 2"
}


def source_icij(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities and relations written as leak CSVs, read back: edges per type."""
    path = scratch_path(spark, "icij")
    e = table(spark, sf_dir, "entities").where("source = 'icij' AND entity_id IS NOT NULL")
    rows = e.select(F.col("entity_id").alias("node_id"), "name", F.col("jurisdiction"), F.lit("leak").alias("sourceID"), "entity_type")
    write = lambda df, name: df.write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/{name}.csv")
    write(rows.where("entity_type <> 'person'").drop("entity_type"), "nodes-entities")
    write(rows.where("entity_type = 'person'").drop("entity_type").withColumnRenamed("jurisdiction", "country_codes"), "nodes-officers")
    kind = O.lookup({"directorship": "director of", "nominee_for": "nominee director of", "registered_agent": "registered agent of", "ownership": "shareholder of", "subsidiary": "related entity of"}, F.col("edge_type"), "connected to")
    write(table(spark, sf_dir, "ownership_edges").select(F.col("source_id").alias("node_id_start"), F.col("target_id").alias("node_id_end"), kind.alias("rel_type")), "relationships")
    _, edges = O.read_icij(spark, path)
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_id").alias("n_owners"))


SQL["source_icij"] = "WITH i AS (SELECT entity_id FROM entities WHERE source = 'icij' AND entity_id IS NOT NULL) SELECT edge_type, count(*) AS n, count(DISTINCT source_id) AS n_owners FROM ownership_edges WHERE source_id IN (SELECT entity_id FROM i) AND target_id IN (SELECT entity_id FROM i) GROUP BY edge_type"


def source_gleif(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "gleif")
    e = table(spark, sf_dir, "ownership_edges").where("edge_type = 'subsidiary' AND trim(source_id) <> '' AND trim(target_id) <> ''")
    e.select(F.trim("target_id").alias("Relationship.StartNode.NodeID"), F.trim("source_id").alias("Relationship.EndNode.NodeID"), F.lit("IS_DIRECTLY_CONSOLIDATED_BY").alias("Relationship.RelationshipType"), F.when(F.col("ceased_on").isNull(), "ACTIVE").otherwise("INACTIVE").alias("Relationship.RelationshipStatus")).write.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("header", True).option("quoteAll", True).csv(path)
    nodes, edges = O.read_gleif(spark, path)
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("source_id").alias("n_parents")))


SQL["source_gleif"] = "WITH e AS (SELECT trim(source_id) AS s, trim(target_id) AS t FROM ownership_edges WHERE edge_type = 'subsidiary' AND ceased_on IS NULL AND trim(source_id) <> '' AND trim(target_id) <> '') SELECT (SELECT count(*) FROM (SELECT s FROM e UNION SELECT t FROM e)) AS n_nodes, count(*) AS n_edges, count(DISTINCT s) AS n_parents FROM e"


def sink_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entry of every trace, merged into a keyed snapshot in two steps and read back."""
    path = scratch_path(spark, "snapshot")
    b = table(spark, sf_dir, "budget_entries").where("trace_id <> '' AND value IS NOT NULL").select("trace_id", "entry_no", "value")
    half = b.agg(F.expr("percentile_approx(entry_no, 0.5)").alias("m")).first()["m"] or 0
    sinks.upsert_snapshot(b.where(F.col("entry_no") > half), path, "trace_id", "entry_no")
    return sinks.upsert_snapshot(b.where(F.col("entry_no") <= half), path, "trace_id", "entry_no").groupBy((F.col("value") > 0).alias("positive")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


SQL["sink_snapshot"] = "SELECT value > 0 AS positive, count(*) AS n, sum(value)::BIGINT AS total FROM (SELECT trace_id, arg_max(value, entry_no) AS value FROM budget_entries WHERE trace_id <> '' AND value IS NOT NULL GROUP BY trace_id) GROUP BY 1"


def sink_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of channels by run, appended twice without repeating a key; rows per run."""
    path = scratch_path(spark, "log")
    s = table(spark, sf_dir, "signals").where("received_at IS NOT NULL AND channel IS NOT NULL")
    keyed = s.groupBy(F.lower(F.trim("channel")).alias("channel"), "source").agg(F.min("received_at").alias("at"))
    sinks.append_rows(keyed.where("source = 'slack'"), path, "first", ["channel", "source"])
    sinks.append_rows(keyed, path, "second", ["channel", "source"])
    return sinks.runs(spark, path, "at").select("run_id", "n")


SQL["sink_append"] = "SELECT CASE WHEN source = 'slack' THEN 'first' ELSE 'second' END AS run_id, count(*) AS n FROM (SELECT DISTINCT lower(trim(channel)) AS channel, source FROM signals WHERE received_at IS NOT NULL AND channel IS NOT NULL) GROUP BY 1"

QUERIES = {f.__name__: f for f in (source_psc, source_icij, source_gleif, sink_snapshot, sink_append)}
