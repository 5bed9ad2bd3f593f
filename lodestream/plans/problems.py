"""The pN_ queries of the general problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.deliveries import IDENTITY_KEYS, first_deliveries, surplus_deliveries
from lodestream.operators.hierarchy import descendants, ownership_hierarchy
from lodestream.operators.instants import delivered_instants
from lodestream.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surplus_deliveries(table(spark, sf_dir, "signals"))


def p3_first_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = first_deliveries(table(spark, sf_dir, "signals"))
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_messages"), F.min("delivery_no").alias("first_no"), F.max("delivery_no").alias("last_no"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership_hierarchy(table(spark, sf_dir, "ownership_edges"), table(spark, sf_dir, "entities"), with_path=False).select("node_id", "root_id", "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ownership_hierarchy(table(spark, sf_dir, "ownership_edges"), table(spark, sf_dir, "entities")).select("node_id", "root_id", "depth", F.array_join("path", ">").alias("path"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(ownership_hierarchy(table(spark, sf_dir, "ownership_edges"), table(spark, sf_dir, "entities")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered_instants(table(spark, sf_dir, "signals"), table(spark, sf_dir, "budget_entries"), table(spark, sf_dir, "feeds"))


QUERIES = {f.__name__: f for f in (p3_found, p3_first_copies, p4_found, p4_paths, p4_descendants, p6_found)}

_json = lambda key: f"CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN nullif(lower(trim(json_extract_string(metadata, '$.{key}'))), '') END"


def _meaning(key: str) -> str:
    if key in ("ts", "edited_ts", "pr_number", "issue_number", "run_id", "sub_id"):
        return f"coalesce(try_cast({_json(key)} AS DECIMAL(38, 9))::VARCHAR, {_json(key)})"
    if key in ("updated_at", "starts_at"):
        return f"coalesce(epoch_us(try_cast(upper({_json(key)}) AS TIMESTAMPTZ))::VARCHAR, {_json(key)})"
    return _json(key)


def _identity_sql() -> str:
    arms = []
    for source, keys in IDENTITY_KEYS.items():
        values = [_meaning(k) for k in keys]
        text = " || chr(31) || ".join(f"coalesce({v}, chr(1))" for v in values)
        arms.append(f"WHEN lower(trim(source)) = '{source}' AND coalesce({', '.join(values)}) IS NOT NULL THEN '{source}' || chr(31) || coalesce(regexp_replace(lower(trim(regexp_replace(channel, '\\s+', ' ', 'g'))), '^#\\s*', ''), chr(1)) || chr(31) || {text}")
    return "CASE " + " ".join(arms) + " END"


SQL = {
    "p3_found": f"SELECT delivery_no FROM (SELECT delivery_no, {_identity_sql()} AS k FROM signals) WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY delivery_no) > 1",
    "p3_first_copies": f"SELECT source, count(*) AS n_messages, min(delivery_no) AS first_no, max(delivery_no) AS last_no FROM (SELECT source, delivery_no, k, row_number() OVER (PARTITION BY k ORDER BY delivery_no) AS n FROM (SELECT source, delivery_no, {_identity_sql()} AS k FROM signals)) WHERE k IS NULL OR n = 1 GROUP BY source",
}
_key = lambda c: rf"regexp_replace(upper(regexp_replace({c}, '\s+', '', 'g')), '^([A-Z]{{0,2}})0*([0-9]+)$', '\1\2')"
_FOREST = f"""spelled AS (SELECT {_key('entity_id')} AS k, min(entity_id) AS id FROM entities GROUP BY 1),
live AS (SELECT source_id, target_id FROM ownership_edges WHERE edge_type = 'subsidiary' AND ceased_on IS NULL),
given AS (SELECT {_key('g')} AS k, min(trim(g)) AS id FROM (SELECT source_id AS g FROM live UNION ALL SELECT target_id FROM live) WHERE g IS NOT NULL GROUP BY 1),
names AS (SELECT given.k, coalesce(spelled.id, given.id) AS id FROM given LEFT JOIN spelled USING (k)),
forest AS (SELECT b.id AS node, min(a.id) AS parent FROM live JOIN names a ON a.k = {_key('source_id')} JOIN names b ON b.k = {_key('target_id')} GROUP BY b.id),
nodes AS (SELECT node FROM forest UNION SELECT parent FROM forest),
walk AS (SELECT node, node AS root, 0 AS depth, node AS path FROM nodes WHERE node NOT IN (SELECT node FROM forest) UNION ALL SELECT f.node, w.root, w.depth + 1, w.path || '>' || f.node FROM walk w JOIN forest f ON f.parent = w.node)"""
SQL["p4_found"] = f"WITH RECURSIVE {_FOREST} SELECT n.node AS node_id, coalesce(w.root, 'cycle') AS root_id, coalesce(w.depth, -1)::INTEGER AS depth FROM nodes n LEFT JOIN walk w ON w.node = n.node"
SQL["p4_paths"] = f"WITH RECURSIVE {_FOREST} SELECT n.node AS node_id, coalesce(w.root, 'cycle') AS root_id, coalesce(w.depth, -1)::INTEGER AS depth, w.path FROM nodes n LEFT JOIN walk w ON w.node = n.node"
SQL["p4_descendants"] = f"WITH RECURSIVE {_FOREST}, s AS (SELECT node, depth, string_split(path, '>') AS p FROM walk) SELECT p[i] AS ancestor_id, node AS node_id, (depth - i + 1)::INTEGER AS distance FROM s, range(1, 1000) r(i) WHERE i <= depth"
