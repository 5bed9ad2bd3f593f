"""The pN_ queries of the llm problems, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.grouping import ROLE_LOCALS, person_groups
from lodestream.llm.leakage import find_leaks, leaked_items
from lodestream.llm.matching import match_records
from lodestream.llm.mixing import mix_plan, mix_report, mixed_documents
from lodestream.llm.names import variant_classes, variant_pairs
from lodestream.llm.pii import replace_pii, surrogate_pieces
from lodestream.llm.reading import reading_levels
from lodestream.scratch import materialize
from lodestream.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(table(spark, sf_dir, "entities"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes themselves, one row an entity: each by its least id, with its size."""
    c = materialize(variant_classes(table(spark, sf_dir, "entities")), "classes")
    least = c.groupBy("class_id").agg(F.min("entity_id").alias("least"), F.count(F.lit(1)).alias("size"))
    return c.join(least, "class_id").select("entity_id", F.col("least").alias("class_id"), "size")


def _pii_key(spark: SparkSession) -> str:
    """The configured key; these queries over synthetic tables fall back to a fixed one, so that their results can be compared from run to run."""
    return spark.conf.get("spark.lodestream.pii.key", None) or "synthetic tables only"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate_pieces(table(spark, sf_dir, "signals"), _pii_key(spark)).select("delivery_no", "pii_kind", "nth")


def p2_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "signals"), _pii_key(spark)).select("delivery_no", "content")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_records(table(spark, sf_dir, "person_records")).select("record_a", "record_b")


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_records(table(spark, sf_dir, "person_records"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return person_groups(table(spark, sf_dir, "person_records"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mix_report(mix_plan(table(spark, sf_dir, "documents"), targets), targets)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(mix_plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))).select("doc_id", "source", "n_tokens", "copy_no")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")).where("band = 4").select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels")).select("doc_id", "n_sentences", "difficulty", "band")


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_replaced, p5_found, p5_matches, p7_found, p8_found, p8_items, p9_mix, p9_shares, p10_found, p10_levels)}
_DOMAIN = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+"
_roles = "[" + ", ".join(f"'{r}'" for r in ROLE_LOCALS) + "]"
SQL: dict[str, str] = {
    "p7_found": rf"""
WITH RECURSIVE t AS (SELECT record_id, lower(trim(x)) AS x FROM (SELECT record_id, unnest(list_concat([email], coalesce(aliases, []::VARCHAR[]))) AS x FROM person_records) WHERE x IS NOT NULL),
a AS (SELECT DISTINCT record_id, CASE WHEN contains(x, '<') THEN trim(regexp_extract(x, '<([^<>]*)>', 1)) ELSE x END AS address FROM t),
h AS (SELECT record_id, address FROM a WHERE regexp_full_match(address, '[^\s@<>]+@{_DOMAIN}') AND NOT list_contains({_roles}, split_part(address, '@', 1))),
l AS (SELECT DISTINCT x.record_id AS u, y.record_id AS v FROM h x JOIN h y ON x.address = y.address AND x.record_id <> y.record_id),
walk(v, root) USING KEY (v) AS (SELECT u, min(u) FROM l GROUP BY u UNION (SELECT l.v, min(w.root) FROM walk w JOIN l ON l.u = w.v JOIN recurring.walk r ON r.v = l.v WHERE w.root < r.root GROUP BY l.v))
SELECT v AS record_id, root AS group_id FROM walk""",
}
