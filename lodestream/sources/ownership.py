"""Readers of public ownership files: each gives a node table and an edge table, lazily.

Nodes are ``(id, name, entity_type, jurisdiction, source)``, edges ``(source_id, target_id,
edge_type, nature, source_dataset)``.  Malformed lines are dropped, unknown kinds left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds of owners and of relations in the files.
PSC_KINDS = {
    "individual-person-with-significant-control": "person",
    "corporate-entity-person-with-significant-control": "foreign_entity",
    "legal-person-person-with-significant-control": "foreign_entity",
    "individual-beneficial-owner": "person",
    "corporate-entity-beneficial-owner": "foreign_entity",
    "legal-person-beneficial-owner": "foreign_entity",
}
ICIJ_RELATIONS = {
    "officer of": "directorship",
    "shareholder of": "ownership",
    "beneficial owner of": "ownership",
    "director of": "directorship",
    "secretary of": "directorship",
    "nominee director of": "nominee_for",
    "nominee shareholder of": "nominee_for",
    "intermediary of": "registered_agent",
    "registered agent of": "registered_agent",
    "related entity of": "subsidiary",
    "connected to": "control",
    "same name and registration date as": "subsidiary",
    "similar name and address as": "subsidiary",
    "registered address": "registered_agent",
}
OWNERSHIP_NATURES = ("ownership-of-shares", "voting-rights")
PSC_SCHEMA = "company_number string, data struct<kind: string, name: string, name_elements: struct<forename: string, middle_name: string, surname: string>, natures_of_control: array<string>, notified_on: date, ceased_on: date, nationality: string, country_of_residence: string, date_of_birth: struct<month: int, year: int>, identification: struct<country_registered: string, place_registered: string>>"


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for k, v in reversed(table.items()):
        out = F.when(key == k, v).otherwise(out)
    return out


def _some(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def person_id(name: Column, month: Column, year: Column) -> Column:
    """A content address of a person: name and month of birth."""
    key = F.concat_ws("_", F.lower(F.trim(name)), F.coalesce(year.cast("string"), F.lit("0000")), F.lpad(F.coalesce(month.cast("string"), F.lit("00")), 2, "0"))
    return F.concat(F.lit("person_"), F.substring(F.sha2(key, 256), 1, 16))


def read_psc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Persons with significant control, one JSON object a line; ceased and secret records are left out."""
    rows = spark.read.schema(PSC_SCHEMA).option("mode", "DROPMALFORMED").json(path).where("company_number <> '' AND data IS NOT NULL AND data.ceased_on IS NULL")
    d = F.col("data")
    rows = rows.where(~F.coalesce(d["kind"].contains("super-secure"), F.lit(False))).withColumn("owner_type", lookup(PSC_KINDS, d["kind"])).where("owner_type IS NOT NULL")
    full = F.concat_ws(" ", _some(d["name_elements"]["forename"]), _some(d["name_elements"]["middle_name"]), _some(d["name_elements"]["surname"]))
    name = F.when((F.col("owner_type") == "person") & (full != ""), full).otherwise(F.coalesce(d["name"], F.lit("Unknown")))
    rows = rows.withColumn("owner_name", name)
    corporate = F.concat(F.lit("corp_"), F.substring(F.sha2(F.lower(F.trim("owner_name")), 256), 1, 16))
    country = F.when(F.col("owner_type") == "person", F.coalesce(_some(d["country_of_residence"]), d["nationality"])).otherwise(F.coalesce(_some(d["identification"]["country_registered"]), d["identification"]["place_registered"]))
    natures = F.filter(F.coalesce(d["natures_of_control"], F.array().cast("array<string>")), lambda n: n != "")
    owning = F.exists(natures, lambda n: n.contains(OWNERSHIP_NATURES[0]) | n.contains(OWNERSHIP_NATURES[1]))
    rows = rows.select("company_number", "owner_type", "owner_name", country.alias("country"), F.when(F.col("owner_type") == "person", person_id(F.col("owner_name"), d["date_of_birth"]["month"], d["date_of_birth"]["year"])).otherwise(corporate).alias("owner_id"), F.array_join(natures, "; ").alias("nature"), F.when(owning, "ownership").otherwise("control").alias("edge_type"))
    companies = rows.select(F.col("company_number").alias("id"), F.col("company_number").alias("name"), F.lit("company").alias("entity_type"), F.lit("GB").alias("jurisdiction"), F.lit("uk_psc").alias("source"))
    owners = rows.select(F.col("owner_id").alias("id"), F.col("owner_name").alias("name"), F.col("owner_type").alias("entity_type"), F.col("country").alias("jurisdiction"), F.lit("uk_psc").alias("source"))
    edges = rows.select(F.col("owner_id").alias("source_id"), F.col("company_number").alias("target_id"), "edge_type", "nature", F.lit("uk_psc").alias("source_dataset"))
    return merge_nodes([companies.unionByName(owners)]), edges


def read_icij(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Leak CSVs: ``nodes-entities``, ``nodes-officers`` and ``relationships``; relations to unknown nodes are dropped."""
    read = lambda name: spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}.csv")
    node_id = lambda n, s: F.concat_ws("_", F.lit("icij"), F.coalesce(_some(s), F.lit("unknown")), n)
    e, o = read("nodes-entities"), read("nodes-officers")
    entities = e.select("node_id", node_id(F.col("node_id"), F.col("sourceID")).alias("id"), "name", F.lit("company").alias("entity_type"), F.col("jurisdiction"))
    officers = o.select("node_id", node_id(F.col("node_id"), F.col("sourceID")).alias("id"), "name", F.lit("person").alias("entity_type"), F.col("country_codes").alias("jurisdiction"))
    keyed = entities.unionByName(officers).where("node_id IS NOT NULL").groupBy("node_id").agg(F.min(F.struct("id", "name", "entity_type", "jurisdiction")).alias("n")).select("node_id", "n.*")
    rel = read("relationships").select(F.col("node_id_start").alias("s"), F.col("node_id_end").alias("t"), F.lower(F.trim("rel_type")).alias("rel"))
    ids = keyed.select("node_id", "id")
    edges = rel.join(ids.select(F.col("node_id").alias("s"), F.col("id").alias("source_id")), "s").join(ids.select(F.col("node_id").alias("t"), F.col("id").alias("target_id")), "t")
    edges = edges.select("source_id", "target_id", lookup(ICIJ_RELATIONS, F.col("rel"), "control").alias("edge_type"), F.col("rel").alias("nature"), F.lit("icij").alias("source_dataset"))
    return keyed.select("id", "name", "entity_type", "jurisdiction", F.lit("icij").alias("source")), edges


def read_gleif(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Legal-entity relationship records; the active ones, from parent to child."""
    rows = spark.read.option("header", True).option("quote", '"').csv(path)
    c = lambda name: F.col(f"`Relationship.{name}`")
    live = rows.where(c("RelationshipStatus") == "ACTIVE").select(c("StartNode.NodeID").alias("child"), c("EndNode.NodeID").alias("parent"), c("RelationshipType").alias("kind")).where("child <> '' AND parent <> ''")
    edges = live.select(F.col("parent").alias("source_id"), F.col("child").alias("target_id"), F.lit("subsidiary").alias("edge_type"), F.lower("kind").alias("nature"), F.lit("gleif").alias("source_dataset"))
    nodes = live.select(F.explode(F.array("child", "parent")).alias("id")).distinct().select("id", F.col("id").alias("name"), F.lit("company").alias("entity_type"), F.lit(None).cast("string").alias("jurisdiction"), F.lit("gleif").alias("source"))
    return nodes, edges


def merge_nodes(tables: list[DataFrame]) -> DataFrame:
    """One row per id; an id in several tables keeps the first table's row."""
    ranked = None
    for k, t in enumerate(tables):
        part = t.withColumn("__rank", F.lit(k))
        ranked = part if ranked is None else ranked.unionByName(part)
    columns = [c for c in ranked.columns if c not in ("id", "__rank")]
    return ranked.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("__rank", *columns)).alias("r")).select("id", *[f"r.{c}" for c in columns])


def read_roster(spark: SparkSession, path: str, aliases_path: str | None = None) -> DataFrame:
    """People of a headerless CSV (name, ``Name <email>``, chat handle, code handle), with alias addresses of a second one."""
    r = spark.read.csv(path, schema="name string, email string, slack_handle string, github_handle string", comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    inner = F.regexp_extract("email", "<([^>]+)>", 1)
    people = r.where("name IS NOT NULL").select("name", F.lower(F.when(inner != "", inner).otherwise(F.trim("email"))).alias("email"), F.regexp_replace("slack_handle", "^@", "").alias("slack_handle"), "github_handle")
    if not aliases_path:
        return people.withColumn("aliases", F.array().cast("array<string>"))
    a = spark.read.csv(aliases_path, schema="email string, alias string", comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    found = a.where("email IS NOT NULL AND alias IS NOT NULL").groupBy(F.lower(F.trim("email")).alias("email")).agg(F.array_sort(F.collect_set(F.lower(F.trim("alias")))).alias("aliases"))
    return people.join(found, "email", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
