"""Queries on the communication graph of signals and the ownership graph, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import graphs as G
from lodestream.operators.hierarchy import ownership_hierarchy
from lodestream.operators.skew import hot_keys, join_unique
from lodestream.plans.activity_queries import repo_flows
from lodestream.plans.problems import _FOREST
from lodestream.scratch import materialize
from lodestream.sources.tables import table

_R = lambda c, n=6: F.round(c, n)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wrote to whom: the author of a signal to the author of its thread and to everyone its metadata mentions."""
    s = table(spark, sf_dir, "signals").where("author IS NOT NULL AND author <> '' AND metadata IS NOT NULL")
    m = F.from_json("metadata", "thread_author string, mentions array<string>")
    to = F.array_compact(F.concat(F.array(m["thread_author"]), F.coalesce(m["mentions"], F.array().cast("array<string>"))))
    key = lambda c: F.lower(F.regexp_replace(c, "^@", ""))
    return s.select(key(F.col("author")).alias("src"), F.explode(to).alias("d"), F.col("source").alias("type"), F.col("received_at").alias("at"), "channel").select("src", key(F.col("d")).alias("dst"), "type", "at", "channel")


_CONTACTS = """contacts AS (
 SELECT lower(regexp_replace(author, '^@', '')) AS src, lower(regexp_replace(d, '^@', '')) AS dst, source AS type, received_at AS ts, channel FROM (
  SELECT author, source, received_at, channel, unnest(list_concat(CASE WHEN json_extract_string(m, '$.thread_author') IS NULL THEN []::VARCHAR[] ELSE [json_extract_string(m, '$.thread_author')] END, coalesce(json_extract_string(m, '$.mentions[*]'), []::VARCHAR[]))) AS d
  FROM (SELECT *, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM signals WHERE author IS NOT NULL AND author <> '' AND metadata IS NOT NULL) WHERE m IS NOT NULL)),
real AS (SELECT * FROM contacts WHERE src <> dst),
edges AS (SELECT src, dst, count(*) AS weight FROM real GROUP BY src, dst),
ties AS (SELECT v, nb, sum(weight)::DOUBLE AS weight FROM (SELECT src AS v, dst AS nb, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges) GROUP BY v, nb)"""


def comm_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.accumulate_edges(contacts(spark, sf_dir))
    return e.select("src", "dst", "type", "weight", F.unix_micros("last_seen").alias("last_us"))


SQL = {"comm_edges": f"WITH {_CONTACTS} SELECT src, dst, type, count(*) AS weight, max(epoch_us(ts)) AS last_us FROM real GROUP BY src, dst, type"}


def comm_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return G.decayed_weights(contacts(spark, sf_dir), as_of).select("src", "dst", _R("weight").alias("weight"))


SQL["comm_decayed"] = f"WITH {_CONTACTS} SELECT src, dst, round(sum(pow(2.0::DOUBLE, -greatest((epoch_us(TIMESTAMPTZ '2025-01-01 00:00:00+00') - epoch_us(ts)) / 86400000000.0::DOUBLE, 0.0::DOUBLE) / 30.0::DOUBLE)), 6) AS weight FROM real GROUP BY src, dst"


def comm_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbours(contacts(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))


SQL["comm_ties"] = f"WITH {_CONTACTS} SELECT v, nb, weight FROM ties"


def comm_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = G.structural_measures(comm_ties(spark, sf_dir))
    return m.select("v", "degree", "triangles", _R("clustering").alias("clustering"), _R("effective_size").alias("effective_size"), _R("constraint").alias("burt_constraint"))


SQL["comm_structure"] = f"""WITH {_CONTACTS},
t AS (SELECT v, sum(weight) AS s, max(weight) AS x, count(*) AS k FROM ties GROUP BY v),
sh AS (SELECT ties.v, nb, weight / s AS p, weight / x AS m FROM ties JOIN t ON ties.v = t.v),
via AS (SELECT a.v AS i, a.nb AS j, sum(b.p * c.p) AS through, sum(b.p * c.m) AS redundant FROM sh a JOIN sh b ON a.v = b.v AND a.nb <> b.nb JOIN sh c ON c.v = a.nb AND c.nb = b.nb GROUP BY a.v, a.nb),
per AS (SELECT sh.v, sum(pow(p + coalesce(through, 0), 2)) AS con, sum(coalesce(redundant, 0)) AS red FROM sh LEFT JOIN via ON via.i = sh.v AND via.j = sh.nb GROUP BY sh.v),
tri AS (SELECT a.v, count(*) // 2 AS n FROM ties a JOIN ties b ON a.v = b.v AND a.nb <> b.nb JOIN ties c ON c.v = a.nb AND c.nb = b.nb GROUP BY a.v)
SELECT t.v, k AS degree, coalesce(n, 0) AS triangles, round(CASE WHEN k > 1 THEN coalesce(n, 0) / (k * (k - 1) / 2) ELSE 0.0::DOUBLE END, 6) AS clustering, round(k - red, 6) AS effective_size, round(con, 6) AS burt_constraint FROM t JOIN per USING (v) LEFT JOIN tri USING (v)"""


def comm_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from the five best connected authors to everyone."""
    ties = comm_ties(spark, sf_dir)
    top = ties.groupBy("v").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "v").limit(5)
    return G.hop_distances(ties, top)


SQL["comm_distances"] = f"""WITH RECURSIVE {_CONTACTS},
top AS (SELECT v FROM ties GROUP BY v ORDER BY count(*) DESC, v LIMIT 5),
walk(source, v, hops) USING KEY (source, v) AS (SELECT v, v, 0 FROM top UNION (SELECT w.source, t.nb, min(w.hops) + 1 FROM walk w JOIN ties t ON t.v = w.v LEFT JOIN recurring.walk r ON r.source = w.source AND r.v = t.nb WHERE r.v IS NULL GROUP BY w.source, t.nb))
SELECT source, v, hops FROM walk"""


def own_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "ownership_edges").select("source_id", "target_id")
    out = e.where("source_id IS NOT NULL").groupBy(F.col("source_id").alias("node")).agg(F.count(F.lit(1)).alias("o"))
    into = e.where("target_id IS NOT NULL").groupBy(F.col("target_id").alias("node")).agg(F.count(F.lit(1)).alias("i"))
    return out.join(into, "node", "full").select("node", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


SQL["own_degrees"] = "SELECT coalesce(a.n, b.n) AS node, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM (SELECT source_id AS n, count(*) AS o FROM ownership_edges WHERE source_id IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT target_id AS n, count(*) AS i FROM ownership_edges WHERE target_id IS NOT NULL GROUP BY 1) b ON a.n = b.n"


def own_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.owner_features(table(spark, sf_dir, "ownership_edges"), table(spark, sf_dir, "entities"))


_sec = "[" + ", ".join(f"'{s}'" for s in G.SECRECY) + "]"
_nom = " OR ".join(rf"regexp_matches(lower(name), '\b{w}\b')" for w in G.NOMINEE_WORDS)
SQL["own_features"] = f"""
WITH own AS (SELECT entity_id, min(jurisdiction) AS j, coalesce({_nom.replace('name', 'min(name)')}, false) AS nominee FROM entities WHERE entity_id IS NOT NULL GROUP BY entity_id),
l AS (SELECT source_id, target_id FROM ownership_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL),
f AS (SELECT source_id, count(*) AS fan FROM l GROUP BY 1),
r AS (SELECT l.target_id, o.j AS oj, o.nominee, fan FROM l JOIN own o ON o.entity_id = l.source_id JOIN f USING (source_id))
SELECT r.target_id, count(*) AS n_links, count(DISTINCT CASE WHEN oj <> '' THEN oj END) AS n_jurisdictions, count(*) FILTER (WHERE list_contains({_sec}, oj)) AS n_secrecy,
  CASE WHEN any_value(t.j) <> '' THEN count(DISTINCT CASE WHEN oj <> '' AND oj <> t.j THEN oj END) ELSE 0 END AS n_foreign, count(*) FILTER (WHERE r.nominee) AS n_nominee, max(fan) AS widest
FROM r JOIN own t ON t.entity_id = r.target_id GROUP BY r.target_id"""


def own_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.components(table(spark, sf_dir, "ownership_edges"), "source_id", "target_id")
    return c.groupBy("root").agg(F.count(F.lit(1)).alias("size"))


SQL["own_components"] = """
WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM ownership_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id),
t AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(v, root) USING KEY (v) AS (SELECT a, min(a) FROM t GROUP BY a UNION (SELECT t.b, min(w.root) FROM walk w JOIN t ON t.a = w.v JOIN recurring.walk r ON r.v = t.b WHERE w.root < r.root GROUP BY t.b))
SELECT root, count(*) AS size FROM walk GROUP BY root"""


def own_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.strongly_connected(table(spark, sf_dir, "ownership_edges").where("ceased_on IS NULL"), "source_id", "target_id")
    return s.groupBy("scc").agg(F.count(F.lit(1)).alias("size"), F.max("v").alias("last"))


SQL["own_cycles"] = """
WITH RECURSIVE e AS (SELECT DISTINCT source_id AS a, target_id AS b FROM ownership_edges WHERE ceased_on IS NULL AND source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id),
down(s, v) AS (SELECT a, b FROM e WHERE a IN (SELECT b FROM e) AND b IN (SELECT a FROM e) UNION SELECT d.s, e.b FROM down d JOIN e ON e.a = d.v),
same AS (SELECT x.s AS v, min(least(x.s, x.v)) AS scc FROM down x JOIN down y ON x.s = y.v AND x.v = y.s WHERE x.s <> x.v GROUP BY x.s)
SELECT scc, count(*) AS size, max(v) AS last FROM same GROUP BY scc"""


def own_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per root of the live subsidiary forest: entities below it and its deepest level."""
    f = ownership_hierarchy(table(spark, sf_dir, "ownership_edges"), table(spark, sf_dir, "entities"), with_path=False)
    return f.where("depth >= 0").groupBy("root_id").agg((F.count(F.lit(1)) - 1).alias("n_below"), F.max("depth").alias("height"))


SQL["own_heights"] = f"WITH RECURSIVE {_FOREST} SELECT root AS root_id, count(*) - 1 AS n_below, max(depth)::INTEGER AS height FROM walk GROUP BY root"


def own_transitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "ownership_edges").where("source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id")
    ties = e.select(F.explode(F.array(F.struct(F.col("source_id").alias("v"), F.col("target_id").alias("nb")), F.struct(F.col("target_id").alias("v"), F.col("source_id").alias("nb")))).alias("x")).select("x.*").distinct()
    tri = G.triangles(ties).select(F.explode(F.array("a", "b", "c")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    k = ties.groupBy("v").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return k.join(tri, "v", "left").select("v", _R(F.coalesce("n", F.lit(0)) / (F.col("k") * (F.col("k") - 1) / 2)).alias("transitivity"))


SQL["own_transitivity"] = """
WITH e AS (SELECT DISTINCT v, nb FROM (SELECT source_id AS v, target_id AS nb FROM ownership_edges UNION ALL SELECT target_id, source_id FROM ownership_edges) WHERE v IS NOT NULL AND nb IS NOT NULL AND v <> nb),
k AS (SELECT v, count(*) AS k FROM e GROUP BY v HAVING count(*) > 1),
tri AS (SELECT a.v, count(*) // 2 AS n FROM e c JOIN e a ON a.nb = c.v JOIN e b ON b.v = a.v AND b.nb = c.nb GROUP BY a.v)
SELECT v, round(coalesce(n, 0) / (k * (k - 1) / 2), 6) AS transitivity FROM k LEFT JOIN tri USING (v)"""


def address_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entities share each entity's address; an unknown address is its own."""
    e = table(spark, sf_dir, "entities").select("entity_id", F.lower(F.trim("address")).alias("address"))
    known = e.where("address <> ''")
    n = known.groupBy("address").agg(F.count(F.lit(1)).alias("n_there"))
    alone = e.where("address IS NULL OR address = ''").select("entity_id", F.lit(1).cast("long").alias("n_there"))
    return join_unique(known, n, "address", hot_keys(known, "address")).select("entity_id", "n_there").unionByName(alone)


SQL["address_concentration"] = "SELECT entity_id, CASE WHEN a IS NULL OR a = '' THEN 1 ELSE count(*) OVER (PARTITION BY a) END AS n_there FROM (SELECT entity_id, lower(trim(address)) AS a FROM entities)"


def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of organisations in different jurisdictions or registers under one normalised name (longer than three characters).

    One row per entity with its class (the least id) and the size of the class.
    """
    e = table(spark, sf_dir, "entities").where("name IS NOT NULL AND entity_type <> 'person'").select("entity_id", X.company_key(F.col("name")).alias("key")).where(F.length("key") > 3)
    classes = e.groupBy("key").agg(F.min("entity_id").alias("class_id"), F.countDistinct("entity_id").alias("n_same")).where("n_same > 1")
    return join_unique(e, classes, "key", hot_keys(e, "key")).select("entity_id", "class_id", "n_same", F.col("key").alias("matched"))


_key = rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '{X.LEGAL_SUFFIX}', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
SQL["entity_resolution"] = f"WITH e AS (SELECT entity_id, {_key} AS k FROM entities WHERE name IS NOT NULL AND entity_type <> 'person'), c AS (SELECT k, min(entity_id) AS class_id, count(DISTINCT entity_id) AS n_same FROM e WHERE length(k) > 3 GROUP BY k HAVING count(DISTINCT entity_id) > 1) SELECT entity_id, class_id, n_same, k AS matched FROM e JOIN c USING (k)"


def identity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of chat and tracker users resolved to roster records: exact, without ``@``, then by name patterns."""
    p = table(spark, sf_dir, "person_records")
    flat = lambda c: F.lower(F.trim(c))
    roster = p.where("source = 'static-csv'")
    name = F.split(F.lower(F.trim("name")), r"\s+")
    two = F.size(name) == 2
    first, last = name[0], name[1]
    exact = roster.where("github_handle <> ''").groupBy(flat(F.col("github_handle")).alias("k")).agg(F.min("record_id").alias("exact_id"))
    patterns = F.array(F.concat(first, last), F.concat(F.substring(first, 1, 1), last), F.concat(last, F.substring(first, 1, 1)), F.concat(last, first), F.concat(first, F.lit("."), last))
    named = roster.where(two).select("record_id", F.explode(F.array_distinct(patterns)).alias("k")).groupBy("k").agg(F.min("record_id").alias("name_id"))
    users = p.where("source IN ('slack-users', 'linear-users')").select("record_id", flat(F.coalesce(F.when(F.col("slack_handle") != "", F.col("slack_handle")), F.col("linear_display_name"))).alias("h")).where("h <> ''")
    users = users.select("record_id", F.regexp_replace("h", "^@", "").alias("k"))
    return users.join(exact, "k", "left").join(named, "k", "left").select("record_id", F.coalesce("exact_id", "name_id").alias("roster_id"), F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("name_id").isNotNull(), "pattern").otherwise("none").alias("how"))


SQL["identity_cascade"] = r"""
WITH r AS (SELECT record_id, github_handle, string_split_regex(lower(trim(name)), '\s+') AS n FROM person_records WHERE source = 'static-csv'),
ex AS (SELECT lower(trim(github_handle)) AS k, min(record_id) AS exact_id FROM r WHERE github_handle <> '' GROUP BY 1),
pt AS (SELECT k, min(record_id) AS name_id FROM (SELECT record_id, unnest([n[1] || n[2], n[1][1] || n[2], n[2] || n[1][1], n[2] || n[1], n[1] || '.' || n[2]]) AS k FROM r WHERE len(n) = 2) GROUP BY k),
u AS (SELECT record_id, regexp_replace(h, '^@', '') AS k FROM (SELECT record_id, lower(trim(coalesce(CASE WHEN slack_handle <> '' THEN slack_handle END, linear_display_name))) AS h FROM person_records WHERE source IN ('slack-users', 'linear-users')) WHERE h <> '')
SELECT record_id, coalesce(exact_id, name_id) AS roster_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN name_id IS NOT NULL THEN 'pattern' ELSE 'none' END AS how FROM u LEFT JOIN ex USING (k) LEFT JOIN pt USING (k)"""

#: The dense eigenvalue solver takes connected components of at most this many vertices, and says so beyond.
MAX_SPECTRUM = 2000


def repo_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplacian eigenvalues of the graph of repositories that share authors, weights 1 + ln(1 + shared).

    The spectrum of a graph is that of its connected components together, so each component is
    solved by itself; one with more than ``MAX_SPECTRUM`` vertices is an error, not cut.
    """
    shared = materialize(repo_flows(spark, sf_dir), "shared")
    roots = G.components(shared, "a", "b")
    parts = join_unique(shared.withColumn("v", F.col("a")), roots, "v", hot_keys(shared.withColumn("v", F.col("a")), "v")).select("root", "a", "b", "n_authors")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(frame["a"]) | set(frame["b"]))
        if len(names) > MAX_SPECTRUM:
            raise ValueError(f"a component of {len(names)} repositories is beyond the dense solver ({MAX_SPECTRUM})")
        at = {v: k for k, v in enumerate(names)}
        w = np.zeros((len(names), len(names)))
        i, j = frame["a"].map(at).to_numpy(), frame["b"].map(at).to_numpy()
        w[i, j] = w[j, i] = 1 + np.log1p(frame["n_authors"].to_numpy())
        values = np.linalg.eigvalsh(np.diag(w.sum(axis=1)) - w)
        return pd.DataFrame({"root": names[0], "k": np.arange(len(values)), "eigenvalue": np.round(values, 6)})

    return parts.groupBy("root").applyInPandas(solve, "root string, k long, eigenvalue double")


QUERIES = {f.__name__: f for f in (comm_edges, comm_decayed, comm_ties, comm_structure, comm_distances, own_degrees, own_features, own_components, own_cycles, own_heights, own_transitivity, address_concentration, entity_resolution, identity_cascade, repo_spectrum)}
