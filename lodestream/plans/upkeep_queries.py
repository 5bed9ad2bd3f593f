"""Queries on upkeep: framing clusters, token and dollar budgets, trends, silence texts, repository traces, merged topology; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.operators import structures as T
from lodestream.plans.activity_queries import SQL as ACTIVITY_SQL, cadence_silence, topic_action_ratio
from lodestream.plans.finding_queries import _FINDINGS, findings
from lodestream.plans.graph_queries import _CONTACTS, contacts
from lodestream.plans.rule_queries import SQL as RULE_SQL, _TRACES, business_weights, traces
from lodestream.scratch import materialize
from lodestream.sources.tables import table

_R = lambda c, n=6: F.round(c, n)


def framing_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the thousand findings most often seen (a top-k report), those framed alike (0.4 of the terms), and whether nobody acts on their terms.

    The similarity is that with the leader.
    """
    f = materialize(findings(spark, sf_dir).where(F.size("terms") > 0).orderBy(F.desc("times"), "finding").limit(1000).select("finding", "terms"), "framed")
    c = materialize(T.leader_clusters(f, "finding", "terms"), "leaders")
    size = c.groupBy("leader").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("leader") != F.col("id"), F.col("similarity"))).alias("similarity")).where("n >= 2")
    action = topic_action_ratio(spark, sf_dir).select(F.col("term").alias("t"), "ratio")
    ratio = c.join(f, c["id"] == f["finding"]).select("leader", F.explode("terms").alias("t")).distinct().join(action, "t").groupBy("leader").agg(F.avg("ratio").alias("action"))
    j = size.join(ratio, "leader", "left").withColumn("action", F.coalesce("action", F.lit(0.5)))
    return j.select("leader", "n", _R("similarity", 4).alias("similarity"), _R("action", 4).alias("action"), F.when((F.col("similarity") > 0.6) & (F.col("action") < 0.2), "critical").otherwise("warning").alias("severity"))


def token_allocation(spark: SparkSession, sf_dir: str, cap: int = 1_000_000, reserve: int = 100_000) -> DataFrame:
    """A daily cap of tokens, less a reserve, shared among channels by their business weight (whole tokens, rounded down)."""
    w = business_weights(spark, sf_dir).select("channel", "effective")
    total = w.agg(F.sum("effective").alias("t"))
    return w.crossJoin(F.broadcast(total)).select("channel", F.floor(_R((cap - reserve) * F.col("effective") / F.col("t"), 4)).alias("tokens"))


SQL = {"token_allocation": f"WITH w AS ({RULE_SQL['business_weights']}) SELECT channel, floor(round(900000 * effective / (SELECT sum(effective) FROM w), 4))::BIGINT AS tokens FROM w"}


def spend_warnings(spark: SparkSession, sf_dir: str, day_cap: float = 0.002, warn: float = 80.0) -> DataFrame:
    """Days by what reading their documents would cost (four characters a token, three dollars a million): fine, warned from 80 % on, exhausted."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND created_at IS NOT NULL").select(F.to_date("created_at").alias("day"), F.floor(F.length("text") / 4).alias("t"))
    per = d.groupBy("day").agg((F.sum("t") * 3 / 1e6).alias("usd"))
    share = _R(F.col("usd") / day_cap * 100, 4)
    return per.select(F.col("day").cast("string").alias("day"), _R("usd").alias("usd"), F.when(share >= 100, "exhausted").when(share >= warn, "warned").otherwise("fine").alias("status"))


SQL["spend_warnings"] = "WITH p AS (SELECT CAST(created_at AS DATE) AS day, sum(length(text) // 4) * 3 / 1000000.0::DOUBLE AS usd FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL GROUP BY 1) SELECT day::VARCHAR AS day, round(usd, 6) AS usd, CASE WHEN round(usd / 0.002::DOUBLE * 100, 4) >= 100 THEN 'exhausted' WHEN round(usd / 0.002::DOUBLE * 100, 4) >= 80 THEN 'warned' ELSE 'fine' END AS status FROM p"


def silence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that fell silent, as texts of a signal of their own."""
    c = cadence_silence(spark, sf_dir).where("silent")
    text = F.format_string("Cadence break: %s has gone quiet. Expected ~%.2f signals a day but actual is %d.", F.col("channel"), F.col("baseline"), F.col("n_last"))
    return c.select(F.concat(F.lit("silence:"), "channel").alias("id"), text.alias("content"), F.lit("cadence").alias("source"), "channel", _R(F.col("n_last") / F.col("baseline"), 4).alias("ratio"))


SQL["silence_signals"] = f"SELECT 'silence:' || channel AS id, printf('Cadence break: %s has gone quiet. Expected ~%.2f signals a day but actual is %d.', channel, baseline, n_last) AS content, 'cadence' AS source, channel, round(n_last / baseline, 4) AS ratio FROM ({ACTIVITY_SQL['cadence_silence']}) WHERE silent"


def source_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of chat in every month's signals, and its trend over three snapshots (rising or falling by more than 0.05)."""
    s = table(spark, sf_dir, "signals").where("received_at IS NOT NULL").groupBy(F.date_format("received_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "slack").alias("c"))
    s = s.select("month", "n", _R(F.col("c") / F.col("n")).alias("share"))
    # one row a month: few enough for one ordered pass
    before = F.lag("share", 2).over(Window.orderBy("month"))
    return s.withColumn("before", before).select("month", "n", "share", F.when(F.col("share") > F.col("before") + 0.05, "rising").when(F.col("share") < F.col("before") - 0.05, "falling").otherwise("stable").alias("trend"))


SQL["source_trends"] = "WITH m AS (SELECT strftime(received_at::TIMESTAMP, '%Y-%m') AS month, count(*) AS n, round(count(*) FILTER (WHERE source = 'slack') / count(*), 6) AS share FROM signals WHERE received_at IS NOT NULL GROUP BY 1), l AS (SELECT *, lag(share, 2) OVER (ORDER BY month) AS before FROM m) SELECT month, n, share, CASE WHEN share > before + 0.05::DOUBLE THEN 'rising' WHEN share < before - 0.05::DOUBLE THEN 'falling' ELSE 'stable' END AS trend FROM l"


def repo_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest five traces of every repository since mid 2024, oldest first."""
    t = traces(spark, sf_dir).where(F.col("received_at") >= F.lit("2024-07-01 00:00:00").cast("timestamp")).where("repo IS NOT NULL")
    last = t.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("received_at"), F.desc("delivery_no")))).where("k <= 5")
    return last.select("repo", "id", "delivery_no", "event", (6 - F.col("k")).alias("place"))


SQL["repo_traces"] = f"WITH {_TRACES} SELECT repo, id, delivery_no, event, 6 - row_number() OVER (PARTITION BY repo ORDER BY received_at DESC, delivery_no DESC) AS place FROM tr WHERE received_at >= TIMESTAMPTZ '2024-07-01 00:00:00+00' AND repo IS NOT NULL QUALIFY place >= 1"


def merged_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts after the two best connected people are merged into the first: the survivor takes over the other's neighbours."""
    e = contacts(spark, sf_dir).where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("nb")), F.struct(F.col("dst").alias("v"), F.col("src").alias("nb")))).alias("e")).select("e.*").distinct()
    e = materialize(e, "topology")
    top = e.groupBy("v").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "v").limit(2)
    pair = top.agg(F.array_sort(F.collect_list("v")).alias("both"))
    j = e.crossJoin(F.broadcast(pair.select(F.element_at("both", 1).alias("kept"), F.element_at("both", 2).alias("gone"))))
    new = lambda c: F.when(F.col(c) == F.col("gone"), F.col("kept")).otherwise(F.col(c)).alias(c)
    return j.select(new("v"), new("nb")).where("v <> nb").distinct().groupBy("v").agg(F.count(F.lit(1)).alias("n_neighbours"))


SQL["merged_topology"] = f"WITH {_CONTACTS}, top AS (SELECT v FROM ties GROUP BY v ORDER BY count(*) DESC, v LIMIT 2), p AS (SELECT min(v) AS kept, max(v) AS gone FROM top), m AS (SELECT DISTINCT CASE WHEN v = gone THEN kept ELSE v END AS v, CASE WHEN nb = gone THEN kept ELSE nb END AS nb FROM ties, p) SELECT v, count(*) AS n_neighbours FROM m WHERE v <> nb GROUP BY v"


def entity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about the same requests or tickets folded to the one seen most often (ties to the least id); others stay as they are."""
    f = findings(spark, sf_dir).select("finding", "times", F.lower("summary").alias("s"))
    named = lambda p, g: F.array_sort(F.array_distinct(F.regexp_extract_all("s", F.lit(p), F.lit(g))))
    keys = F.concat(F.transform(named(r"pr\s*#([0-9]+)", 1), lambda x: F.concat(F.lit("pr:"), x)), named(r"\b[a-z]{2,}-[0-9]+\b", 0))
    k = f.withColumn("key", F.when(F.size(keys) > 0, F.array_join(keys, "|")).otherwise(F.col("finding")))
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("n_folded"), F.max(F.struct("times", F.col("finding")))["times"].alias("times"), F.min_by("finding", F.struct((-F.col("times")).alias("t"), "finding")).alias("finding")).select("finding", "n_folded", "times")


SQL["entity_findings"] = rf"WITH {_FINDINGS}, k AS (SELECT finding, times, list_concat(list_transform(list_sort(list_distinct(regexp_extract_all(lower(summary), 'pr\s*#([0-9]+)', 1))), lambda x: 'pr:' || x), list_sort(list_distinct(regexp_extract_all(lower(summary), '\b[a-z]{{2,}}-[0-9]+\b')))) AS keys FROM findings) SELECT arg_min(finding, (-times, finding)) AS finding, count(*) AS n_folded, max(times) AS times FROM k GROUP BY CASE WHEN len(keys) > 0 THEN array_to_string(keys, '|') ELSE finding END"

QUERIES = {f.__name__: f for f in (framing_clusters, token_allocation, spend_warnings, silence_signals, source_trends, repo_traces, merged_topology, entity_findings)}
