"""Queries on the state of the mesh as a whole, and on patterns among its latest signals; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.plans.activity_queries import SQL as ACTIVITY_SQL, _channel, _SQL_CHANNEL, style_ema, topic_action_ratio
from lodestream.plans.finding_queries import SQL as FINDING_SQL, quorum_findings
from lodestream.plans.pipeline_queries import CONTEXTS, SQL as PIPELINE_SQL, familiarity_scores
from lodestream.plans.text_queries import sql_terms
from lodestream.sources.tables import table

_R = lambda c, n=6: F.round(c, n)
#: Above this share of all signals a worker is over-specialised.
MOST_SHARE, LEAST_DIVERSITY = 0.4, 0.3
#: The cache of signals that patterns are sought in (a ring buffer, as a feature).
CACHE = 500


def _workers(spark, sf_dir) -> DataFrame:
    """Seeded contexts as workers: signals taken in and their mean familiarity."""
    f = familiarity_scores(spark, sf_dir)
    taken = f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("worker"), F.col(f"f_{c}").alias("score")) for c in CONTEXTS])).alias("e")).select("e.*").where("score > 0.2")
    return taken.groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("familiarity"))


_taken = " UNION ALL ".join(f"SELECT '{c}' AS worker, f_{c} AS score FROM fs" for c in CONTEXTS)
_WORKERS = f"fs AS ({PIPELINE_SQL['familiarity_scores']}), w AS (SELECT worker, count(*) AS n, avg(score) AS familiarity FROM ({_taken}) WHERE score > 0.2 GROUP BY worker)"


def diversity_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variety of the workers against that of their load: diversity, reserve, over-specialised workers, and whether the variety suffices."""
    w = _workers(spark, sf_dir)
    total = w.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    p = w.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("t"))
    d = p.groupBy("k").agg((1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"), F.sum(-F.col("p") * F.log2("p")).alias("h"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("p") > MOST_SHARE, F.col("worker")))), ",").alias("over_specialised"))
    shannon = F.when(F.col("k") > 1, F.col("h") / F.log2(F.col("k").cast("double"))).otherwise(0.0)
    return d.select(_R("simpson").alias("worker_diversity"), _R(shannon).alias("source_diversity"), "over_specialised", _R(F.greatest(F.lit(0.0), F.col("simpson") - LEAST_DIVERSITY)).alias("reserve"), (_R("simpson") >= _R(shannon)).alias("variety_met"))


SQL = {"diversity_state": f"WITH {_WORKERS}, p AS (SELECT worker, n / (SELECT sum(n) FROM w) AS p FROM w), d AS (SELECT count(*) AS k, 1 - sum(p * p) AS s, sum(-p * log2(p)) AS h, coalesce(string_agg(worker, ',' ORDER BY worker) FILTER (WHERE p > {MOST_SHARE}), '') AS o FROM p), e AS (SELECT *, CASE WHEN k > 1 THEN h / log2(k::DOUBLE) ELSE 0.0::DOUBLE END AS sh FROM d) SELECT round(s, 6) AS worker_diversity, round(sh, 6) AS source_diversity, o AS over_specialised, round(greatest(0.0::DOUBLE, s - {LEAST_DIVERSITY}::DOUBLE), 6) AS reserve, round(s, 6) >= round(sh, 6) AS variety_met FROM e"}


def field_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence, entropy, resonance and substrate of the mesh: means of what is known of each."""
    w = _workers(spark, sf_dir)
    total = w.agg(F.sum("n").alias("t"))
    s = w.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("t")).agg(F.var_pop("familiarity").alias("var"), F.avg("familiarity").alias("fam"), F.sum(-F.col("p") * F.log2("p")).alias("h"), F.count(F.lit(1)).alias("k"), (1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"))
    q = quorum_findings(spark, sf_dir).agg(F.count(F.lit(1)).alias("q"), F.count_if("met").alias("met"))
    a = topic_action_ratio(spark, sf_dir).agg(F.avg(F.when(F.col("ratio") < 0.1, 1.0).otherwise(0.0)).alias("low"))
    c = style_ema(spark, sf_dir).agg(F.avg("ema").alias("ema"))
    j = s.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(c))
    coherence = (F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("var") / 0.25)) + F.col("met") / F.col("q")) / 2
    entropy = F.when(F.col("k") >= 2, F.col("h") / F.log2(F.col("k").cast("double"))).otherwise(0.5)
    resonance = (F.col("fam") + (1 - F.col("low")) + F.col("simpson")) / 3
    return j.select(_R(coherence, 5).alias("coherence"), _R(entropy, 5).alias("entropy"), _R(resonance, 5).alias("resonance"), _R(1 - F.col("ema"), 5).alias("substrate"))


SQL["field_state"] = f"WITH {_WORKERS}, p AS (SELECT familiarity, n / (SELECT sum(n) FROM w) AS p FROM w), s AS (SELECT var_pop(familiarity) AS v, avg(familiarity) AS f, sum(-p * log2(p)) AS h, count(*) AS k, 1 - sum(p * p) AS d FROM p), q AS (SELECT count(*) AS q, count(*) FILTER (WHERE met) AS m FROM ({FINDING_SQL['quorum_findings']})), a AS (SELECT avg(CASE WHEN ratio < 0.1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS low FROM ({ACTIVITY_SQL['topic_action_ratio']})), c AS (SELECT avg(ema) AS e FROM ({ACTIVITY_SQL['style_ema']})) SELECT round((greatest(0.0::DOUBLE, 1 - least(1.0::DOUBLE, v / 0.25::DOUBLE)) + m / q) / 2, 5) AS coherence, round(CASE WHEN k >= 2 THEN h / log2(k::DOUBLE) ELSE 0.5::DOUBLE END, 5) AS entropy, round((f + (1 - low) + d) / 3, 5) AS resonance, round(1 - e, 5) AS substrate FROM s, q, a, c"


def health_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh in one row: workers, what they took in, error (sum of 1 - familiarity), familiarity, findings and their quorums."""
    w = _workers(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_workers"), F.sum("n").alias("n_taken"), _R(F.sum(1 - F.col("familiarity")), 5).alias("error"), _R(F.avg("familiarity"), 5).alias("familiarity"))
    q = quorum_findings(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_findings"), F.count_if("met").alias("n_met"))
    return w.crossJoin(F.broadcast(q))


SQL["health_pulse"] = f"WITH {_WORKERS} SELECT count(*) AS n_workers, sum(n)::BIGINT AS n_taken, round(sum(1 - familiarity), 5) AS error, round(avg(familiarity), 5) AS familiarity, (SELECT count(*) FROM ({FINDING_SQL['quorum_findings']})) AS n_findings, (SELECT count(*) FROM ({FINDING_SQL['quorum_findings']}) WHERE met) AS n_met FROM w"


def recurring_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the latest five hundred signals, those that two or more authors' others of the day before echo (a quarter of the terms)."""
    s = table(spark, sf_dir, "signals").where("content IS NOT NULL AND author IS NOT NULL AND received_at IS NOT NULL").select("delivery_no", F.lower(F.regexp_replace("author", "^@", "")).alias("author"), "source", F.unix_micros("received_at").alias("us"), X.terms(F.col("content")).alias("terms"))
    c = s.where(F.size("terms") > 0).orderBy(F.desc("us"), F.desc("delivery_no")).limit(CACHE)
    one = c.select("delivery_no", "author", "us", F.size("terms").alias("k"), F.explode("terms").alias("t"))
    two = c.select(F.col("delivery_no").alias("other"), F.col("author").alias("who"), F.col("us").alias("at"), F.size("terms").alias("m"), F.explode("terms").alias("t"))
    pairs = one.join(two, "t").where((F.col("delivery_no") != F.col("other")) & (F.col("at") <= F.col("us")) & (F.col("at") >= F.col("us") - 86_400_000_000)).groupBy("delivery_no", "k", "other", "who", "m").agg(F.count(F.lit(1)).alias("both"))
    like = pairs.where(F.col("both") / (F.col("k") + F.col("m") - F.col("both")) >= 0.25)
    return like.groupBy("delivery_no").agg(F.count(F.lit(1)).alias("n_like"), F.count_distinct("who").alias("n_authors")).where("n_like >= 2 AND n_authors >= 2").withColumn("confidence", F.least(F.lit(1.0), F.col("n_like") / 5))


SQL["recurring_themes"] = f"WITH c AS (SELECT delivery_no, lower(regexp_replace(author, '^@', '')) AS author, epoch_us(received_at) AS us, {sql_terms('content')} AS terms FROM signals WHERE content IS NOT NULL AND author IS NOT NULL AND received_at IS NOT NULL AND len({sql_terms('content')}) > 0 ORDER BY us DESC, delivery_no DESC LIMIT {CACHE}), p AS (SELECT a.delivery_no, b.author AS who, len(list_intersect(a.terms, b.terms)) AS i, len(a.terms) AS k, len(b.terms) AS m FROM c a JOIN c b ON a.delivery_no <> b.delivery_no AND b.us <= a.us AND b.us >= a.us - 86400000000) SELECT delivery_no, count(*) AS n_like, count(DISTINCT who) AS n_authors, least(1.0::DOUBLE, count(*) / 5) AS confidence FROM p WHERE i > 0 AND i / (k + m - i) >= 0.25 GROUP BY delivery_no HAVING count(*) >= 2 AND count(DISTINCT who) >= 2"


def first_seen_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the days since they were first and last heard in each channel: when what is known of them is old."""
    s = table(spark, sf_dir, "signals").where("received_at IS NOT NULL AND channel IS NOT NULL").select("source", _channel().alias("channel"), F.unix_micros("received_at").alias("us"))
    end = s.agg(F.max("us").alias("end"))
    per = s.groupBy("source", "channel").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    day = 86_400_000_000.0
    d = per.crossJoin(F.broadcast(end)).select("source", ((F.col("end") - F.col("a")) / day).alias("since"), ((F.col("end") - F.col("b")) / day).alias("quiet"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n_channels"), _R(F.max("since"), 4).alias("oldest"), _R(F.avg("quiet"), 4).alias("mean_quiet"), F.count_if(F.col("quiet") >= 14).alias("n_quiet"))


SQL["first_seen_stages"] = f"WITH s AS (SELECT source, {_SQL_CHANNEL} AS channel, epoch_us(received_at) AS us FROM signals WHERE received_at IS NOT NULL AND channel IS NOT NULL), p AS (SELECT source, channel, ((SELECT max(us) FROM s) - min(us)) / 86400000000.0::DOUBLE AS since, ((SELECT max(us) FROM s) - max(us)) / 86400000000.0::DOUBLE AS quiet FROM s GROUP BY 1, 2) SELECT source, count(*) AS n_channels, round(max(since), 4) AS oldest, round(avg(quiet), 4) AS mean_quiet, count(*) FILTER (WHERE quiet >= 14) AS n_quiet FROM p GROUP BY source"


def shared_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations as repositories and the brands they buy as packages: how many packages each shares with another, and with how many."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("repo"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("package"))
    d = li.join(o, "o_orderkey").join(c, "o_custkey").join(p, "p_partkey").groupBy("repo", "package").agg(F.count(F.lit(1)).alias("n"))
    users = d.groupBy("package").agg(F.count(F.lit(1)).alias("k"))
    return d.join(users, "package").groupBy("repo").agg(F.count(F.lit(1)).alias("n_packages"), F.count_if(F.col("k") > 1).alias("n_shared"), F.sum("n").alias("n_uses"))


SQL["shared_packages"] = "WITH d AS (SELECT c_nationkey AS repo, concat_ws('/', p_brand, p_size) AS package, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), u AS (SELECT package, count(*) AS k FROM d GROUP BY 1) SELECT repo, count(*) AS n_packages, count(*) FILTER (WHERE k > 1) AS n_shared, sum(n)::BIGINT AS n_uses FROM d JOIN u USING (package) GROUP BY repo"

QUERIES = {f.__name__: f for f in (diversity_state, field_state, health_pulse, recurring_themes, first_seen_stages, shared_packages)}
