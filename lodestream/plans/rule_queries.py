"""Queries on traces, policy, budgets, redaction, structural coefficients, weights and field state; with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import scoring as S, text as X
from lodestream.plans.activity_queries import _SQL_CHANNEL, _channel
from lodestream.plans.pipeline_queries import CONTEXTS, SQL as PIPELINE_SQL, familiarity_scores
from lodestream.plans.text_queries import _list, _lit, _meta, _sql_meta, sql_terms
from lodestream.sources.tables import table

_R = lambda c, n=6: F.round(c, n)


# ---- traces and policy ----------------------------------------------------------------------


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace events of code hosting: ``id, delivery_no, repo, author, event, files, additions, deletions, received_at, title``."""
    s = table(spark, sf_dir, "signals").where("source = 'github' AND content IS NOT NULL AND received_at IS NOT NULL")
    m = F.from_json("metadata", "event_type string, pr_number string, issue_number string, files_changed array<string>, additions bigint, deletions bigint")
    s = s.select("delivery_no", _channel().alias("repo"), F.lower(F.regexp_replace("author", "^@", "")).alias("author"), "received_at", F.substring(F.split_part("content", F.lit("\n"), F.lit(1)), 1, 200).alias("title"), m.alias("m"))
    event = F.coalesce("m.event_type", F.lit("unknown"))
    identifier = F.coalesce("m.pr_number", "m.issue_number", F.col("delivery_no").cast("string"))
    return s.select(
        S.trace_id(event, F.coalesce("repo", F.lit("")), identifier).alias("id"), "delivery_no", "repo", "author", event.alias("event"), F.coalesce("m.files_changed", F.array().cast("array<string>")).alias("files"),
        F.coalesce("m.additions", F.lit(0)).alias("additions"), F.coalesce("m.deletions", F.lit(0)).alias("deletions"), "received_at", "title",
    )


_M = "CASE WHEN json_valid(metadata) THEN metadata END"
_TRACES = f"""tr0 AS (SELECT delivery_no, {_SQL_CHANNEL} AS repo, lower(regexp_replace(author, '^@', '')) AS author, received_at, substr(split_part(content, chr(10), 1), 1, 200) AS title, {_M} AS m FROM signals WHERE source = 'github' AND content IS NOT NULL AND received_at IS NOT NULL),
tr AS (SELECT substr(sha256(coalesce(json_extract_string(m, '$.event_type'), 'unknown') || ':' || coalesce(repo, '') || ':' || coalesce(json_extract_string(m, '$.pr_number'), json_extract_string(m, '$.issue_number'), delivery_no::VARCHAR)), 1, 20) AS id, delivery_no, repo, author, coalesce(json_extract_string(m, '$.event_type'), 'unknown') AS event, coalesce(json_extract_string(m, '$.files_changed[*]'), []::VARCHAR[]) AS files, coalesce(json_extract_string(m, '$.additions')::BIGINT, 0) AS additions, coalesce(json_extract_string(m, '$.deletions')::BIGINT, 0) AS deletions, received_at, title FROM tr0)"""


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trace id: its first event, and how often it was recorded."""
    t = traces(spark, sf_dir)
    first = t.groupBy("id").agg(F.min_by(F.struct("repo", "author", "event", "title"), F.struct("received_at", "delivery_no")).alias("f"), F.count(F.lit(1)).alias("n"))
    return first.select("id", "f.repo", "f.author", "f.event", F.md5("f.title").alias("title"), "n")


SQL = {"trace_events": f"WITH {_TRACES}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at, delivery_no) AS k, count(*) OVER (PARTITION BY id) AS n FROM tr) SELECT id, repo, author, event, md5(title) AS title, n FROM r WHERE k = 1"}


def recent_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty latest traces (a top-k report)."""
    return traces(spark, sf_dir).orderBy(F.desc("received_at"), F.desc("delivery_no")).limit(50).select("id", "delivery_no", F.unix_micros("received_at").alias("us"))


SQL["recent_traces"] = f"WITH {_TRACES} SELECT id, delivery_no, epoch_us(received_at) AS us FROM tr ORDER BY received_at DESC, delivery_no DESC LIMIT 50"


def policy_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traces(spark, sf_dir).select("delivery_no", "repo", "author", F.explode(S.policy_signals(F.col("files"), F.col("additions") + F.col("deletions"))).alias("s"))
    return t.select("delivery_no", "repo", "author", F.col("s.kind").alias("kind"), F.col("s.detail").alias("detail"))


_domains = "list_sort(list_distinct(flatten(list_transform(files, lambda f: list_filter([" + ", ".join(f"CASE WHEN contains(f, '{p}') THEN '{d}' END" for p, d in S.PATH_DOMAINS) + "], lambda d: d IS NOT NULL)))))"
_auth = f"list_filter(files, lambda f: regexp_matches(f, {_lit(S.AUTH_PATHS.removeprefix('(?i)'))}, 'i'))"
_POLICY = f"""{_TRACES}, pd AS (SELECT *, {_domains} AS domains, {_auth} AS auth, additions + deletions AS diff FROM tr),
ps AS (SELECT delivery_no, repo, author, received_at, 'dependency_crossing' AS kind, array_to_string(domains, ',') AS detail FROM pd WHERE len(domains) > 1 UNION ALL SELECT delivery_no, repo, author, received_at, 'auth_surface_touched', array_to_string(auth, ',') FROM pd WHERE len(auth) > 0 UNION ALL SELECT delivery_no, repo, author, received_at, 'high_churn', diff::VARCHAR FROM pd WHERE diff > {S.HIGH_CHURN})"""
SQL["policy_signals"] = f"WITH {_POLICY} SELECT delivery_no, repo, author, kind, detail FROM ps"


def _status(spark, sf_dir):
    b = table(spark, sf_dir, "budget_entries").where("value IS NOT NULL AND repo IS NOT NULL AND received_at IS NOT NULL")
    end = b.agg(F.max("received_at").alias("end"))
    recent = b.crossJoin(F.broadcast(end)).where(F.col("received_at") > F.col("end") - F.expr("INTERVAL 7 DAYS")).where(F.col("metric").isin(*S.BUDGETS))
    limit = S.looked_up(F.col("metric"), S.BUDGETS, 0)
    return recent.groupBy("repo", "metric").agg(F.sum("value").alias("current")).select("repo", "metric", "current", limit.alias("threshold"), _R(F.col("current") / limit, 2).alias("utilization"), (F.col("current") > limit).alias("exceeded"))


_limit = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.BUDGETS.items()) + " ELSE 0 END"
_STATUS = f"bs AS (SELECT repo, metric, sum(value)::BIGINT AS current, ({_limit})::INTEGER AS threshold FROM budget_entries WHERE value IS NOT NULL AND repo IS NOT NULL AND received_at > (SELECT max(received_at) FROM budget_entries WHERE value IS NOT NULL AND repo IS NOT NULL) - INTERVAL 7 DAYS AND list_contains({_list(S.BUDGETS)}, metric) GROUP BY repo, metric)"


def budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of the last week against its limits, per repository and metric."""
    return _status(spark, sf_dir)


SQL["budget_status"] = f"WITH {_STATUS} SELECT repo, metric, current, threshold, round(current / threshold, 2) AS utilization, current > threshold AS exceeded FROM bs"


def policy_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of structure in repositories whose budget for that kind is exceeded: nothing else calls for intervention."""
    metric = S.looked_up(F.col("kind"), {"dependency_crossing": "dependency_crossings", "auth_surface_touched": "auth_touches", "high_churn": "diff_lines"}, None)
    over = _status(spark, sf_dir).where("exceeded").select("repo", "metric", "current", "threshold")
    return policy_signals(spark, sf_dir).withColumn("metric", metric).join(over, ["repo", "metric"]).select("delivery_no", "repo", "kind", "current", "threshold")


SQL["policy_interventions"] = f"WITH {_POLICY}, {_STATUS} SELECT delivery_no, ps.repo, kind, current, threshold FROM ps JOIN bs ON bs.repo = ps.repo AND bs.metric = CASE kind WHEN 'dependency_crossing' THEN 'dependency_crossings' WHEN 'auth_surface_touched' THEN 'auth_touches' ELSE 'diff_lines' END WHERE current > threshold"


def recorded_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget rows that traces give rise to: changed lines, crossings and auth touches per repository."""
    t = traces(spark, sf_dir)
    found = S.policy_signals(F.col("files"), F.col("additions") + F.col("deletions"))["kind"]
    diff = F.col("additions") + F.col("deletions")
    rows = F.array(F.struct(F.lit("diff_lines").alias("metric"), diff.alias("value")), F.struct(F.lit("dependency_crossings").alias("metric"), F.array_contains(found, "dependency_crossing").cast("long").alias("value")), F.struct(F.lit("auth_touches").alias("metric"), F.array_contains(found, "auth_surface_touched").cast("long").alias("value")))
    return t.where("repo IS NOT NULL").select("repo", F.inline(rows)).where("value > 0").groupBy("repo", "metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


SQL["recorded_budgets"] = f"WITH {_POLICY}, r AS (SELECT repo, 'diff_lines' AS metric, diff AS value FROM pd WHERE diff > 0 UNION ALL SELECT repo, 'dependency_crossings', 1 FROM pd WHERE len(domains) > 1 UNION ALL SELECT repo, 'auth_touches', 1 FROM pd WHERE len(auth) > 0) SELECT repo, metric, count(*) AS n, sum(value)::BIGINT AS total FROM r WHERE repo IS NOT NULL GROUP BY repo, metric"


def repo_flow_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of the flow within each repository: 1 + ln(1 + changed lines) per trace, 1 where nothing changed."""
    diff = F.col("additions") + F.col("deletions")
    return traces(spark, sf_dir).where("repo IS NOT NULL").groupBy("repo").agg(F.count(F.lit(1)).alias("n"), _R(F.sum(F.when(diff > 0, 1 + F.log1p(diff.cast("double"))).otherwise(1.0)), 4).alias("weight"))


SQL["repo_flow_weights"] = f"WITH {_TRACES} SELECT repo, count(*) AS n, round(sum(CASE WHEN additions + deletions > 0 THEN 1 + ln(1 + additions + deletions) ELSE 1.0::DOUBLE END), 4) AS weight FROM tr WHERE repo IS NOT NULL GROUP BY repo"


# ---- redaction ------------------------------------------------------------------------------


def redacted_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person records as internal readers may see them: confidential addresses are hidden, log lines are public."""
    p = table(spark, sf_dir, "person_records").where("record_id IS NOT NULL")
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    hidden = F.when(some("email") == "", "").otherwise("[REDACTED]")
    log = F.concat(F.col("record_id").cast("string"), F.when(some("team") != "", F.concat(F.lit(" ("), F.col("team"), F.lit(")"))).otherwise(""))
    return p.select("record_id", some("name").alias("name"), hidden.alias("email"), S.redacted_identifier(some("email")).alias("masked"), log.alias("log_line"))


SQL["redacted_profiles"] = "SELECT record_id, coalesce(name, '') AS name, CASE WHEN coalesce(email, '') = '' THEN '' ELSE '[REDACTED]' END AS email, CASE WHEN contains(coalesce(email, ''), '@') AND contains(split_part(email, '@', -1), '.') THEN substr(email, 1, 1) || '***@***' ELSE coalesce(email, '') END AS masked, record_id::VARCHAR || CASE WHEN coalesce(team, '') <> '' THEN ' (' || team || ')' ELSE '' END AS log_line FROM person_records WHERE record_id IS NOT NULL"


# ---- structural coefficients ----------------------------------------------------------------


def transaction_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven coefficients and their levels per vector: the first 40 features are its own, the others its neighbourhood's; degrees from its label and number."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), (F.col("label") % 5).alias("i"), (F.col("vec_id") % 7).alias("o"))
    e = e.select("vec_id", F.slice("v", 1, 40).alias("own"), F.slice("v", 41, 24).alias("near"), "i", "o")
    c = S.transaction_coefficients(F.col("own"), F.col("near"), F.col("i"), F.col("o"))
    e = e.select("vec_id", *[_R(x, 5).alias(n) for n, x in c.items()])
    return e.withColumn("levels", F.concat_ws(" ", *[F.concat(S.level(F.col(n)), F.lit("_" + n)) for n in c]))


_clip = lambda x: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
_sig = lambda x, m, s: f"(1 / (1 + exp(-{s}::DOUBLE * ({x} - {m}::DOUBLE))))"
_level = lambda n: f"CASE WHEN {n} > 0.7 THEN 'high' WHEN {n} > 0.3 THEN 'mid' ELSE 'low' END || '_{n}'"
_COEF = {
    "frag": _clip(_sig("o", 3.0, 0.8)), "relay": f"CASE WHEN i + o > 0 THEN {_clip('(1 - abs(i - o) / (i + o)) * ' + _sig('(i + o)', 4.0, 0.5))} ELSE 0.0::DOUBLE END", "variance": _clip("ls / 3"),
    "divergence": f"CASE WHEN ns > 0 AND ls > 0 THEN {_clip('abs(nm - lm) / greatest(ls, 0.01::DOUBLE) / 3')} ELSE 0.0::DOUBLE END", "density": "CASE WHEN ls > 0 THEN len(list_filter(own, lambda x: abs((x - lm) / ls) > 2)) / len(own) ELSE 0.0::DOUBLE END",
    "fan": "CASE WHEN i + o > 0 THEN ((o - i) / (o + i) + 1) / 2 ELSE 0.5::DOUBLE END", "complexity": f"CASE WHEN nm <> 0 THEN {_clip('ns / abs(nm) / 3')} ELSE 0.0::DOUBLE END",
}
SQL["transaction_coefficients"] = f"""WITH e AS (SELECT vec_id, (embedding::DOUBLE[])[1:40] AS own, (embedding::DOUBLE[])[41:64] AS near, label % 5 AS i, vec_id % 7 AS o FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
s AS (SELECT *, list_avg(own) AS lm, list_stddev_pop(own) AS ls, list_avg(near) AS nm, list_stddev_pop(near) AS ns FROM e),
c AS (SELECT vec_id, {', '.join(f'round({x}, 5) AS {n}' for n, x in _COEF.items())} FROM s)
SELECT *, concat_ws(' ', {', '.join(_level(n) for n in _COEF)}) AS levels FROM c"""


def wallet_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven coefficients per customer, whose orders stand for a wallet's transactions (finished ones for sent ones, days for blocks, clerks' priorities for partners)."""
    o = table(spark, sf_dir, "orders").where("o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = o.withColumn("gap", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)))
    per = o.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("k")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("partners"), F.count_if(F.col("k") > 1).alias("repeated"))
    a = o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("txs"), F.count_if(F.col("o_orderstatus") == "F").alias("sent"), F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("max"), F.avg("gap").alias("gap_mean"), F.max("gap").alias("gap_max"), F.median("gap").alias("gap_median"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("lifetime"), (F.min("o_totalprice") / F.sum("o_totalprice") / 100).alias("fee_share"),
    ).join(per, "o_custkey")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    names = ("txs", "sent", "mean", "max", "gap_mean", "gap_max", "gap_median", "lifetime", "fee_share", "partners", "repeated")
    return a.select("o_custkey", *[_R(x, 5).alias(n) for n, x in S.wallet_coefficients({n: zero(n) for n in names}).items()])


_z = lambda c: f"coalesce({c}, 0)"
SQL["wallet_coefficients"] = f"""WITH o AS (SELECT *, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
p AS (SELECT o_custkey, count(*) AS partners, count(*) FILTER (WHERE k > 1) AS repeated FROM (SELECT o_custkey, o_orderpriority, count(*) AS k FROM o GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT o_custkey, count(*) AS txs, count(*) FILTER (WHERE o_orderstatus = 'F') AS sent, avg(o_totalprice) AS mean, max(o_totalprice) AS mx, avg(gap) AS gm, max(gap) AS gx, median(gap) AS gd, date_diff('day', min(o_orderdate), max(o_orderdate)) AS life, min(o_totalprice) / sum(o_totalprice) / 100 AS fee FROM o GROUP BY 1)
SELECT o_custkey, round({_clip('sent / txs')}, 5) AS asymmetry, round(CASE WHEN mean > 0 AND mx > 0 THEN {_clip(_sig('mx / mean', 5.0, 0.5))} ELSE 0.0::DOUBLE END, 5) AS concentration, round(CASE WHEN {_z('gm')} > 0 AND {_z('gx')} > 0 THEN {_clip('gd / gx')} ELSE 0.0::DOUBLE END, 5) AS regularity,
  round({_clip(_sig('partners / txs', 2.0, 1.0))}, 5) AS partners, round({_clip('fee * 100')}, 5) AS fees, round(CASE WHEN {_z('life')} > 0 THEN {_clip(_sig('txs / life * 1000', 1.0, 2.0))} ELSE 1.0::DOUBLE END, 5) AS intensity, round({_clip('repeated / partners')}, 5) AS repetition FROM a JOIN p USING (o_custkey)"""


# ---- weights, energy, field state -----------------------------------------------------------


def business_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every channel from four metrics (frequency, seniority, gravity, engagement), and its place in the routing order."""
    s = table(spark, sf_dir, "signals").where("channel IS NOT NULL").select(_channel().alias("channel"), F.lower(F.regexp_replace("author", "^@", "")).alias("author"), "source", F.coalesce(_meta("is_thread_reply") == "true", F.lit(False)).alias("reply"))
    c = s.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author").alias("k"), F.count_if(F.col("source") == "github").alias("g"), F.count_if("reply").alias("r"))
    top = c.agg(F.max("n").alias("tn"), F.max("k").alias("tk"))
    m = c.crossJoin(F.broadcast(top))
    raw, effective = S.business_weight([F.col("n") / F.col("tn"), F.when(F.col("tk") > 0, F.col("k") / F.col("tk")).otherwise(0.0), F.col("g") / F.col("n"), F.col("r") / F.col("n")])
    m = m.select("channel", _R(raw, 5).alias("raw"), _R(effective, 5).alias("effective"))
    return m.withColumn("place", F.rank().over(Window.partitionBy(F.substring("channel", 1, 1)).orderBy(F.desc("effective"), "channel")))


SQL["business_weights"] = f"WITH s AS (SELECT {_SQL_CHANNEL} AS channel, lower(regexp_replace(author, '^@', '')) AS author, source, coalesce({_sql_meta('is_thread_reply')} = 'true', false) AS reply FROM signals WHERE channel IS NOT NULL), c AS (SELECT channel, count(*) AS n, count(DISTINCT author) AS k, count(*) FILTER (WHERE source = 'github') AS g, count(*) FILTER (WHERE reply) AS r FROM s GROUP BY channel), w AS (SELECT channel, 0.25::DOUBLE * (n / (SELECT max(n) FROM c)) + 0.25::DOUBLE * (k / (SELECT max(k) FROM c)) + 0.25::DOUBLE * (g / n) + 0.25::DOUBLE * (r / n) AS w FROM c), r AS (SELECT channel, round(w, 5) AS raw, round(greatest(w, 0.1::DOUBLE), 5) AS effective FROM w) SELECT *, rank() OVER (PARTITION BY substr(channel, 1, 1) ORDER BY effective DESC, channel) AS place FROM r"


def context_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy, life-cycle status, fork and gap thresholds of every seeded context after the signals it takes in (more familiar than 0.2)."""
    f = familiarity_scores(spark, sf_dir).join(table(spark, sf_dir, "signals").select("delivery_no", "received_at"), "delivery_no")
    taken = f.select("received_at", F.explode(F.array(*[F.struct(F.lit(c).alias("context"), F.col(f"f_{c}").alias("score")) for c in CONTEXTS])).alias("e")).select("received_at", "e.*").where("score > 0.2 AND received_at IS NOT NULL")
    c = taken.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("base"), F.avg("score").alias("mean"), F.max(F.unix_micros("received_at")).alias("last"))
    end = f.agg(F.max(F.unix_micros("received_at")).alias("end"))
    c = c.crossJoin(F.broadcast(end))
    level = S.energy(F.col("base"), 0.00001, (F.col("end") - F.col("last")) / 1e6)
    return c.select("context", "n", _R(level, 3).alias("energy"), S.energy_status(level).alias("status"), S.should_fork(F.col("n"), F.col("mean")).alias("forks"), _R(S.gap_threshold(F.col("n").cast("double"))).alias("gap_threshold"))


_taken = " UNION ALL ".join(f"SELECT '{c}' AS context, f_{c} AS score, received_at FROM f" for c in CONTEXTS)
SQL["context_states"] = f"WITH f AS (SELECT q.*, received_at FROM ({PIPELINE_SQL['familiarity_scores']}) q JOIN (SELECT delivery_no, received_at FROM signals) USING (delivery_no)), t AS (SELECT * FROM ({_taken}) WHERE score > 0.2 AND received_at IS NOT NULL), c AS (SELECT context, count(*) AS n, sum(score) AS base, avg(score) AS mean, max(epoch_us(received_at)) AS last FROM t GROUP BY context), e AS (SELECT *, base * exp(-0.00001::DOUBLE * ((SELECT max(epoch_us(received_at)) FROM f) - last) / 1000000.0::DOUBLE) AS en FROM c) SELECT context, n, round(en, 3) AS energy, CASE WHEN en < 0.05 THEN 'archived' WHEN en < 0.3 THEN 'decaying' ELSE 'active' END AS status, n > 100 OR (n > 10 AND mean < 0.5) AS forks, round(CASE WHEN n < 10 THEN 0.0::DOUBLE WHEN n < 50 THEN 0.08::DOUBLE * (n - 10) / 40 ELSE 0.08::DOUBLE END, 6) AS gap_threshold FROM e"


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that no seeded context knows (all scores below 0.1), per source."""
    top = F.greatest(*[F.col(f"f_{c}") for c in CONTEXTS])
    f = familiarity_scores(spark, sf_dir).select("delivery_no", top.alias("top")).join(table(spark, sf_dir, "signals").select("delivery_no", "source"), "delivery_no")
    return f.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("top") < 0.1).alias("n_gaps"), _R(F.stddev_samp("top"), 5).alias("spread"))


SQL["coverage_gaps"] = f"WITH f AS (SELECT source, greatest({', '.join('f_' + c for c in CONTEXTS)}) AS top FROM ({PIPELINE_SQL['familiarity_scores']}) JOIN (SELECT delivery_no, source FROM signals) USING (delivery_no)) SELECT source, count(*) AS n, count(*) FILTER (WHERE top < 0.1) AS n_gaps, round(stddev_samp(top), 5) AS spread FROM f GROUP BY source"


def calibration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score over each user's last fifty forecasts (an event's value squashed to 0..1, against whether it was a purchase), its partitions, babbling, and the score after a session's decay."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    f = F.col("value") / (1 + F.abs("value"))
    err = F.pow((f + 1) / 2 - F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0), 2)
    r = e.select("user_id", err.alias("err"), F.row_number().over(w).alias("k")).where("k <= 50")
    c = r.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("err").alias("brier"), F.array_sort(F.collect_list(F.struct("k", "err"))).alias("x"))
    keep = F.greatest(F.lit(1), F.floor(F.col("n") * 0.95).cast("int"))
    decayed = F.aggregate(F.slice("x", F.lit(1), keep), F.lit(0.0), lambda s, x: s + x["err"]) / keep
    return c.select("user_id", "n", _R("brier", 5).alias("brier"), _R(S.brier_partitions(F.col("brier")), 4).alias("n_star"), (_R("brier", 5) > 0.33).alias("babbling"), _R(decayed, 5).alias("decayed"))


SQL["calibration_scores"] = "WITH r AS (SELECT user_id, pow((value / (1 + abs(value)) + 1) / 2 - CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 2) AS err, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL QUALIFY k <= 50), c AS (SELECT user_id, count(*) AS n, avg(err) AS b FROM r GROUP BY 1), d AS (SELECT r.user_id, avg(err) AS d FROM r JOIN c ON c.user_id = r.user_id AND r.k <= greatest(1, floor(c.n * 0.95)) GROUP BY 1) SELECT user_id, n, round(b, 5) AS brier, round(greatest(1.0::DOUBLE, -0.5::DOUBLE + 0.5::DOUBLE * sqrt(1 + 2 / greatest(b, 0.01::DOUBLE))), 4) AS n_star, round(b, 5) > 0.33 AS babbling, round(d, 5) AS decayed FROM c JOIN d USING (user_id)"


def breathing_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the thresholds breathe: phase and modulation at every signal's index, summed up by phase."""
    phase, modulation = S.breathing(F.col("delivery_no"))
    s = table(spark, sf_dir, "signals").where("delivery_no IS NOT NULL").select(phase.alias("phase"), modulation.alias("m"))
    return s.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), _R(F.min("m"), 5).alias("least"), _R(F.max("m"), 5).alias("most"), _R(F.avg("m"), 5).alias("mean"))


_pos = "(delivery_no % 200 / 200)"
SQL["breathing_phases"] = f"WITH s AS (SELECT {_pos} AS p FROM signals WHERE delivery_no IS NOT NULL), m AS (SELECT CASE WHEN p < 0.6 THEN 'accumulate' ELSE 'integrate' END AS phase, CASE WHEN p < 0.6 THEN -0.1::DOUBLE * sin({math.pi!r}::DOUBLE * (p / 0.6::DOUBLE)) ELSE 0.1::DOUBLE * sin({math.pi!r}::DOUBLE * ((p - 0.6::DOUBLE) / 0.4::DOUBLE)) END AS m FROM s) SELECT phase, count(*) AS n, round(min(m), 5) AS least, round(max(m), 5) AS most, round(avg(m), 5) AS mean FROM m GROUP BY phase"


def source_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per channel, how much the variety of authors shrank in its last week more than its volume did (both against the week before)."""
    s = table(spark, sf_dir, "signals").where("received_at IS NOT NULL AND author IS NOT NULL AND channel IS NOT NULL").select(_channel().alias("channel"), F.lower(F.regexp_replace("author", "^@", "")).alias("author"), "received_at")
    end = s.agg(F.max("received_at").alias("end"))
    back = F.floor((F.unix_micros("end") - F.unix_micros("received_at")) / (7 * 86_400_000_000)).cast("int")
    per = s.crossJoin(F.broadcast(end)).withColumn("week", back).where("week < 2").groupBy("channel", "week", "author").agg(F.count(F.lit(1)).alias("n"))
    # the entropy in one aggregation, from sums of counts
    e = per.groupBy("channel", "week").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("nl"))
    e = e.withColumn("h", F.log2(F.col("t").cast("double")) - F.col("nl") / F.col("t"))
    two = e.groupBy("channel").agg(*[F.max(F.when(F.col("week") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("t", "h")]).where("t0 IS NOT NULL AND t1 IS NOT NULL AND h1 > 0.000001")
    er, vr = _R(F.col("h0") / F.col("h1")), F.col("t0") / F.col("t1")
    return two.select("channel", er.alias("entropy_ratio"), _R(vr).alias("volume_ratio"), _R(S.asymmetry(er, vr), 4).alias("score"))


SQL["source_asymmetry"] = f"""WITH s AS (SELECT {_SQL_CHANNEL} AS channel, lower(regexp_replace(author, '^@', '')) AS author, epoch_us(received_at) AS us FROM signals WHERE received_at IS NOT NULL AND author IS NOT NULL AND channel IS NOT NULL),
v AS (SELECT channel, ((SELECT max(us) FROM s) - us) // 604800000000 AS week, author FROM s),
p AS (SELECT channel, week, author, count(*) AS n FROM v WHERE week < 2 GROUP BY 1, 2, 3),
e AS (SELECT channel, week, sum(n) AS t, log2(sum(n)::DOUBLE) - sum(n * log2(n::DOUBLE)) / sum(n) AS h FROM p GROUP BY 1, 2),
w AS (SELECT a.channel, round(a.h / b.h, 6) AS er, a.t / b.t AS vr FROM e a JOIN e b ON a.channel = b.channel AND a.week = 0 AND b.week = 1 WHERE b.h > 0.000001)
SELECT channel, er AS entropy_ratio, round(vr, 6) AS volume_ratio, round(CASE WHEN greatest(0.0::DOUBLE, 1 - er) - greatest(0.0::DOUBLE, 1 - vr) > 0 THEN least(1.0::DOUBLE, sqrt(greatest(0.0::DOUBLE, 1 - er) - greatest(0.0::DOUBLE, 1 - vr)) * sqrt(least(vr, 1.0::DOUBLE))) ELSE 0.0::DOUBLE END, 4) AS score FROM w"""


def metric_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a second over the last minute, hour and day of each kind's own clock."""
    e = table(spark, sf_dir, "events").where("event_type IS NOT NULL AND ts IS NOT NULL").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    last = e.groupBy("event_type").agg(F.max("us").alias("last"))
    j = e.join(last, "event_type")
    age = (F.col("last") - F.col("us")) / 1e6
    return j.groupBy("event_type").agg(*[_R(F.count_if(age < s) / s, 6).alias(n) for n, s in (("minute", 60), ("hour", 3600), ("day", 86400))])


SQL["metric_rates"] = "WITH e AS (SELECT event_type, epoch_us(ts) AS us, max(epoch_us(ts)) OVER (PARTITION BY event_type) AS last FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL) SELECT event_type, " + ", ".join(f"round(count(*) FILTER (WHERE (last - us) / 1000000.0::DOUBLE < {s}) / {s}, 6) AS {n}" for n, s in (("minute", 60), ("hour", 3600), ("day", 86400))) + " FROM e GROUP BY event_type"


def rated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of documents by their latest rater: how many of each band, and how many documents of the language are unrated."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    r = table(spark, sf_dir, "reading_labels").where("band IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("rater", "band"))["band"].alias("band"))
    return d.join(r, "doc_id", "left").groupBy("lang").agg(*[F.count_if(F.col("band") == b).alias(f"n_band{b}") for b in (1, 2, 3, 4)], F.count_if(F.col("band").isNull()).alias("n_unrated"))


SQL["rated_findings"] = "WITH r AS (SELECT doc_id, arg_max(band, (rater, band)) AS band FROM reading_labels WHERE band IS NOT NULL GROUP BY 1) SELECT coalesce(lang, 'none') AS lang, " + ", ".join(f"count(*) FILTER (WHERE band = {b}) AS n_band{b}" for b in (1, 2, 3, 4)) + ", count(*) FILTER (WHERE band IS NULL) AS n_unrated FROM documents LEFT JOIN r USING (doc_id) GROUP BY 1"


def source_affinities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of every source and of its busiest author among the signals of each channel."""
    s = table(spark, sf_dir, "signals").where("channel IS NOT NULL AND source IS NOT NULL").select(_channel().alias("channel"), "source", F.lower(F.regexp_replace("author", "^@", "")).alias("author"))
    per = s.groupBy("channel", "source", "author").agg(F.count(F.lit(1)).alias("n"))
    c = per.groupBy("channel", "source").agg(F.sum("n").alias("n"), F.max(F.when(F.col("author").isNotNull(), F.col("n"))).alias("top"))
    total = c.groupBy("channel").agg(F.sum("n").alias("t"))
    return c.join(total, "channel").select("channel", "source", _R(F.col("n") / F.col("t")).alias("source_affinity"), _R(F.coalesce("top", F.lit(0)) / F.col("t")).alias("author_affinity"))


SQL["source_affinities"] = f"WITH p AS (SELECT {_SQL_CHANNEL} AS channel, source, lower(regexp_replace(author, '^@', '')) AS author, count(*) AS n FROM signals WHERE channel IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2, 3), c AS (SELECT channel, source, sum(n) AS n, coalesce(max(n) FILTER (WHERE author IS NOT NULL), 0) AS top FROM p GROUP BY 1, 2) SELECT channel, source, round(n / sum(n) OVER (PARTITION BY channel), 6) AS source_affinity, round(top / sum(n) OVER (PARTITION BY channel), 6) AS author_affinity FROM c"


def issue_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every comment on a ticket, who last wrote the ticket before it (as-of lookup); nobody is linked to themselves."""
    s = table(spark, sf_dir, "signals").where("source = 'linear' AND author IS NOT NULL AND received_at IS NOT NULL")
    s = s.select("delivery_no", F.lower(F.regexp_replace("author", "^@", "")).alias("author"), "received_at", _meta("event_type").alias("event"), _meta("identifier").alias("ticket"), _meta("team").alias("team")).where("ticket IS NOT NULL")
    w = Window.partitionBy("ticket").orderBy("received_at", "delivery_no").rowsBetween(Window.unboundedPreceding, -1)
    comment = F.coalesce(F.col("event") == "linear_comment", F.lit(False))
    k = s.withColumn("owner", F.last(F.when(~comment, F.col("author")), ignorenulls=True).over(w)).where(comment)
    return k.where("owner IS NOT NULL AND owner <> author").select("delivery_no", "author", "owner", "ticket", "team")


SQL["issue_authors"] = f"WITH s AS (SELECT delivery_no, lower(regexp_replace(author, '^@', '')) AS author, received_at, coalesce({_sql_meta('event_type')} = 'linear_comment', false) AS comment, {_sql_meta('identifier')} AS ticket, {_sql_meta('team')} AS team FROM signals WHERE source = 'linear' AND author IS NOT NULL AND received_at IS NOT NULL), k AS (SELECT *, last_value(CASE WHEN NOT comment THEN author END IGNORE NULLS) OVER (PARTITION BY ticket ORDER BY received_at, delivery_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM s WHERE ticket IS NOT NULL) SELECT delivery_no, author, owner, ticket, team FROM k WHERE comment AND owner IS NOT NULL AND owner <> author"


def channel_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that share a word of their names, as classes: each channel with the words that others use too."""
    words = F.filter(F.split(F.lower(F.regexp_replace("channel", "[/-]", " ")), r"\s+"), lambda w: (w != "") & ~w.isin("the", "and", "for", "com"))
    c = table(spark, sf_dir, "signals").where("channel IS NOT NULL").select(_channel().alias("channel")).distinct().select("channel", F.explode(F.array_distinct(words)).alias("word"))
    n = c.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return c.join(n, "word").groupBy("channel").agg(F.array_join(F.array_sort(F.collect_set("word")), ",").alias("words"), F.max("n").alias("most"))


SQL["channel_relations"] = rf"WITH c AS (SELECT DISTINCT {_SQL_CHANNEL} AS channel FROM signals WHERE channel IS NOT NULL), w AS (SELECT channel, unnest(list_distinct(list_filter(string_split_regex(lower(regexp_replace(channel, '[/-]', ' ', 'g')), '\s+'), lambda w: w <> '' AND NOT list_contains(['the', 'and', 'for', 'com'], w)))) AS word FROM c), n AS (SELECT word, count(*) AS n FROM w GROUP BY 1 HAVING count(*) > 1) SELECT channel, array_to_string(list_sort(list(word)), ',') AS words, max(n) AS most FROM w JOIN n USING (word) GROUP BY channel"


def worker_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel's label: its three commonest terms of four or more characters."""
    t = table(spark, sf_dir, "signals").where("content IS NOT NULL AND channel IS NOT NULL").select(_channel().alias("channel"), F.explode(X.terms(F.col("content"))).alias("term")).where(F.length("term") > 3)
    c = t.groupBy("channel", "term").agg(F.count(F.lit(1)).alias("n"))
    top = c.withColumn("k", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("n"), "term"))).where("k <= 3")
    return top.groupBy("channel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda s: s["term"]), "/").alias("label"))


SQL["worker_labels"] = f"WITH c AS (SELECT channel, term, count(*) AS n FROM (SELECT {_SQL_CHANNEL} AS channel, unnest({sql_terms('content')}) AS term FROM signals WHERE content IS NOT NULL AND channel IS NOT NULL) WHERE length(term) > 3 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, term) AS k FROM c QUALIFY k <= 3) SELECT channel, string_agg(term, '/' ORDER BY k) AS label FROM r GROUP BY channel"


def spectral_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy split, gap, alert and severity of each spectrum of the graph of repositories."""
    from lodestream.plans.graph_queries import repo_spectrum

    e = repo_spectrum(spark, sf_dir)
    n = e.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("eigenvalue").alias("total"), F.max("eigenvalue").alias("most"), F.max(F.when(F.col("k") == 1, F.col("eigenvalue"))).alias("second"), F.max(F.when(F.col("k") == 0, F.col("eigenvalue"))).alias("first"))
    low = e.join(n.select("root", F.col("n").alias("size")), "root").where(F.col("k") < F.floor(F.col("size") / 2)).groupBy("root").agg(F.sum("eigenvalue").alias("low"))
    s = n.join(low, "root").select("root", "n", _R(F.col("low") / F.col("total"), 4).alias("low_ratio"), _R(1 - F.col("low") / F.col("total"), 4).alias("high_ratio"), _R(F.col("second") - F.col("first"), 4).alias("gap"), _R(F.least(F.lit(1.0), (F.col("second") - F.col("first")) / F.col("most") * 2), 4).alias("dimensionality"))
    subtype, severity = S.spectral_alert(F.col("low_ratio"), F.col("high_ratio"), F.col("gap"))
    return s.withColumns({"subtype": subtype, "severity": severity})


QUERIES = {
    f.__name__: f
    for f in (
        trace_events, recent_traces, policy_signals, budget_status, policy_interventions, recorded_budgets, repo_flow_weights, redacted_profiles, transaction_coefficients, wallet_coefficients, business_weights, context_states, coverage_gaps,
        calibration_scores, breathing_phases, source_asymmetry, metric_rates, rated_findings, source_affinities, issue_authors, channel_relations, worker_labels, spectral_alerts,
    )
}
