"""Queries on activity over time: topics, channels, ownership of work, cadence, diversity, registries; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import rules, text as X
from lodestream.operators import windows as W
from lodestream.plans.pipeline_queries import CONTEXTS
from lodestream.plans.text_queries import SQL as TEXT_SQL, SQL_FINDING, _list, _meta, _sql_meta, sql_sentences, sql_terms, style_index
from lodestream.scratch import materialize
from lodestream.sources.tables import table

_R = lambda c, n=6: F.round(c, n)


def _channel():
    return F.lower(F.trim(F.regexp_replace("channel", "^#", "")))


_SQL_CHANNEL = "lower(trim(regexp_replace(channel, '^#', '')))"


def _events(spark, sf_dir):
    s = table(spark, sf_dir, "signals").where("content IS NOT NULL")
    event, state = F.coalesce(_meta("event_type"), F.lit("")), F.coalesce(_meta("state"), _meta("status"), F.lit(""))
    # a merged pull request is the action that its state says
    event = F.when((event == "pull_request") & F.upper(state).isin("MERGED", "CLOSED"), F.concat(F.lit("pull_request_"), F.lower(state))).otherwise(event)
    src = F.col("source")
    return s.select("delivery_no", "source", F.lower(F.regexp_replace("author", "^@", "")).alias("author"), _channel().alias("channel"), "received_at", X.terms(F.col("content")).alias("terms"), rules.is_action(event, src, state).alias("action"), rules.is_discussion(event, src).alias("discussion"), rules.is_private_channel(F.col("channel")).alias("private"), rules.is_work_activity(src, state).alias("work"), rules.is_finished_work(event, src, state).alias("finished"))


_ev = f"CASE WHEN {_sql_meta('event_type')} = 'pull_request' AND upper(coalesce({_sql_meta('state')}, {_sql_meta('status')}, '')) IN ('MERGED', 'CLOSED') THEN 'pull_request_' || lower(coalesce({_sql_meta('state')}, {_sql_meta('status')})) ELSE coalesce({_sql_meta('event_type')}, '') END"
_EVENTS = f"""ev AS (SELECT delivery_no, source, lower(regexp_replace(author, '^@', '')) AS author, {_SQL_CHANNEL} AS channel, received_at, {sql_terms('content')} AS terms,
  coalesce(list_contains({_list(rules.ACTION_EVENTS)}, {_ev}), false) OR coalesce(source = 'linear' AND list_contains({_list(rules.DONE_STATES)}, lower(coalesce({_sql_meta('state')}, {_sql_meta('status')}, ''))), false) AS action,
  coalesce(list_contains({_list(rules.DISCUSSION_EVENTS)}, {_ev}), false) OR coalesce(source = 'slack', false) AS discussion, coalesce(regexp_matches(lower(channel), '^#*(priv-|dm-|private-)'), false) AS private,
  coalesce(source = 'github', false) OR coalesce(source = 'linear' AND list_contains({_list(rules.FINISHED_STATES)}, lower(coalesce({_sql_meta('state')}, {_sql_meta('status')}, ''))), false) AS work,
  coalesce(list_contains({_list(rules.ACTION_EVENTS)}, {_ev}), false) OR coalesce(source = 'linear' AND list_contains({_list(rules.FINISHED_STATES)}, lower(coalesce({_sql_meta('state')}, {_sql_meta('status')}, ''))), false) AS finished FROM signals WHERE content IS NOT NULL)"""


def topic_action_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir).where("action OR discussion").select(F.explode("terms").alias("term"), "action", "discussion")
    c = t.groupBy("term").agg(F.count_if("action").alias("n_actions"), F.count_if("discussion").alias("n_discussions")).where("n_discussions >= 3")
    ratio = F.col("n_actions") / F.col("n_discussions")
    return c.select("term", "n_actions", "n_discussions", _R(ratio).alias("ratio"), F.when(ratio >= 0.5, "healthy").when(ratio >= 0.1, "stable").otherwise("decoupling").alias("trend"))


SQL = {"topic_action_ratio": f"WITH {_EVENTS}, c AS (SELECT term, count(*) FILTER (WHERE action) AS n_actions, count(*) FILTER (WHERE discussion) AS n_discussions FROM (SELECT unnest(terms) AS term, action, discussion FROM ev WHERE action OR discussion) GROUP BY term) SELECT term, n_actions, n_discussions, round(n_actions / n_discussions, 6) AS ratio, CASE WHEN n_actions / n_discussions >= 0.5 THEN 'healthy' WHEN n_actions / n_discussions >= 0.1 THEN 'stable' ELSE 'decoupling' END AS trend FROM c WHERE n_discussions >= 3"}


def channel_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per term, how far talk about it went private while work on it goes on (each signal is work, private or public)."""
    t = _events(spark, sf_dir).select(F.explode("terms").alias("term"), "work", "private")
    c = t.groupBy("term").agg(F.count_if("work").alias("n_work"), F.count_if(~F.col("work") & F.col("private")).alias("n_private"), F.count_if(~F.col("work") & ~F.col("private")).alias("n_public"))
    talk = F.col("n_private") + F.col("n_public")
    c = c.where((talk > 0) & (talk + F.col("n_work") >= 4))
    score = F.col("n_private") / talk * (0.5 + 0.5 * F.least(F.lit(1.0), F.col("n_work") / talk))
    return c.select("term", "n_public", "n_private", "n_work", _R(score).alias("score"), (_R(score) >= 0.3).alias("migrated"))


SQL["channel_shift"] = f"WITH {_EVENTS}, c AS (SELECT term, count(*) FILTER (WHERE work) AS n_work, count(*) FILTER (WHERE NOT work AND private) AS n_private, count(*) FILTER (WHERE NOT work AND NOT private) AS n_public FROM (SELECT unnest(terms) AS term, work, private FROM ev) GROUP BY term), s AS (SELECT *, n_private / (n_private + n_public) * (0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, n_work / (n_private + n_public))) AS x FROM c WHERE n_private + n_public > 0 AND n_private + n_public + n_work >= 4) SELECT term, n_public, n_private, n_work, round(x, 6) AS score, round(x, 6) >= 0.3 AS migrated FROM s"


def solo_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms on which one author alone acts, over two or more systems and three or more signals."""
    t = _events(spark, sf_dir).select(F.explode("terms").alias("term"), "author", "channel", F.col("finished").alias("action"), "received_at")
    c = t.groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("action"), F.col("author"))).alias("owner"), F.max(F.when(F.col("action"), F.col("author"))).alias("last"), F.count_distinct("channel").alias("n_systems"), F.max(F.when(F.col("action"), F.unix_micros("received_at"))).alias("last_us")
    )
    return c.where("owner = last AND n_systems >= 2 AND n >= 3").select("term", "owner", "n", "n_systems", "last_us")


SQL["solo_topics"] = f"WITH {_EVENTS} SELECT term, min(author) FILTER (WHERE action) AS owner, count(*) AS n, count(DISTINCT channel) AS n_systems, max(epoch_us(received_at)) FILTER (WHERE action) AS last_us FROM (SELECT unnest(terms) AS term, author, channel, finished AS action, received_at FROM ev) GROUP BY term HAVING count(DISTINCT author) FILTER (WHERE action) = 1 AND count(DISTINCT channel) >= 2 AND count(*) >= 3"


def style_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND channel IS NOT NULL").select("doc_id", F.col("channel"))
    return style_index(spark, sf_dir).join(d, "doc_id").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), _R(F.avg("compression"), 5).alias("compression"), _R(F.avg("hedging"), 5).alias("hedging"))


SQL["style_by_channel"] = f"SELECT channel, count(*) AS n, round(avg(compression), 5) AS compression, round(avg(hedging), 5) AS hedging FROM ({TEXT_SQL['style_index']}) JOIN (SELECT doc_id, channel FROM documents WHERE text IS NOT NULL AND channel IS NOT NULL) USING (doc_id) GROUP BY channel"


def style_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential average of the compression index per source, its trend, and whether it began high."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", "created_at")
    scored = materialize(style_index(spark, sf_dir).select("doc_id", "compression").join(d, "doc_id").where("created_at IS NOT NULL"), "style")
    e = W.ema(scored, "source", ["created_at", "doc_id"], "compression")
    delta = _R("ema") - _R("previous")
    return e.select("source", "n", _R("ema").alias("ema"), F.when(delta > 0.02, "increasing").when(delta < -0.02, "decreasing").otherwise("stable").alias("trend"), (F.col("first_value") >= 0.3).alias("born_high"))


SQL["style_ema"] = f"""
WITH s AS ({TEXT_SQL['style_index']}), d AS (SELECT source, compression, created_at, doc_id FROM s JOIN (SELECT doc_id, source, created_at FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND created_at IS NOT NULL) USING (doc_id)),
l AS (SELECT source, list(compression ORDER BY created_at, doc_id) AS x FROM d GROUP BY source),
e AS (SELECT source, x, list_reduce(x, lambda a, v: 0.3::DOUBLE * v + 0.7::DOUBLE * a) AS ema, CASE WHEN len(x) > 1 THEN list_reduce(x[:len(x) - 1], lambda a, v: 0.3::DOUBLE * v + 0.7::DOUBLE * a) END AS previous FROM l)
SELECT source, len(x) AS n, round(ema, 6) AS ema, CASE WHEN round(ema, 6) - round(previous, 6) > 0.02 THEN 'increasing' WHEN round(ema, 6) - round(previous, 6) < -0.02 THEN 'decreasing' ELSE 'stable' END AS trend, x[1] >= 0.3 AS born_high FROM e"""


def metric_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-score of the latest value of every repository's metric."""
    b = table(spark, sf_dir, "budget_entries").where("value IS NOT NULL").withColumn("series", F.concat_ws("/", "repo", "metric"))
    z = W.last_z_score(b, "series", ["received_at", "entry_no"], "value")
    return z.select("series", "n", _R("mean", 4).alias("mean"), _R("z", 4).alias("z"))


SQL["metric_anomalies"] = """
WITH r AS (SELECT concat_ws('/', repo, metric) AS series, value, row_number() OVER (PARTITION BY concat_ws('/', repo, metric) ORDER BY received_at DESC, entry_no DESC) AS k FROM budget_entries WHERE value IS NOT NULL),
s AS (SELECT series, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, max(value) FILTER (WHERE k = 1) AS last FROM r WHERE k <= 100 GROUP BY series)
SELECT series, n, round(mean, 4) AS mean, CASE WHEN n >= 10 AND std > 0 THEN round((last - mean) / std, 4) END AS z FROM s"""


def budget_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of the last seven days per repository and metric, against a clock fixed at the data's end."""
    b = table(spark, sf_dir, "budget_entries").where("value IS NOT NULL")
    end = b.agg(F.max("received_at").alias("end"))
    recent = b.crossJoin(F.broadcast(end)).where(F.col("received_at") > F.col("end") - F.expr("INTERVAL 7 DAYS"))
    return recent.groupBy("repo", "metric").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


SQL["budget_windows"] = "SELECT repo, metric, sum(value) AS total, count(*) AS n FROM budget_entries WHERE value IS NOT NULL AND received_at > (SELECT max(received_at) FROM budget_entries WHERE value IS NOT NULL) - INTERVAL 7 DAYS GROUP BY repo, metric"


def budget_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "budget_entries").where("value IS NOT NULL AND repo IS NOT NULL")
    return b.groupBy("repo").pivot("metric", ["diff_lines", "dependency_crossings", "auth_touches"]).sum("value")


SQL["budget_pivot"] = "SELECT repo, sum(value) FILTER (WHERE metric = 'diff_lines') AS diff_lines, sum(value) FILTER (WHERE metric = 'dependency_crossings') AS dependency_crossings, sum(value) FILTER (WHERE metric = 'auth_touches') AS auth_touches FROM budget_entries WHERE value IS NOT NULL AND repo IS NOT NULL GROUP BY repo"


def cadence_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per channel, signals a day over its earlier days against its last day's; silent below 30 % of that."""
    s = table(spark, sf_dir, "signals").where("received_at IS NOT NULL").select(_channel().alias("channel"), F.to_date("received_at").alias("day"))
    per = s.groupBy("channel", "day").agg(F.count(F.lit(1)).alias("n"))
    ends = per.groupBy("channel").agg(F.max("day").alias("last"), F.min("day").alias("first"), F.sum("n").alias("total"), F.max_by("n", "day").alias("n_last"))
    days = F.datediff("last", "first")
    base = F.when(days > 0, (F.col("total") - F.col("n_last")) / days)
    return ends.where(F.col("total") >= 20).select("channel", "total", _R(base).alias("baseline"), F.col("n_last"), (F.col("n_last") / base < 0.3).alias("silent"))


SQL["cadence_silence"] = f"""
WITH p AS (SELECT {_SQL_CHANNEL} AS channel, CAST(received_at AS DATE) AS day, count(*) AS n FROM signals WHERE received_at IS NOT NULL GROUP BY 1, 2),
e AS (SELECT channel, max(day) AS last, min(day) AS first, sum(n)::BIGINT AS total, arg_max(n, day) AS n_last FROM p GROUP BY channel),
b AS (SELECT *, CASE WHEN last > first THEN (total - n_last) / (last - first) END AS base FROM e WHERE total >= 20)
SELECT channel, total, round(base, 6) AS baseline, n_last, n_last / base < 0.3 AS silent FROM b"""


def source_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the sources of each day's signals and its volume."""
    per = table(spark, sf_dir, "signals").where("received_at IS NOT NULL").groupBy(F.to_date("received_at").alias("day"), "source").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("day"))
    return per.withColumn("t", total).groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("n").alias("n"), _R(F.sum(W.shannon(F.col("n"), F.col("t")))).alias("entropy"))


SQL["source_coherence"] = "WITH p AS (SELECT CAST(received_at AS DATE) AS day, source, count(*) AS n FROM signals WHERE received_at IS NOT NULL GROUP BY 1, 2), t AS (SELECT day, n, sum(n) OVER (PARTITION BY day) AS t FROM p) SELECT day::VARCHAR AS day, sum(n)::BIGINT AS n, round(sum(-(n / t) * log2(n / t)), 6) AS entropy FROM t GROUP BY day"


def author_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simpson and normalised Shannon diversity of the authors of every channel."""
    per = table(spark, sf_dir, "signals").where("author IS NOT NULL AND author <> ''").groupBy(_channel().alias("channel"), F.lower(F.regexp_replace("author", "^@", "")).alias("author")).agg(F.count(F.lit(1)).alias("n"))
    # sums of counts give both measures in one aggregation, without joining totals back
    a = per.groupBy("channel").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("nl"))
    h = F.log2(F.col("t").cast("double")) - F.col("nl") / F.col("t")
    return a.select("channel", F.col("k").alias("n_authors"), _R(1 - F.col("sq") / (F.col("t") * F.col("t"))).alias("simpson"), _R(F.when(F.col("k") > 1, h / F.log2(F.col("k").cast("double"))).otherwise(0.0)).alias("shannon"))


SQL["author_diversity"] = f"WITH p AS (SELECT {_SQL_CHANNEL} AS channel, lower(regexp_replace(author, '^@', '')) AS author, count(*) AS n FROM signals WHERE author IS NOT NULL AND author <> '' GROUP BY 1, 2), t AS (SELECT channel, n, sum(n) OVER (PARTITION BY channel) AS t FROM p) SELECT channel, count(*) AS n_authors, round(1 - sum((n / t) * (n / t)), 6) AS simpson, round(CASE WHEN count(*) > 1 THEN sum(-(n / t) * log2(n / t)) / log2(count(*)) ELSE 0.0::DOUBLE END, 6) AS shannon FROM t GROUP BY channel"


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), _R(F.min("value"), 4).alias("least"), _R(F.max("value"), 4).alias("most"), _R(F.avg("value"), 4).alias("mean"), _R(F.stddev_samp("value"), 4).alias("stdev"))


SQL["metrics_summary"] = "SELECT event_type, count(*) AS n, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS stdev FROM events WHERE value IS NOT NULL GROUP BY event_type"


def metrics_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", [50, 95, 99])


SQL["metrics_percentiles"] = "SELECT event_type, p AS percent, l[least(CAST(floor(len(l) * p / 100) AS BIGINT), len(l) - 1) + 1] AS value FROM (SELECT event_type, list(value ORDER BY value) AS l FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type), (SELECT unnest([50, 95, 99]) AS p)"


def largest_remainder(spark: SparkSession, sf_dir: str, seats: int = 1000) -> DataFrame:
    """A thousand units shared among nations in proportion to their customers' positive balances (Hare quota)."""
    w = table(spark, sf_dir, "customer").where("c_acctbal > 0").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("w"))
    everyone = Window.partitionBy()
    quota = w.withColumn("q", F.col("w") * seats / F.sum("w").over(everyone)).withColumn("whole", F.floor("q"))
    left = F.lit(seats) - F.sum("whole").over(everyone)
    order = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("q") - F.col("whole"), 9)), "c_nationkey"))
    return quota.select("c_nationkey", (F.col("whole") + F.when(order <= left, 1).otherwise(0)).alias("units"))


SQL["largest_remainder"] = "WITH w AS (SELECT c_nationkey, round(sum(c_acctbal), 2) AS w FROM customer WHERE c_acctbal > 0 GROUP BY 1), q AS (SELECT c_nationkey, w * 1000 / sum(w) OVER () AS q FROM w), f AS (SELECT c_nationkey, floor(q)::BIGINT AS whole, row_number() OVER (ORDER BY round(q - floor(q), 9) DESC, c_nationkey) AS o, 1000 - sum(floor(q)) OVER () AS r FROM q) SELECT c_nationkey, whole + CASE WHEN o <= r THEN 1 ELSE 0 END AS units FROM f"


def finding_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of one finding hash folded to a finding: how often, first and last seen, number of channels."""
    s = table(spark, sf_dir, "signals").where("content IS NOT NULL AND content <> ''")
    h = s.select(X.finding_hash(F.coalesce("source", F.lit("")), F.col("content"), F.array_compact(F.array("author"))).alias("finding"), _channel().alias("channel"), "received_at")
    return h.groupBy("finding").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("received_at")).alias("first_us"), F.max(F.unix_micros("received_at")).alias("last_us"), F.count_distinct("channel").alias("n_channels"))


SQL["finding_registry"] = f"SELECT {SQL_FINDING} AS finding, count(*) AS n, min(epoch_us(received_at)) AS first_us, max(epoch_us(received_at)) AS last_us, count(DISTINCT {_SQL_CHANNEL}) AS n_channels FROM signals WHERE content IS NOT NULL AND content <> '' GROUP BY 1"


def label_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the style measures tell demanding documents (band 3 and 4) from easy ones: Cohen's d."""
    bands = table(spark, sf_dir, "reading_labels").where("band IS NOT NULL").groupBy("doc_id").agg((F.avg("band") >= 2.5).alias("hard"))
    s = style_index(spark, sf_dir).join(bands, "doc_id").select("hard", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in ("nominal", "passive", "hedging")])).alias("e")).select("hard", "e.*")
    h, e = F.when(F.col("hard"), F.col("x")), F.when(~F.col("hard"), F.col("x"))
    a = s.groupBy("measure").agg(F.count(h).alias("n_hard"), F.count(e).alias("n_easy"), F.avg(h).alias("mh"), F.avg(e).alias("me"), F.var_pop(h).alias("vh"), F.var_pop(e).alias("ve"))
    pooled = F.sqrt((F.col("vh") + F.col("ve")) / 2)
    return a.select("measure", "n_hard", "n_easy", _R(F.when(pooled > 0, (F.col("mh") - F.col("me")) / pooled), 4).alias("cohens_d"))


SQL["label_evaluation"] = f"""
WITH s AS ({TEXT_SQL['style_index']}), b AS (SELECT doc_id, avg(band) >= 2.5 AS hard FROM reading_labels WHERE band IS NOT NULL GROUP BY doc_id),
e AS (SELECT hard, measure, x FROM (SELECT hard, nominal, passive, hedging FROM s JOIN b USING (doc_id)) UNPIVOT (x FOR measure IN (nominal, passive, hedging))),
a AS (SELECT measure, count(*) FILTER (WHERE hard) AS n_hard, count(*) FILTER (WHERE NOT hard) AS n_easy, avg(x) FILTER (WHERE hard) AS mh, avg(x) FILTER (WHERE NOT hard) AS me, var_pop(x) FILTER (WHERE hard) AS vh, var_pop(x) FILTER (WHERE NOT hard) AS ve FROM e GROUP BY measure)
SELECT measure, n_hard, n_easy, CASE WHEN vh + ve > 0 THEN round((mh - me) / sqrt((vh + ve) / 2), 4) END AS cohens_d FROM a"""


def request_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every review or comment, the author of its pull request as far as known when it arrived (as-of lookup); nobody is linked to themselves."""
    s = table(spark, sf_dir, "signals").where("source = 'github' AND author IS NOT NULL").select("delivery_no", "author", _channel().alias("repo"), "received_at", _meta("event_type").alias("event"), _meta("pr_number").alias("pr"), _meta("action").alias("action")).where("pr IS NOT NULL AND received_at IS NOT NULL")
    w = Window.partitionBy("repo", "pr").orderBy("received_at", "delivery_no").rowsBetween(Window.unboundedPreceding, -1)
    known = s.withColumn("opened_by", F.last(F.when((F.col("event") == "pull_request") & F.coalesce(F.col("action") == "opened", F.lit(True)), F.col("author")), ignorenulls=True).over(w))
    return known.where("event <> 'pull_request' AND opened_by IS NOT NULL AND opened_by <> author").select("delivery_no", "author", "opened_by")


SQL["request_authors"] = f"""
WITH s AS (SELECT delivery_no, author, {_SQL_CHANNEL} AS repo, received_at, {_sql_meta('event_type')} AS event, {_sql_meta('pr_number')} AS pr, {_sql_meta('action')} AS action FROM signals WHERE source = 'github' AND author IS NOT NULL),
k AS (SELECT *, last_value(CASE WHEN event = 'pull_request' AND coalesce(action = 'opened', true) THEN author END IGNORE NULLS) OVER (PARTITION BY repo, pr ORDER BY received_at, delivery_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened_by FROM s WHERE pr IS NOT NULL AND received_at IS NOT NULL)
SELECT delivery_no, author, opened_by FROM k WHERE event <> 'pull_request' AND opened_by IS NOT NULL AND opened_by <> author"""


def repo_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of repositories by the number of authors active in both."""
    s = table(spark, sf_dir, "signals").where("source = 'github' AND author IS NOT NULL AND channel IS NOT NULL")
    by = s.select(_channel().alias("repo"), F.lower(F.regexp_replace("author", "^@", "")).alias("author")).distinct()
    return by.select("author", F.col("repo").alias("a")).join(by.select("author", F.col("repo").alias("b")), "author").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_authors"))


SQL["repo_flows"] = f"WITH b AS (SELECT DISTINCT {_SQL_CHANNEL} AS repo, lower(regexp_replace(author, '^@', '')) AS author FROM signals WHERE source = 'github' AND author IS NOT NULL AND channel IS NOT NULL) SELECT x.repo AS a, y.repo AS b, count(*) AS n_authors FROM b x JOIN b y ON x.author = y.author AND x.repo < y.repo GROUP BY 1, 2"


def recent_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest signals of every author."""
    s = table(spark, sf_dir, "signals").where("author IS NOT NULL AND received_at IS NOT NULL").select("author", "delivery_no", F.unix_micros("received_at").alias("us"))
    return W.latest_rows(s, "author", ["us", "delivery_no"], 3)


SQL["recent_by_author"] = "SELECT author, delivery_no, epoch_us(received_at) AS us FROM signals WHERE author IS NOT NULL AND received_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY author ORDER BY received_at DESC, delivery_no DESC) <= 3"


#: How surely somebody knows of what they authored, reviewed, commented on, were mentioned in.
EXPOSURE_WEIGHTS = {"authored": 0.95, "assigned": 0.90, "reviewed": 0.85, "commented": 0.75, "mentioned": 0.50, "reacted": 0.35, "channel_present": 0.20}
AS_OF = "2025-06-01 00:00:00"
#: Findings whose terms are asked for: the seeded contexts' words stand for three.
FINDING_TERMS = {name: words for name, (words, _, _) in CONTEXTS.items()}


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``person, source, channel, kind, received_at, terms``: who met which signal, and how.

    Authors author, review or comment by event type (a reply in a thread comments); everyone
    that metadata mentions is mentioned; other producers (alerts) expose nobody.
    """
    s = table(spark, sf_dir, "signals").where("received_at IS NOT NULL AND source IN ('github', 'linear', 'slack')")
    m = F.from_json("metadata", "event_type string, is_thread_reply boolean, mentions array<string>")
    person = lambda c: F.lower(F.regexp_replace(c, "^@", ""))
    s = s.select("source", _channel().alias("channel"), "received_at", X.terms(F.coalesce("content", F.lit(""))).alias("terms"), F.col("author"), m.alias("m"))
    event = F.coalesce(F.col("m.event_type"), F.lit(""))
    kind = F.when(event == "pr_review", "reviewed").when(event.isin("pr_comment", "issue_comment", "linear_comment"), "commented").when(event == "check_run", F.lit(None)).when((F.col("source") == "slack") & F.col("m.is_thread_reply"), "commented").otherwise("authored")
    met = F.concat(F.array(F.struct(person(F.col("author")).alias("person"), kind.alias("kind"))), F.transform(F.coalesce(F.col("m.mentions"), F.array().cast("array<string>")), lambda p: F.struct(person(p).alias("person"), F.lit("mentioned").alias("kind"))))
    return s.select("source", "channel", "received_at", "terms", F.explode(met).alias("e")).select("e.*", "source", "channel", "received_at", "terms").where("person <> '' AND kind IS NOT NULL")


def exposure_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(a person already knows of a finding): noisy-or over exposures, by kind, age, channel size, volume and topic overlap."""
    e = materialize(exposures(spark, sf_dir), "exposures")
    as_of = F.lit(AS_OF).cast("timestamp")
    size = e.where("kind IN ('authored', 'reviewed', 'commented')").groupBy("source", "channel").agg(F.count_distinct("person").alias("authors"))
    week = F.col("received_at") > as_of - F.expr("INTERVAL 7 DAYS")
    volume = e.groupBy("person").agg(F.count_if(week & (F.col("received_at") <= as_of)).alias("v7"))
    finding = F.explode(F.array(*[F.struct(F.lit(n).alias("finding"), F.array(*map(F.lit, t)).alias("words")) for n, t in FINDING_TERMS.items()]))
    met = e.select("person", "source", "channel", "kind", "received_at", "terms", finding.alias("f"))
    both = F.size(F.array_intersect("terms", "f.words"))
    met = met.select("person", "source", "channel", "kind", "received_at", F.col("f.finding").alias("finding"), (both / (F.size("terms") + F.size("f.words") - both)).alias("overlap")).where("overlap >= 0.1")
    base = F.lit(0.10)
    for k, w in EXPOSURE_WEIGHTS.items():
        base = F.when(F.col("kind") == k, w).otherwise(base)
    age = F.greatest((F.unix_micros(as_of) - F.unix_micros("received_at")) / 86_400_000_000.0, F.lit(0.0))
    crowd = F.greatest(F.coalesce("authors", F.lit(5)) / 5, F.lit(1.0))
    p = base * F.pow(F.lit(2.0), -age / 14) * F.pow(F.lit(0.8), F.log2(crowd)) * 50 / (50 + F.coalesce("v7", F.lit(0)) / 7) * F.col("overlap")
    rows = met.join(size, ["source", "channel"], "left").join(volume, "person", "left")
    return rows.groupBy("person", "finding").agg(F.count(F.lit(1)).alias("n"), _R(1 - F.product(1 - F.least(p, F.lit(1.0)))).alias("p_knows"))


_PERSON = lambda c: f"lower(regexp_replace({c}, '^@', ''))"
_EXPOSURES = f"""x0 AS (SELECT *, CASE WHEN json_valid(metadata) THEN metadata END AS m FROM signals WHERE received_at IS NOT NULL AND source IN ('github', 'linear', 'slack')),
x1 AS (SELECT source, {_SQL_CHANNEL} AS channel, received_at, {sql_terms("coalesce(content, '')")} AS terms, author, coalesce(json_extract_string(m, '$.event_type'), '') AS event, coalesce(json_extract_string(m, '$.is_thread_reply') = 'true', false) AS reply, coalesce(json_extract_string(m, '$.mentions[*]'), []::VARCHAR[]) AS mentions FROM x0),
x AS (SELECT {_PERSON('author')} AS person, CASE WHEN event = 'pr_review' THEN 'reviewed' WHEN event IN ('pr_comment', 'issue_comment', 'linear_comment') THEN 'commented' WHEN event = 'check_run' THEN NULL WHEN source = 'slack' AND reply THEN 'commented' ELSE 'authored' END AS kind, source, channel, received_at, terms FROM x1
 UNION ALL SELECT {_PERSON('p')}, 'mentioned', source, channel, received_at, terms FROM (SELECT *, unnest(mentions) AS p FROM x1)),
e AS (SELECT * FROM x WHERE person <> '' AND kind IS NOT NULL)"""
_words = " UNION ALL ".join(f"SELECT '{n}' AS finding, {_list(t)} AS words" for n, t in FINDING_TERMS.items())
_kinds = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in EXPOSURE_WEIGHTS.items()) + " ELSE 0.10::DOUBLE END"
_KNOWS = f"""{_EXPOSURES}, sz AS (SELECT source, channel, count(DISTINCT person) AS authors FROM e WHERE kind IN ('authored', 'reviewed', 'commented') GROUP BY 1, 2),
vol AS (SELECT person, count(*) FILTER (WHERE received_at > TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 7 DAYS AND received_at <= TIMESTAMPTZ '{AS_OF}+00') AS v7 FROM e GROUP BY 1),
o AS (SELECT e.*, finding, len(list_intersect(terms, words)) / (len(terms) + len(words) - len(list_intersect(terms, words))) AS overlap FROM e, ({_words})),
p AS (SELECT o.person, finding, {_kinds} * pow(2.0::DOUBLE, -greatest((epoch_us(TIMESTAMPTZ '{AS_OF}+00') - epoch_us(received_at)) / 86400000000.0::DOUBLE, 0.0::DOUBLE) / 14) * pow(0.8::DOUBLE, log2(greatest(coalesce(authors, 5) / 5, 1.0::DOUBLE))) * 50 / (50 + coalesce(v7, 0) / 7) * overlap AS p FROM o LEFT JOIN sz ON sz.source = o.source AND sz.channel IS NOT DISTINCT FROM o.channel AND o.channel IS NOT NULL LEFT JOIN vol ON vol.person = o.person WHERE overlap >= 0.1)"""
SQL["exposure_knowledge"] = f"WITH {_KNOWS} SELECT person, finding, count(*) AS n, round(1 - product(1 - least(p, 1.0::DOUBLE)), 6) AS p_knows FROM p GROUP BY person, finding"


QUERIES = {f.__name__: f for f in (topic_action_ratio, channel_shift, solo_topics, style_by_channel, style_ema, metric_anomalies, budget_windows, budget_pivot, cadence_silence, source_coherence, author_diversity, metrics_summary, metrics_percentiles, largest_remainder, finding_registry, label_evaluation, request_authors, repo_flows, recent_by_author, exposure_knowledge)}
