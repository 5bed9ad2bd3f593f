"""Queries on sequences, sessions, sets and sketches, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import windows as W
from lodestream.plans.activity_queries import _channel
from lodestream.plans.text_queries import sql_terms
from lodestream.sources.tables import table

_R = lambda c, n=6: F.round(c, n)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every user: runs of events less than six hours apart."""
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("last").alias("last_us"), "n")


SQL = {
    "user_sessions": "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(epoch_us(ts)) AS start_us, max(epoch_us(ts)) AS last_us, count(*) AS n FROM s GROUP BY user_id, k"
}


def _grams(spark, sf_dir):
    """Per user, the multiset of the one- to three-step runs among all steps: ``(user_id, gram, n)``."""
    return W.step_runs(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


_GRAMS = """r AS (SELECT user_id, event_type, ts, event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
l AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS s FROM r GROUP BY user_id),
g AS (SELECT user_id, gram, count(*) AS n FROM (SELECT user_id, unnest(list_concat(s, list_transform(range(1, greatest(len(s), 1)), lambda i: s[i] || '>' || s[i + 1]), list_transform(range(1, greatest(len(s) - 1, 1)), lambda i: s[i] || '>' || s[i + 1] || '>' || s[i + 2]))) AS gram FROM l) GROUP BY user_id, gram)"""


def step_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grams(spark, sf_dir).groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_users"))


SQL["step_ngrams"] = f"WITH {_GRAMS} SELECT gram, sum(n)::BIGINT AS n, count(*) AS n_users FROM g GROUP BY gram"


def sequence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset Jaccard of every user's step runs with those of the busiest user."""
    g = _grams(spark, sf_dir)
    ref = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "user_id").limit(1).select("user_id")
    base = g.join(F.broadcast(ref), "user_id", "left_semi").select("gram", F.col("n").alias("m"))
    whole = base.agg(F.sum("m").alias("mt"))
    both = g.join(base, "gram", "left").groupBy("user_id").agg(F.sum("n").alias("nt"), F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("common"))
    return both.crossJoin(F.broadcast(whole)).select("user_id", _R(F.col("common") / (F.col("nt") + F.col("mt") - F.col("common"))).alias("similarity"))


SQL["sequence_similarity"] = f"WITH {_GRAMS}, ref AS (SELECT user_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 1), b AS (SELECT gram, n AS m FROM g WHERE user_id IN (SELECT user_id FROM ref)), c AS (SELECT g.user_id, sum(n) AS nt, sum(least(n, coalesce(m, 0))) AS common FROM g LEFT JOIN b USING (gram) GROUP BY g.user_id) SELECT user_id, round(common / (nt + (SELECT sum(m) FROM b) - common), 6) AS similarity FROM c"


def weekday_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each source on its last day against the mean of the days of its period before.

    The period is the weekday, or the half of the week (working days, weekend) where there are
    fewer than two such days, or else all days.
    """
    per = table(spark, sf_dir, "signals").where("received_at IS NOT NULL AND source IS NOT NULL").groupBy("source", F.to_date("received_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = per.groupBy("source").agg(F.max("day").alias("last"), F.max_by("n", "day").alias("n_last"))
    h = per.join(last, "source").where("day < last")
    weekend = lambda c: F.weekday(c) >= 5
    same, half = F.when(F.weekday("day") == F.weekday("last"), F.col("n")), F.when(weekend("day") == weekend("last"), F.col("n"))
    a = h.groupBy("source", "last", "n_last").agg(F.count(same).alias("k"), F.avg(same).alias("s"), F.count(half).alias("kh"), F.avg(half).alias("h"), F.avg("n").alias("a"))
    return a.select("source", F.col("last").cast("string").alias("last"), "n_last", _R(F.when(F.col("k") >= 2, F.col("s")).when(F.col("kh") >= 2, F.col("h")).otherwise(F.col("a")), 4).alias("baseline"))


SQL["weekday_baseline"] = "WITH p AS (SELECT source, CAST(received_at AS DATE) AS day, count(*) AS n FROM signals WHERE received_at IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2), l AS (SELECT source, max(day) AS last, arg_max(n, day) AS n_last FROM p GROUP BY source), h AS (SELECT source, last, n_last, n, dayofweek(day) = dayofweek(last) AS same, (isodow(day) >= 6) = (isodow(last) >= 6) AS half FROM p JOIN l USING (source) WHERE day < last) SELECT source, last::VARCHAR AS last, n_last, round(CASE WHEN count(*) FILTER (WHERE same) >= 2 THEN avg(n) FILTER (WHERE same) WHEN count(*) FILTER (WHERE half) >= 2 THEN avg(n) FILTER (WHERE half) ELSE avg(n) END, 4) AS baseline FROM h GROUP BY source, last, n_last"


def next_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every signal, the author's next one in another source within an hour (an interval join without pairing).

    Each hour of an author is a group of its own that also holds the next hour's signals to look
    ahead to, so an author with very many signals is split.
    """
    s = table(spark, sf_dir, "signals").where("author IS NOT NULL AND source IS NOT NULL AND received_at IS NOT NULL").select("delivery_no", F.lower(F.regexp_replace("author", "^@", "")).alias("author"), "source", F.unix_micros("received_at").alias("us"))
    hour = F.floor(F.col("us") / 3_600_000_000)
    s = s.withColumn("hour", hour).withColumn("group", F.explode(F.array(F.col("hour"), F.col("hour") - 1)))
    # from the latest on, so that the start of the next run of one source is the last start seen
    w = Window.partitionBy("author", "group").orderBy(F.desc("us"), F.desc("delivery_no"))
    start = F.when(~F.col("source").eqNullSafe(F.lead("source").over(w)), F.struct("source", "us"))
    n = s.withColumn("start", start).withColumn("next", F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    n = n.where("hour = group").select("source", F.col("next.source").alias("next_source"), "us", F.col("next.us").alias("next_us"))
    return n.where("next_us - us <= 3600000000").groupBy("source", "next_source").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("next_us") - F.col("us")).alias("least_us"))


SQL["next_elsewhere"] = """
WITH s AS (SELECT delivery_no, lower(regexp_replace(author, '^@', '')) AS author, source, epoch_us(received_at) AS us FROM signals WHERE author IS NOT NULL AND source IS NOT NULL AND received_at IS NOT NULL),
f AS (SELECT *, CASE WHEN lag(source) OVER w IS DISTINCT FROM source THEN 1 ELSE 0 END AS fresh FROM s WINDOW w AS (PARTITION BY author ORDER BY us, delivery_no)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY author ORDER BY us, delivery_no ROWS UNBOUNDED PRECEDING) AS run FROM f),
n AS (SELECT author, run, min(us) AS us, any_value(source) AS source FROM r GROUP BY author, run)
SELECT r.source, n.source AS next_source, count(*) AS n, min(n.us - r.us) AS least_us FROM r JOIN n ON n.author = r.author AND n.run = r.run + 1 WHERE n.us - r.us <= 3600000000 GROUP BY 1, 2"""


def best_per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents of one text (but for letter case and blanks) the longest, ties to the smaller id; with how many there were."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    whole = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    return d.groupBy(F.md5(whole).alias("start")).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.length("text").alias("len"), (-F.col("doc_id")).alias("d"))).alias("b")).select("start", "n", (-F.col("b.d")).alias("doc_id"), F.col("b.len").cast("long").alias("n_chars"))


SQL["best_per_text"] = r"SELECT md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ')) AS start, count(*) AS n, arg_max(doc_id, (length(text), -doc_id)) AS doc_id, max(length(text)) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1"


def source_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that documents share with signals, and that either has alone, counted."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.explode(X.terms(F.col("text"))).alias("term")).distinct()
    s = table(spark, sf_dir, "signals").where("content IS NOT NULL").select(F.explode(X.terms(F.col("content"))).alias("term")).distinct()
    return d.intersect(s).agg(F.count(F.lit(1)).alias("both")).crossJoin(d.exceptAll(s).agg(F.count(F.lit(1)).alias("documents_only"))).crossJoin(s.exceptAll(d).agg(F.count(F.lit(1)).alias("signals_only")))


SQL["source_sets"] = f"WITH d AS (SELECT DISTINCT unnest({sql_terms('text')}) AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT DISTINCT unnest({sql_terms('content')}) AS t FROM signals WHERE content IS NOT NULL) SELECT (SELECT count(*) FROM (SELECT t FROM d INTERSECT SELECT t FROM s)) AS both, (SELECT count(*) FROM (SELECT t FROM d EXCEPT SELECT t FROM s)) AS documents_only, (SELECT count(*) FROM (SELECT t FROM s EXCEPT SELECT t FROM d)) AS signals_only"


def activity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by source and channel with subtotals."""
    s = table(spark, sf_dir, "signals").where("channel IS NOT NULL").select("source", _channel().alias("channel"))
    r = s.rollup("source", "channel").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return r.select("source", "channel", "n", F.col("level").cast("int").alias("level"))


SQL["activity_rollup"] = "SELECT source, channel, count(*) AS n, grouping_id(source, channel)::INTEGER AS level FROM (SELECT source, lower(trim(regexp_replace(channel, '^#', ''))) AS channel FROM signals WHERE channel IS NOT NULL) GROUP BY ROLLUP (source, channel)"


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate distinct authors and median arrival second per source (mergeable sketches)."""
    s = table(spark, sf_dir, "signals").where("received_at IS NOT NULL")
    return s.groupBy("source").agg(F.approx_count_distinct("author", 0.02).alias("n_authors"), F.percentile_approx(F.second("received_at"), 0.5, 10_000).alias("median_second"))


def term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of the vocabularies of all pairs of document sources (a closed set of sources)."""
    t = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("source", F.explode(X.terms(F.col("text"))).alias("term")).distinct()
    size = t.groupBy("source").agg(F.count(F.lit(1)).alias("k"))
    per = t.groupBy("term").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    pairs = per.select(F.explode(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("common"))
    return pairs.join(size.select(F.col("source").alias("a"), F.col("k").alias("ka")), "a").join(size.select(F.col("source").alias("b"), F.col("k").alias("kb")), "b").select("a", "b", "common", _R(F.col("common") / (F.col("ka") + F.col("kb") - F.col("common"))).alias("jaccard"))


SQL["term_overlap"] = f"WITH t AS (SELECT DISTINCT source, unnest({sql_terms('text')}) AS term FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), k AS (SELECT source, count(*) AS k FROM t GROUP BY source), p AS (SELECT x.source AS a, y.source AS b, count(*) AS common FROM t x JOIN t y ON x.term = y.term AND x.source < y.source GROUP BY 1, 2) SELECT a, b, common, round(common / (ka.k + kb.k - common), 6) AS jaccard FROM p JOIN k ka ON ka.source = a JOIN k kb ON kb.source = b"


def prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every channel, the longest team name that begins it (longest-prefix match by equi-join on prefixes)."""
    names = table(spark, sf_dir, "person_records").where("team <> ''").select(F.lower("team").alias("prefix")).distinct()
    c = table(spark, sf_dir, "signals").where("channel IS NOT NULL").select(_channel().alias("channel")).distinct()
    cut = c.where("channel <> ''").select("channel", F.explode(F.transform(F.sequence(F.lit(1), F.length("channel")), lambda n: F.substring("channel", F.lit(1), n))).alias("prefix"))
    return cut.join(names, "prefix").groupBy("channel").agg(F.max_by("prefix", F.length("prefix")).alias("team"))


SQL["prefix_lookup"] = "WITH p AS (SELECT DISTINCT lower(team) AS prefix FROM person_records WHERE team <> ''), c AS (SELECT DISTINCT lower(trim(regexp_replace(channel, '^#', ''))) AS channel FROM signals WHERE channel IS NOT NULL) SELECT channel, arg_max(prefix, length(prefix)) AS team FROM c JOIN p ON starts_with(channel, prefix) WHERE channel <> '' GROUP BY channel"

QUERIES = {f.__name__: f for f in (user_sessions, step_ngrams, sequence_similarity, weekday_baseline, next_elsewhere, best_per_text, source_sets, activity_rollup, sketches, term_overlap, prefix_lookup)}
