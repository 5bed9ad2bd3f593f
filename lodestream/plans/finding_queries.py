"""Queries on findings: scores, life cycle, re-emission, portfolio, corroboration, surfacing; with their SQL.

A finding here is a text that signals repeat: its actors, channels, how often and how long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import scoring as S, text as X
from lodestream.operators import graphs as G
from lodestream.plans.activity_queries import _SQL_CHANNEL, _channel, exposure_knowledge, SQL as ACTIVITY_SQL
from lodestream.plans.graph_queries import _CONTACTS, contacts
from lodestream.plans.pipeline_queries import CONTEXTS
from lodestream.plans.text_queries import _list, _meta, _sql_meta, sql_terms
from lodestream.scratch import materialize
from lodestream.sources.tables import table

_R = lambda c, n=6: F.round(c, n)
#: What kind of finding a source's repeated texts are, and how known a text of an event type is.
KINDS = {"slack": "overlap", "github": "risk", "linear": "trend", "grafana": "contradiction"}
CLASSES = {"message": "correlation", "linear_comment": "retrieval", "pr_comment": "retrieval", "issue_comment": "retrieval", "pull_request": "discovery"}
NOW = "2024-01-01 00:00:00"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``finding, kind, severity, classification, summary, actors, channels, times, first_us, last_us, days, terms``, one row per text.

    Sets of actors and channels are bounded by the people and channels there are.
    """
    s = table(spark, sf_dir, "signals").where("content IS NOT NULL AND content <> '' AND received_at IS NOT NULL AND source IS NOT NULL")
    rows = s.select(F.md5(F.lower(F.trim("content"))).alias("finding"), "content", "source", F.lower(F.regexp_replace("author", "^@", "")).alias("actor"), _channel().alias("channel"), F.unix_micros("received_at").alias("us"), _meta("event_type").alias("event"), _meta("severity").alias("severity"))
    f = rows.groupBy("finding").agg(
        F.min("source").alias("source"), F.min("event").alias("event"), F.max("severity").alias("severity"), F.min("content").alias("summary"), F.array_sort(F.collect_set("actor")).alias("actors"), F.array_sort(F.collect_set("channel")).alias("channels"), F.count(F.lit(1)).alias("times"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
    )
    f = f.select("finding", S.looked_up(F.col("source"), KINDS, "parallel_activity").alias("kind"), F.coalesce("severity", F.lit("medium")).alias("severity"), S.looked_up(F.coalesce("event", F.lit("")), CLASSES, "amplification").alias("classification"), "summary", "actors", "channels", "times", "first_us", "last_us", ((F.col("last_us") - F.col("first_us")) / 86_400_000_000.0).alias("days"), X.terms(F.col("summary")).alias("terms"))
    return materialize(f, "findings")


_case = lambda key, t, default: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + f" ELSE '{default}' END"
_num = lambda key, t, default: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in t.items()) + f" ELSE {default}::DOUBLE END"
_FINDINGS = f"""fr AS (SELECT md5(lower(trim(content, ' '))) AS finding, content, source, lower(regexp_replace(author, '^@', '')) AS actor, {_SQL_CHANNEL} AS channel, epoch_us(received_at) AS us, {_sql_meta('event_type')} AS event, {_sql_meta('severity')} AS severity FROM signals WHERE content IS NOT NULL AND content <> '' AND received_at IS NOT NULL AND source IS NOT NULL),
fg AS (SELECT finding, min(source) AS source, min(event) AS event, max(severity) AS severity, min(content) AS summary, list_sort(list_distinct(list(actor) FILTER (WHERE actor IS NOT NULL))) AS actors, list_sort(list_distinct(list(channel) FILTER (WHERE channel IS NOT NULL))) AS channels, count(*) AS times, min(us) AS first_us, max(us) AS last_us FROM fr GROUP BY finding),
findings AS (SELECT finding, {_case('source', KINDS, 'parallel_activity')} AS kind, coalesce(severity, 'medium') AS severity, {_case("coalesce(event, '')", CLASSES, 'amplification')} AS classification, summary, coalesce(actors, []) AS actors, coalesce(channels, []) AS channels, times, first_us, last_us, (last_us - first_us) / 86400000000.0::DOUBLE AS days, {sql_terms('summary')} AS terms FROM fg)"""
_days_ago = f"((epoch_us(TIMESTAMPTZ '{NOW}+00') - last_us) / 86400000000.0::DOUBLE)"
_hits = " + ".join(f"CASE WHEN contains(lower(summary), '{w}') THEN 1 ELSE 0 END" for w in S.RISK_WORDS)
_currency = f"CASE WHEN {_days_ago} > 180 THEN 'stale' WHEN {_days_ago} > 60 THEN 'historical' ELSE 'active' END"
_risk = f"greatest(0.05::DOUBLE, least(1.0::DOUBLE, ({_num('kind', S.TYPE_COUPLING, 0.4)} + {_num('lower(severity)', S.SEVERITY_SHIFT, 0.0)} + least(0.15::DOUBLE, ({_hits}) * 0.05::DOUBLE)) * {_num('classification', S.CLASS_FACTOR, 1.0)} * {_num(_currency, S.CURRENCY_FACTOR, 1.0)}))"
_conf = "least(0.95::DOUBLE, 0.4::DOUBLE + 0.1::DOUBLE * len(channels))"
_comm = f"(1 / (1 + exp(-(3.0::DOUBLE * ({_conf} * 0.6::DOUBLE + least(1.0::DOUBLE, len(actors) * 0.2::DOUBLE) * 0.4::DOUBLE)))))"


def _scored(f: DataFrame, known: DataFrame) -> DataFrame:
    """Findings with the four parts of their score; without a path between actors the bridge is the moderate prior."""
    ago = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.col("last_us")) / 86_400_000_000.0
    currency = F.when(ago > 180, "stale").when(ago > 60, "historical").otherwise("active")
    confidence = F.least(F.lit(0.95), 0.4 + 0.1 * F.size("channels"))
    resolved = f.select("finding", F.explode("actors").alias("v")).join(known, "v", "left_semi").groupBy("finding").agg(F.count(F.lit(1)).alias("n_resolved"))
    s = f.join(resolved, "finding", "left").withColumn("n_actors", F.size("actors"))
    parts = {
        "d_bridge": F.lit(0.5), "c_entity": S.entity_confidence(F.col("n_actors"), F.coalesce("n_resolved", F.lit(0))),
        "r_coupling": S.risk_coupling(F.col("kind"), F.col("severity"), F.col("summary"), F.col("classification"), currency), "gamma": S.communicability(confidence, F.col("n_actors"), F.lit(0)),
    }
    s = s.withColumns({k: _R(v) for k, v in parts.items()})
    return s.withColumn("score", _R(F.col("d_bridge") * F.col("c_entity") * F.col("r_coupling") * F.col("gamma")))


def _known(spark, sf_dir):
    return contacts(spark, sf_dir).where("src <> dst").select(F.explode(F.array("src", "dst")).alias("v")).distinct()


_SCORED = f"""{_CONTACTS}, {_FINDINGS}, known AS (SELECT DISTINCT v FROM ties),
res AS (SELECT finding, count(*) AS n FROM (SELECT finding, unnest(actors) AS v FROM findings) JOIN known USING (v) GROUP BY finding),
parts AS (SELECT f.*, 0.5::DOUBLE AS d_bridge, round(CASE WHEN len(actors) > 0 THEN 0.3::DOUBLE + 0.65::DOUBLE * coalesce(n, 0) / len(actors) ELSE 0.3::DOUBLE END, 6) AS c_entity, round({_risk}, 6) AS r_coupling, round({_comm}, 6) AS gamma FROM findings f LEFT JOIN res USING (finding)),
scored AS (SELECT *, round(d_bridge * c_entity * r_coupling * gamma, 6) AS score FROM parts)"""


def finding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S(f) = bridge x entity confidence x risk coupling x communicability of every finding."""
    return _scored(findings(spark, sf_dir), _known(spark, sf_dir)).select("finding", "kind", "d_bridge", "c_entity", "r_coupling", "gamma", "score")


SQL = {"finding_scores": f"WITH {_SCORED} SELECT finding, kind, d_bridge, c_entity, r_coupling, gamma, score FROM scored"}


def _staged(s: DataFrame) -> DataFrame:
    ratio = F.lit(-1.0)
    return s.withColumn("stage", S.decay_stage(F.col("times"), F.col("days"), F.col("classification") == "retrieval", ratio, F.exists("channels", lambda c: c.contains("incident")) & (F.col("kind") == "contradiction")))


_STAGE = "CASE WHEN kind = 'contradiction' AND len(list_filter(channels, lambda c: contains(c, 'incident'))) > 0 THEN 'acknowledged' WHEN times <= 1 THEN 'active' WHEN classification = 'retrieval' THEN CASE WHEN times >= 2 AND days >= 7 THEN 'normalized' ELSE 'deferred' END WHEN times >= 3 AND days >= 14 THEN 'normalized' WHEN times >= 2 THEN 'deferred' ELSE 'active' END"


def decay_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(findings(spark, sf_dir)).select("finding", "times", _R("days").alias("days"), "stage")


SQL["decay_stages"] = f"WITH {_FINDINGS} SELECT finding, times, round(days, 6) AS days, {_STAGE} AS stage FROM findings"


def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per life-cycle stage and kind."""
    return _staged(findings(spark, sf_dir)).groupBy("kind").pivot("stage", ["active", "deferred", "normalized", "acknowledged"]).agg(F.count(F.lit(1))).na.fill(0)


SQL["registry_summary"] = f"WITH {_FINDINGS} SELECT kind, count(*) FILTER (WHERE s = 'active') AS active, count(*) FILTER (WHERE s = 'deferred') AS deferred, count(*) FILTER (WHERE s = 'normalized') AS normalized, count(*) FILTER (WHERE s = 'acknowledged') AS acknowledged FROM (SELECT kind, {_STAGE} AS s FROM findings) GROUP BY kind"


def _long_words(text):
    edge = ".,!?;:()[]{}\"'*`<>#~"
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.btrim(w, F.lit(edge))), lambda w: F.length(w) >= 4))


_sql_long = lambda c: rf"list_distinct(list_filter(list_transform(string_split_regex(lower({c}), '\s+'), lambda w: trim(w, '.,!?;:()[]{{}}""''*`<>#~')), lambda w: length(w) >= 4))".replace('""', '"')


def reemissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings to emit again: nearing or at normalised deviance, or strengthened by the terms of the last day's signals; the heavier trigger wins.

    Escalation outranks new evidence; both need a score.
    """
    s = _staged(_scored(findings(spark, sf_dir), _known(spark, sf_dir)))
    sig = table(spark, sf_dir, "signals").where("content IS NOT NULL AND received_at IS NOT NULL")
    end = sig.agg(F.max("received_at").alias("end"))
    fresh = sig.crossJoin(F.broadcast(end)).where(F.col("received_at") > F.col("end") - F.expr("INTERVAL 1 DAY")).select(F.explode(X.terms(F.col("content"))).alias("w")).distinct()
    candidates = s.where("stage IN ('deferred', 'normalized')")
    shared = candidates.where("score >= 0.01").select("finding", F.explode(_long_words("summary")).alias("w")).join(fresh, "w").groupBy("finding").agg(F.count(F.lit(1)).alias("shared"))
    escalated = (F.col("score") >= 0.02) & ((F.col("stage") == "normalized") | (F.col("times") >= 2))
    r = candidates.join(shared, "finding", "left").withColumn("trigger", F.when(escalated, "decay_escalation").when((F.col("score") >= 0.01) & (F.col("shared") >= 2), "new_evidence"))
    return r.where("trigger IS NOT NULL").select("finding", "stage", "trigger", "times", "score")


SQL["reemissions"] = f"""WITH {_SCORED}, st AS (SELECT *, {_STAGE} AS stage FROM scored),
fresh AS (SELECT DISTINCT unnest({sql_terms('content')}) AS w FROM signals WHERE content IS NOT NULL AND received_at > (SELECT max(received_at) FROM signals WHERE content IS NOT NULL) - INTERVAL 1 DAY),
c AS (SELECT * FROM st WHERE stage IN ('deferred', 'normalized')),
sh AS (SELECT finding, count(*) AS shared FROM (SELECT finding, unnest({_sql_long('summary')}) AS w FROM c WHERE score >= 0.01) JOIN fresh USING (w) GROUP BY finding),
r AS (SELECT c.*, CASE WHEN score >= 0.02 AND (stage = 'normalized' OR times >= 2) THEN 'decay_escalation' WHEN score >= 0.01 AND shared >= 2 THEN 'new_evidence' END AS trig FROM c LEFT JOIN sh USING (finding))
SELECT finding, stage, trig AS trigger, times, score FROM r WHERE trig IS NOT NULL"""


def portfolio_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-linkage clusters of recurring findings that share an actor or a channel, with compound scores.

    Findings are linked to what they share, never to each other, so a busy channel costs its number of findings.
    """
    s = materialize(_scored(findings(spark, sf_dir), _known(spark, sf_dir)).where("times >= 2").select("finding", "actors", "channels", "score"), "scored")
    keys = s.select("finding", F.explode(F.concat(F.transform("actors", lambda a: F.concat(F.lit("~a:"), a)), F.transform("channels", lambda c: F.concat(F.lit("~c:"), c)))).alias("key"))
    roots = G.components(keys, "finding", "key").select(F.col("v").alias("finding"), "root")
    c = s.join(roots, "finding").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"), F.sum("score").alias("total")).where("n >= 2")
    compound = F.col("top") + 0.3 * (F.col("total") - F.col("top"))
    return c.select(F.col("root").alias("cluster"), "n", _R("top").alias("top_score"), _R(compound, 4).alias("compound"), ((_R(compound, 4) >= 0.4) & (_R("top") < 0.4)).alias("escalated"))


SQL["portfolio_clusters"] = f"""WITH RECURSIVE {_SCORED}, s AS (SELECT finding, actors, channels, score FROM scored WHERE times >= 2),
k AS (SELECT finding AS a, unnest(list_concat(list_transform(actors, lambda x: '~a:' || x), list_transform(channels, lambda x: '~c:' || x))) AS b FROM s),
t AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
w(v, root) USING KEY (v) AS (SELECT a, min(least(a, b)) FROM t GROUP BY a UNION (SELECT t.b, min(w.root) FROM w JOIN t ON t.a = w.v JOIN recurring.w r ON r.v = t.b WHERE w.root < r.root GROUP BY t.b)),
c AS (SELECT root, count(*) AS n, max(score) AS top, sum(score) AS total FROM s JOIN w ON w.v = s.finding GROUP BY root HAVING count(*) >= 2)
SELECT root AS cluster, n, round(top, 6) AS top_score, round(top + 0.3::DOUBLE * (total - top), 4) AS compound, round(top + 0.3::DOUBLE * (total - top), 4) >= 0.4 AND round(top, 6) < 0.4 AS escalated FROM c"""

#: Workers that may corroborate: the seeded contexts' words, in order.
_WORKERS = {name: words for name, (words, _, _) in CONTEXTS.items()}


def _routed(f: DataFrame) -> DataFrame:
    """Every finding to the (at most five) workers whose words it shares, at least two of them (ties by name)."""
    overlap = {n: F.size(F.array_intersect("words", F.array(*map(F.lit, w)))) / (F.size("words") + len(w) - F.size(F.array_intersect("words", F.array(*map(F.lit, w))))) for n, w in _WORKERS.items()}
    words = F.array_distinct(F.concat(F.filter("terms", lambda t: t.rlike(r"^\p{L}+$")), "actors"))
    r = f.select("finding", "kind", "classification", words.alias("words")).where(F.size("words") > 0)
    ranked = r.select("finding", "kind", "classification", F.array_sort(F.array(*[F.struct((-_R(o)).alias("minus"), F.lit(n).alias("worker")) for n, o in overlap.items()])).alias("w"))
    top = ranked.select("finding", "kind", "classification", F.posexplode(F.slice("w", 1, 5)).alias("k", "w"))
    return top.select("finding", "kind", "classification", F.col("w.worker").alias("worker"), (-F.col("w.minus")).alias("relevance"), "k").where("relevance >= 0.02 OR k < 2")


def _verdicts(r: DataFrame) -> DataFrame:
    x = F.col("relevance")
    return r.withColumns({"verdict": F.when(x >= 0.1, "corroborate").when(x >= 0.03, "partial").otherwise("no_evidence"), "confidence": F.when(x >= 0.1, F.least(F.lit(0.7), 0.3 + x * 2)).when(x >= 0.03, 0.3).otherwise(0.2)})


_over = lambda w: f"round(len(list_intersect(words, {_list(w)})) / (len(words) + {len(w)} - len(list_intersect(words, {_list(w)}))), 6)"
_ROUTED = f"""{_FINDINGS}, fw AS (SELECT finding, kind, classification, list_distinct(list_concat(list_filter(terms, lambda t: regexp_full_match(t, '\\p{{L}}+')), actors)) AS words FROM findings),
rt0 AS ({' UNION ALL '.join(f"SELECT finding, kind, classification, '{n}' AS worker, {_over(w)} AS relevance FROM fw WHERE len(words) > 0" for n, w in _WORKERS.items())}),
rt AS (SELECT *, row_number() OVER (PARTITION BY finding ORDER BY relevance DESC, worker) AS k FROM rt0 QUALIFY k <= 5 AND (relevance >= 0.02 OR k <= 2)),
vd AS (SELECT *, CASE WHEN relevance >= 0.1 THEN 'corroborate' WHEN relevance >= 0.03 THEN 'partial' ELSE 'no_evidence' END AS verdict, CASE WHEN relevance >= 0.1 THEN least(0.7::DOUBLE, 0.3::DOUBLE + relevance * 2) WHEN relevance >= 0.03 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS confidence FROM rt)"""


def finding_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(_routed(findings(spark, sf_dir))).select("finding", "worker", "relevance", "verdict", _R("confidence").alias("confidence"))


SQL["finding_routes"] = f"WITH {_ROUTED} SELECT finding, worker, relevance, verdict, round(confidence, 6) AS confidence FROM vd"


def quorum_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a finding's workers together: partial ones count half; a quorum needs two workers and confidence."""
    v = _verdicts(_routed(findings(spark, sf_dir)))
    ok = F.col("verdict").isin("corroborate", "partial")
    weighted = F.when(F.col("verdict") == "corroborate", F.col("confidence")).when(F.col("verdict") == "partial", F.col("confidence") / 2)
    q = v.groupBy("finding").agg(F.count_if(ok).alias("n_corroborate"), F.count(F.lit(1)).alias("n_consulted"), _R(F.coalesce(F.avg(weighted), F.lit(0.0))).alias("confidence"))
    return q.withColumn("met", (F.col("n_corroborate") >= 2) & (F.col("confidence") >= 0.6))


SQL["quorum_findings"] = f"WITH {_ROUTED} SELECT finding, count(*) FILTER (WHERE verdict <> 'no_evidence') AS n_corroborate, count(*) AS n_consulted, round(coalesce(avg(CASE verdict WHEN 'corroborate' THEN confidence WHEN 'partial' THEN confidence / 2 END), 0.0::DOUBLE), 6) AS confidence, count(*) FILTER (WHERE verdict <> 'no_evidence') >= 2 AND round(coalesce(avg(CASE verdict WHEN 'corroborate' THEN confidence WHEN 'partial' THEN confidence / 2 END), 0.0::DOUBLE), 6) >= 0.6 AS met FROM vd GROUP BY finding"

# What a verdict does to a competency, and which competency a finding exercises.
VERDICT_DELTAS = {"corroborate": 0.02, "partial": 0.005, "contradict": -0.03}
COMPETENCIES = {"correlation": "cross_context_propagation", "discovery": "cross_context_propagation", "amplification": "temporal_analysis"}
KIND_COMPETENCIES = {"trend": "temporal_analysis", "risk": "anomaly_detection", "overlap": "similarity_detection"}


def competency_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning signal per competency: verdict deltas weighted by their confidence, summed."""
    v = _verdicts(_routed(findings(spark, sf_dir)))
    name = F.coalesce(S.looked_up(F.col("classification"), COMPETENCIES, None), S.looked_up(F.col("kind"), KIND_COMPETENCIES, None))
    delta = S.looked_up(F.col("verdict"), VERDICT_DELTAS, 0.0) * F.col("confidence")
    return v.select(name.alias("competency"), delta.alias("delta")).where("competency IS NOT NULL AND delta <> 0").groupBy("competency").agg(F.count(F.lit(1)).alias("n"), _R(F.sum("delta"), 5).alias("total"))


SQL["competency_deltas"] = f"WITH {_ROUTED}, d AS (SELECT CASE classification WHEN 'correlation' THEN 'cross_context_propagation' WHEN 'discovery' THEN 'cross_context_propagation' WHEN 'amplification' THEN 'temporal_analysis' ELSE CASE kind WHEN 'trend' THEN 'temporal_analysis' WHEN 'risk' THEN 'anomaly_detection' WHEN 'overlap' THEN 'similarity_detection' END END AS competency, CASE verdict WHEN 'corroborate' THEN 0.02::DOUBLE WHEN 'partial' THEN 0.005::DOUBLE ELSE 0.0::DOUBLE END * confidence AS delta FROM vd) SELECT competency, count(*) AS n, round(sum(delta), 5) AS total FROM d WHERE competency IS NOT NULL AND delta <> 0 GROUP BY competency"


def worker_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each worker is asked to corroborate: findings routed to it, distinct by the opening of their summary."""
    f = findings(spark, sf_dir)
    r = _routed(f).join(f.select("finding", F.substring("summary", 1, 64).alias("opening")), "finding")
    return r.groupBy("worker").agg(F.count(F.lit(1)).alias("n_routed"), F.count_distinct("opening").alias("n_asked"), _R(F.max("relevance")).alias("top_relevance"))


SQL["worker_payloads"] = f"WITH {_ROUTED} SELECT worker, count(*) AS n_routed, count(DISTINCT substr(summary, 1, 64)) AS n_asked, round(max(relevance), 6) AS top_relevance FROM rt JOIN findings USING (finding) GROUP BY worker"


def finding_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why findings are dropped before they are shown: re-descriptions, and overlaps of a single actor."""
    f = findings(spark, sf_dir)
    why = F.when(F.col("classification") == "retrieval", "retrieval").when((F.size("actors") <= 1) & (F.col("kind") == "overlap"), "single_actor_overlap").otherwise("kept")
    return f.groupBy("kind", why.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


SQL["finding_filter"] = f"WITH {_FINDINGS} SELECT kind, CASE WHEN classification = 'retrieval' THEN 'retrieval' WHEN len(actors) <= 1 AND kind = 'overlap' THEN 'single_actor_overlap' ELSE 'kept' END AS outcome, count(*) AS n FROM findings GROUP BY 1, 2"


def insight_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with text, distinct findings, and findings distinct by kind and the opening shown."""
    f = findings(spark, sf_dir)
    return f.agg(F.sum("times").alias("n_raw"), F.count(F.lit(1)).alias("n_findings"), F.count_distinct("kind", F.substring("summary", 1, 80)).alias("n_shown"))


SQL["insight_funnel"] = f"WITH {_FINDINGS} SELECT sum(times)::BIGINT AS n_raw, count(*) AS n_findings, count(DISTINCT (kind, substr(summary, 1, 80))) AS n_shown FROM findings"


def surfacing_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every person the asked-for findings in order of surface value: importance to them less the annoyance of what they know.

    Importance is the finding's share of all exposures; feedback is simulated by how often they met it (each met twice was known).
    """
    k = exposure_knowledge(spark, sf_dir)
    total = k.groupBy("finding").agg(F.sum("n").alias("all"))
    whole = k.agg(F.sum("n").alias("whole"))
    met = k.groupBy("person").agg(F.count_if(F.col("n") >= 2).alias("knew"), F.count_if(F.col("n") < 2).alias("novel"))
    r = k.join(total, "finding").join(met, "person").crossJoin(F.broadcast(whole))
    value = S.surface_value(_R(F.col("all") / F.col("whole")), F.col("p_knows"), S.annoyance_weight(F.col("knew"), F.col("novel")))
    r = r.select("person", "finding", "p_knows", _R(value, 5).alias("value"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("value"), "finding")))


SQL["surfacing_ranks"] = f"WITH k AS ({ACTIVITY_SQL['exposure_knowledge']}), t AS (SELECT finding, sum(n) AS a FROM k GROUP BY finding), m AS (SELECT person, count(*) FILTER (WHERE n >= 2) AS knew, count(*) FILTER (WHERE n < 2) AS novel FROM k GROUP BY person), r AS (SELECT person, finding, p_knows, round(round(a / (SELECT sum(n) FROM k), 6) * (1 - p_knows) - 0.3::DOUBLE * (0.5::DOUBLE + knew / (knew + novel)) * p_knows, 5) AS value FROM k JOIN t USING (finding) JOIN m USING (person)) SELECT person, finding, p_knows, value, row_number() OVER (PARTITION BY person ORDER BY value DESC, finding) AS rank FROM r"


def finding_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that two or more actors share, with how far apart two of them are known to be: one hop if any of them are in contact."""
    f = findings(spark, sf_dir).where(F.size("actors") >= 2).select("finding", "actors")
    ties = contacts(spark, sf_dir).where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("nb")), F.struct(F.col("dst").alias("v"), F.col("src").alias("nb")))).alias("e")).select("e.*").distinct()
    near = f.select("finding", "actors", F.explode("actors").alias("v")).join(ties, "v").where(F.array_contains("actors", F.col("nb"))).select("finding").distinct().withColumn("in_contact", F.lit(True))
    return f.join(near, "finding", "left").select("finding", F.size("actors").alias("n_actors"), F.coalesce("in_contact", F.lit(False)).alias("in_contact"))


SQL["finding_actors"] = f"WITH {_CONTACTS}, {_FINDINGS}, m AS (SELECT finding, actors FROM findings WHERE len(actors) >= 2), n AS (SELECT DISTINCT finding FROM (SELECT finding, actors, unnest(actors) AS v FROM m) JOIN ties USING (v) WHERE list_contains(actors, nb)) SELECT finding, len(actors) AS n_actors, finding IN (SELECT finding FROM n) AS in_contact FROM m"

QUERIES = {f.__name__: f for f in (finding_scores, decay_stages, registry_summary, reemissions, portfolio_clusters, finding_routes, quorum_findings, competency_deltas, worker_payloads, finding_filter, insight_funnel, surfacing_ranks, finding_actors)}
