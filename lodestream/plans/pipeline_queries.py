"""The flagship pipeline: score signals against seeded contexts, vote, and filter what may surface.

Contexts and agents are small literal tables (three rows each), so they are expressions and need
no join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import rules, text as X
from lodestream.plans.text_queries import SQL as TEXT_SQL, _kill, _labels, _list, _meta, _red, _redact, sql_terms
from lodestream.sources.tables import table

_R = lambda c, n=6: F.round(c, n)

#: Seeded contexts: terms, share of each source, time of the last signal.
CONTEXTS = {
    "engineering": (("deploy", "error", "cache", "index", "queue", "retry", "timeout", "latency", "release", "build", "pool", "memory", "certificate", "rollback", "schema", "migration"), {"github": 0.5, "grafana": 0.3, "slack": 0.2}, "2024-06-01 00:00:00"),
    "delivery": (("ticket", "standup", "review", "target", "estimate", "acceptance", "cycle", "blocked", "rollout", "week", "milestone", "demo", "operator", "spike", "comment", "tenant"), {"linear": 0.7, "slack": 0.2, "github": 0.1}, "2024-09-01 00:00:00"),
    "people": (("hire", "leave", "customer", "called", "contract", "badge", "laptop", "desk", "payroll", "form", "offsite", "talked", "escalated", "attachment", "redact", "signed"), {"slack": 0.8, "linear": 0.1, "github": 0.1}, "2024-03-01 00:00:00"),
}
#: Weights of the components of familiarity: keywords, source, time, credibility.
WEIGHTS = {"keyword": 0.5, "source": 0.2, "temporal": 0.2, "credibility": 0.1}
HALF_LIFE_HOURS = 24 * 30
#: Agents: confidence, affinity to each context, weight of each domain.
AGENTS = {
    "reviewer": (0.95, {"engineering": 0.95, "delivery": 0.6, "people": 0.1}, {"technical": 0.9, "operations": 0.7, "business": 0.3, "organizational": 0.2, "general": 0.4}),
    "manager": (0.9, {"engineering": 0.3, "delivery": 0.9, "people": 0.95}, {"technical": 0.3, "operations": 0.55, "business": 0.9, "organizational": 0.8, "general": 0.6}),
}
#: A context takes part in the vote on a signal that is more familiar to it than this.
RELEVANCE = 0.2
#: Weight above which a vote is resolved, and above which an unresolved one is flagged for review.
RESOLVED, FLAGGED = 0.6, 0.3
ACTIONS = ("surface", "store", "ignore")


def familiarity(term_array: Column, source: Column, at: Column, credibility: Column, context: str) -> Column:
    """Weighted mean of keyword overlap (Jaccard), source share, nearness in time and credibility, in [0, 1]."""
    words, shares, last = CONTEXTS[context]
    both = F.size(F.array_intersect(term_array, F.array(*map(F.lit, words))))
    keyword = both / (F.size(term_array) + len(words) - both)
    share = F.lit(0.0)
    for s, v in shares.items():
        share = F.when(source == s, v).otherwise(share)
    seconds = F.abs(F.unix_micros(at) - F.unix_micros(F.lit(last + "+00:00").cast("timestamp"))) / 1e6
    temporal = F.coalesce(F.exp(-math.log(2) / (HALF_LIFE_HOURS * 3600) * seconds), F.lit(0.0))
    total = WEIGHTS["keyword"] * keyword + WEIGHTS["source"] * share + WEIGHTS["temporal"] * temporal + WEIGHTS["credibility"] * credibility
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / sum(WEIGHTS.values())))


def scored_signals(signals: DataFrame) -> DataFrame:
    """Signals with text, their terms, credibility, domain and familiarity with every context."""
    diff = F.coalesce(_meta("additions").try_cast("bigint"), F.lit(0)) + F.coalesce(_meta("deletions").try_cast("bigint"), F.lit(0))
    s = signals.where("content IS NOT NULL").select("delivery_no", "content", "source", "channel", "received_at", X.terms(F.col("content")).alias("terms"), rules.credibility(F.coalesce(_meta("event_type"), F.lit("")), F.col("source"), diff).alias("credibility"), _labels().alias("labels"))
    s = s.withColumn("domain", rules.domain(F.col("terms"), F.col("source"), F.col("channel"), F.col("labels")))
    return s.withColumns({f"f_{c}": _R(familiarity(F.col("terms"), F.col("source"), F.col("received_at"), F.col("credibility"), c)) for c in CONTEXTS})


_FAM_SQL = []
for _name, (_words, _shares, _last) in CONTEXTS.items():
    _share = "CASE " + " ".join(f"WHEN source = '{s}' THEN {v}::DOUBLE" for s, v in _shares.items()) + " ELSE 0.0::DOUBLE END"
    _both = f"len(list_intersect(terms, {_list(_words)}))"
    _FAM_SQL.append(
        f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.5::DOUBLE * {_both} / (len(terms) + {len(_words)} - {_both}) + 0.2::DOUBLE * {_share} + 0.2::DOUBLE * coalesce(exp({-math.log(2) / (HALF_LIFE_HOURS * 3600)!r}::DOUBLE * abs(epoch_us(received_at) - epoch_us(TIMESTAMPTZ '{_last}+00:00')) / 1000000.0::DOUBLE), 0.0::DOUBLE) + 0.1::DOUBLE * credibility) / 1.0::DOUBLE)), 6) AS f_{_name}"
    )
_SCORED = f"""base AS (SELECT s.delivery_no, s.content, s.source, s.channel, s.received_at, {sql_terms('s.content')} AS terms, c.credibility, d.domain FROM signals s JOIN ({TEXT_SQL['credibility_scores'].replace('round(CASE WHEN diff', '(CASE WHEN diff').replace('END, 6) AS credibility', 'END) AS credibility')}) c USING (delivery_no) JOIN ({TEXT_SQL['domain_inference']}) d USING (delivery_no) WHERE s.content IS NOT NULL),
scored AS (SELECT *, {', '.join(_FAM_SQL)} FROM base)"""


def familiarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_signals(table(spark, sf_dir, "signals")).select("delivery_no", *[f"f_{c}" for c in CONTEXTS])


SQL = {"familiarity_scores": f"WITH {_SCORED} SELECT delivery_no, {', '.join('f_' + c for c in CONTEXTS)} FROM scored"}


def _best(s: DataFrame) -> DataFrame:
    top = F.greatest(*[F.col(f"f_{c}") for c in CONTEXTS])
    name = F.lit(None).cast("string")
    for c in reversed(CONTEXTS):
        name = F.when(F.col(f"f_{c}") == top, c).otherwise(name)
    return s.withColumns({"familiarity": top, "context": name})


def ballot(context: str, agent: str, domain: str) -> tuple[str, float]:
    """``(action, weight)`` of an agent's mechanical assessment: it surfaces what it is sure of in a domain that matters to it, ignores what is far, else stores."""
    confidence, affinities, weights = AGENTS[agent]
    sure, weight = confidence * affinities.get(context, 0.0), weights.get(domain, 0.0)
    action = "surface" if sure > 0.7 and weight > 0.5 else "ignore" if sure < 0.2 else "store"
    return action, round(sure * confidence * weight, 6)


DOMAINS = (*rules.DOMAIN_HINTS, "general")


def votes(domain: Column, scores: dict[str, Column]) -> dict[str, Column]:
    """Summed weight of every action over the relevant contexts' agents (a fixed table of contexts, agents and domains)."""
    out = {a: F.lit(0.0) for a in ACTIONS}
    for c, score in scores.items():
        for a in ACTIONS:
            weight = F.lit(0.0)
            for d in DOMAINS:
                weight = F.when(domain == d, sum(w for who in AGENTS for act, w in [ballot(c, who, d)] if act == a)).otherwise(weight)
            out[a] = out[a] + F.when(score > RELEVANCE, weight).otherwise(0.0)
    return out


def consensus(vote: dict[str, Column]) -> dict[str, Column]:
    """``action, weight, status``: the heaviest action (ties in the order surface, store, ignore) if its weight resolves the vote, else store.

    Without any assessment a signal is stored with weight 0.
    """
    most = F.greatest(*vote.values())
    name = F.lit("store")
    for a in reversed(ACTIONS):
        name = F.when(vote[a] == most, a).otherwise(name)
    status = F.when(most > RESOLVED, "resolved").when(most > FLAGGED, "flagged").otherwise("open")
    return {"action": F.when(most > RESOLVED, name).otherwise("store"), "weight": _R(most), "status": status}


def voted_signals(signals: DataFrame) -> DataFrame:
    """Scored signals with the votes summed once per row (the struct keeps the optimiser from repeating them)."""
    s = _best(scored_signals(signals))
    v = votes(F.col("domain"), {c: F.col(f"f_{c}") for c in CONTEXTS})
    return s.select("delivery_no", "content", "context", "domain", "familiarity", F.explode(F.array(F.struct(*[v[a].alias(a) for a in ACTIONS]))).alias("v"))


def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = voted_signals(table(spark, sf_dir, "signals"))
    found = consensus({a: F.col(f"v.{a}") for a in ACTIONS})
    return s.select("delivery_no", "context", "domain", "familiarity", *[c.alias(n) for n, c in found.items()])


def _sql_vote(action: str) -> str:
    arms = []
    for c in CONTEXTS:
        table_of = [(d, sum(w for who in AGENTS for act, w in [ballot(c, who, d)] if act == action)) for d in DOMAINS]
        arms.append(f"CASE WHEN f_{c} > {RELEVANCE} THEN CASE domain " + " ".join(f"WHEN '{d}' THEN {w!r}::DOUBLE" for d, w in table_of) + " ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END")
    return f"{' + '.join(arms)} AS v_{action}"


_top = f"greatest({', '.join('f_' + c for c in CONTEXTS)})"
_VOTED = f"""{_SCORED}, best AS (SELECT *, {_top} AS familiarity, CASE {' '.join(f"WHEN f_{c} = {_top} THEN '{c}'" for c in CONTEXTS)} END AS context FROM scored),
voted AS (SELECT *, greatest(v_surface, v_store, v_ignore) AS w FROM (SELECT *, {', '.join(map(_sql_vote, ACTIONS))} FROM best)),
decided AS (SELECT *, CASE WHEN w <= {RESOLVED} THEN 'store' WHEN v_surface = w THEN 'surface' WHEN v_store = w THEN 'store' ELSE 'ignore' END AS action FROM voted)"""
SQL["consensus_votes"] = f"WITH {_VOTED} SELECT delivery_no, context, domain, familiarity, action, round(w, 6) AS weight, CASE WHEN w > {RESOLVED} THEN 'resolved' WHEN w > {FLAGGED} THEN 'flagged' ELSE 'open' END AS status FROM decided"


def surfaced_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may surface: voted so with a resolved vote, not stopped by a constraint, redacted where one asks for it.

    What a constraint stops is dropped at the scan; the decision is a struct of its own, so the
    filter on it is not pushed below the vote and nothing is computed twice.
    """
    s = voted_signals(table(spark, sf_dir, "signals").where(rules.kill_category(F.col("content")).isNull()))
    kept = s.select("*", F.explode(F.filter(F.array(F.struct(*[c.alias(n) for n, c in consensus({a: F.col(f"v.{a}") for a in ACTIONS}).items()])), lambda d: d["action"] == "surface")).alias("d"))
    return kept.select("delivery_no", "context", "domain", "familiarity", F.col("d.weight").alias("weight"), F.when(rules.asks_redaction(F.col("content")), "redact").otherwise("pass").alias("filter"), rules.redacted(F.col("content")).alias("content"))


SQL["surfaced_output"] = f"WITH {_VOTED} SELECT delivery_no, context, domain, familiarity, round(w, 6) AS weight, CASE WHEN {_redact} THEN 'redact' ELSE 'pass' END AS filter, {_red} AS content FROM decided WHERE action = 'surface' AND NOT ({_kill})"

QUERIES = {f.__name__: f for f in (familiarity_scores, consensus_votes, surfaced_output)}
