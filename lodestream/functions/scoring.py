"""Closed forms: scores of findings, surfacing, energy, weights, structural coefficients, policy and redaction rules.

All are native column expressions, so they fuse into the scan's generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# How near a finding comes to operational risk, by kind, severity, words, class and currency.
TYPE_COUPLING = {"contradiction": 0.85, "risk": 0.80, "overlap": 0.55, "trend": 0.45, "parallel_activity": 0.40, "cross_source_correlation": 0.50, "recurring_theme": 0.35}
SEVERITY_SHIFT = {"critical": 0.20, "high": 0.15, "medium": 0.0, "low": -0.10}
RISK_WORDS = ("deploy", "production", "payment", "billing", "downtime", "outage", "security", "auth", "migration", "database", "breaking", "regression", "rollback", "hotfix", "incident")
CLASS_FACTOR = {"retrieval": 0.5, "amplification": 1.0, "correlation": 1.0, "discovery": 1.2}
CURRENCY_FACTOR = {"active": 1.0, "historical": 0.6, "stale": 0.2}

# Paths of authentication surfaces, and the domains of paths.
AUTH_PATHS = r"(?i)(^|/)(auth[/.]|middleware/auth|security[/.]|session[/.]|jwt[/.]|token[/.]|acl[/.]|permissions?[/.]|rbac[/.]|oauth[/.]|credentials?[/.]|firewall[/.])"
PATH_DOMAINS = (
    ("src/pms/bookings/", "booking"), ("src/pms/availability/", "availability"), ("src/data/pricing/", "pricing"), ("src/payment/", "payment"), ("src/pms/pms/", "pms-integration"), ("src/pms/sync/", "sync"), ("src/auth/", "auth"), ("src/search/", "search"),
    ("src/saas/", "saas"), ("src/growth/", "growth"), ("src/ai/", "ai"), ("services/api/", "api-server"), ("services/auth/", "auth-server"), ("services/scheduler/", "scheduler"), ("packages/libraries/prisma/", "prisma-schema"), ("packages/clients/", "external-client"),
)
# Weekly limits of activity, and from how many changed lines on a change is large.
BUDGETS = {"diff_lines": 5000, "dependency_crossings": 5, "auth_touches": 3}
HIGH_CHURN = 500


def sigmoid(x: Column, midpoint: float = 0.0, steepness: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-steepness * (x - midpoint)))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def looked_up(key: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def risk_coupling(kind: Column, severity: Column, summary: Column, classification: Column, currency: Column) -> Column:
    """Base by kind, shifted by severity and up to three risk words, scaled by class and currency, in [0.05, 1]."""
    low = F.lower(summary)
    hits = F.lit(0)
    for w in RISK_WORDS:
        hits = hits + F.when(low.contains(w), 1).otherwise(0)
    raw = looked_up(F.lower(kind), TYPE_COUPLING, 0.40) + looked_up(F.lower(severity), SEVERITY_SHIFT, 0.0) + F.least(F.lit(0.15), hits * 0.05)
    return clip(raw * looked_up(F.lower(classification), CLASS_FACTOR, 1.0) * looked_up(F.lower(currency), CURRENCY_FACTOR, 1.0), 0.05)


def communicability(confidence: Column, n_actors: Column, n_bridges: Column) -> Column:
    """How precisely a finding can be passed on: confidence and what it names."""
    return sigmoid(3.0 * (confidence * 0.6 + F.least(F.lit(1.0), n_actors * 0.2 + n_bridges * 0.15) * 0.4))


def bridge_distance(max_hops: Column, mean_effective_size: Column) -> Column:
    """How far a finding reaches across structural holes; 0.95 for people without a path (null hops)."""
    return F.coalesce(sigmoid(max_hops * F.log1p(mean_effective_size) - 2), F.lit(0.95))


def entity_confidence(n_actors: Column, n_resolved: Column) -> Column:
    return F.when(n_actors > 0, 0.3 + 0.65 * n_resolved / n_actors).otherwise(0.3)


def decay_stage(times: Column, days: Column, retrieval: Column, action_correlation: Column, changed: Column) -> Column:
    """Active, deferred, normalized or acknowledged: what is repeated without action fades, re-descriptions faster; a first surfacing is always active."""
    fast = retrieval | F.coalesce((action_correlation >= 0) & (action_correlation < 0.1), F.lit(False))
    stage = F.when(fast, F.when((times >= 2) & (days >= 7), "normalized").otherwise("deferred")).otherwise(F.when((times >= 3) & (days >= 14), "normalized").when(times >= 2, "deferred").otherwise("active"))
    return F.when(changed, "acknowledged").when(times <= 1, "active").otherwise(stage)


def annoyance_weight(knew: Column, novel: Column, base: float = 0.3) -> Column:
    """The cost of telling somebody what they know, by how often they did; neutral without feedback."""
    total = knew + novel
    return base * (0.5 + F.when(total > 0, knew / total).otherwise(0.5))


def surface_value(importance: Column, p_knows: Column, annoyance: Column | float = 0.3, weight: float = 1.0) -> Column:
    return weight * importance * (1 - p_knows) - annoyance * p_knows


def energy(base: Column, rate: float, seconds: Column) -> Column:
    return base * F.exp(-rate * seconds)


def energy_status(level: Column) -> Column:
    return F.when(level < 0.05, "archived").when(level < 0.3, "decaying").otherwise("active")


def should_fork(count: Column, familiarity: Column, volume: int = 100, coherence: float = 0.5) -> Column:
    return (count > volume) | (count > 10) & (familiarity < coherence)


def gap_threshold(mean_count: Column, configured: float = 0.08) -> Column:
    """No gaps below ten signals a worker, then rising to the configured threshold at fifty."""
    return F.when(mean_count < 10, 0.0).when(mean_count < 50, configured * (mean_count - 10) / 40).otherwise(configured)


def business_weight(metrics: list[Column], weights: tuple[float, ...] = (0.25, 0.25, 0.25, 0.25), floor: float = 0.1) -> tuple[Column, Column]:
    """``raw, effective``: the weighted mean of metrics in [0, 1] (others are an error), and not below the floor."""
    total = sum(weights)
    mean = sum((w * m for w, m in zip(weights[1:], metrics[1:])), weights[0] * metrics[0]) / total if total else F.lit(0.5)
    valid = F.lit(True)
    for m in metrics:
        valid = valid & (m >= 0) & (m <= 1) & ~F.isnan(m)
    raw = F.when(valid, clip(mean)).otherwise(F.raise_error(F.lit("a metric lies outside 0 to 1")).cast("double"))
    return raw, F.greatest(raw, F.lit(floor))


def transaction_coefficients(local: Column, neighbourhood: Column, in_degree: Column, out_degree: Column) -> dict[str, Column]:
    """Seven structural coefficients of a transaction in [0, 1], from its own and its neighbourhood's features and its degrees."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    std = lambda a, m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))
    lm, nm = mean(local), mean(neighbourhood)
    ls, ns = std(local, lm), std(neighbourhood, nm)
    total = in_degree + out_degree
    extreme = F.size(F.filter(local, lambda x: F.abs((x - lm) / ls) > 2)) / F.size(local)
    return {
        "frag": clip(sigmoid(out_degree, 3.0, 0.8)),
        "relay": clip(F.when(total > 0, (1 - F.abs(in_degree - out_degree) / total) * sigmoid(total, 4.0, 0.5)).otherwise(0.0)),
        "variance": clip(ls / 3),
        "divergence": clip(F.when((ns > 0) & (ls > 0), F.abs(nm - lm) / F.greatest(ls, F.lit(0.01)) / 3).otherwise(0.0)),
        "density": clip(F.when(ls > 0, extreme).otherwise(0.0)),
        "fan": clip(F.when(total > 0, ((out_degree - in_degree) / total + 1) / 2).otherwise(0.5)),
        "complexity": clip(F.when(nm != 0, ns / F.abs(nm) / 3).otherwise(0.0)),
    }


def wallet_coefficients(w: dict[str, Column]) -> dict[str, Column]:
    """Seven structural coefficients of a wallet in [0, 1]: balance, concentration, regularity, partners, fees, intensity, repetition."""
    some = lambda c, x: F.when(c, x).otherwise(0.0)
    return {
        "asymmetry": clip(F.when(w["txs"] > 0, w["sent"] / w["txs"]).otherwise(0.5)),
        "concentration": some((w["mean"] > 0) & (w["max"] > 0), clip(sigmoid(w["max"] / w["mean"], 5.0, 0.5))),
        "regularity": some((w["gap_mean"] > 0) & (w["gap_max"] > 0), clip(w["gap_median"] / w["gap_max"])),
        "partners": F.when(w["txs"] > 0, clip(sigmoid(w["partners"] / w["txs"], 2.0, 1.0))).when(w["partners"] > 0, clip(sigmoid(w["partners"], 10.0, 0.3))).otherwise(0.0),
        "fees": clip(w["fee_share"] * 100),
        "intensity": F.when(w["lifetime"] > 0, clip(sigmoid(w["txs"] / w["lifetime"] * 1000, 1.0, 2.0))).when(w["txs"] > 0, 1.0).otherwise(0.0),
        "repetition": some(w["partners"] > 0, clip(w["repeated"] / w["partners"])),
    }


def level(x: Column) -> Column:
    return F.when(x > 0.7, "high").when(x > 0.3, "mid").otherwise("low")


def file_domains(path: Column) -> Column:
    return F.array_compact(F.array(*[F.when(path.contains(p), d) for p, d in PATH_DOMAINS]))


def policy_signals(files: Column, diff_lines: Column) -> Column:
    """What is structurally true of a change, as an array of ``kind, detail``."""
    domains = F.array_sort(F.array_distinct(F.flatten(F.transform(files, file_domains))))
    auth = F.filter(files, lambda f: f.rlike(AUTH_PATHS))
    found = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"))
    return F.array_compact(F.array(
        F.when(F.size(domains) > 1, found("dependency_crossing", F.array_join(domains, ","))), F.when(F.size(auth) > 0, found("auth_surface_touched", F.array_join(auth, ","))), F.when(diff_lines > HIGH_CHURN, found("high_churn", diff_lines))
    ))


def trace_id(event: Column, repo: Column, identifier: Column) -> Column:
    return F.substring(F.sha2(F.concat(event, F.lit(":"), repo, F.lit(":"), identifier), 256), 1, 20)


def redacted_identifier(identifier: Column) -> Column:
    """An e-mail address shows its first character only; everything else is public."""
    looks = identifier.contains("@") & F.substring_index(identifier, "@", -1).contains(".")
    return F.when(looks, F.concat(F.substring(identifier, 1, 1), F.lit("***@***"))).otherwise(identifier)


def brier_partitions(score: Column) -> Column:
    """How many messages a source of this calibration can tell apart."""
    return F.greatest(F.lit(1.0), -0.5 + 0.5 * F.sqrt(1 + 2 / F.greatest(score, F.lit(0.01))))


def breathing(index: Column, period: int = 200, accumulate: float = 0.6, amplitude: float = 0.1) -> tuple[Column, Column]:
    """``phase, modulation`` of thresholds at a signal's index: lowered while accumulating, raised while integrating."""
    at = index % period / period
    low, high = at / accumulate, (at - accumulate) / (1 - accumulate)
    return F.when(at < accumulate, "accumulate").otherwise("integrate"), F.when(at < accumulate, -amplitude * F.sin(math.pi * low)).otherwise(amplitude * F.sin(math.pi * high))


def asymmetry(entropy_ratio: Column, volume_ratio: Column) -> Column:
    """How much more the variety of sources shrank than their volume, while volume is still there."""
    gap = F.greatest(F.lit(0.0), 1 - entropy_ratio) - F.greatest(F.lit(0.0), 1 - volume_ratio)
    return F.when(gap > 0, F.least(F.lit(1.0), F.sqrt(gap) * F.sqrt(F.least(volume_ratio, F.lit(1.0))))).otherwise(0.0)


def coupling_severity(strength: Column) -> Column:
    return F.when(strength > 0.7, "high").when(strength > 0.4, "medium").otherwise("low")


def spectral_alert(low: Column, high: Column, gap: Column) -> tuple[Column, Column]:
    """``subtype, severity`` of a spectrum: discordant flow on the right, collapsing modes on the left, else none."""
    left = (low > 0.75) & (gap < 0.5)
    return F.when(high > 0.65, "right_shift").when(left, "left_shift").otherwise("none"), F.when(high > 0.8, "critical").when(high > 0.7, "high").when((high > 0.65) | left, "medium").otherwise("low")
