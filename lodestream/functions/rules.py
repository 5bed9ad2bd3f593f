"""Rules on signals: constraints, noise, domains, credibility, action and discussion predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that stop a message, in order, and patterns that are blanked.
KILL_PATTERNS = (
    (r"\b\d{3}-\d{2}-\d{4}\b", "pii_ssn"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "pii_email"),
    (r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", "pii_credit_card"),
    (r"(?:password|passwd|pwd)\s*[=:]\s*\S+", "credentials"),
    (r"(?:api[_-]?key|secret[_-]?key|access[_-]?token)\s*[=:]\s*\S+", "credentials"),
    (r"(?:Bearer|Basic)\s+[A-Za-z0-9+/=_-]{20,}", "credentials"),
    (r"\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s*(?:salary|compensation|comp\b)", "financial_compensation"),
    (r"(?:salary|compensation|comp)\s*(?:is|was|of|:)[\s:]*\$\d+", "financial_compensation"),
    (r"(?:termination|terminated|firing|fired|PIP)\s+(?:of|for)\s+\w+", "hr_sensitive"),
    (r"(?:equity|stock\s*options?|vesting)\s*(?:is|was|of|:)\s*\d+", "hr_sensitive"),
)
REDACT_PATTERNS = (
    (r"\b\d{3}-\d{3}-\d{4}\b", "[PHONE REDACTED]", "pii_phone"),
    (r"\b\d{1,5}\s+\w+\s+(?:St|Ave|Blvd|Dr|Rd|Ln|Way|Ct)\b", "[ADDRESS REDACTED]", "pii_address"),
)
# Subtypes of system messages, and short acknowledgements.
SYSTEM_SUBTYPES = ("channel_join", "channel_leave", "bot_add", "bot_remove", "channel_topic", "channel_purpose", "channel_name", "pinned_item", "unpinned_item")
ACKS = ("ok", "okay", "k", "kk", "kthx", "thanks", "thank you", "thx", "ty", "tysm", "ty!", "np", "no problem", "yes", "yep", "yeah", "ya", "no", "nope", "sure", "sounds good", "sgtm", "lgtm", "+1", "-1", "done", "done!", "ditto", "same", "agreed", "agree", "nice", "cool", "great", "awesome", "lol", "haha", "ack", "acked", "got it", "gotit", "yw", "ditto.", "+1!", "this", "indeed", "right")
ACK_EDGES = " \t\n.!?,:;)(_*~`\"'"
# Hints of the domains, in order of precedence (keywords, sources, parts of channel names).
DOMAIN_HINTS = {
    "technical": (("bug", "error", "fail", "crash", "fix", "merge", "refactor", "api", "endpoint", "test", "code", "pr", "commit", "branch"), ("github",), ("engineering", "dev", "code-review", "backend", "frontend")),
    "business": (("revenue", "sales", "customer", "market", "growth", "churn", "conversion", "pricing", "forecast", "contract"), (), ("sales", "marketing", "leadership", "revenue")),
    "operations": (("deploy", "release", "rollback", "ci", "build", "infra", "incident", "outage", "monitoring", "alert", "pipeline"), ("deploy",), ("ops", "devops", "incidents", "infrastructure")),
    "organizational": (("hire", "team", "meeting", "review", "onboarding", "process", "standup", "retro", "sprint", "planning"), (), ("general", "hr", "hiring", "culture")),
}
COSTLY_EVENTS = ("pull_request", "push", "release", "merge", "review")
CHEAP_EVENTS = ("comment", "reaction", "status_update", "label_change")
ACTION_EVENTS = ("pull_request_merged", "pull_request_closed", "push", "commit", "deployment", "release")
DISCUSSION_EVENTS = ("message", "comment", "issue_comment", "pr_comment")
DONE_STATES = ("done", "closed", "completed", "cancelled")
FINISHED_STATES = ("done", "closed", "completed")


def kill_category(text: Column) -> Column:
    """The category of the first kill pattern that fires; null if none does."""
    out = F.lit(None).cast("string")
    for pattern, category in reversed(KILL_PATTERNS):
        out = F.when(text.rlike("(?i)" + pattern), category).otherwise(out)
    return out


def redacted(text: Column) -> Column:
    for pattern, replacement, _ in REDACT_PATTERNS:
        text = F.regexp_replace(text, "(?i)" + pattern, replacement.replace("$", r"\$"))
    return text


def fired_categories(text: Column) -> Column:
    """All categories that fire, sorted."""
    kinds = [(p, c) for p, c in KILL_PATTERNS] + [(p, c) for p, _, c in REDACT_PATTERNS]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), c) for p, c in kinds]))))


def keywords(pattern: str, least: int = 2) -> list[str]:
    """The runs of letters that a pattern spells out, lower case: what a cheap search can look for first."""
    bare = re.sub(r"\[.*?\]|\\[a-zA-Z]|\{[^}]*\}", "", pattern)
    return [m.lower() for m in re.findall(f"[a-zA-Z]{{{least},}}", bare)]


class Constraints:
    """A set of constraints from a configuration: ``kill_patterns`` and ``redact_patterns`` of ``pattern, category[, replacement]``."""

    def __init__(self, config: dict | None = None):
        config = {} if config is None else config
        self.kills = tuple((e["pattern"], e["category"]) for e in config.get("kill_patterns", ()))
        self.redactions = tuple((e["pattern"], e.get("replacement", "[REDACTED]"), e["category"]) for e in config.get("redact_patterns", ()))
        for pattern, *_ in (*self.kills, *self.redactions):
            re.compile(pattern)

    def any_keyword(self, text: Column) -> Column:
        """Whether any word that the patterns spell out occurs; patterns that spell none out always count."""
        words = [keywords(p) for p, *_ in (*self.kills, *self.redactions)]
        if not all(words):
            return F.lit(True)
        return F.coalesce(F.lower(text).rlike("|".join(re.escape(w) for ws in words for w in ws)), F.lit(False)) if words else F.lit(False)

    def action(self, text: Column) -> Column:
        hit = lambda patterns: F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)
        return F.when(hit([p for p, _ in self.kills]), "kill").when(hit([p for p, _, _ in self.redactions]), "redact").otherwise("pass")

    def redacted(self, text: Column) -> Column:
        for pattern, replacement, _ in self.redactions:
            text = F.regexp_replace(text, "(?i)" + pattern, replacement.replace("$", r"\$"))
        return text


# What a rating of feedback changes.
RATING_ACTIONS = {"helpful": (("agent_confidence", 0.05),), "wrong": (("agent_confidence", -0.08),), "irrelevant": (("agent_confidence", -0.03),), "already_knew": (("agent_confidence", 0.02), ("surfacing_priority", -0.04))}


def rating_actions(rating: Column, enabled: tuple[str, ...] = ("agent_confidence",)) -> Column:
    """What a rating calls for, as an array of ``dimension, delta, enabled``; null for other ratings."""
    out = F.lit(None).cast("array<struct<dimension:string,delta:double,enabled:boolean>>")
    for name, actions in RATING_ACTIONS.items():
        out = F.when(rating == name, F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(x).alias("delta"), F.lit(d in enabled).alias("enabled")) for d, x in actions])).otherwise(out)
    return out


def asks_redaction(text: Column) -> Column:
    redacts = F.lit(False)
    for pattern, _, _ in REDACT_PATTERNS:
        redacts = redacts | text.rlike("(?i)" + pattern)
    return redacts


def constraint_action(text: Column) -> Column:
    return F.when(kill_category(text).isNotNull(), "kill").when(asks_redaction(text), "redact").otherwise("pass")


def is_noise(content: Column, subtype: Column) -> Column:
    """Empty texts, system messages, texts without a letter or digit, and short acknowledgements."""
    text = F.btrim(content, F.lit(" \t\n\r"))
    bare = F.btrim(F.lower(text), F.lit(ACK_EDGES))
    return F.coalesce((text == "") | ~text.rlike(r"[\p{L}\p{N}]") | ((F.length(text) <= 16) & bare.isin(*ACKS)), F.lit(True)) | F.coalesce(subtype.isin(*SYSTEM_SUBTYPES), F.lit(False))


def domain_scores(term_array: Column, source: Column, channel: Column, labels: Column | None = None) -> dict[str, Column]:
    out = {}
    for domain, (keywords, sources, channels) in DOMAIN_HINTS.items():
        score = 0.2 * F.size(F.array_intersect(term_array, F.array(*map(F.lit, keywords))))
        if sources:
            score = score + F.when(source.isin(*sources), 0.3).otherwise(0.0)
        if labels is not None:
            score = score + 0.1 * F.coalesce(F.size(F.array_intersect(F.array_distinct(F.transform(labels, F.lower)), F.array(*map(F.lit, keywords)))), F.lit(0))
        near = F.lit(False)
        for c in channels:
            near = near | F.coalesce(F.lower(channel).contains(c), F.lit(False))
        out[domain] = score + F.when(near, 0.2).otherwise(0.0)
    return out


def domain(term_array: Column, source: Column, channel: Column, labels: Column | None = None) -> Column:
    """The domain with the highest additive score, ties to the first in the table; ``general`` if all are zero."""
    scores = domain_scores(term_array, source, channel, labels)
    best = F.greatest(*scores.values())
    out = F.lit("general")
    for name, score in reversed(scores.items()):
        out = F.when((best > 0) & (score == best), name).otherwise(out)
    return out


def credibility(event_type: Column, source: Column, diff_lines: Column) -> Column:
    """What a signal cost its sender: by event type, else by source, plus a bonus that grows with the lines changed."""
    base = F.when(event_type.isin(*COSTLY_EVENTS), 0.8).when(event_type.isin(*CHEAP_EVENTS), 0.2).when(source == "github", 0.6).when(source == "linear", 0.4).otherwise(0.5)
    bonus = F.least(F.lit(0.2), 0.05 * F.log10(F.greatest(diff_lines, F.lit(1)).cast("double")))
    return F.when(diff_lines > 0, F.least(F.lit(1.0), base + bonus)).otherwise(base)


def is_action(event_type: Column, source: Column, state: Column) -> Column:
    return F.coalesce(event_type.isin(*ACTION_EVENTS), F.lit(False)) | F.coalesce((source == "linear") & F.lower(state).isin(*DONE_STATES), F.lit(False))


def is_finished_work(event_type: Column, source: Column, state: Column) -> Column:
    """An action that is done, not cancelled: what makes somebody the owner of a topic."""
    return F.coalesce(event_type.isin(*ACTION_EVENTS), F.lit(False)) | F.coalesce((source == "linear") & F.lower(state).isin(*FINISHED_STATES), F.lit(False))


def is_work_activity(source: Column, state: Column) -> Column:
    """Work rather than talk: anything on code, and tickets that are done."""
    return F.coalesce(source == "github", F.lit(False)) | F.coalesce((source == "linear") & F.lower(state).isin(*FINISHED_STATES), F.lit(False))


def is_discussion(event_type: Column, source: Column) -> Column:
    return F.coalesce(event_type.isin(*DISCUSSION_EVENTS), F.lit(False)) | F.coalesce(source == "slack", F.lit(False))


def is_private_channel(channel: Column) -> Column:
    return F.coalesce(F.lower(channel).rlike(r"^#*(priv-|dm-|private-)"), F.lit(False))
