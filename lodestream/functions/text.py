"""Text expressions: terms, sentences, style measures, rules.  All are native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that are no terms.
STOPWORDS = tuple(
    """
    are was has had the and for but not you all can her his how its may who did got him she our out own too yet any few now say way via per use see
    new set get add let run try
    also been does each even from have here into just like made make many more most much must need next only over some such take than that them then
    they this very want well were what when will with your form work used type same both done able keep sure seem show look give good part last long
    back turn help left case call
    about after being below could doing every first going might never other shall since still their there these thing those under until using where
    which while would should through between during before
    number based added updated change changed right given found think because however already another without within around along either rather though
    actually currently instead whether against toward possible potential suggested related expected required included following according different
    available specific several example general likely please ensure allow allows supported option options appropriate consider certain provide provides
    seems appears become
    """.split()
)
# Characters that are taken off both ends of a term.
EDGE_CHARS = ".,!?;:()[]{}\"'*`<>#~^|\\=_"

# Phrases and patterns of the style measures.
HEDGES = ("may", "might", "could potentially", "it appears", "seems to", "is expected to", "under investigation", "possibly", "perhaps", "it seems", "appears to", "likely", "unlikely", "probably", "to some extent", "in some cases", "tends to", "somewhat", "it is believed", "it is thought", "it is possible")
FORWARD = ("will", "going to", "plan to", "intend to", "aim to", "next week", "next month", "next quarter", "next sprint", "tomorrow", "upcoming", "goal is", "target is", "deadline", "by friday", "by monday", "by end of", "ship by", "launch by", "we will", "we'll", "we plan", "we intend", "we aim", "scheduled for", "on track to", "expected to ship")
BACKWARD = ("was", "were", "had been", "used to", "previously", "last week", "last month", "last quarter", "last sprint", "yesterday", "formerly", "historically", "in the past", "we had", "we used to", "we were", "it was", "back when", "at that time", "prior to")
PASSIVE = r"\b(?:was|were|been|being|is|are|has\s+been|have\s+been|had\s+been)\s+(?:\w+ly\s+)?(\w+(?:ed|en|t|wn|ne))\b"
NOMINAL = r"\b\w{4,}(?:tion|ment|ness|ity|ence|ance|sion)\b"
CONCRETE = r"\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4})\b|\b\d+(?:\.\d+)?%?\b|\b(?:will|must|fixed|deployed|completed|resolved|merged|shipped|released|closed|done)\b"
# Words of either sentiment, legal forms, and words that say little in a company name.
POSITIVE_WORDS = ("good", "great", "excellent", "nice", "fixed", "resolved", "improved", "success", "working", "done", "merged", "approved", "completed", "shipped", "deployed", "ready", "happy", "love")
NEGATIVE_WORDS = ("bad", "error", "fail", "bug", "broken", "crash", "issue", "problem", "wrong", "blocked", "stuck", "slow", "missing", "critical", "urgent", "regression", "revert", "hack")
LEGAL_SUFFIX = r"\b(ltd|limited|plc|llp|lp|inc|incorporated|corp|corporation|sa|ag|gmbh|bv|nv|srl|sl|pty|pte|co|company)\b\.?"
GENERIC_NAME_WORDS = ("limited", "ltd", "plc", "llp", "lp", "inc", "corp", "corporation", "holdings", "holding", "group", "services", "solutions", "consulting", "investments", "investment", "trading", "properties", "property", "management", "international", "global", "capital", "ventures", "partners", "associates", "enterprises", "developments", "development", "resources", "systems", "technologies", "technology", "uk", "the", "and", "of", "in", "for", "co", "company")


def phrase_pattern(phrases) -> str:
    """Any of the phrases as whole words."""
    return r"\b(?:" + "|".join(p.replace("-", r"\-") for p in phrases) + r")\b"


def _flags(unicode: bool) -> str:
    return "(?iU)" if unicode else "(?i)"


def terms(text: Column) -> Column:
    """The distinct terms of a text as an array; null for null.

    Markup is dropped, tokens are split at white space, lowered and freed of edge characters;
    tokens under three characters, stopwords, links, numbers, rules and tokens without a letter
    or digit are none.
    """
    bare = F.split(F.regexp_replace(text, "<[^>]+>", " "), r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]+")
    cut = F.transform(bare, lambda t: F.btrim(F.lower(t), F.lit(EDGE_CHARS)))
    keep = F.filter(cut, lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS) & ~t.contains("://") & ~t.rlike(r"^[0-9][0-9.]*$") & ~t.rlike(r"^[-#]{2,}$") & t.rlike(r"[\p{L}\p{N}]"))
    return F.array_distinct(keep)


def sentences(text: Column) -> Column:
    """Non-empty pieces between runs of ``.!?`` that end a word."""
    return F.filter(F.transform(F.split(text, r"[.!?]+(?:\s|$)"), lambda s: F.btrim(s, F.lit(" \t\n\r\x0b\x0c"))), lambda s: s != "")


def words(text: Column) -> Column:
    """Whole words of ASCII letters, lower case, in order (a word that holds any other letter or digit is none)."""
    return F.transform(F.filter(F.split(text, r"[^\p{L}\p{N}\p{M}_]+"), lambda w: w.rlike("^[a-zA-Z]+$")), F.lower)


def _share(parts: Column, pattern: str, unicode: bool) -> Column:
    return F.size(F.filter(parts, lambda s: s.rlike(_flags(unicode) + pattern))) / F.size(parts)


def style_measures(parts: Column, unicode: bool = True) -> dict[str, Column]:
    """Sentence-wise hedging, passives, nominalisations, specificity and the compression index from them.

    ``parts`` are the ``sentences`` of a text, best as a column of their own, for every measure
    reads them.  A text without sentences has specificity 1 and all else 0.  ``unicode`` says whether letters
    beyond ASCII count as word characters.
    """
    some = F.size(parts) > 0
    hedging = F.when(some, _share(parts, phrase_pattern(HEDGES), unicode)).otherwise(0.0)
    passive = F.when(some, _share(parts, PASSIVE, unicode)).otherwise(0.0)
    count = F.aggregate(parts, F.lit(0), lambda n, s: n + F.regexp_count(s, F.lit(_flags(unicode) + NOMINAL)))
    nominal = F.when(some, F.least(count / F.size(parts), F.lit(1.0))).otherwise(0.0)
    specific = F.when(some, _share(parts, CONCRETE, unicode)).otherwise(1.0)
    index = F.when(some, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.3 * hedging + 0.3 * passive + 0.2 * nominal + 0.2 * (1.0 - specific)))).otherwise(0.0)
    return {"hedging": hedging, "passive": passive, "nominal": nominal, "specificity": specific, "compression": index}


def temporal_orientation(parts: Column, unicode: bool = True) -> Column:
    """(forward - backward) / (forward + backward) of the ``sentences`` of a text; 0 without either."""
    ahead = F.size(F.filter(parts, lambda s: s.rlike(_flags(unicode) + phrase_pattern(FORWARD))))
    back = F.size(F.filter(parts, lambda s: s.rlike(_flags(unicode) + phrase_pattern(BACKWARD))))
    return F.when(ahead + back > 0, (ahead - back) / (ahead + back)).otherwise(0.0)


def lexical_diversity(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0)


def token_entropy(tokens: Column) -> Column:
    """Shannon entropy of an array's values in bits, in one pass over the sorted array (no explode)."""
    n = F.size(tokens)
    runs = F.aggregate(
        F.array_sort(tokens),
        F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, t: F.when(a["last"].eqNullSafe(t), F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(
            F.struct(t.alias("last"), F.lit(1).alias("run"), (a["sum"] + F.when(a["run"] > 0, a["run"] * F.log2(a["run"])).otherwise(0.0)).alias("sum"))
        ),
    )
    total = runs["sum"] + F.when(runs["run"] > 0, runs["run"] * F.log2(runs["run"])).otherwise(0.0)
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def sentiment(tokens: Column) -> dict[str, Column]:
    """Polarity, magnitude and label by word sets over distinct lower-case words."""
    own = F.array_distinct(tokens)
    pos, neg = F.size(F.array_intersect(own, F.array(*map(F.lit, POSITIVE_WORDS)))), F.size(F.array_intersect(own, F.array(*map(F.lit, NEGATIVE_WORDS))))
    total = pos + neg
    polarity = F.when(total > 0, (pos - neg) / total).otherwise(0.0)
    magnitude = F.when(total > 0, F.least(F.lit(1.0), total / 5)).otherwise(0.0)
    label = F.when(total == 0, "neutral").when(polarity > 0.2, "positive").when(polarity < -0.2, "negative").when(magnitude > 0.3, "mixed").otherwise("neutral")
    return {"polarity": polarity, "magnitude": magnitude, "label": label}


def company_key(name: Column) -> Column:
    """A company name without legal forms, punctuation and repeated blanks, lower case."""
    bare = F.regexp_replace(F.lower(name), LEGAL_SUFFIX, "")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def name_profile(name: Column) -> dict[str, Column]:
    """Number of words, their entropy and the share of generic words of a name (words of one letter do not count)."""
    tokens = F.filter(F.split(F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}\s]", " ")), r"\s+"), lambda t: F.length(t) > 1)
    generic = F.size(F.filter(tokens, lambda t: t.isin(*GENERIC_NAME_WORDS)))
    return {"n_words": F.size(tokens), "entropy": token_entropy(tokens), "generic_ratio": F.when(F.size(tokens) > 0, generic / F.size(tokens)).otherwise(0.0)}


def mentions(content: Column, author: Column | None = None) -> Column:
    """Distinct ``@handles`` of a text but the author's own, sorted."""
    found = F.array_distinct(F.regexp_extract_all(content, F.lit(r"@(\w[\w.-]*)"), F.lit(1)))
    return F.array_sort(F.filter(found, lambda m: F.coalesce(m != author, F.lit(True))) if author is not None else found)


def code_tokens(text: Column) -> Column:
    """Words of code: dots, underscores and camel case are parted, lower case, two characters or more."""
    parted = F.regexp_replace(F.regexp_replace(text, r"[._/\\-]+", " "), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.filter(F.split(F.lower(F.regexp_replace(parted, r"[^A-Za-z0-9]+", " ")), r"\s+"), lambda t: F.length(t) >= 2)


def content_hash(parts: list[Column], length: int = 16) -> Column:
    """A short content address: the first characters of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def bag_of_words(summary: Column, length: int = 120) -> Column:
    """The sorted distinct words of three or more ASCII letters or digits in the first characters of a summary, joined by blanks."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.substring(F.lower(F.trim(summary)), 1, length), "[^a-z0-9]+"), lambda w: F.length(w) >= 3))), " ")


def finding_hash(kind: Column, summary: Column, actors: Column) -> Column:
    """What makes two findings the same whatever the order of their words: kind, words, actors, and the requests, tickets and people named.

    The words are those of the opening of the summary (as in the system studied, for summaries are
    short); requests, tickets and mentions are looked for in all of it.
    """
    low = F.lower(F.trim(summary))
    named = lambda pattern, group: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(group)))), ",")
    norm = F.regexp_replace(F.lower(F.trim(kind)), "[ -]", "_")
    who = F.array_join(F.array_sort(F.transform(actors, lambda a: F.lower(F.trim(a)))), ",")
    return content_hash([norm, bag_of_words(summary), who, named(r"pr\s*#([0-9]+)", 1), named("[a-z]+-[0-9]+", 0), named(r"@([\p{L}\p{N}_-]+)", 1)])
