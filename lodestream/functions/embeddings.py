"""Embeddings by signed hashing, per strategy, and their weighted comparison; all native expressions.

A token falls into a bucket by the first byte of its MD5 digest and gets its sign from the ninth,
so a vector is the same in any engine.  Bucket counts are powers of two up to 256.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of code, and the first of the two places each has in a technical embedding.
CODE_PATTERNS = {
    "function_definition": (r"\b(?:def|function|func|fn)\s+(\w+)", 32), "import_statement": (r"\b(?:import|from|require|include)\s+[\w.]+", 34), "error_pattern": (r"\b(?:Error|Exception|raise|throw|panic)\b", 38),
    "class_definition": (r"\b(?:class|struct|interface)\s+(\w+)", 40), "decorator": (r"@\w+", 42), "dotted_path": (r"\b\w+(?:\.\w+){2,}\b", 44),
}


def _byte(token: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(token), 2 * at + 1, 2), 16, 10).cast("int")


def signed(tokens: Column, buckets: int, offset: int = 0, weight: float = 1.0) -> Column:
    """``place, x`` of every token: its bucket from ``offset`` on, and its signed weight."""
    return F.transform(tokens, lambda t: F.struct((_byte(t, 0) % buckets + offset).alias("place"), (F.when(_byte(t, 8) % 2 == 0, 1.0).otherwise(-1.0) * weight).alias("x")))


def gathered(parts: Column, dim: int = 64) -> Column:
    """``place, x`` entries summed to a vector of length one; a null or empty list gives zeros."""
    some = F.coalesce(parts, F.array().cast("array<struct<place:int,x:double>>"))
    # the entries are bound once, not hashed again for every place
    raw = F.transform(F.array(some), lambda p: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate(p, F.lit(0.0), lambda s, e: s + F.when(e["place"] == d, e["x"]).otherwise(0.0))))[0]
    return F.transform(F.array(raw), lambda v: F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))), lambda n: F.transform(v, lambda x: F.when(n > 1e-12, x / n).otherwise(x))))[0][0]


def semantic(text: Column) -> Column:
    """The words of a text, lower case, without punctuation, of two characters or more."""
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
    return gathered(signed(F.filter(words, lambda w: F.length(w) >= 2), 64))


def social(author: Column, mentions: Column, channel: Column) -> Column:
    """Who writes (twice as heavy), to whom, the pairs of both, and where (half as heavy again)."""
    none = F.array().cast("array<string>")
    one = lambda c, prefix: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.concat(F.lit(prefix), c))).otherwise(none)
    met = F.filter(F.coalesce(mentions, none), lambda m: m != "")
    pairs = F.when(F.coalesce(author, F.lit("")) != "", F.transform(met, lambda m: F.concat(F.lit("pair:"), author, F.lit("+"), m))).otherwise(none)
    return gathered(F.concat(signed(one(author, "author:"), 32, 0, 2.0), signed(F.transform(met, lambda m: F.concat(F.lit("mention:"), m)), 32), signed(pairs, 16, 32), signed(one(channel, "channel:"), 16, 48, 1.5)))


def code_patterns(text: Column) -> dict[str, Column]:
    """How often each pattern of code occurs in a text."""
    return {n: F.regexp_count(text, F.lit(p)) for n, (p, _) in CODE_PATTERNS.items()}


def technical(text: Column, tokens: Column) -> Column:
    """Tokens of code, with the counts and the presence of patterns."""
    marks = [F.struct(F.lit(at + k).cast("int").alias("place"), (c.cast("double") if k == 0 else F.when(c > 0, 1.0).otherwise(0.0)).alias("x")) for (n, c), (_, at) in zip(code_patterns(text).items(), CODE_PATTERNS.values()) for k in (0, 1)]
    return gathered(F.concat(signed(tokens, 32), F.array(*marks)))


def softmax(logits: dict[str, Column]) -> dict[str, Column]:
    most = F.greatest(*logits.values()) if len(logits) > 1 else next(iter(logits.values()))
    e = {n: F.exp(x - most) for n, x in logits.items()}
    total = sum(list(e.values())[1:], list(e.values())[0])
    return {n: x / total for n, x in e.items()}


def updated_logits(logits: dict[str, Column], contributions: dict[str, Column], count: Column, rate: float = 0.05) -> dict[str, Column]:
    """Logits after one acceptance: strategies that contributed more than the mean gain what the others lose."""
    mean = sum(list(contributions.values())[1:], list(contributions.values())[0]) / len(contributions)
    return {n: x + rate / (1 + count * 0.01) * (contributions[n] - mean) for n, x in logits.items()}
