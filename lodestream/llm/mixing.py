"""Mixing sources to target weights by Poisson replication.

Each document is repeated as often as the inverse Poisson distribution gives at a uniform
number hashed from its id and a seed.  The rate of a source is the one whose repeats, cut at
the source's cap, sum to its target tokens: it is solved on the realised numbers (a histogram
of tokens by uniform number, 4,096 bins a source), so that shares are met and not merely met
on average.  The total is the largest at which no source passes its cap.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.scratch import materialize

#: Bins of the histogram that the driver solves rates on, for each source of the target table.
BINS = 4096
#: At most this many sources; their targets and histograms are held by the driver.
MAX_SOURCES = 10_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(documents: DataFrame, text_col: str = "text", out_col: str = "n_tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """``documents`` with the number of tokens of each whole text (0 for null or empty)."""

    def count(texts: pd.Series) -> pd.Series:
        encode = _encoder(tokenizer).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return documents.withColumn(out_col, F.pandas_udf(count, "long")(F.col(text_col)))


def poisson_thresholds(rate: float, cap: int) -> list[float]:
    """The inverted Poisson distribution of mean ``rate``: uniform numbers above which a document is repeated 1, 2, ..., ``cap`` times."""
    out, term = [], math.exp(-rate)
    total = term
    for k in range(cap):
        out.append(total)
        term *= rate / (k + 1)
        total += term
    return out


def solve_rate(bins: dict[int, int], goal: float, cap: int) -> float:
    """The rate at which the binned tokens, repeated, come closest to ``goal`` tokens."""
    middle = (np.array(sorted(bins)) + 0.5) / BINS
    tokens = np.array([bins[b] for b in sorted(bins)], dtype=float)

    def reached(rate: float) -> float:
        return float(tokens @ np.searchsorted(np.array(poisson_thresholds(rate, cap)), middle, side="left"))

    low, high = 0.0, 1.0
    while reached(high) < goal and high < 700:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if reached(mid) < goal else (low, mid)
    return high


def _uniform(doc: Column, seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(doc, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def mix_plan(documents: DataFrame, targets: DataFrame, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens, repeats`` of every document of a wanted source.

    Documents without id, source or target take no part, a null or empty text has no tokens, a
    repeated row is a document of its own under the same number.  Sources of the targets that
    have no tokens cannot contribute; the others share the total in proportion to their targets.
    """
    wanted = {}
    for r in targets.where("source IS NOT NULL AND target_share > 0").limit(MAX_SOURCES + 1).collect():
        wanted[r["source"]] = (float(r["target_share"]), int(r["max_repeats"] or 0))
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    docs = documents.where("doc_id IS NOT NULL AND source IS NOT NULL").where(F.col("source").isin(list(wanted)) if wanted else F.lit(False)).select("doc_id", "source", "text")
    counted = materialize(count_tokens(docs, tokenizer=tokenizer).select("doc_id", "source", "n_tokens", _uniform(F.col("doc_id"), seed).alias("u")), "tokens")
    histogram: dict[str, dict[int, int]] = {}
    for r in counted.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n")).where("n > 0").collect():
        histogram.setdefault(r["source"], {})[r["bin"]] = r["n"]
    sizes = {s: sum(b.values()) for s, b in histogram.items()}
    able = {s: wanted[s] for s in sizes if wanted[s][1] > 0}
    shares = sum(t for t, _ in able.values())
    total = min((cap * sizes[s] / (t / shares) for s, (t, cap) in able.items()), default=0.0)
    marks = []
    for s, (t, cap) in sorted(able.items()):
        goal = total * t / shares
        marks.append((s, [-1.0] * cap if goal >= cap * sizes[s] * (1 - 1e-12) else poisson_thresholds(solve_rate(histogram[s], goal, cap), cap)))
    drawn = documents.sparkSession.createDataFrame(marks, "source string, marks array<double>")  # at most MAX_SOURCES rows
    repeats = F.coalesce(F.size(F.filter("marks", lambda m: m < F.col("u"))), F.lit(0))
    return counted.join(F.broadcast(drawn), "source", "left").select("doc_id", "source", "n_tokens", F.when(F.col("marks").isNull(), 0).otherwise(repeats).cast("int").alias("repeats"))


def mixed_documents(plan: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as planned, in a global order of hashed numbers.

    ``position_key`` orders the mix; writing partitions by its range gives a global shuffle.
    """
    copies = plan.where("repeats > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), "repeats")).alias("copy_no"))
    return copies.withColumn("position_key", F.xxhash64("doc_id", "copy_no", F.lit(seed))).sort("position_key")


def mix_report(plan: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: documents, tokens, tokens in the mix, target and reached share, most repeats."""
    per = plan.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("mix_tokens"), F.max("repeats").alias("most_repeats"))
    whole = per.agg(F.sum("mix_tokens").alias("whole"))
    rows = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").join(per, "source", "left").crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return rows.select("source", "target_share", "max_repeats", zero("n_docs"), zero("n_tokens"), zero("mix_tokens"), zero("most_repeats"), F.round(F.coalesce(F.col("mix_tokens") / F.col("whole"), F.lit(0.0)), 6).alias("reached_share"))
