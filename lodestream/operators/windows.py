"""Ordered recurrences and window statistics that stay bounded per key.

A recurrence that forgets exponentially needs only the last rows of a key to reach double
precision, so keys are cut to their latest rows first (``row_number`` below a limit, which Spark
already applies before the shuffle) and folded as a bounded array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators.skew import hot_keys


def latest_rows(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` latest rows of every key (by ``order``, all ascending)."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def step_runs(df: DataFrame, key: str, order: list[str], value: str, least: int = 10_000, ranges: int = 64) -> DataFrame:
    """``(key, gram, n)``: the multiset of the one- to three-step runs of ``value`` (a string without nulls) along ``order``.

    Keys that are hot (``skew.hot_keys`` with ``least``) are split into ``ranges`` of their first
    order column; runs across a border are counted from the two rows on either side of it.
    """
    hot = hot_keys(df, key, least)
    rows, is_hot = df.select(key, *order, value).withColumn("__r", F.lit(0)), F.col(key).isin(hot)
    if hot:
        bounds = df.where(is_hot).groupBy(key).agg(F.percentile_approx(order[0], [k / ranges for k in range(1, ranges)]).alias("__b"))
        rows = df.select(key, *order, value).join(F.broadcast(bounds), key, "left").withColumn("__r", F.coalesce(F.size(F.filter("__b", lambda b: b < F.col(order[0]))), F.lit(0))).drop("__b")
        rows = rows.withColumn("__r", F.when(is_hot, F.col("__r")).otherwise(0))
    part = Window.partitionBy(key, "__r").orderBy(*order)
    ahead = lambda c, n, w: F.lead(c, n).over(w)
    seen = rows.select("*", ahead(value, 1, part).alias("__2"), ahead(value, 2, part).alias("__3"), F.lag(value, 2).over(part).alias("__back"))
    two, three = F.concat(value, F.lit(">"), "__2"), F.concat(value, F.lit(">"), "__2", F.lit(">"), "__3")
    runs = seen.select(key, F.explode(F.array(F.col(value), two, three)).alias("gram"))
    if hot:
        whole = Window.partitionBy(key).orderBy(*order)
        ends = seen.where(is_hot & (F.col("__3").isNull() | F.col("__back").isNull())).select(key, "__r", *order, value)
        ends = ends.select("*", *[ahead(c, n, whole).alias(f"{a}{n + 1}") for n in (1, 2) for c, a in ((value, "__"), ("__r", "__r"))])
        runs = runs.unionByName(ends.select(key, F.explode(F.array(F.when(F.col("__r") != F.col("__r2"), two), F.when(F.col("__r") != F.col("__r3"), three))).alias("gram")))
    return runs.where("gram IS NOT NULL").groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))


def memory_of(alpha: float, precision: float = 1e-17) -> int:
    """After how many rows an exponential average of weight ``alpha`` has forgotten to double precision."""
    return max(2, math.ceil(math.log(precision) / math.log(1 - alpha)))


def ema(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3) -> DataFrame:
    """Per key: number of rows, last exponential average, the one before it, and the first value.

    The first value seeds the average; rows with a null key or value are skipped.  Ties in order
    are broken by the value.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    n = memory_of(alpha)
    recent = latest_rows(rows, key, [*order, value], n)
    arr = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v"))))
    fold = lambda a: F.aggregate(
        F.transform(a, lambda s: s["__v"]),
        F.struct(F.lit(None).cast("double").alias("e"), F.lit(None).cast("double").alias("p")),
        lambda acc, v: F.struct(F.when(acc["e"].isNull(), v).otherwise(alpha * v + (1 - alpha) * acc["e"]).alias("e"), acc["e"].alias("p")),
    )
    folded = recent.groupBy(key).agg(fold(arr).alias("f")).select(key, F.col("f.e").alias("ema"), F.col("f.p").alias("previous"))
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.col(value).cast("double"), F.struct(*order, F.col(value))).alias("first_value"))
    return counts.join(folded, key)


def last_z_score(df: DataFrame, key: str, order: list[str], value: str, window: int = 100, least: int = 10) -> DataFrame:
    """Per key, how many standard deviations (population) the latest value lies from the mean of the ``window`` latest.

    Null below ``least`` rows or without spread.
    """
    recent = latest_rows(df.where(F.col(key).isNotNull() & F.col(value).isNotNull()), key, [*order, value], window)
    s = recent.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(F.struct(*order, F.col(value).alias("__v")))["__v"].alias("last"))
    return s.select(key, "n", "mean", "std", "last", F.when((F.col("n") >= least) & (F.col("std") > 0), (F.col("last") - F.col("mean")) / F.col("std")).alias("z"))


def nearest_rank(df: DataFrame, key: str, value: str, percents: list[int], bins: int = 4096) -> DataFrame:
    """Per key and percent, the value at rank ``int(n * p / 100)`` (from 0, at most the last), exactly.

    A histogram of ``bins`` per key finds the bin of each rank; only that bin's rows are ranked.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("x"))
    span = rows.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    binned = rows.join(F.broadcast(span) if span.count() <= 100_000 else span, "k")
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    binned = binned.select("k", "x", "n", b.alias("b"))
    hist = binned.groupBy("k", "b").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    w = Window.partitionBy("k").orderBy("b")
    upto = hist.withColumn("before", F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = upto.select("k", "b", "c", "before", "n", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")).withColumn("rank", F.least(F.floor(F.col("n") * F.col("percent") / 100), F.col("n") - 1))
    wanted = wanted.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c"))).select("k", "b", "percent", (F.col("rank") - F.col("before")).alias("offset"))
    ranked = binned.join(wanted.select("k", "b").distinct(), ["k", "b"], "left_semi").withColumn("offset", F.row_number().over(Window.partitionBy("k", "b").orderBy("x")) - 1)
    return wanted.join(ranked.select("k", "b", "offset", "x"), ["k", "b", "offset"]).select(F.col("k").alias(key), "percent", F.col("x").alias("value"))


def shannon(counts: Column, total: Column) -> Column:
    """One count's part of the entropy in bits."""
    p = counts / total
    return F.when(counts > 0, -p * F.log2(p)).otherwise(0.0)
