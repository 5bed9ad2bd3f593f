"""Index structures as tables: counting Bloom filters, greedy selections, queues with retries.

A filter is a sparse table ``(filter, slot, n)``, so adding is an aggregation and two filters are
compared by a join; nothing is held as an array.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.vectors import fnv1a_array


def filter_size(capacity: int = 10_000, error: float = 0.01) -> tuple[int, int]:
    """``slots, hashes`` of a Bloom filter for so many items at an error rate."""
    slots = max(64, -int(capacity * math.log(error) / math.log(2) ** 2))
    return slots, min(20, max(1, int(slots / max(capacity, 1) * math.log(2))))


def mixed_hash(texts: list[str]) -> np.ndarray:
    """A 32-bit hash of every text's UTF-8 bytes, independent of FNV-1a: multiply, rotate and fold words of four bytes, then mix."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    width = -(-max(size.max(initial=0), 1) // 4) * 4
    grid = np.zeros((len(raw), width), dtype=np.uint8)
    for k, r in enumerate(raw):
        grid[k, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    words = grid.view("<u4")
    turn = lambda x, n: (x << np.uint32(n)) | (x >> np.uint32(32 - n))
    h = np.zeros(len(raw), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for c in range(words.shape[1]):
            k = turn(words[:, c] * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            whole, tail = size >= 4 * (c + 1), (size > 4 * c) & (size < 4 * (c + 1))
            h = np.where(whole, turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(tail, h ^ k, h))
        h ^= size.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        return h ^ (h >> np.uint32(16))


def bloom_slots(item: Column, slots: int, hashes: int) -> Column:
    """The slots of an item: ``hashes`` steps of the second hash from the first; null for null."""

    def run(values: pd.Series) -> pd.Series:
        texts = [v or "" for v in values]
        first = fnv1a_array(texts) % np.uint64(slots)
        second = mixed_hash(texts).astype(np.uint64) % np.uint64(slots)
        out = (first[:, None] + np.arange(hashes, dtype=np.uint64) * second[:, None]) % np.uint64(slots)
        return pd.Series(list(out.astype(np.int32))).where(~values.isna(), None)

    return F.pandas_udf(run, "array<int>")(item)


def bloom_filters(items: DataFrame, key: str, item: str, slots: int, hashes: int) -> DataFrame:
    """Counting filters ``(key, slot, n)`` of the items of every key, counters saturating at 255."""
    s = items.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, F.explode(bloom_slots(F.col(item), slots, hashes)).alias("slot"))
    return s.groupBy(key, "slot").agg(F.least(F.count(F.lit(1)), F.lit(255)).alias("n"))


def bloom_removed(filters: DataFrame, items: DataFrame, key: str, item: str, slots: int, hashes: int) -> DataFrame:
    """The filters after removing distinct items ``(key, item)`` that they hold; an item with an empty slot changes nothing.

    Items are taken out as one batch: none is judged by a counter that another lowered.
    """
    want = items.select(key, item).distinct().select(key, item, F.posexplode(bloom_slots(F.col(item), slots, hashes)).alias("i", "slot"))
    met = want.join(filters, [key, "slot"]).groupBy(key, item).agg(F.count(F.lit(1)).alias("found")).where(F.col("found") == hashes)
    less = want.join(met.select(key, item), [key, item]).groupBy(key, "slot").agg(F.count(F.lit(1)).alias("less"))
    return filters.join(less, [key, "slot"], "left").select(key, "slot", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")).where("n > 0")


def bloom_members(filters: DataFrame, items: DataFrame, key: str, item: str, slots: int, hashes: int) -> DataFrame:
    """Of ``items (key, item)`` those that the key's filter may hold (no held item is missed)."""
    want = items.select(key, item, F.explode(F.array_distinct(bloom_slots(F.col(item), slots, hashes))).alias("slot"))
    need = want.groupBy(key, item).agg(F.count(F.lit(1)).alias("need"))
    met = want.join(filters, [key, "slot"]).groupBy(key, item).agg(F.count(F.lit(1)).alias("met"))
    return need.join(met, [key, item]).where("met >= need").select(key, item)


def bloom_claims(filters: DataFrame, items: DataFrame, key: str, item: str, slots: int, hashes: int) -> DataFrame:
    """``key, item``: every filter that may hold each of ``items (item)``, found by the items' slots, so no filter is paired with what it cannot hold."""
    own = F.array_distinct(bloom_slots(F.col(item), slots, hashes))
    want = items.where(F.col(item).isNotNull()).select(item).distinct().select(item, own.alias("s")).select(item, F.size("s").alias("need"), F.explode("s").alias("slot"))
    met = want.join(filters.where("n > 0").select(key, "slot"), "slot").groupBy(key, item, "need").agg(F.count(F.lit(1)).alias("met"))
    return met.where("met = need").select(key, item)


def bloom_overlap(filters: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """``key, overlap`` of every filter with one other ``(slot, n)``: the sum of the lesser over the sum of the greater counters."""
    total = filters.groupBy(key).agg(F.sum("n").alias("own"))
    base = other.agg(F.sum("n").alias("base"))
    both = filters.join(other.select("slot", F.col("n").alias("m")), "slot").groupBy(key).agg(F.sum(F.least("n", "m")).alias("common"))
    j = total.join(both, key, "left").crossJoin(F.broadcast(base)).withColumn("common", F.coalesce("common", F.lit(0)))
    return j.select(key, F.when(F.col("own") + F.col("base") > F.col("common"), F.col("common") / (F.col("own") + F.col("base") - F.col("common"))).otherwise(0.0).alias("overlap"))


def bloom_digest(filters: DataFrame, key: str, slots: int, bins: int = 128) -> DataFrame:
    """``key, bin, total``: counters summed over bins as even as can be, the first ones a slot larger."""
    wide, more = slots // bins + 1, slots % bins
    slot = F.col("slot")
    bin_ = F.when(slot < wide * more, F.floor(slot / wide)).otherwise(more + F.floor((slot - wide * more) / (slots // bins)))
    return filters.groupBy(key, bin_.cast("int").alias("bin")).agg(F.sum("n").alias("total"))


#: Greedy selections look at all their candidates at once, in one task.
MAX_CANDIDATES = 10_000


def farthest_first(rows: DataFrame, id_col: str, terms_col: str, count: int) -> DataFrame:
    """``place, id``: ``count`` ids, each the farthest (by Jaccard of terms) from those before, from the least id on; ties to the less.

    A selection by hand from a small set: more than ``MAX_CANDIDATES`` rows are an error.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MAX_CANDIDATES:
            raise ValueError(f"farthest_first chooses among at most {MAX_CANDIDATES} rows")
        frame = frame.sort_values(id_col)
        ids, sets = frame[id_col].tolist(), [frozenset(t) for t in frame[terms_col]]
        apart = lambda a, b: 1 - (len(a & b) / len(a | b) if a and b else 0.0)
        chosen = [0] if ids else []
        near = [apart(s, sets[0]) for s in sets]
        while len(chosen) < min(count, len(ids)):
            k = max((x for x in range(len(ids)) if x not in set(chosen)), key=lambda x: (near[x], -x))
            chosen.append(k)
            near = [min(n, apart(s, sets[k])) for n, s in zip(near, sets)]
        return pd.DataFrame({"place": range(1, len(chosen) + 1), "id": [ids[k] for k in chosen]}).astype({"place": "int32"})

    kind = dict(rows.dtypes)[id_col]
    return rows.select(F.lit(0).alias("all"), id_col, terms_col).groupBy("all").applyInPandas(choose, f"place int, id {kind}")


def leader_clusters(rows: DataFrame, id_col: str, terms_col: str, least: float = 0.4) -> DataFrame:
    """``leader, id, similarity``: every row joins the first earlier leader (by id) that shares ``least`` of the terms, or leads itself.

    The order decides, so one task looks at all rows: more than ``MAX_CANDIDATES`` are an error.
    Rows without terms take no part.
    """
    kind = dict(rows.dtypes)[id_col]

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MAX_CANDIDATES:
            raise ValueError(f"leaders are chosen among at most {MAX_CANDIDATES} rows")
        leaders: list[tuple[object, frozenset]] = []
        by_term: dict[str, set[int]] = {}
        out = []
        for i, terms in frame.sort_values(id_col)[[id_col, terms_col]].itertuples(index=False):
            own = frozenset(terms)
            met = sorted({k for t in own for k in by_term.get(t, ())})
            found = next(((k, s) for k in met if (s := len(own & leaders[k][1]) / len(own | leaders[k][1])) >= least), None)
            if found is None:
                for t in own:
                    by_term.setdefault(t, set()).add(len(leaders))
                leaders.append((i, own))
                out.append((i, i, 1.0))
            else:
                out.append((leaders[found[0]][0], i, found[1]))
        return pd.DataFrame(out, columns=["leader", "id", "similarity"])

    return rows.where(F.size(terms_col) > 0).select(F.lit(0).alias("all"), id_col, terms_col).groupBy("all").applyInPandas(choose, f"leader {kind}, id {kind}, similarity double")


def select_peers(positions: DataFrame, id_col: str, vec_col: str, target: int = 6) -> DataFrame:
    """``id, place, peer``: for every worker its two nearest, its two farthest, then those farthest from all chosen (1 - cosine), up to ``target``."""
    kind = dict(positions.dtypes)[id_col]

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MAX_CANDIDATES:
            raise ValueError(f"peers are chosen among at most {MAX_CANDIDATES} workers")
        frame = frame.sort_values(id_col)
        ids, x = frame[id_col].tolist(), np.array([np.asarray(v, dtype=float) for v in frame[vec_col]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        d = np.round(1 - x @ x.T, 9)
        out = []
        for w in range(len(ids)):
            order = [k for k in np.lexsort((np.arange(len(ids)), d[w])) if k != w]
            chosen = order[:2] + [k for k in sorted(order[2:], key=lambda k: (-d[w, k], order.index(k)))[:2]]
            rest = [k for k in order if k not in chosen]
            while len(chosen) < min(target, len(order)):
                k = max(rest, key=lambda k: (d[k, chosen].min(), -order.index(k)))
                chosen.append(k)
                rest.remove(k)
            out += [(ids[w], p + 1, ids[k]) for p, k in enumerate(chosen)]
        return pd.DataFrame(out, columns=["id", "place", "peer"]).astype({"place": "int32"})

    return positions.select(F.lit(0).alias("all"), id_col, vec_col).groupBy("all").applyInPandas(choose, f"id {kind}, place int, peer {kind}")


def message_outcomes(attempts: DataFrame, retries: int = 3) -> DataFrame:
    """``topic, message, n_attempts, outcome`` from a log ``(topic, message, at, ok)``.

    A message is acknowledged by its first success; with ``retries`` failures before that it is dead
    and later attempts do not count; else it is pending.
    """
    w = Window.partitionBy("topic", "message").orderBy("at", "ok")
    seen = attempts.withColumn("k", F.row_number().over(w)).withColumn("failed", F.sum((~F.col("ok")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = seen.groupBy("topic", "message").agg(F.min(F.when(F.col("ok"), F.col("k"))).alias("acked"), F.min(F.when(F.col("failed") >= retries, F.col("k"))).alias("dead"), F.count(F.lit(1)).alias("n"))
    acked = F.col("acked").isNotNull() & (F.col("dead").isNull() | (F.col("acked") < F.col("dead")))
    end = F.when(acked, F.col("acked")).otherwise(F.coalesce("dead", "n"))
    return g.select("topic", "message", end.alias("n_attempts"), F.when(acked, "acknowledged").when(F.col("dead").isNotNull(), "dead").otherwise("pending").alias("outcome"))
