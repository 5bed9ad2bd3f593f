"""Similarity search and near-duplicate classes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.vectors import hamming, hyperplane_buckets
from lodestream.operators.graphs import components
from lodestream.scratch import materialize

#: Query vectors sent to the tasks at once.
QUERY_BLOCK = 2048
#: Rows of a bucket scored at once.
CELL_BLOCK = 1024


def nearest_exact(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """``(query_id, id, cosine, rank)``: the ``k`` nearest rows of every query, itself left out, ties to the smaller id.

    Queries go in blocks of ``QUERY_BLOCK`` to all rows; every task keeps its own ``k`` best of
    each query, so ``k`` rows per query and task are shuffled.  Vectors without length match with 0.
    """
    out, block = None, []

    def search(ids: list, vectors: np.ndarray) -> DataFrame:
        sized = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: list[tuple] = [(np.zeros(0), np.zeros(0, dtype=np.int64))] * len(ids)
            own = np.array(ids)
            for frame in frames:
                there = frame[id_col].to_numpy()
                m = np.array([np.asarray(v, dtype=float) for v in frame[vec_col]])
                score = sized @ (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)).T
                score[own[:, None] == there[None, :]] = -np.inf
                for q in range(len(ids)):
                    s, i = np.concatenate([best[q][0], score[q]]), np.concatenate([best[q][1], there])
                    keep = np.lexsort((i, -s))[:k]
                    best[q] = (s[keep], i[keep])
            rows_ = [(ids[q], int(i), float(s)) for q in range(len(ids)) for s, i in zip(*best[q]) if s > -np.inf]
            yield pd.DataFrame(rows_, columns=["query_id", "id", "cosine"])

        return rows.select(id_col, vec_col).mapInPandas(scan, "query_id long, id long, cosine double")

    for r in queries.select(id_col, vec_col).toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            part = search([b[0] for b in block], np.array([b[1] for b in block], dtype=float))
            out, block = (part if out is None else out.unionByName(part)), []
    if block or out is None:
        width = len(block[0][1]) if block else 1
        part = search([b[0] for b in block], np.array([b[1] for b in block], dtype=float).reshape(-1, width)) if block else rows.select(F.col(id_col).cast("long").alias("query_id"), F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("cosine")).where("false")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_hashed(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, dim: int, k: int, tables: int = 12, planes: int = 6) -> DataFrame:
    """``(query_id, id, cosine, rank)`` among the rows that share a hyperplane bucket with the query in any table.

    Equi-joins on (table, bucket): no query meets all rows.  Recall grows with ``tables`` and falls with ``planes``.
    """
    keyed = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.posexplode(hyperplane_buckets(F.col(vec_col), dim, tables, planes)).alias("t", "b"))
    asked = queries.select(F.col(id_col).alias("query_id"), F.posexplode(hyperplane_buckets(F.col(vec_col), dim, tables, planes)).alias("t", "b"))
    pairs = asked.join(keyed.select("id", "t", "b"), ["t", "b"]).where("query_id <> id").select("query_id", "id").distinct()
    both = pairs.join(rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")), "id").join(queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).cast("array<double>").alias("q")), "query_id")
    from lodestream.functions.vectors import cosine

    scored = both.select("query_id", "id", cosine(F.col("q"), F.col("v")).alias("cosine"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_in_cells(queries: DataFrame, rows: DataFrame, id_col: str, vec_col: str, dim: int, k: int, planes: int = 6) -> DataFrame:
    """``(query_id, id, cosine, rank)`` as ``nearest_exact``, through hyperplane buckets that are passed over only by proof.

    Rows are sorted by bucket where they lie.  A query leaves out the rows of a bucket only if their
    least angle, that to the bucket's mean less the bucket's widest, lies beyond its own ``k`` best so
    far: recall is 1 at every size, and vectors without clusters cost a full scan.
    """
    bucket = F.element_at(hyperplane_buckets(F.col(vec_col), dim, 1, planes), 1)
    celled = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), bucket.alias("cell")).sortWithinPartitions("cell")
    out, block = None, []

    def search(ids: list, vectors: np.ndarray) -> DataFrame:
        sized = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score, there = np.full((len(ids), k), -np.inf), np.full((len(ids), k), -1, dtype=np.int64)
            own = np.array(ids, dtype=np.int64)
            for frame in frames:
                for part in (c.iloc[at : at + CELL_BLOCK] for _, c in frame.groupby("cell") for at in range(0, len(c), CELL_BLOCK)):
                    m = np.array([np.asarray(v, dtype=float) for v in part["v"]])
                    m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                    mean = m.mean(axis=0)
                    mean /= max(np.linalg.norm(mean), 1e-300)
                    widest = np.arccos(np.clip(m @ mean, -1, 1).min())
                    least = np.maximum(np.arccos(np.clip(sized @ mean, -1, 1)) - widest, 0)
                    live = np.flatnonzero(np.cos(least) >= score[:, -1] - 1e-6)
                    if not len(live):
                        continue
                    s = sized[live] @ m.T
                    i = part["id"].to_numpy(dtype=np.int64)
                    s[own[live][:, None] == i[None, :]] = -np.inf
                    s = np.concatenate([score[live], s], axis=1)
                    i = np.concatenate([there[live], np.broadcast_to(i, (len(live), len(i)))], axis=1)
                    keep = np.lexsort((i, -np.round(s, 9)), axis=1)[:, :k]
                    score[live], there[live] = np.take_along_axis(s, keep, 1), np.take_along_axis(i, keep, 1)
            q, n = np.nonzero(score > -np.inf)
            yield pd.DataFrame({"query_id": own[q], "id": there[q, n], "cosine": score[q, n]})

        return celled.mapInPandas(scan, "query_id long, id long, cosine double")

    for r in queries.select(id_col, vec_col).toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            part = search([b[0] for b in block], np.array([b[1] for b in block], dtype=float))
            out, block = (part if out is None else out.unionByName(part)), []
    if block or out is None:
        part = search([b[0] for b in block], np.array([b[1] for b in block], dtype=float).reshape(-1, dim))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_duplicate_classes(prints: DataFrame, id_col: str, print_col: str, distance: int = 3, pieces: int = 6) -> DataFrame:
    """``(id, class_id, n_links, earlier)`` of every row whose 64-bit fingerprint lies within ``distance`` bits of another's.

    Equal fingerprints form one class without being paired.  Different ones are found exactly: cut
    into ``pieces``, two fingerprints within ``distance`` bits agree in ``pieces - distance`` of
    them, and every choice of that many is an index of its own, so that keys are 32 bits wide.
    Rows without fingerprint take no part; ``n_links`` counts the other fingerprints within the distance,
    ``earlier`` is the least id below the row's own within it, null where there is none.
    """
    # written before it is filtered: a filter on a Python column would be pushed below it and compute it twice
    rows = materialize(prints.select(F.col(id_col).alias("id"), F.col(print_col).alias("fp")), "fingerprints").where("id IS NOT NULL AND fp IS NOT NULL")
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "prints")
    edges = [64 * k // pieces for k in range(pieces + 1)]
    piece = [F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(pieces)]
    keys = F.array(*[F.xxhash64(F.lit(str(c)), *[piece[k] for k in c]) for c in combinations(range(pieces), pieces - distance)])
    index = distinct.select("fp", "rep", F.explode(keys).alias("key"))
    one, two = index.select("key", F.col("fp").alias("f1"), F.col("rep").alias("a")), index.select("key", F.col("fp").alias("f2"), F.col("rep").alias("b"))
    # Spark takes the index for as small as the prints: without the hint it would gather all keys on the driver to broadcast them
    links = materialize(one.join(two.hint("merge"), "key").where("a < b").where(hamming(F.col("f1"), F.col("f2")) <= distance).select("a", "b").distinct(), "links")
    roots = components(links, "a", "b").select(F.col("v").alias("rep"), "root")
    ends = F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("near")), F.struct(F.col("b").alias("rep"), F.col("a").alias("near"))))
    count = links.select(ends.alias("e")).select("e.*").groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"), F.min("near").alias("near"))
    classes = distinct.join(roots, "rep", "left").join(count, "rep", "left").where("n > 1 OR root IS NOT NULL")
    # every fingerprint stands for its least id, so the least of its own and of those linked is the first within the distance
    found = rows.join(classes.select("fp", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.least("rep", "near").alias("first")), "fp")
    return found.select("id", "class_id", "n_links", F.when(F.col("first") < F.col("id"), F.col("first")).alias("earlier"))


def shingle_classes(sets: DataFrame, id_col: str, set_col: str, tenths: int = 8) -> DataFrame:
    """``(id, class_id, n_links)`` of every row whose set (an array without repeats) has a Jaccard of ``tenths`` / 10 or more with another row's.

    Exact: two such sets share an element among the rarest ``size - ceil(size * tenths / 10) + 1`` of
    each, so only those are joined, and every pair found is counted in whole.  Equal sets form one
    class without being paired.  Rows with an empty set take no part; ``n_links`` counts the other sets linked.
    """
    rows = materialize(sets.select(F.col(id_col).alias("id"), F.array_sort(F.col(set_col)).alias("s")).where("id IS NOT NULL AND size(s) > 0").withColumn("key", F.sha2(F.to_json("s"), 256)), "sets")
    distinct = materialize(rows.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("s").alias("s")), "distinct")
    items = distinct.select("rep", F.size("s").alias("k"), F.explode("s").alias("x"))
    common = items.groupBy("x").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = items.join(common, "x").groupBy("rep", "k").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o")).withColumn("least", F.expr(f"CAST(ceil(k * {tenths} / 10) AS INT)"))
    # elements that no other set has are the rarest: they take up the first places of the prefix and join nothing
    prefix = materialize(ranked.where("size(o) >= least").select("rep", "k", F.size("o").alias("m"), F.posexplode(F.expr("slice(o, 1, size(o) - least + 1)")["x"]).alias("p", "x")).withColumn("m", F.expr("m - p")), "prefixes")
    one, two = (prefix.select("x", F.col("rep").alias(r), F.col("k").alias(f"k{r}"), F.col("m").alias(f"m{r}")) for r in "ab")
    # from the first element that both have on, neither has more than m left to share
    pairs = one.join(two, "x").where(f"a < b AND (10 + {tenths}) * least(ma, mb) >= {tenths} * (ka + kb)").select("a", "b").distinct()
    both = pairs.join(distinct.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(distinct.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("k"), F.size(F.array_intersect("sa", "sb")).alias("c"))
    links = materialize(both.where(f"(10 + {tenths}) * c >= {tenths} * k").select("a", "b"), "links")
    roots = components(links, "a", "b").select(F.col("v").alias("rep"), "root")
    count = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    classes = distinct.join(roots, "rep", "left").join(count, "rep", "left").where("n > 1 OR root IS NOT NULL")
    return rows.join(classes.select("key", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "key").select("id", "class_id", "n_links")
