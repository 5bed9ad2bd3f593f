"""Graph operators on edge tables: weights, triangles, structural measures, distances, components.

Edge tables are ``(src, dst, ...)``.  Triangles are listed once, from edges oriented towards the
vertex of higher degree, so that a vertex with very many edges never pairs them all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.skew import hot_keys, join_unique
from lodestream.scratch import materialize, release

# Secrecy jurisdictions, as codes and as names.
SECRECY = (
    "VGB", "BVI", "British Virgin Islands", "CYM", "KY", "Cayman Islands", "PAN", "Panama", "BMU", "BM", "Bermuda", "JEY", "JE", "Jersey", "GGY", "GG", "Guernsey",
    "IMN", "IM", "Isle of Man", "LIE", "LI", "Liechtenstein", "MCO", "MC", "Monaco", "LUX", "LU", "Luxembourg", "CHE", "CH", "Switzerland", "SGP", "SG", "Singapore",
    "HKG", "HK", "Hong Kong", "ARE", "AE", "United Arab Emirates", "BHS", "BS", "Bahamas", "MUS", "MU", "Mauritius", "WSM", "WS", "Samoa", "VUT", "VU", "Vanuatu",
    "SYC", "SC", "Seychelles", "BLZ", "BZ", "Belize", "ANT", "Anguilla", "AIA", "GIB", "GI", "Gibraltar", "MLT", "MT", "Malta", "CYP", "CY", "Cyprus",
    "NLD", "NL", "Netherlands", "IRL", "IE", "Ireland", "USA", "US", "United States", "Delaware",
)
# Words of nominee owners.
NOMINEE_WORDS = ("trust", "foundation", "anstalt", "stiftung", "settlement", "nominee", "fiduciary", "trustee", "nominees")


def accumulate_edges(events: DataFrame) -> DataFrame:
    """``src, dst, type`` edges from single contacts ``(src, dst, type, at, channel)``: count, last contact and its channel.

    Contacts with oneself or without an end are ignored.
    """
    real = events.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    return real.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("weight"), F.max("at").alias("last_seen"), F.max(F.struct("at", "channel"))["channel"].alias("channel"))


def decayed_weights(events: DataFrame, as_of, half_life_days: float = 30.0) -> DataFrame:
    """Contacts summed with weights that halve every ``half_life_days`` before ``as_of``; later ones count fully."""
    age = (F.unix_micros(as_of) - F.unix_micros("at")) / 86_400_000_000.0
    weight = F.pow(F.lit(2.0), -F.greatest(age, F.lit(0.0)) / half_life_days)
    return events.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").groupBy("src", "dst").agg(F.sum(weight).alias("weight"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected ties ``(v, nb, weight)``, both ways, weights of both directions added."""
    pair = F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("dst").alias("nb"), "weight"), F.struct(F.col("dst").alias("v"), F.col("src").alias("nb"), "weight")))
    return edges.select(pair.alias("e")).select("e.*").groupBy("v", "nb").agg(F.sum("weight").alias("weight"))


def triangles(ties: DataFrame) -> DataFrame:
    """Every triangle of an undirected tie table once, as ``(a, b, c)``."""
    degree = ties.groupBy("v").agg(F.count(F.lit(1)).alias("deg"))
    hot = hot_keys(ties, "v")
    ranked = join_unique(ties.select("v", "nb"), degree, "v", hot).select(F.struct("deg", "v").alias("rv"), "v", "nb")
    there = join_unique(ranked.withColumnRenamed("nb", "k").select("rv", "v", "k"), degree.select(F.col("v").alias("k"), F.col("deg").alias("kd")), "k", hot)
    up = there.where(F.col("rv") < F.struct(F.col("kd").alias("deg"), F.col("k").alias("v"))).select(F.col("v").alias("lo"), F.col("k").alias("hi"), "kd")
    up = materialize(up, "oriented")
    one, two = up.select("lo", F.col("hi").alias("x"), F.col("kd").alias("xd")), up.select("lo", F.col("hi").alias("y"), F.col("kd").alias("yd"))
    wedges = one.join(two, "lo").where(F.struct("xd", "x") < F.struct(F.col("yd").alias("xd"), F.col("y").alias("x")))
    return wedges.join(up.select(F.col("lo").alias("x"), F.col("hi").alias("y")), ["x", "y"], "left_semi").select(F.col("lo").alias("a"), F.col("x").alias("b"), F.col("y").alias("c"))


def _corners(tri: DataFrame) -> DataFrame:
    """All six orders ``(i, j, q)`` of each triangle."""
    orders = [("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a")]
    return tri.select(F.explode(F.array(*[F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.col(q).alias("q")) for i, j, q in orders])).alias("t")).select("t.*")


def structural_measures(ties: DataFrame) -> DataFrame:
    """Per vertex: degree, triangles, clustering coefficient, effective size and Burt's constraint.

    The indirect part of the constraint takes the share of j's ties that go to q.
    """
    total = ties.groupBy("v").agg(F.sum("weight").alias("sum"), F.max("weight").alias("most"), F.count(F.lit(1)).alias("degree"))
    hot = hot_keys(ties, "v")
    share = materialize(join_unique(ties, total, "v", hot).select("v", "nb", (F.col("weight") / F.col("sum")).alias("p"), (F.col("weight") / F.col("most")).alias("m")), "shares")
    corners = materialize(_corners(triangles(ties)), "corners")
    iq = share.select(F.col("v").alias("i"), F.col("nb").alias("q"), F.col("p").alias("p_iq"))
    jq = share.select(F.col("v").alias("j"), F.col("nb").alias("q"), F.col("p").alias("p_jq"), F.col("m").alias("m_jq"))
    via = corners.join(iq, ["i", "q"]).join(jq, ["j", "q"])
    indirect = via.groupBy("i", "j").agg(F.sum(F.col("p_iq") * F.col("p_jq")).alias("through"), F.sum(F.col("p_iq") * F.col("m_jq")).alias("redundant"))
    direct = share.select(F.col("v").alias("i"), F.col("nb").alias("j"), "p").join(indirect, ["i", "j"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    per = direct.groupBy(F.col("i").alias("v")).agg(F.sum(F.pow(F.col("p") + zero("through"), 2)).alias("constraint"), F.sum(zero("redundant")).alias("redundant"))
    count = corners.groupBy(F.col("i").alias("v")).agg((F.count(F.lit(1)) / 2).cast("long").alias("triangles"))
    k = F.col("degree")
    return total.join(per, "v").join(count, "v", "left").select(
        "v", "degree", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.when(k > 1, F.coalesce("triangles", F.lit(0)) / (k * (k - 1) / 2)).otherwise(0.0).alias("clustering"), (k - F.col("redundant")).alias("effective_size"), "constraint"
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(v, root)``: weakly connected components, ``root`` the least vertex; alternating large and small stars.

    Steps go on until one changes nothing.  Loops and edges without an end are ignored, so a vertex
    without a real edge is not listed.
    """
    pair = lambda x, y: (F.least(x, y).alias("u"), F.greatest(x, y).alias("w"))
    now = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(*pair(F.col(a), F.col(b))).distinct(), "cc")
    mark = None
    while True:
        both = now.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("w").alias("nb")), F.struct(F.col("w").alias("v"), F.col("u").alias("nb")))).alias("e")).select("e.*")
        least = both.groupBy("v").agg(F.least(F.min("nb"), F.col("v")).alias("m"))
        hot = hot_keys(both, "v")  # a vertex has no more rows below than here
        large = join_unique(both, least, "v", hot).where("nb > v").select(*pair(F.col("nb"), F.col("m"))).where("u <> w").distinct()
        down = large.select(F.col("w").alias("v"), F.col("u").alias("nb"))
        low = down.groupBy("v").agg(F.min("nb").alias("m"))
        small = join_unique(down, low, "v", hot).select(F.explode(F.array(F.struct("nb", "m"), F.struct(F.col("v").alias("nb"), F.col("m")))).alias("e")).select(*pair(F.col("e.nb"), F.col("e.m"))).where("u <> w").distinct()
        before, now = now, materialize(small, "cc")
        release(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("w").alias("v"), F.col("u").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("v"), "root").distinct())


def hop_distances(ties: DataFrame, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``(source, v, hops)`` to everything reachable from each of ``sources(v)``; one frontier for all, breadth first.

    Each hop is one job over the frontier alone; found vertices are appended as tables of their
    hop, never rewritten.  ``max_hops`` ends the search earlier for callers that ask for less.
    """
    ties = materialize(ties.select("v", "nb"), "ties")
    rings = [materialize(sources.where("v IS NOT NULL").select(F.col("v").alias("source"), "v", F.lit(0).alias("hops")).distinct(), "bfs")]
    while max_hops is None or len(rings) <= max_hops:
        # what is next to a ring lies in it, in the one before, or is new
        near = rings[-1] if len(rings) == 1 else rings[-1].unionByName(rings[-2])
        reached = rings[-1].join(ties, "v").select("source", F.col("nb").alias("v")).distinct().join(near.select("source", "v"), ["source", "v"], "left_anti")
        ring = materialize(reached.withColumn("hops", F.lit(len(rings))), "bfs")
        if ring.isEmpty():
            break
        rings.append(ring)
    release(ties)
    return rings[0].sparkSession.read.schema(rings[0].schema).parquet(*[r._scratch_path for r in rings])


#: Ties that a task holds at once to count paths in; a larger graph is joined ring by ring.
HELD_TIES = 10_000_000
#: Sources that go to a task together, tasks at least, numbers that a table of paths holds, and ties gathered at once.
SOURCE_BLOCK, LEAST_BLOCKS, PATH_CELLS, TIE_CHUNK = 512, 24, 4_000_000, 1 << 18


def betweenness(ties: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``v, score``: how many shortest paths between two others run through every vertex (each undirected pair once).

    ``ties`` hold every tie both ways.  Paths are counted breadth first from all ``sources`` (all
    vertices by default, which is exact; a sample gives an estimate for its sources), then shares
    flow back ring by ring.  Up to ``HELD_TIES`` ties, blocks of sources go to tasks that hold the
    graph, so that only sums per vertex and block are shuffled.
    """
    ties = materialize(ties.select("v", "nb").where("v <> nb").distinct(), "ties")
    asked = ties.select("v").distinct() if sources is None else sources.select("v").where("v IS NOT NULL").distinct()
    if ties.count() > HELD_TIES:
        return _betweenness_by_joins(ties, asked)
    every = materialize(ties.select("v").unionByName(asked).distinct().withColumn("id", F.monotonically_increasing_id()), "vertices")
    hot = hot_keys(ties, "v")
    numbered = join_unique(ties, every.select("v", F.col("id").alias("a")), "v", hot).select("a", F.col("nb").alias("v"))
    lists = materialize(join_unique(numbered, every, "v", hot).groupBy("a").agg(F.collect_list("id").alias("b")), "lists")
    starts = materialize(asked.join(every, "v").select("id"), "starts")
    blocks = max(LEAST_BLOCKS, -(-starts.count() // SOURCE_BLOCK))
    graphs = lists.crossJoin(F.broadcast(ties.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block")))).repartition(blocks, "block")
    starts = starts.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")
    sums = graphs.groupBy("block").cogroup(starts.groupBy("block")).applyInPandas(_block_shares, "id long, share double")
    return sums.groupBy("id").agg((F.sum("share") / 2).alias("score")).join(every, "id").select("v", "score")


def _block_shares(graph: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """``id, share`` of the vertices that a block of sources reaches: their parts of the shortest paths, ends left out (Brandes)."""
    ids = np.unique(np.concatenate([graph["a"].to_numpy(dtype=np.int64), starts["id"].to_numpy(dtype=np.int64)]))
    size = np.zeros(len(ids), dtype=np.int64)
    place = np.searchsorted(ids, graph["a"].to_numpy(dtype=np.int64))
    order = np.argsort(place)
    size[place] = [len(b) for b in graph["b"]]
    to = np.searchsorted(ids, np.concatenate([np.zeros(0, dtype=np.int64), *(graph["b"].iloc[k] for k in order)])).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(size)])[:-1]

    def around(rows: np.ndarray) -> np.ndarray:
        """Where the ties of ``rows`` lie, row after row."""
        n = size[rows]
        return np.repeat(first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def gather(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each of ``rows`` (all have ties) the sum of its neighbours' rows of ``table``."""
        out, ends = np.empty((len(rows), table.shape[1])), np.cumsum(size[rows])
        at = 0
        while at < len(rows):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TIE_CHUNK, "right")))
            part = rows[at:upto]
            out[at:upto] = np.add.reduceat(table[to[around(part)]], np.cumsum(size[part]) - size[part], axis=0)
            at = upto
        return out

    total, reached = np.zeros(len(ids)), np.zeros(len(ids), dtype=bool)
    sources = np.searchsorted(ids, starts["id"].to_numpy(dtype=np.int64))
    width = int(min(16, max(1, PATH_CELLS // max(1, len(ids)))))
    for own in (sources[k : k + width] for k in range(0, len(sources), width)):
        shape = (len(ids), len(own))
        ring, paths, now, share = np.full(shape, -1, dtype=np.int32), np.zeros(shape), np.zeros(shape), np.zeros(shape)
        ring[own, np.arange(len(own))] = 0
        paths[own, np.arange(len(own))] = now[own, np.arange(len(own))] = 1
        fronts = [np.unique(own)]
        while True:
            near = np.unique(to[around(fronts[-1])])
            near = near[(ring[near] < 0).any(axis=1)]
            count = gather(now, near)
            count[ring[near] >= 0] = 0
            now[fronts[-1]] = 0
            some = (count > 0).any(axis=1)
            near, count = near[some], count[some]
            if not len(near):
                break
            now[near] = count
            paths[near] += count
            ring[near] = np.where(count > 0, len(fronts), ring[near])
            fronts.append(near)
        for k in range(len(fronts) - 1, 0, -1):
            far, back = fronts[k], fronts[k - 1]
            now[far] = np.where(ring[far] == k, (1 + share[far]) / np.where(ring[far] == k, paths[far], 1), 0)
            flow = gather(now, back[size[back] > 0])
            back = back[size[back] > 0]
            share[back] += np.where(ring[back] == k - 1, flow * paths[back], 0)
            now[far] = 0
        share[own, np.arange(len(own))] = 0
        total += share.sum(axis=1)
        reached |= (ring >= 0).any(axis=1)
    return pd.DataFrame({"id": ids[reached], "share": total[reached]})


def _betweenness_by_joins(ties: DataFrame, asked: DataFrame) -> DataFrame:
    """``betweenness`` of a graph that no task can hold: the state is one row a source and reached vertex."""
    start = asked.select(F.col("v").alias("source"), "v", F.lit(1.0).alias("paths"))
    rings = [materialize(start, "ring")]
    while True:
        near = rings[-1] if len(rings) == 1 else rings[-1].unionByName(rings[-2])
        onward = rings[-1].join(ties, "v").groupBy("source", F.col("nb").alias("v")).agg(F.sum("paths").alias("paths")).join(near.select("source", "v"), ["source", "v"], "left_anti")
        ring = materialize(onward, "ring")
        if ring.isEmpty():
            break
        rings.append(ring)
    share = rings[-1].select("source", "v", "paths", F.lit(0.0).alias("share"))
    parts = [share]
    for ring in reversed(rings[:-1]):
        back = share.select("source", F.col("v").alias("nb"), ((1 + F.col("share")) / F.col("paths")).alias("each")).join(ties, "nb").join(ring, ["source", "v"])
        own = back.groupBy("source", "v").agg(F.sum(F.col("each") * F.col("paths")).alias("share"))
        share = materialize(ring.join(own, ["source", "v"], "left").select("source", "v", "paths", F.coalesce("share", F.lit(0.0)).alias("share")), "share")
        parts.append(share)
    total = parts[0]
    for p in parts[1:]:
        total = total.unionByName(p)
    return total.groupBy("v").agg((F.sum(F.when(F.col("v") != F.col("source"), F.col("share")).otherwise(0.0)) / 2).alias("score"))


def strongly_connected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """``(v, scc)`` of the vertices on directed cycles of two or more vertices; ``scc`` the least vertex.

    Rounds trim vertices without an edge in or out and contract an independent set of those with
    exactly one of each (``x -> v -> y`` becomes ``x -> y``; if x is y, x is known to lie on a cycle),
    so chains and cycles of any length vanish in O(log n) rounds.  In the core that is left every
    vertex takes the least vertex that reaches it, and what reaches that vertex back is a component.
    Contracted vertices then join the component that both their neighbours are in.  Steps go on
    until one changes nothing.  Loops, repeated edges and edges without an end add nothing.
    """
    live = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("s"), F.col(b).alias("t")).distinct(), "scc")
    history, loops, size = [], live.select(F.col("s").alias("v")).where("false"), live.count()
    while size:
        into = live.groupBy(F.col("t").alias("v")).agg(F.count(F.lit(1)).alias("i"), F.min("s").alias("x"))
        out = live.groupBy(F.col("s").alias("v")).agg(F.count(F.lit(1)).alias("o"), F.min("t").alias("y"))
        both = materialize(into.join(out, "v"), "degrees")
        salt = F.lit(f"r{len(history)}")  # a string, so that every round compiles to the same code
        rank = lambda c: F.struct(F.xxhash64(F.col(c), salt), F.col(c))
        gone = materialize(both.where("i = 1 AND o = 1").where((rank("v") > rank("x")) & (rank("v") > rank("y"))).select("v", "x", "y"), "gone")
        kept = live.join(both.select(F.col("v").alias("s")), "s", "left_semi").join(both.select(F.col("v").alias("t")), "t", "left_semi")
        kept = kept.join(gone.select(F.col("v").alias("s")), "s", "left_anti").join(gone.select(F.col("v").alias("t")), "t", "left_anti").select("s", "t")
        # a bridge counts only where both its ends are still there: trimmed vertices are on no cycle
        bridges = gone.where("x <> y").join(both.select(F.col("v").alias("x")), "x", "left_semi").join(both.select(F.col("v").alias("y")), "y", "left_semi").select(F.col("x").alias("s"), F.col("y").alias("t"))
        before, live = live, materialize(kept.unionByName(bridges).distinct(), "scc")
        single = not both.where("i = 1 AND o = 1").isEmpty()
        release(before)
        release(both)
        history.append(gone)
        loops = loops.unionByName(gone.where("x = y").select(F.col("x").alias("v")))
        was, size = size, live.count()
        if size == was and not single:
            break
    loops = materialize(loops.distinct(), "loops")
    label = _core_components(live)
    named = label.select("v")
    for h in history:
        named = named.unionByName(h.select("v"))
    label = materialize(label.unionByName(loops.join(named, "v", "left_anti").select("v", F.col("v").alias("c"))), "labels")
    for gone in reversed(history):
        near = gone.join(label.select(F.col("v").alias("x"), F.col("c").alias("cx")), "x", "left").join(label.select(F.col("v").alias("y"), F.col("c").alias("cy")), "y", "left")
        own = near.join(loops.withColumn("looped", F.lit(True)), "v", "left")
        found = own.select("v", F.when(F.col("cx") == F.col("cy"), F.col("cx")).when(F.col("looped"), F.col("v")).alias("c")).where("c IS NOT NULL")
        before, label = label, materialize(label.unionByName(found), "labels")
        release(before)
        release(gone)
    least = label.groupBy("c").agg(F.min("v").alias("scc"))
    return join_unique(label, least, "c", hot_keys(label, "c")).select("v", "scc")


def _core_components(live: DataFrame) -> DataFrame:
    """``(v, c)`` of all vertices on cycles of a graph ``(s, t)``, by forward colours and their backward closure."""
    out = live.select(F.col("s").alias("v"), F.col("s").alias("c")).where("false")
    while not live.isEmpty():
        color = live.select(F.explode(F.array("s", "t")).alias("v")).distinct().withColumn("c", F.col("v"))
        color = _spread_least(live.select(F.col("s").alias("from"), F.col("t").alias("to")), color)
        inside = live.join(color.select(F.col("v").alias("s"), F.col("c").alias("cs")), "s").join(color.select(F.col("v").alias("t"), F.col("c").alias("ct")), "t").where("cs = ct")
        inside = materialize(inside.select("s", "t", "cs"), "inside")
        back = front = materialize(color.where("v = c").select("v", "c"), "back")
        while True:
            more = inside.join(front.select(F.col("v").alias("t"), "c"), "t").where("c = cs").select(F.col("s").alias("v"), "c").distinct().join(back, ["v", "c"], "left_anti")
            front = materialize(more, "back")
            if front.isEmpty():
                break
            back = back.unionByName(front)
        found = back.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(back, "c").select("v", "c")
        out = materialize(out.unionByName(found), "components")
        rest = live.join(back.select(F.col("v").alias("s")), "s", "left_anti").join(back.select(F.col("v").alias("t")), "t", "left_anti").select("s", "t")
        before, live = live, materialize(rest, "scc")
        for table in (before, inside, color):
            release(table)
    return out


def _spread_least(arcs: DataFrame, color: DataFrame) -> DataFrame:
    """Every vertex takes the least colour that reaches it; steps until none moves."""
    color = materialize(color, "color")
    while True:
        offered = arcs.join(color.select(F.col("v").alias("from"), "c"), "from").groupBy(F.col("to").alias("v")).agg(F.min("c").alias("o"))
        new = materialize(color.join(offered, "v", "left").select("v", F.least("c", "o").alias("c"), F.coalesce(F.col("o") < F.col("c"), F.lit(False)).alias("moved")), "color")
        moved = not new.where("moved").isEmpty()
        release(color)
        color = new.drop("moved")
        color._scratch_path = new._scratch_path
        if not moved:
            return color


def owner_features(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Per owned entity, over its owners: number of links, distinct jurisdictions, secrecy, foreign and nominee owners, widest fan-out."""
    own = entities.where("entity_id IS NOT NULL").groupBy("entity_id").agg(F.min("jurisdiction").alias("jurisdiction"), F.min("name").alias("name"))
    links = edges.where("source_id IS NOT NULL AND target_id IS NOT NULL").select("source_id", "target_id")
    hot = hot_keys(links, "source_id")
    nominee = F.lit(False)
    for w in NOMINEE_WORDS:
        nominee = nominee | F.coalesce(F.lower("name").rlike(rf"\b{w}\b"), F.lit(False))
    fan = links.groupBy("source_id").agg(F.count(F.lit(1)).alias("fan_out"))
    owners = fan.join(own.select(F.col("entity_id").alias("source_id"), F.col("jurisdiction").alias("oj"), nominee.alias("nominee")), "source_id")
    rows = join_unique(links, owners, "source_id", hot)
    per = rows.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_links"), F.collect_set(F.when(F.col("oj") != "", F.col("oj"))).alias("js"), F.count_if(F.col("oj").isin(*SECRECY)).alias("n_secrecy"), F.count_if("nominee").alias("n_nominee"), F.max("fan_out").alias("widest"))
    target = own.select(F.col("entity_id").alias("target_id"), F.col("jurisdiction").alias("tj"))
    foreign = F.size(F.filter("js", lambda j: j != F.col("tj")))
    return per.join(target, "target_id").select("target_id", "n_links", F.size("js").alias("n_jurisdictions"), "n_secrecy", F.when(F.col("tj") != "", foreign).otherwise(0).alias("n_foreign"), "n_nominee", "widest")
