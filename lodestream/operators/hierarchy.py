"""Parent-child rows to full hierarchies by tree contraction.

Every round *rakes* (removes the leaves) and *compresses* (splices out an independent set
of unary-chain nodes, chosen by coin flips on the node's hash).  A removed node records the
parent it then hung from, the number of original links between them and the nodes spliced
out between.  After O(log n) expected rounds only roots are left; a loop contracts to a node
that is its own parent.  Reversing the recorded rounds restores root, depth and path.

Each round is a constant number of equi-joins on unique keys, so a node with very many
children is only ever met by a partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.skew import hot_keys, join_unique
from lodestream.scratch import materialize, release

CYCLE = "cycle"


def _coin(node: str, round_no: int):
    # the round as a string, so that every round compiles to the same code
    return F.xxhash64(F.col(node), F.lit(f"r{round_no}")).bitwiseAND(F.lit(1))


def _round(live: DataFrame, round_no: int) -> DataFrame:
    """One rake and compress; ``fate``: 0 stays, 1 removed now, 2 a loop contracted to one node."""
    kids = live.groupBy(F.col("parent").alias("k_parent")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("only"))
    state = live.join(kids, live["node"] == kids["k_parent"], "left").drop("k_parent")
    looped = F.col("node") == F.col("parent")
    spliceable = (F.col("n") == 1) & ~looped & (F.col("only") != F.col("node")) & (_coin("node", round_no) == 1) & (_coin("only", round_no) == 0)
    splice = state.where(spliceable).select(
        F.col("node").alias("s_node"), F.col("parent").alias("s_parent"), F.col("links").alias("s_links"), F.col("between").alias("s_between"), F.col("only").alias("s_only")
    )
    # a child that is no leaf hands its splice over; the child then hangs from its grandparent
    after = state.join(splice, (state["node"] == splice["s_only"]) & state["n"].isNotNull(), "left")
    spliced = F.col("s_node").isNotNull()
    kept = F.struct(
        F.col("node"),
        F.when(spliced, F.col("s_parent")).otherwise(F.col("parent")).alias("parent"),
        F.when(spliced, F.col("s_links") + F.col("links")).otherwise(F.col("links")).alias("links"),
        F.when(spliced, F.concat("s_between", F.array("s_node"), "between")).otherwise(F.col("between")).alias("between"),
        F.when(F.col("n").isNull(), 1).when(looped, 2).otherwise(0).alias("fate"),
        F.lit(False).alias("gone"),
    )
    gone = F.struct(F.col("s_node").alias("node"), F.col("s_parent").alias("parent"), F.col("s_links").alias("links"), F.col("s_between").alias("between"), F.lit(1).alias("fate"), F.lit(True).alias("gone"))
    rows = after.select(F.explode(F.when(spliced, F.array(kept, gone)).otherwise(F.array(kept))).alias("r")).select("r.*")
    # a spliced-out node appears twice: as it was and as gone; the latter wins
    return rows.groupBy("node").agg(F.max_by(F.struct("parent", "links", "between", "fate"), "gone").alias("r")).select("node", "r.*")


def contract_forest(links: DataFrame, parent_col: str, child_col: str, with_path: bool = True, max_rounds: int = 200) -> DataFrame:
    """Root, depth and path of every node of a parent-child table.

    Rows with a null parent or child are no links, repeated rows count once, extra columns are
    ignored, and an empty table gives an empty result.  A child with several parents keeps the
    smallest (the result is a forest by definition).  Nodes on a loop or below one get root
    ``cycle``, depth -1 and a null path.  Returns ``node_id, root_id, depth[, path]``; ``path``
    runs from the root to the node, both included.
    """
    pairs = links.select(F.col(parent_col).cast("string").alias("parent"), F.col(child_col).cast("string").alias("node")).where("parent IS NOT NULL AND node IS NOT NULL")
    tree = pairs.groupBy("node").agg(F.min("parent").alias("parent"))
    empty = F.array().cast("array<string>")
    live = materialize(tree.select("node", "parent", F.lit(1).alias("links"), empty.alias("between")), "forest")
    roots = live.select(F.col("parent").alias("node")).distinct().join(live.select("node"), "node", "left_anti")
    labels = roots.select("node", F.col("node").alias("root_id"), F.lit(0).alias("depth"), F.array("node").alias("path"))

    hot = hot_keys(live, "parent")  # splicing never adds to a node's children, so the list holds for all rounds

    first, removed, rounds, state = live, [], 0, live
    while not state.isEmpty():
        if rounds == max_rounds:
            raise RuntimeError(f"no end after {max_rounds} contraction rounds")
        done = _round(state.select("node", "parent", "links", "between") if with_path else state.select("node", "parent", "links", empty.alias("between")), rounds)
        if not with_path:
            done = done.withColumn("between", empty)
        table = materialize(done, "round", partition_by="fate")
        removed.append(table)
        state = table.where("fate = 0")
        rounds += 1

    # a contracted loop leaves in its round, but what hangs from it may leave later: loops are known from the start
    for table in removed:
        labels = labels.unionByName(table.where("fate = 2").select("node", F.lit(CYCLE).alias("root_id"), F.lit(-1).alias("depth"), F.lit(None).cast("array<string>").alias("path")))
    labels = materialize(labels, "labels")

    path = F.concat("path", "between", F.array("node")) if with_path else F.lit(None).cast("array<string>")
    for table in reversed(removed):
        above = labels.withColumnRenamed("node", "parent")
        below = join_unique(table.where("fate = 1").select("node", "parent", "links", "between"), above, "parent", hot)
        bad = F.col("root_id") == CYCLE
        new = below.select("node", "root_id", F.when(bad, -1).otherwise(F.col("depth") + F.col("links")).alias("depth"), F.when(~bad, path).alias("path"))
        # rounds shrink geometrically, so writing all labels anew costs a small multiple of the nodes in total
        before, labels = labels, materialize(labels.unionByName(new), "labels")
        release(before)
        release(table)
    release(first)
    out = labels.withColumnRenamed("node", "node_id")
    return out if with_path else out.drop("path")


def descendants(forest: DataFrame) -> DataFrame:
    """All ``(ancestor_id, node_id, distance)`` pairs of the result of ``contract_forest``.

    One row per node and ancestor, from the paths: no join, no recursion.  Nodes on or below a
    loop have no path and take no part.
    """
    steps = forest.where("path IS NOT NULL").select("node_id", F.posexplode("path").alias("pos", "ancestor_id"), "depth")
    return steps.where(F.col("pos") < F.col("depth")).select("ancestor_id", "node_id", (F.col("depth") - F.col("pos")).alias("distance"))


def entity_id_key(column):
    """An entity id whatever its case, blanks or dropped leading zeros of a register number."""
    upper = F.upper(F.regexp_replace(column, r"\s+", ""))
    return F.when(upper != "", F.regexp_replace(upper, r"^([A-Z]{0,2})0*([0-9]+)$", "$1$2"))


def live_subsidiaries(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct live subsidiary links ``(owner, owned)``, ids as spelled in ``entities``.

    Ids that no entity has are kept as given (of several writings, the smallest).
    """
    links = edges.where("edge_type = 'subsidiary' AND ceased_on IS NULL").select("source_id", "target_id").distinct()
    spelled = entities.where("entity_id IS NOT NULL").groupBy(entity_id_key(F.col("entity_id")).alias("key")).agg(F.min("entity_id").alias("spelled"))
    given = links.select(F.explode(F.array("source_id", "target_id")).alias("given")).where("given IS NOT NULL").groupBy(entity_id_key(F.col("given")).alias("key")).agg(F.min(F.trim("given")).alias("given"))
    names = given.join(spelled, "key", "left").select("key", F.coalesce("spelled", "given").alias("id"))
    keyed = links.select(entity_id_key(F.col("source_id")).alias("s"), entity_id_key(F.col("target_id")).alias("t")).where("s IS NOT NULL AND t IS NOT NULL").distinct()
    hot = hot_keys(keyed, "s")
    owner, owned = names.select(F.col("key").alias("s"), F.col("id").alias("owner")), names.select(F.col("key").alias("t"), F.col("id").alias("owned"))
    return join_unique(keyed, owner, "s", hot).join(owned, "t").select("owner", "owned")


def ownership_hierarchy(edges: DataFrame, entities: DataFrame, with_path: bool = True) -> DataFrame:
    """``contract_forest`` over the live subsidiary links."""
    return contract_forest(live_subsidiaries(edges, entities), "owner", "owned", with_path)
