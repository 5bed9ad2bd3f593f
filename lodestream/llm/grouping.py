"""Pairwise matches to groups: strip, compress, solve the core, restore.

Rounds remove every degree-one vertex (it hangs from its only neighbour) and, by list ranking
on degree-two chains, an independent set of chain vertices (local maxima of a per-round hash;
the two neighbours become adjacent).  Chains of any length vanish in O(log n) expected rounds.
What has neither is the reduced core, solved by alternating large-star / small-star steps.
Labels then return to the removed vertices in reverse order.

Degrees are partial aggregations and edges are removed by joins on whole edges, so a vertex
with a third of all edges never meets a join on itself, except through ``join_unique``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.operators.skew import hot_keys, join_unique
from lodestream.scratch import materialize, release


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("w").alias("nb")), F.struct(F.col("w").alias("v"), F.col("u").alias("nb")))).alias("e")).select("e.*")


def _pair(a, b):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("w")


def _strip_round(edges: DataFrame, round_no: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``removed(v, onto, kind)``, the plan of the remaining edges and the scratch table behind it; kind 1: leaf, 2: chain."""
    degree = _both_ways(edges).groupBy("v").agg(F.count(F.lit(1)).alias("deg"), F.min("nb").alias("a"), F.max("nb").alias("b")).where("deg <= 2")
    degree = materialize(degree, "degree")
    ends = degree.where("deg = 1").select(F.col("v").alias("x"), F.col("a").alias("y"))
    # of two leaves that face each other, the larger one leaves
    mutual = ends.join(ends.select(F.col("y").alias("x"), F.col("x").alias("y"), F.lit(1).alias("m")), ["x", "y"], "left")
    gone_leaves = mutual.where("m IS NULL OR x > y").select(F.col("x").alias("v"), F.col("y").alias("onto"), F.lit(1).alias("kind"))
    salt = F.lit(f"r{round_no}")  # a string, so that every round compiles to the same code
    rank = lambda c: F.struct(F.xxhash64(F.col(c), salt), F.col(c))
    chains = degree.where("deg = 2").where((rank("v") > rank("a")) & (rank("v") > rank("b")))
    chains = chains.join(ends.select(F.col("y").alias("v")).distinct(), "v", "left_anti")
    gone_chains = chains.select("v", F.col("a").alias("onto"), F.lit(2).alias("kind"), "b")
    removed = materialize(gone_leaves.withColumn("b", F.lit(None).cast("long")).unionByName(gone_chains), "removed")
    dead = removed.select(*_pair(F.col("v"), F.col("onto"))).unionByName(removed.where("kind = 2").select(*_pair(F.col("v"), F.col("b"))))
    bridges = removed.where("kind = 2").select(*_pair(F.col("onto"), F.col("b")))
    left = edges.join(dead, ["u", "w"], "left_anti").unionByName(bridges).distinct()
    return removed, left, degree


def _solve_core(edges: DataFrame) -> DataFrame:
    """``(v, root)`` of the vertices of ``edges``: alternating large and small stars until nothing changes."""
    now, mark = edges, None
    while True:
        both = _both_ways(now)
        least = both.groupBy("v").agg(F.least(F.min("nb"), F.col("v")).alias("m"))
        hot = hot_keys(both, "v")  # a vertex has no more rows below than here
        large = join_unique(both, least, "v", hot).where("nb > v").select(*_pair(F.col("nb"), F.col("m"))).where("u <> w").distinct()
        down = large.select(F.col("w").alias("v"), F.col("u").alias("nb"))
        low = down.groupBy("v").agg(F.min("nb").alias("m"))
        small = join_unique(down, low, "v", hot).select(F.explode(F.array(F.struct("nb", "m"), F.struct(F.col("v").alias("nb"), F.col("m")))).alias("e")).select(*_pair(F.col("e.nb"), F.col("e.m"))).where("u <> w").distinct()
        before, now = now, materialize(small, "core")
        if before is not edges:
            release(before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("w").alias("v"), F.col("u").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("v"), "root").distinct())


def connected_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``(member, group_id)`` for everything in a table of links; ``group_id`` is the group's least member.

    Ids are bigints.  Null ends and self links are no links, repeated links count once, extra
    columns are ignored, an empty table gives an empty result.
    """
    links = pairs.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    edges = materialize(links.select(*_pair(F.col("x"), F.col("y"))).distinct(), "edges")
    # stripping and splicing never add to a vertex's degree, so this list holds for all rounds
    hot = hot_keys(_both_ways(edges), "v")
    history, core = [], edges
    while True:
        removed, left, degree = _strip_round(core, len(history))
        if removed.isEmpty():
            break
        history.append(removed)
        before, core = core, materialize(left, "edges")
        release(before)
        release(degree)
    empty = edges.select(F.col("u").alias("v"), F.col("u").alias("root")).where("false")
    known = empty if core.isEmpty() else materialize(_solve_core(core), "labels")
    for removed in reversed(history):
        part = removed.select("v", "onto", "kind")
        # an end that is neither removed nor labelled is the last vertex of its component: its own root
        fresh = part.select(F.col("onto").alias("v")).distinct().join(part.select("v").unionByName(known.select("v")), "v", "left_anti")
        labelled = known.unionByName(fresh.select("v", F.col("v").alias("root")))
        for kind in (2, 1):
            label = labelled.select(F.col("v").alias("onto"), "root")
            labelled = labelled.unionByName(join_unique(part.where(F.col("kind") == kind), label, "onto", hot).select("v", "root"))
        # rounds shrink geometrically, so writing all labels anew costs a small multiple of the vertices in total
        before, known = known, materialize(labelled, "labels")
        release(before)
        release(removed)
    least = known.groupBy("root").agg(F.min("v").alias("group_id"))
    return join_unique(known, least, "root", hot_keys(known, "root")).select(F.col("v").alias("member"), "group_id")


#: Local parts of mailboxes that belong to no single person.
ROLE_LOCALS = (
    "abuse", "accounts", "admin", "administrator", "alerts", "all", "billing", "bot", "bots", "build", "builds", "ci", "contact", "data", "deploy", "dev", "devnull", "devops",
    "do-not-reply", "donotreply", "engineering", "everyone", "feedback", "finance", "github", "hello", "help", "helpdesk", "hr", "info", "infra", "it", "jobs", "legal", "mail",
    "mailer-daemon", "marketing", "me", "n/a", "na", "news", "no-reply", "nobody", "none", "noreply", "notifications", "notify", "null", "office", "oncall", "on-call", "ops",
    "payments", "platform", "postmaster", "press", "privacy", "release", "releases", "reply", "robot", "root", "sales", "security", "service", "services", "shared", "slack", "sre",
    "staff", "support", "sysadmin", "system", "team", "teams", "tech", "test", "undisclosed", "unknown", "user", "web", "webmaster", "webhook", "x", "xxx",
)
_DOMAIN = r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+"


def mail_address(text):
    """The one address in a field: lower case, without blanks, display name or brackets; null if there is none.

    Role, robot and placeholder mailboxes count as none.
    """
    low = F.lower(F.trim(text))
    inner = F.regexp_extract(low, r"<\s*(?:mailto:)?([^<>]*?)\s*>\s*$", 1)
    bare = F.regexp_replace(F.when(inner != "", inner).otherwise(low), r"^[\s\"'(\[]*(?:mailto:)?|[\s\"')\],;.]*$", "")
    local, robot = F.substring_index(bare, "@", 1), F.regexp_replace(F.substring_index(bare, "@", 1), r"[0-9]+$", "")
    ok = bare.rlike(rf"^[^\s@<>]+@{_DOMAIN}$") & ~local.isin(*ROLE_LOCALS) & ~robot.rlike(r"(^|[-_.+])(bot|noreply|no-reply)$|\[bot\]$")
    return F.when(ok, bare)


def shared_address_links(records: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of every record to the least record that shares an address with it."""
    texts = F.concat(F.array(F.col("email")), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))
    held = records.where("record_id IS NOT NULL").select(F.col("record_id").cast("long").alias("record_id"), F.explode(texts).alias("t")).select("record_id", mail_address(F.col("t")).alias("address")).where("address IS NOT NULL").distinct()
    held = materialize(held, "addresses")
    first = held.groupBy("address").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("address", "first")
    return join_unique(held, first, "address", hot_keys(held, "address")).where("record_id <> first").select(F.col("first").alias("a"), F.col("record_id").alias("b"))


def person_groups(records: DataFrame) -> DataFrame:
    """``record_id, group_id`` of every record linked to at least one other by shared addresses.

    Null ids, fields and alias lists hold nothing; a record repeated under its own id is one record.
    """
    return connected_groups(shared_address_links(records), "a", "b").withColumnRenamed("member", "record_id")
