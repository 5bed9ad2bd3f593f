import random
from collections import Counter, deque

from pyspark.sql import functions as F

from lodestream.operators import graphs as G, structures as T


def _fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def _mix(data):
    """Brute force of the second hash, word by word."""
    turn = lambda x, n: (x << n | x >> (32 - n)) % 2**32
    h = 0
    for i in range(0, len(data), 4):
        part = data[i : i + 4]
        k = turn(int.from_bytes(part, "little") * 0xCC9E2D51 % 2**32, 15) * 0x1B873593 % 2**32
        h ^= k
        if len(part) == 4:
            h = (turn(h, 13) * 5 + 0xE6546B64) % 2**32
    h ^= len(data)
    for mul, s in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
        h = (h ^ h >> s) * mul % 2**32
    return h ^ h >> 16


ITEMS = ["", "a", "abc", "abcd", "abcde", "naïve café", "x" * 400, "deploy", "🙂"]


def test_slots_equal_brute_force(spark):
    slots, hashes = T.filter_size(100)
    got = {r["t"]: r["s"] for r in spark.createDataFrame([(t,) for t in ITEMS], "t string").select("t", T.bloom_slots(F.col("t"), slots, hashes).alias("s")).collect()}
    for t in ITEMS:
        d = t.encode()
        assert got[t] == [(_fnv(d) + i * _mix(d)) % slots for i in range(hashes)]
    assert (slots, hashes) == (958, 6) and T.filter_size(1)[0] == 64


def test_filters_count_remove_and_claim(spark):
    slots, hashes = T.filter_size(50)
    rows = spark.createDataFrame([("a", t) for t in ITEMS] + [("b", "deploy")] * 300 + [(None, "x"), ("a", None)], "k string, t string")
    f = T.bloom_filters(rows, "k", "t", slots, hashes)
    table = {(r["k"], r["slot"]): r["n"] for r in f.collect()}
    want = Counter(("a", (_fnv(t.encode()) + i * _mix(t.encode())) % slots) for t in ITEMS for i in range(hashes))
    assert {k: v for k, v in table.items() if k[0] == "a"} == want and all(v == 255 for k, v in table.items() if k[0] == "b")
    asked = spark.createDataFrame([("a", t) for t in [*ITEMS, "never there"]], "k string, t string")
    held = {r["t"] for r in T.bloom_members(f, asked, "k", "t", slots, hashes).collect()}
    assert set(ITEMS) <= held
    claims = {(r["k"], r["t"]) for r in T.bloom_claims(f, asked.select("t"), "k", "t", slots, hashes).collect()}
    assert {t for k, t in claims if k == "a"} == held and ("b", "deploy") in claims
    less = T.bloom_removed(f, spark.createDataFrame([("a", "abcd"), ("a", "never there")], "k string, t string"), "k", "t", slots, hashes)
    after = {(r["k"], r["slot"]): r["n"] for r in less.where("k = 'a'").collect()}
    gone = Counter(("a", (_fnv(b"abcd") + i * _mix(b"abcd")) % slots) for i in range(hashes))
    assert "never there" in held or sum(want.values()) - sum(after.values()) == sum(gone.values())
    bins = {r["bin"]: r["total"] for r in T.bloom_digest(f.where("k = 'a'"), "k", slots, 7).collect()}
    edges = [slots // 7 * k + min(k, slots % 7) for k in range(8)]
    assert bins == {b: n for b in range(7) if (n := sum(v for (_, s), v in want.items() if edges[b] <= s < edges[b + 1]))}
    same = T.bloom_overlap(f.where("k = 'a'"), "k", f.where("k = 'a'").select("slot", "n")).first()
    assert same["overlap"] == 1.0


def test_betweenness_equals_brute_force(spark):
    rnd = random.Random(3)
    edges = {tuple(sorted(rnd.sample(range(14), 2))) for _ in range(22)} | {(20, 21)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        order, back, paths, dist, queue = [], {v: [] for v in near}, Counter({s: 1}), {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    back[w].append(v)
        share = dict.fromkeys(near, 0.0)
        for w in reversed(order):
            for v in back[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                want[w] += share[w] / 2
    ties = spark.createDataFrame([*edges, *[(b, a) for a, b in edges]], "v long, nb long")
    got = {r["v"]: r["score"] for r in G.betweenness(ties).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_betweenness_of_a_long_path_and_by_joins(spark):
    n = 800  # one job a ring would take many minutes
    path = spark.createDataFrame([(f"v{a}", f"v{b}") for k in range(n - 1) for a, b in ((k, k + 1), (k + 1, k))], "v string, nb string")
    assert {r["v"]: round(r["score"], 6) for r in G.betweenness(path).collect()} == {f"v{k}": k * (n - 1 - k) for k in range(n)}
    rnd = random.Random(5)
    edges = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(90)}
    ties = spark.createDataFrame([*edges, *[(b, a) for a, b in edges]], "v long, nb long")
    some = spark.createDataFrame([(0,), (3,), (3,), (99,)], "v long")
    for asked in (ties.select("v").distinct(), some.distinct()):
        rows, joined = ({r["v"]: round(r["score"], 6) for r in f.collect()} for f in (G.betweenness(ties, asked), G._betweenness_by_joins(ties, asked)))
        assert rows == joined and rows
    assert G.betweenness(ties.where("false")).collect() == []


def test_greedy_selections(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["x", "y"]), (4, ["x", "z"]), (5, [])], "id long, terms array<string>")
    assert [r["id"] for r in T.farthest_first(rows, "id", "terms", 3).orderBy("place").collect()] == [1, 3, 5]
    assert T.farthest_first(rows.where("false"), "id", "terms", 3).count() == 0
    places = spark.createDataFrame([(k, [float(x), float(y)]) for k, (x, y) in enumerate([(1, 0), (1, 0.1), (1, 0.2), (0, 1), (-1, 0), (-1, 0.1), (0.5, 1)])], "id long, v array<double>")
    peers = [r["peer"] for r in T.select_peers(places, "id", "v").where("id = 0").orderBy("place").collect()]
    assert peers[:2] == [1, 2] and set(peers[2:4]) == {4, 5} and len(peers) == 6


def test_message_outcomes(spark):
    log = [("t", 1, 1, True), ("t", 2, 1, False), ("t", 2, 2, True), ("t", 2, 3, False), *[("t", 3, k, False) for k in range(5)], ("t", 3, 9, True), ("t", 4, 1, False)]
    got = {r["message"]: (r["n_attempts"], r["outcome"]) for r in T.message_outcomes(spark.createDataFrame(log, "topic string, message long, at long, ok boolean")).collect()}
    assert got == {1: (1, "acknowledged"), 2: (2, "acknowledged"), 3: (3, "dead"), 4: (1, "pending")}


def test_leaders_take_what_is_like_them(spark):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "y", "z"]), ("c", ["z", "w"]), ("d", []), ("e", ["z"]), ("f", ["x", "y", "z", "w"])], "id string, terms array<string>")
    got = {r["id"]: (r["leader"], round(r["similarity"], 3)) for r in T.leader_clusters(rows, "id", "terms").collect()}
    assert got == {"a": ("a", 1.0), "b": ("a", 0.667), "c": ("c", 1.0), "e": ("c", 0.5), "f": ("a", 0.5)}
    assert T.leader_clusters(rows.where("false"), "id", "terms").count() == 0
