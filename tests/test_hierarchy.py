import random

import pytest

from lodestream.operators.hierarchy import contract_forest, descendants, live_subsidiaries


def brute(links):
    parent = {}
    for p, c in links:
        if p is not None and c is not None:
            parent[c] = min(parent.get(c, p), p)
    out = {}
    for n in set(parent) | set(parent.values()):
        path, at = [n], n
        while at in parent and len(path) <= len(parent) + 1:
            at = parent[at]
            path.append(at)
        loop = len(path) > len(parent) + 1 or len(set(path)) < len(path)
        out[n] = ("cycle", -1, None) if loop else (at, len(path) - 1, path[::-1])
    return out


def run(spark, links):
    df = spark.createDataFrame([(*x, "extra", 1) for x in links], "p string, c string, node string, depth int")
    f = contract_forest(df, "p", "c")
    return {r["node_id"]: (r["root_id"], r["depth"], r["path"]) for r in f.collect()}, f


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_loops(spark, seed):
    rnd = random.Random(seed)
    links = [(f"n{rnd.randrange(k)}" if rnd.random() < 0.9 else f"n{rnd.randrange(60)}", f"n{k}") for k in range(1, 60)]
    links += [(None, "x"), ("y", None), ("s", "s"), links[3], links[3]]
    got, f = run(spark, links)
    assert got == brute(links)
    want = {(a, n, len(v[2]) - 1 - i) for n, v in got.items() if v[2] for i, a in enumerate(v[2][:-1])}
    assert {tuple(r) for r in descendants(f).select("ancestor_id", "node_id", "distance").collect()} == want


def test_long_chain_and_wide_star(spark):
    links = [(f"c{k}", f"c{k + 1}") for k in range(120)] + [("hub", f"leaf{k}") for k in range(200)]
    got, _ = run(spark, links)
    assert got["c120"][:2] == ("c0", 120) and got["c120"][2] == [f"c{k}" for k in range(121)]
    assert got["leaf7"] == ("hub", 1, ["hub", "leaf7"])


def test_two_cycle_and_what_hangs_below(spark):
    got, _ = run(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")])
    assert {k: v[:2] for k, v in got.items()} == dict.fromkeys("abcd", ("cycle", -1))


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_deep_trees_below_a_loop(spark, size):
    """What hangs from a loop outlives it in the contraction; many loops see many coin flips."""
    links = []
    for k in range(12):
        links += [(f"l{k}_{i}", f"l{k}_{(i + 1) % size}") for i in range(size)]
        links += [(f"l{k}_0", f"t{k}_0")] + [(f"t{k}_{i}", f"t{k}_{i + 1}") for i in range(3 * k)] + [(f"t{k}_{i}", f"s{k}_{i}") for i in range(0, 3 * k, 2)]
    got, _ = run(spark, links)
    assert got == brute(links)


def test_empty_table(spark):
    assert run(spark, [])[0] == {}


def test_ids_as_spelled_in_entities(spark):
    edges = spark.createDataFrame(
        [(" sc002621", "5767923", "subsidiary", None), ("SC002621", "05767923\t", "subsidiary", None), ("ZZ1", "ICIJ_BL_1", "subsidiary", None), ("a", "b", "subsidiary", "2020-01-01"), ("a", "b", "control", None), (None, "b", "subsidiary", None), ("", "b", "subsidiary", None)],
        "source_id string, target_id string, edge_type string, ceased_on string",
    )
    entities = spark.createDataFrame([("SC002621",), ("05767923",), ("icij_bl_1",), (None,)], "entity_id string")
    assert sorted(map(tuple, live_subsidiaries(edges, entities).collect())) == [("SC002621", "05767923"), ("ZZ1", "icij_bl_1")]
