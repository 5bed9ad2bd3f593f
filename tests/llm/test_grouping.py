import random

import pytest

from lodestream.llm.grouping import connected_groups, person_groups


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def run(spark, pairs):
    df = spark.createDataFrame([(*p, 1, "v") for p in pairs], "x long, y long, u int, root string")
    return {r["member"]: r["group_id"] for r in connected_groups(df, "x", "y").collect()}


@pytest.mark.parametrize("seed,n,m", [(1, 80, 60), (2, 60, 150), (3, 200, 190)])
def test_random_graphs(spark, seed, n, m):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(None, 1), (5, None), (7, 7), (3, 4), (3, 4), (4, 3)]
    assert run(spark, pairs) == brute(pairs)


def test_long_chain_ring_star_and_complete_core(spark):
    pairs = [(k, k + 1) for k in range(100, 250)] + [(300 + k, 300 + (k + 1) % 40) for k in range(40)] + [(400, 401 + k) for k in range(90)]
    pairs += [(a, b) for a in range(500, 508) for b in range(a + 1, 508)] + [(507, 520), (520, 521)]
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert run(spark, []) == {}


SCHEMA = "record_id long, name string, email string, aliases array<string>, first string"


def groups(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {r["record_id"]: r["group_id"] for r in person_groups(df).collect()}


def test_addresses_however_written(spark):
    rows = [
        (1, "A", " Ann@X.example", None),
        (2, "A", "Ann B <ann@x.example>", None),
        (3, None, None, ["<ANN@x.example> ", "ann", None, ""]),
        (4, "A", "ann@x.exmaple", None),
        (5, "B", "noreply@x.example", ["team@x.example"]),
        (6, "C", "noreply@x.example", ["team@x.example", "n/a", "unknown@invalid"]),
        (7, "D", "unknown@invalid", ["12+d@users.noreply.codehub.example"]),
        (8, "D", "", ["12+D@users.noreply.codehub.example"]),
        (None, "A", "ann@x.example", None),
        (1, "A", " Ann@X.example", None),
        (9, "long", "x" * 100_000 + "@y.example", []),
    ]
    assert groups(spark, rows) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert groups(spark, []) == {}


def test_chain_of_addresses(spark):
    rows = [(k, "n", f"a{k}@x.example", [f"a{k - 1}@x.example"]) for k in range(10, 60)]
    assert groups(spark, rows) == {k: 10 for k in range(10, 60)}
