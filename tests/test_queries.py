import pytest

import __spark_entry__ as entry
from lodestream.plans import registry
from oracle import check, connect


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    check(entry.queries()[name](spark, small), connect(small), registry.oracle_sql()[name])


def _classes(rows):
    """Classes are named by their least member, and everybody in one is linked or a copy."""
    least = {}
    for r in rows:
        least[r["class_id"]] = min(r["id"], least.get(r["class_id"], r["id"]))
    assert all(k == v for k, v in least.items()) and all(r["n_links"] >= 0 for r in rows)
    assert all(sum(1 for q in rows if q["class_id"] == k) > 1 for k in least)


def _eigenvalues(rows):
    by = {}
    for r in rows:
        by.setdefault(r["root"], []).append((r["k"], r["eigenvalue"]))
    for values in by.values():
        values = [v for _, v in sorted(values)]
        assert abs(values[0]) < 1e-6 and values == sorted(values) and len(values) >= 2 and values[1] > 1e-6


def _bloom(rows):
    """A counting filter sees what is there and a little more."""
    assert {r["source"]: (r["estimate"], r["exact"]) for r in rows}["slack"] == (1.0, 1.0)
    assert all(abs(r["estimate"] - r["exact"]) < 0.1 for r in rows)


def _peers(rows):
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append((r["place"], r["peer"]))
    assert all(len(p) == min(6, len(by) - 1) and len({q for _, q in p}) == len(p) and all(q != w for _, q in p) for w, p in by.items())


#: What holds for the rows of queries that SQL cannot express.
CONTENT = {
    "p6_found": lambda rows: [assert_(len({(r["tbl"], r["row_no"]) for r in rows}) == len(rows)), assert_(all(10**15 < r["utc_us"] < 2 * 10**15 for r in rows))],
    "simhash_classes": _classes,
    "jaccard_classes": _classes,
    "duplicate_texts": lambda rows: assert_(all(r["kept"] == r["class_id"] and r["n_members"] > 1 for r in rows)),
    "term_embeddings": lambda rows: assert_(all(r["length"] in (0.0, 1.0) and abs(r["first"]) <= 1 for r in rows) and any(r["first"] < 0 for r in rows)),
    "repo_spectrum": _eigenvalues,
    "spectral_alerts": lambda rows: assert_(all(abs(r["low_ratio"] + r["high_ratio"] - 1) < 2e-4 and (r["subtype"] == "right_shift") == (r["high_ratio"] > 0.65) for r in rows)),
    "stream_first_deliveries": lambda rows: assert_({r["source"] for r in rows} == {"slack", "github", "linear", "grafana"} and all(r["n"] > 0 for r in rows)),
    "stream_silence": lambda rows: assert_(len({(r["channel"], r["last_seen"]) for r in rows}) == len(rows)),
    "comm_betweenness": lambda rows: assert_(all(r["score"] >= 0 for r in rows) and any(r["score"] > 0 for r in rows)),
    "worker_peers": _peers,
    "diverse_seeds": lambda rows: assert_(sorted(r["place"] for r in rows) == list(range(1, 13)) and len({r["id"] for r in rows}) == 12),
    "technical_embeddings": lambda rows: assert_(all(r["length"] in (0.0, 1.0) and 0 <= r["pattern_share"] <= 1 for r in rows) and any(r["pattern_share"] > 0 for r in rows)),
    "stream_controllers": lambda rows: assert_(all(-1 <= r["output"] <= 1 and -10 <= r["integral"] <= 10 for r in rows)),
    "stream_stability": lambda rows: assert_({r["status"] for r in rows} <= {-1.0, 0.0, 1.0}),
    "sketches": lambda rows: assert_(all(r["n_authors"] > 0 and 0 <= r["median_second"] < 60 for r in rows)),
    "framing_clusters": lambda rows: assert_(all(r["n"] >= 2 and 0.4 <= r["similarity"] <= 1 and (r["severity"] == "critical") == (r["similarity"] > 0.6 and r["action"] < 0.2) for r in rows)),
    "bloom_overlaps": _bloom,
    "bloom_membership": lambda rows: assert_(all(r["n_own"] == r["n_terms"] <= r["n_claimed"] for r in rows)),
}


def assert_(holds):
    assert holds


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_content_of_queries_without_sql(spark, small, name):
    rows = entry.queries()[name](spark, small).collect()
    assert rows
    CONTENT.get(name, lambda r: None)(rows)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
