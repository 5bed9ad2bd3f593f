import pytest

import __spark_entry__ as entry
from lodestream.llm.queries import QUERIES, SQL
from lodestream.sources.tables import table
from oracle import check, connect


def _ordered_pairs(a, b):
    def holds(spark, small, rows):
        assert len({(r[a], r[b]) for r in rows}) == len(rows) and all(r[a] < r[b] for r in rows)

    return holds


def _people(spark, small, rows):
    _ordered_pairs("record_a", "record_b")(spark, small, rows)
    source = {r["record_id"]: r["source"] for r in table(spark, small, "person_records").select("record_id", "source").collect()}
    assert all(source[r["record_a"]] != source[r["record_b"]] for r in rows)
    assert all(0.5 <= r["confidence"] <= 1 for r in rows if "confidence" in r.asDict())


def _pieces(spark, small, rows):
    most = {}
    for r in rows:
        most.setdefault((r["delivery_no"], r["pii_kind"]), []).append(r["nth"])
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in most.values())
    assert {k for _, k in most} <= {"EMAIL", "PHONE", "ID", "ADDRESS", "NAME"}


def _replaced(spark, small, rows):
    import re

    was = {r["delivery_no"]: r["content"] for r in table(spark, small, "signals").select("delivery_no", "content").collect()}
    assert len(rows) == len(was)
    for r in rows:
        if r["content"] != was[r["delivery_no"]]:
            # what stands between the placeholders is in the text, in order
            at = 0
            for part in re.split(r"<(?:EMAIL|PHONE|ID|ADDRESS|NAME):[^>]*>", r["content"]):
                at = was[r["delivery_no"]].index(part, at) + len(part)


def _mix(spark, small, rows):
    caps = {r["source"]: r["max_repeats"] for r in table(spark, small, "mix_targets").collect()}
    assert all(1 <= r["copy_no"] <= caps[r["source"]] for r in rows) and len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)


def _shares(spark, small, rows):
    able = [r for r in rows if r["n_tokens"]]
    whole = sum(r["target_share"] for r in able)
    assert abs(sum(r["reached_share"] for r in rows) - 1) < 1e-4
    # a hundred documents leave shares a few points apart
    assert all(abs(r["reached_share"] - r["target_share"] / whole) < 0.12 for r in able) and all(r["most_repeats"] <= r["max_repeats"] for r in rows)


def _name_classes(spark, small, rows):
    by = {}
    for r in rows:
        by.setdefault((r["class_id"], r["size"]), []).append(r["entity_id"])
    assert all(k == min(m) and n == len(m) > 1 for (k, n), m in by.items())
    pairs = {(r["entity_a"], r["entity_b"]) for r in QUERIES["p1_found"](spark, small).collect()}
    assert pairs == {(a, b) for m in by.values() for a in m for b in m if a < b}


CONTENT = {
    "p1_classes": _name_classes, "p1_found": _ordered_pairs("entity_a", "entity_b"), "p2_found": _pieces, "p2_replaced": _replaced, "p5_found": _people, "p5_matches": _people, "p9_mix": _mix, "p9_shares": _shares,
    "p8_found": lambda spark, small, rows: _unique(rows, "doc_id", "item_id"), "p8_items": lambda spark, small, rows: _unique([r for r in rows if 0.5 <= r["most"] <= 1 and r["n_docs"] > 0], "item_id", least=len(rows)),
    "p10_found": lambda spark, small, rows: _unique(rows, "doc_id"), "p10_levels": lambda spark, small, rows: _unique([r for r in rows if r["band"] is None or 1 <= r["band"] <= 4 and 1 <= r["difficulty"] <= 4], "doc_id", least=len(rows)),
}


def _unique(rows, *keys, least=1):
    assert len(rows) >= least and len({tuple(r[k] for k in keys) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = entry.queries()[name](spark, small)
    if name in SQL:
        check(df, connect(small), SQL[name])
    else:
        rows = df.collect()
        assert rows
        CONTENT[name](spark, small, rows)
