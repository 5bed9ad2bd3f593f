import random
from collections import Counter

import pytest

from lodestream.operators import windows as W
from lodestream.plans import sequence_queries as Q
from pyspark.sql import functions as F


def _runs(steps):
    return Counter(">".join(steps[i : i + n]) for n in (1, 2, 3) for i in range(len(steps) - n + 1))


def _steps(rows):
    steps = {}
    for user, _, _, kind in sorted(rows):
        steps.setdefault(user, []).append(kind)
    return steps


@pytest.mark.parametrize("least", [50, 10_000])
def test_step_runs_read_every_step(spark, least):
    rnd = random.Random(4)
    rows = [(u, rnd.randrange(150), k, rnd.choice("abc")) for k, u in enumerate([1] * 400 + [2] * 60 + [3] * 2 + [4])]
    got = {(r["u"], r["gram"]): r["n"] for r in W.step_runs(spark.createDataFrame(rows, "u int, t int, id int, kind string"), "u", ["t", "id"], "kind", least).collect()}
    assert got == {(u, g): n for u, s in _steps(rows).items() for g, n in _runs(s).items()}


def test_step_ngrams_count_all_events(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/events.parquet").where("user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL").select("user_id", "ts", "event_id", "event_type").collect()]
    want = sum((_runs(s) for s in _steps(rows).values()), Counter())
    assert {r["gram"]: r["n"] for r in Q.step_ngrams(spark, small).collect()} == dict(want)


def test_next_elsewhere_looks_past_the_same_source(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(k, rnd.choice(["@Ann", "ann", "bob", None]), rnd.choice(["chat", "mail", "code", None]), rnd.randrange(200_000)) for k in range(400)]
    spark.createDataFrame(rows, "delivery_no long, author string, source string, t long").select("delivery_no", "author", "source", F.timestamp_seconds("t").alias("received_at")).write.parquet(f"{tmp_path}/signals.parquet")
    by = {}
    for k, author, source, t in rows:
        if author and source:
            by.setdefault(author.lstrip("@").lower(), []).append((t, k, source))
    want = {}
    for seq in map(sorted, by.values()):
        for i, (t, _, source) in enumerate(seq):
            later = next((x for x in seq[i + 1 :] if x[2] != source), None)
            if later and later[0] - t <= 3600:
                want.setdefault((source, later[2]), []).append((later[0] - t) * 1_000_000)
    assert {(r["source"], r["next_source"]): (r["n"], r["least_us"]) for r in Q.next_elsewhere(spark, str(tmp_path)).collect()} == {p: (len(g), min(g)) for p, g in want.items()}


def test_best_per_text_reads_the_whole_text(spark, tmp_path):
    opening = "one opening line " * 10
    texts = [opening + "a", opening + "b", opening.upper() + "  A ", opening + "a", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r["doc_id"], r["n"], r["n_chars"]) for r in Q.best_per_text(spark, str(tmp_path)).collect()} == {(2, 3, len(texts[2])), (1, 1, len(texts[1])), (4, 1, 0)}
