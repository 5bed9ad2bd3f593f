from datetime import datetime, timedelta, timezone

import pytest

from lodestream.functions import rules
from lodestream.sources import backfill as B, identity as I
from pyspark.sql import functions as F

NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)


def test_since_policies():
    assert B.Since.parse(None).cutoff(NOW) == NOW and B.Since.parse(None).cutoff(None) is None
    assert B.Since.parse("ALL").cutoff(NOW) is None
    assert B.Since.parse("2024-01-02T03:00:00+02:00").cutoff(NOW) == datetime(2024, 1, 2, 1, tzinfo=timezone.utc)
    assert B.Since.parse("2024-01-02").cutoff(None) == datetime(2024, 1, 2, tzinfo=timezone.utc)
    for bad in ("", "yesterday"):
        with pytest.raises(ValueError):
            B.Since.parse(bad)


def test_backfill_start():
    day = timedelta(days=1)
    assert B.backfill_start(NOW) == (NOW - 7 * day, True)
    assert B.backfill_start(NOW, last_run=NOW - 2 * day) == (NOW - 2 * day, False)
    assert B.backfill_start(NOW, days=90) == (NOW - 90 * day, False)
    assert B.backfill_start(NOW, days=90, checkpoint=NOW - 3 * day) == (NOW - 3 * day, False)
    assert B.backfill_start(NOW, days=1, checkpoint=NOW - 3 * day) == (NOW - day, False)
    assert B.backfill_start(NOW, checkpoint=NOW - 30 * day, last_run=NOW) == (NOW - 7 * day, True)


def test_back_scan_windows_join_and_grow():
    w = B.back_scan(NOW, 100.0, 300.0, 1000.0)
    assert w[0][1] == NOW and all(a[0] == b[1] for a, b in zip(w, w[1:]))
    assert [(e - s).total_seconds() for s, e in w] == [100, 150, 225, 300]
    assert [(e - s).total_seconds() for s, e in B.back_scan(NOW, 100.0, 1000.0, 500.0, fullness=1.0)] == [100, 300]


def test_since_filter_reaches_the_scan(spark, small, capsys):
    df = B.since_filter(spark.read.parquet(f"{small}/signals.parquet"), "received_at", NOW)
    df.explain()
    assert "GreaterThanOrEqual(received_at" in capsys.readouterr().out


def test_private_channels_and_names(spark):
    s = spark.createDataFrame([("#Secret", "U1"), ("priv-x", "U2"), ("open", "U3"), (None, None)], "channel string, author string")
    c = spark.createDataFrame([("secret", "C1", True, 3), ("priv-x", "C2", False, 9)], "channel string, id string, is_private boolean, n_members long")
    got = {r["channel"]: r["is_private"] for r in I.private_channels(s, c).collect()}
    assert got == {"#Secret": True, "priv-x": False, "open": False, None: False}
    u = spark.createDataFrame([("U1", "ann"), ("U1", "ann"), ("", "x")], "slack_user_id string, slack_handle string")
    assert sorted(str(r["author"]) for r in I.with_user_names(s, u).collect()) == ["None", "U2", "U3", "ann"]


def test_keywords_and_configured_constraints(spark):
    assert rules.keywords(r"(?:password|passwd)\s*[=:]\s*\S+") == ["password", "passwd"] and rules.keywords(r"\b\d{3}-\d{2}\b") == []
    c = rules.Constraints({"kill_patterns": [{"pattern": r"pass(?:word)?\s*=", "category": "a"}], "redact_patterns": [{"pattern": r"\d{4}", "category": "b", "replacement": "$N"}]})
    rows = spark.createDataFrame([(1, "PASSWORD = x"), (2, "pin 1234"), (3, "fine"), (4, None)], "k int, t string")
    got = {r["k"]: (r["a"], r["r"]) for r in rows.select("k", c.action(F.col("t")).alias("a"), c.redacted(F.col("t")).alias("r")).collect()}
    assert got == {1: ("kill", "PASSWORD = x"), 2: ("redact", "pin $N"), 3: ("pass", "fine"), 4: ("pass", None)}
    empty = rules.Constraints()
    assert {r["a"] for r in rows.select(empty.action(F.col("t")).alias("a")).collect()} == {"pass"}
    with pytest.raises(Exception):
        rules.Constraints({"kill_patterns": [{"pattern": "(", "category": "a"}]})
