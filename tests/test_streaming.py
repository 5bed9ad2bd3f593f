"""Streams over several files, a micro-batch each, with rows out of order and late."""

import datetime as dt

import pytest

from lodestream.streaming import flows as S
from pyspark.sql import functions as F


def _files(spark, path, batches, schema):
    """One file a batch, in order of name and time, and the stream that reads one a trigger."""
    import os
    import time

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/w{k}")
        name = next(n for n in os.listdir(f"{path}/w{k}") if n.endswith(".parquet"))
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(f"{path}/w{k}/{name}", f"{path}/in/part-{k}.parquet")
        os.utime(f"{path}/in/part-{k}.parquet", (time.time() - 100 + k,) * 2)
    return S.stream_table(spark, f"{path}/in", spark.read.parquet(f"{path}/in").schema, files_per_trigger=1)


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_late_rows_are_dropped_and_open_windows_grow(spark, tmp_path):
    batches = [[("a", at(1)), ("a", at(1, 5)), ("b", at(2))], [("a", at(9)), ("a", at(1, 7))], [("a", at(9, 3)), ("b", at(8))], [("a", at(20)), ("a", at(1, 8))]]
    stream = _files(spark, tmp_path, batches, "k string, ts timestamp")
    out = S.run_available(S.windowed_counts(stream, "ts", ["k"], "1 day", "2 days"), "late", "update")
    got = {(r["k"], r["day"]): r["n"] for r in out.groupBy("k", F.day("window.start").alias("day")).agg(F.max_by("n", "batch_no").alias("n")).collect()}
    # late rows are judged by the watermark of the batch before: the last file comes when it stands at the seventh
    assert got == {("a", 1): 3, ("b", 2): 1, ("a", 9): 2, ("b", 8): 1, ("a", 20): 1}


def test_average_is_carried_from_batch_to_batch(spark, tmp_path):
    values = [0.5, 0.1, 0.9, 0.4, 0.7, 0.2]
    batches = [[("a", at(1), values[0]), ("a", at(2), values[1])], [("a", at(4), values[3]), ("a", at(3), values[2]), ("b", at(1), 1.0)], [("a", at(5), values[4]), ("a", at(6), values[5]), ("a", at(7), None)]]
    out = S.run_available(S.ema_stream(_files(spark, tmp_path, batches, "k string, ts timestamp, v double"), "k", "ts", "v"), "ema", "update")
    e = values[0]
    for v in values[1:]:
        e = 0.3 * v + 0.7 * e
    last = {r["k"]: r for r in out.groupBy("k").agg(F.max_by("ema", "batch_no").alias("ema"), F.max_by("n", "batch_no").alias("n")).collect()}
    assert last["a"]["ema"] == pytest.approx(e) and last["a"]["n"] == 6 and last["b"]["ema"] == 1.0


def test_silence_is_reported_once_by_the_timer(spark, tmp_path):
    batches = [[("a", at(1)), ("b", at(1))], [("b", at(5))], [("b", at(9))], [("b", at(10))]]
    out = S.run_available(S.silence_stream(_files(spark, tmp_path, batches, "k string, ts timestamp"), "k", "ts", "1 hour", 72), "quiet")
    got = [(r["k"], r["n"]) for r in out.collect()]
    assert ("a", 1) in got and got.count(("a", 1)) == 1


def test_repeats_in_later_batches_are_dropped(spark, tmp_path):
    meta = '{"ts": "1.5"}'
    rows = lambda *nos: [(n, "x", "slack", "#General" if n % 2 else "general", "u", meta if n < 4 else f'{{"ts": "{n}"}}', at(1 + n % 3)) for n in nos]
    stream = _files(spark, tmp_path, [rows(1, 5), rows(2, 6), rows(3, 5)], "delivery_no long, content string, source string, channel string, author string, metadata string, received_at timestamp")
    out = S.run_available(S.first_deliveries_stream(stream, "30 days").select("delivery_no", "message"), "dedup")
    assert out.count() == 3 and {r["delivery_no"] for r in out.collect()} == {1, 5, 6}


@pytest.mark.parametrize("name", ["pid", "temperature", "change_rate", "feedback_rate", "stability"])
def test_recurrences_are_folded_in_order_over_batches(spark, tmp_path, name):
    from lodestream.streaming import recurrences as R

    start, step = getattr(R, name)()
    names = [f"s{k}" for k in range(len(start))]
    values = [0.5, 1.9, -0.3, 1.22, 1.24, 1.16, 0.9, 0.77, 0.76, 3.0, 0.0, 1.0]
    batches = [[("a", at(1 + k), v) for k, v in enumerate(values[:5])][::-1], [("a", at(1 + k), v) for k, v in enumerate(values) if 5 <= k < 9] + [("b", at(1), 2.0), (None, at(1), 1.0), ("a", at(20), None)], [("a", at(1 + k), v) for k, v in enumerate(values) if k >= 9]]
    out = S.run_available(R.fold_stream(_files(spark, tmp_path, batches, "k string, ts timestamp, v double"), "k", ["ts"], "v", names, start, step), "fold", "update")
    state = start
    for v in values:
        state = step(state, v)
    last = out.where("k = 'a'").orderBy(F.desc("batch_no")).first()
    assert [last[c] for c in names] == pytest.approx(list(state)) and last["n"] == len(values)


def test_controller_and_hysteresis_by_hand():
    from lodestream.streaming import recurrences as R

    start, step = R.pid()
    one = step(start, 0.2)
    assert one == pytest.approx((0.5, 0.5, 0.3 * 0.5 + 0.05 * 0.5))  # no derivative at first
    assert step(one, 0.7) == pytest.approx((0.5, 0.0, 0.05 * 0.5 + 0.1 * -0.5))
    start, step = R.stability(alpha=1.0)
    seen, state = [], start
    for v in (1.0, 1.24, 1.26, 1.17, 1.14, 0.76, 0.74, 0.84, 0.86):
        state = step(state, v)
        seen.append(state[1])
    assert seen == [0, 0, 1, 1, 0, 0, -1, -1, 0]
