from datetime import datetime, timezone

import pytest

from lodestream.operators.instants import delivered_instants, instant_dictionary

FEEDS = [("us", "s", "America/New_York", "mdy"), ("de", "s", "Europe/Berlin", "dmy"), ("utc", "s", "UTC", "ymd"), ("in", "s", "Asia/Kolkata", "dmy"), ("np", "s", "Asia/Kathmandu", "dmy"), ("bad", "s", "Nowhere/Land", "dmy"), (None, "s", "UTC", "ymd")]


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("us", "2023-04-01 13:08:13,661", us(2023, 4, 1, 17, 8, 13, micro=661000)),
    ("us", "04/01/2023 07:47", us(2023, 4, 1, 11, 47)),
    ("de", "04/01/2023 07:47:01", us(2023, 1, 4, 6, 47, 1)),
    ("de", "1.4.23, 23:40", us(2023, 4, 1, 21, 40)),
    ("us", "4/12/2023 12:20:19 AM", us(2023, 4, 12, 4, 20, 19)),
    ("de", "01/04/2023 2:40 pm", us(2023, 4, 1, 12, 40)),
    ("utc", "2023/04/01 14:23:33", us(2023, 4, 1, 14, 23, 33)),
    ("utc", "20230401T162218Z", us(2023, 4, 1, 16, 22, 18)),
    ("us", "20230401165420", us(2023, 4, 1, 20, 54, 20)),
    ("us", "1680358346.623", 1680358346623000),
    ("us", "1680355209", 1680355209000000),
    ("us", "1680360569387", 1680360569387000),
    ("us", "1680369545414200", 1680369545414200),
    ("us", "Wed Sep 13 08:52:48 EDT 2023", us(2023, 9, 13, 12, 52, 48)),
    ("us", "Sun Nov  5 01:30:00 EST 2023", us(2023, 11, 5, 6, 30)),
    ("us", "Sun Nov  5 01:30:00 EDT 2023", us(2023, 11, 5, 5, 30)),
    ("us", "2023-11-05 01:30:00", us(2023, 11, 5, 5, 30)),
    ("de", "2023-03-26 02:30:00", us(2023, 3, 26, 1, 30)),
    ("in", "16 Apr 2023 20:31:29 IST", us(2023, 4, 16, 15, 1, 29)),
    ("np", "Sat, 01 Apr 2023 02:54:09 +0545", us(2023, 3, 31, 21, 9, 9)),
    ("in", "2024-03-15T18:20:35+05:30[Asia/Kolkata]", us(2024, 3, 15, 12, 50, 35)),
    ("us", "2023-04-13T12:17:24+00:00[UTC]", us(2023, 4, 13, 12, 17, 24)),
    ("us", "01-Apr-2023 06:52:04", us(2023, 4, 1, 10, 52, 4)),
    (None, "2023-04-01 07:16:07.426500+02:00", us(2023, 4, 1, 5, 16, 7, micro=426500)),
    ("bad", "2023-04-01T10:00:00+0200", us(2023, 4, 1, 8)),
]
NOTHING = [("us", "0000-00-00 00:00:00"), ("us", "pending"), ("us", ""), ("us", None), ("us", "2023-02-30 10:00"), ("us", "13/13/2023 10:00"), ("us", "2023-04-01 10:00:00 XYZ"), ("bad", "2023-04-01 10:00:00"), ("nofeed", "2023-04-01 10:00:00"), ("us", "x" * 200_000), ("us", "2023-04-01T25:00:00")]
CANONICAL = [("us", "2023-04-01T10:00:00Z"), ("us", "2023-04-01T10:00:00.5+00:00")]


def tables(spark, rows):
    signals = spark.createDataFrame([(k, f, t, "x") for k, (f, t) in enumerate(rows)], "delivery_no long, feed string, timestamp string, utc_us string")
    budget = spark.createDataFrame([], "entry_no long, feed string, timestamp string")
    return signals, budget, spark.createDataFrame(FEEDS, "feed string, source string, zone string, date_order string")


def test_every_writing(spark):
    rows = [c[:2] for c in CASES] + NOTHING + CANONICAL
    got = {r["row_no"]: r["utc_us"] for r in delivered_instants(*tables(spark, rows)).collect()}
    for k, (feed, text, want) in enumerate(CASES):
        assert got.pop(k, None) == want, (feed, text)
    assert got == {}


def test_repeats_and_both_tables(spark):
    signals, _, feeds = tables(spark, [("us", "04/01/2023 07:47")] * 3)
    budget = spark.createDataFrame([(0, "us", "04/01/2023 07:47"), (1, None, None)], "entry_no long, feed string, timestamp string")
    assert delivered_instants(signals, budget, feeds).count() == 4
    assert delivered_instants(signals.where("false"), budget.where("false"), feeds.where("false")).count() == 0


def test_dictionary_grows(spark):
    _, _, feeds = tables(spark, [])
    first = instant_dictionary(spark.createDataFrame([("us", "04/01/2023 07:47"), (None, "1680355209")], "feed string, text string"), feeds)
    marked = first.withColumn("utc_us", first["utc_us"] * 0 + 1)
    second = instant_dictionary(spark.createDataFrame([("us", "04/01/2023 07:47"), (None, "1680355209"), ("us", "1680355209")], "feed string, text string"), feeds, known=marked)
    assert {(r["feed"], r["text"]): r["utc_us"] for r in second.collect()} == {("us", "04/01/2023 07:47"): 1, (None, "1680355209"): 1, ("us", "1680355209"): 1680355209000000}


@pytest.mark.parametrize("text", ["2023-04-01", "Apr 1, 2023 10:00 AM"])
def test_other_common_writings(spark, text):
    assert delivered_instants(*tables(spark, [("utc", text)])).count() == 1


def test_a_kept_dictionary_parses_each_value_once(spark, tmp_path):
    from lodestream.operators.instants import extend_dictionary

    feeds = spark.createDataFrame([("f", "x", "UTC", "ymd")], "feed string, source string, zone string, date_order string")
    rows = lambda *texts: spark.createDataFrame([("f", t) for t in texts], "feed string, text string")
    path = f"{tmp_path}/words"
    one = extend_dictionary(path, rows("2024-01-02 03:04:05", "nonsense", "2024-01-02 03:04:05"), feeds)
    assert one.count() == 2
    before = {f.name for f in (tmp_path / "words").iterdir()}
    two = extend_dictionary(path, rows("nonsense", "2024-01-02 03:04:06", None), feeds)
    assert two.count() == 3 and two.where("utc_us IS NOT NULL").count() == 2
    assert before <= {f.name for f in (tmp_path / "words").iterdir()}
