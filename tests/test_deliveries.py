import json

from lodestream.operators.deliveries import first_deliveries, surplus_deliveries

SCHEMA = "delivery_no long, source string, channel string, metadata string, timestamp string, __o string, key string"


def rows(spark, *data):
    return spark.createDataFrame([(*d, None, "x", "y") for d in data], SCHEMA)


def surplus(df):
    return sorted(r[0] for r in surplus_deliveries(df).collect())


def test_values_agree_by_meaning(spark):
    df = rows(
        spark,
        (1, "slack", "#Ops", json.dumps({"ts": "1701518213.339400"})),
        (2, "slack", "ops ", '{"ts": 1701518213.3394, "retry_num": 1}'),
        (3, "slack", "ops", json.dumps({"ts": "1701518213.339400", "edited_ts": "1701518300.1"})),
        (4, "grafana", "a", json.dumps({"fingerprint": "F", "starts_at": "2024-01-01T00:00:00Z", "state": "firing"})),
        (5, "grafana", "A", json.dumps({"state": "Firing", "fingerprint": "f", "starts_at": "2024-01-01T01:00:00.000000+01:00"})),
        (6, "github", "r", json.dumps({"event_type": "pull_request", "pr_number": 7, "state": "OPEN"})),
        (7, "github", "r", json.dumps({"event_type": "pull_request", "pr_number": "7", "state": "OPEN"})),
        (8, "github", "r", json.dumps({"event_type": "pull_request", "pr_number": 7, "state": "MERGED"})),
    )
    assert surplus(df) == [2, 5, 7]


def test_keyless_rows_are_messages_of_their_own(spark):
    df = rows(spark, (1, "slack", "a", None), (2, "slack", "a", None), (3, "slack", "a", '{"ts": "1.0"'), (4, "slack", "a", '{"ts": "1.0"'), (5, "slack", None, "{}"), (6, None, None, '{"ts": "1"}'), (7, "slack", "a", ""), (None, "slack", "a", '{"ts": "1"}'))
    assert surplus(df) == []
    assert first_deliveries(df).count() == 8


def test_null_channels_and_long_values(spark):
    long = json.dumps({"ts": "5", "text": "x" * 500_000})
    df = rows(spark, (9, "slack", None, long), (3, "slack", None, '{"ts":5.0}'), (4, "slack", "", '{"ts":"5"}'))
    assert surplus(df) == [9]


def test_repeated_rows_and_empty_table(spark):
    df = rows(spark, (1, "slack", "a", '{"ts":"1"}'), (1, "slack", "a", '{"ts":"1"}'), (2, "slack", "a", '{"ts":"1"}'), (2, "slack", "a", '{"ts":"1"}'))
    assert surplus(df) == [2]
    kept = first_deliveries(df)
    assert kept.count() == 2 and set(kept.columns) == set(df.columns)
    assert surplus(df.where("false")) == []


def test_a_message_of_a_third_of_all_rows(spark):
    df = spark.range(30_000).selectExpr("id AS delivery_no", "'slack' AS source", "'c' AS channel", "concat('{\"ts\":\"', if(id % 3 = 0, 1, id), '\"}') AS metadata")
    assert len(surplus(df)) == 10_000  # 10,000 copies of ts 1 and the row that has it by its own number, less one kept


def test_equal_identifiers_of_different_keys_stay_apart(spark):
    from pyspark.sql import functions as F

    from lodestream.operators.deliveries import quotient_dedup

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (None, "a")], "no long, k string")
    same = lambda key: (F.lit(7).cast("long"), F.lit(9).cast("long"))
    assert [r["no"] for r in quotient_dedup(rows, F.col("k"), "no", words=same).collect()] == [3]


def test_shards_go_by_quotient_and_hot_messages_are_combined(spark, capsys):
    from pyspark.sql import functions as F

    from lodestream.operators.deliveries import quotient_dedup

    rows = spark.range(60_000).select(F.col("id").alias("no"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    found = quotient_dedup(rows, F.col("k"), "no")
    assert found.count() == 19_999 and found.where("no % 3 <> 0 OR no = 0").count() == 0
    found.explain()
    assert "hashpartitioning(__q" in capsys.readouterr().out
