import json

from lodestream.sources import events as E, ownership as O, sinks


def test_psc_lines(spark, tmp_path):
    rows = [
        {"company_number": "1", "data": {"kind": "individual-person-with-significant-control", "name": "Mr A B", "name_elements": {"forename": "A", "surname": "B"}, "natures_of_control": ["ownership-of-shares-25"], "date_of_birth": {"month": 3, "year": 1970}, "nationality": "British"}},
        {"company_number": "2", "data": {"kind": "corporate-entity-person-with-significant-control", "name": "X Ltd", "natures_of_control": ["significant-influence"]}},
        {"company_number": "3", "data": {"kind": "super-secure-person-with-significant-control"}},
        {"company_number": "4", "data": {"kind": "individual-beneficial-owner", "name": "C", "ceased_on": "2020-01-01"}},
        {"company_number": "5", "data": {"kind": "unheard-of"}},
        {"data": {}},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n\n")
    nodes, edges = O.read_psc(spark, str(tmp_path / "a.json"))
    assert {(r["target_id"], r["edge_type"]) for r in edges.collect()} == {("1", "ownership"), ("2", "control")}
    assert {(r["name"], r["entity_type"]) for r in nodes.collect()} == {("1", "company"), ("2", "company"), ("A B", "person"), ("X Ltd", "foreign_entity")}


def test_roster(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# people\nAlice Smith, Alice <Alice@x.example>, @Alice Smith, alice-gh\nBob, bob@x.example, , \n")
    (tmp_path / "a.csv").write_text("# aliases\nalice@x.example, 1+alice-gh@users.noreply.codehub.example\n")
    got = {r["name"]: r for r in O.read_roster(spark, str(tmp_path / "r.csv"), str(tmp_path / "a.csv")).collect()}
    assert got["Alice Smith"]["email"] == "alice@x.example" and got["Alice Smith"]["aliases"] == ["1+alice-gh@users.noreply.codehub.example"] and got["Bob"]["aliases"] == []


def test_roster_of_many_lines_is_read_by_lines(spark, tmp_path):
    from lodestream.sources import work_items as W

    uuid = lambda k: f"{k:08x}-0000-4000-8000-000000000000"
    lines = ["| above | `" + uuid(0) + "` |", "# one", "", "| name | id |", "|---|---|"] + [f"| n {k} | `{uuid(k)}` |" for k in range(1, 30_001)] + ["##  two  words ", f"| x | {uuid(30_001)} |", "#none", "| no | id |"]
    (tmp_path / "a.md").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.md").write_text(f"# empty\n## three\r\n| y | `{uuid(7)}` |")
    conf = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "0"}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = W.roster_markdown(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 1
        rows = sorted(map(tuple, got.collect()))
    finally:
        for k in conf:
            spark.conf.unset(k)
    want = [("", "above", uuid(0)), *(("one", f"n {k}", uuid(k)) for k in range(1, 30_001)), ("two  words", "x", uuid(30_001)), ("three", "y", uuid(7))]
    assert rows == sorted(want)


def test_pull_requests_and_chat(spark, tmp_path):
    pr = {"number": 1, "title": "T", "body": "B", "state": "OPEN", "author": {"login": "a"}, "updatedAt": "2024-01-01T00:00:00Z", "additions": 3, "deletions": 1, "files": [{"path": "x"}], "comments": [{"id": "c", "author": {"login": "renovate[bot]"}, "body": "hi"}, {"id": "d", "author": {"login": "b"}, "body": "ok"}], "reviews": [{"id": "r", "author": {"login": "c"}, "body": None, "state": "APPROVED"}]}
    (tmp_path / "p.json").write_text(json.dumps(pr) + "\n" + json.dumps(pr) + "\n")
    got = {r["id"]: r for r in E.pull_requests(spark, str(tmp_path / "p.json"), "o/r").collect()}
    assert set(got) == {"o/r:pull_request:1:OPEN", "o/r:pr_comment:1:d", "o/r:pr_review:1:r"}
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, [{"channel": "c", "user": "u", "text": "q", "ts": "1.5"}, {"channel": "c", "user": "v", "text": "a", "ts": "2.5", "thread_ts": "1.5"}, {"channel": "c", "ts": "3.5", "subtype": "channel_join"}])))
    chat = {r["id"]: json.loads(r["metadata"]) for r in E.chat_messages(spark, str(tmp_path / "m.json")).collect()}
    assert set(chat) == {"c:1.5", "c:2.5"} and chat["c:2.5"]["thread_author"] == "u"


def test_signal_lines(spark, tmp_path):
    spark.dataSource.register(E.SignalLines)
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "1", "timestamp": "2024-01-01", "metadata": {"a": 1}}) + "\nbroken\n" + json.dumps({"id": "2", "timestamp": "2024-02-01"}))
    assert [r["id"] for r in spark.read.format("signal_lines").option("since", "2024-01-15").load(str(tmp_path)).collect()] == ["2"]
    assert spark.read.format("signal_lines").load(str(tmp_path)).count() == 2


def test_snapshot_and_log(spark, tmp_path):
    a = spark.createDataFrame([("x", 1, "old"), ("y", 1, "y")], "k string, t int, v string")
    b = spark.createDataFrame([("x", 2, "new"), ("z", 1, "z"), ("y", 0, "late")], "k string, t int, v string")
    sinks.upsert_snapshot(a, f"{tmp_path}/s", "k", "t")
    assert sorted(map(tuple, sinks.upsert_snapshot(b, f"{tmp_path}/s", "k", "t").collect())) == [("x", 2, "new"), ("y", 1, "y"), ("z", 1, "z")]
    sinks.append_rows(a, f"{tmp_path}/l", "r1", ["k"])
    sinks.append_rows(b, f"{tmp_path}/l", "r2", ["k"])
    assert {r["run_id"]: r["n"] for r in sinks.runs(spark, f"{tmp_path}/l", "t").collect()} == {"r1": 2, "r2": 1}
