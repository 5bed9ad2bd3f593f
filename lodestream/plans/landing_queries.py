"""Queries that land the tables in each producer's format, read them back through the readers, and keep state in stores; with SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import rules, text as X, vectors as V
from lodestream.plans.activity_queries import _SQL_CHANNEL, _channel
from lodestream.plans.graph_queries import _CONTACTS, contacts
from lodestream.plans.text_queries import _list, _meta, _sql_meta
from lodestream.scratch import scratch_path
from lodestream.sources import backfill as B, events as E, identity as I, stores, work_items as W
from lodestream.sources.tables import table
from lodestream.streaming import flows

_R = lambda c, n=6: F.round(c, n)
_iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _counted(signals: DataFrame) -> DataFrame:
    """Signals read back: how many of each event type, with how many authors and how much text."""
    event = F.coalesce(F.get_json_object("metadata", "$.event_type"), F.lit("ticket"))
    return signals.groupBy(event.alias("event")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("author").alias("n_authors"), F.sum(F.length("content")).alias("n_chars"))


def source_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue comments landed under their issues."""
    path = scratch_path(spark, "issues")
    s = table(spark, sf_dir, "signals").where("source = 'github' AND content IS NOT NULL AND received_at IS NOT NULL").select("content", "author", "received_at", _meta("issue_number").try_cast("bigint").alias("number")).where("number IS NOT NULL")
    g = s.groupBy("number").agg(F.min("received_at").alias("at"), F.collect_list(F.struct(F.struct(F.col("author").alias("login")).alias("author"), F.col("content").alias("body"), _iso("received_at").alias("createdAt"))).alias("comments"))
    g.select("number", F.concat(F.lit("issue "), "number").alias("title"), F.lit("OPEN").alias("state"), F.struct(F.lit("owner").alias("login")).alias("author"), _iso("at").alias("createdAt"), "comments").write.json(path)
    return _counted(W.issues(spark, path, "repo")).select("event", "n")


_BOTS = _list(E.BOTS)
SQL = {
    "source_issues": f"WITH s AS (SELECT content, author, received_at, try_cast({_sql_meta('issue_number')} AS BIGINT) AS number FROM signals WHERE source = 'github' AND content IS NOT NULL AND received_at IS NOT NULL), c AS (SELECT DISTINCT number, received_at FROM s WHERE number IS NOT NULL AND trim(content, ' ') <> '' AND NOT coalesce(list_contains({_BOTS}, lower(author)) OR ends_with(lower(author), '[bot]'), false)) SELECT 'issue' AS event, count(DISTINCT number) AS n FROM s WHERE number IS NOT NULL UNION ALL SELECT 'issue_comment', count(*) FROM c"
}


def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    s = table(spark, sf_dir, "signals").where("source = 'github' AND received_at IS NOT NULL").where(_meta("event_type") == "check_run")
    s.select(_meta("run_name").alias("name"), _meta("conclusion").alias("conclusion"), _iso("received_at").alias("createdAt"), _meta("branch").alias("headBranch")).write.json(path)
    return W.failed_runs(spark, path, "repo").groupBy(F.get_json_object("metadata", "$.conclusion").alias("conclusion")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("content").alias("n_texts"))


SQL["source_checks"] = f"WITH s AS (SELECT coalesce({_sql_meta('run_name')}, 'unknown') AS name, {_sql_meta('conclusion')} AS conclusion, received_at, coalesce({_sql_meta('branch')}, 'unknown') AS branch FROM signals WHERE source = 'github' AND received_at IS NOT NULL AND {_sql_meta('event_type')} = 'check_run'), d AS (SELECT * FROM s WHERE conclusion IN ('failure', 'timed_out', 'cancelled') QUALIFY row_number() OVER (PARTITION BY name, received_at ORDER BY conclusion) = 1) SELECT conclusion, count(*) AS n, count(DISTINCT (conclusion, name, branch)) AS n_texts FROM d GROUP BY conclusion"


def source_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets landed with their comments, read back."""
    path = scratch_path(spark, "tickets")
    s = table(spark, sf_dir, "signals").where("source = 'linear' AND content IS NOT NULL AND received_at IS NOT NULL").select("delivery_no", "content", "author", "received_at", _meta("identifier").alias("identifier"), _meta("event_type").alias("event"), _meta("title").alias("title")).where("identifier IS NOT NULL")
    note = F.when(F.col("event") == "linear_comment", F.struct(F.col("delivery_no").cast("string").alias("id"), F.col("content").alias("body"), F.struct(F.coalesce("author", F.lit("")).alias("displayName")).alias("user"), _iso("received_at").alias("createdAt")))
    g = s.groupBy("identifier").agg(F.max("title").alias("title"), F.max("received_at").alias("at"), F.collect_list(note).alias("nodes"))
    g.select("identifier", "title", _iso("at").alias("updatedAt"), F.struct("nodes").alias("comments")).write.json(path)
    return _counted(W.tickets(spark, path, "team")).select("event", "n")


SQL["source_tickets"] = f"WITH s AS (SELECT content, {_sql_meta('identifier')} AS identifier, {_sql_meta('event_type')} AS event FROM signals WHERE source = 'linear' AND content IS NOT NULL AND received_at IS NOT NULL) SELECT 'ticket' AS event, count(DISTINCT identifier) AS n FROM s WHERE identifier IS NOT NULL UNION ALL SELECT 'linear_comment', count(*) FROM s WHERE identifier IS NOT NULL AND event = 'linear_comment' AND trim(content, ' ') <> ''"


def source_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts landed with labels, read back once a fingerprint."""
    path = scratch_path(spark, "alerts")
    s = table(spark, sf_dir, "signals").where("source = 'grafana'").select(_meta("fingerprint").alias("fingerprint"), _meta("alert_name").alias("name"), _meta("severity").alias("severity"), _meta("state").alias("state"), _meta("starts_at").alias("startsAt")).where("fingerprint IS NOT NULL")
    s.select("fingerprint", F.create_map(F.lit("alertname"), F.coalesce("name", F.lit("Unknown")), F.lit("severity"), F.coalesce("severity", F.lit("warning"))).alias("labels"), F.struct("state").alias("status"), "startsAt").write.json(path)
    a = W.alerts(spark, path)
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("content").contains(" on unknown — ")).alias("n_texts"))


SQL["source_alerts"] = f"SELECT count(DISTINCT {_sql_meta('fingerprint')}) AS n, count(DISTINCT {_sql_meta('fingerprint')}) AS n_ids, count(DISTINCT {_sql_meta('fingerprint')}) AS n_texts FROM signals WHERE source = 'grafana'"


def source_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events landed as dashboard annotations: one without text is named by its tags."""
    path = scratch_path(spark, "annotations")
    e = table(spark, sf_dir, "events").where("event_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL")
    e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("text"), F.array("event_type", F.lit("x")).alias("tags"), F.col("event_type").alias("dashboardUID"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time")).write.json(path)
    return W.annotations(spark, path).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("content").startswith("Annotation on")).alias("n_untitled"), F.max(F.unix_millis("timestamp")).alias("last_ms"))


SQL["source_annotations"] = "SELECT 'annotations/' || event_type AS channel, count(*) AS n, count(*) FILTER (WHERE event_id % 2 <> 0) AS n_untitled, max(epoch_us(ts) // 1000) AS last_ms FROM (SELECT DISTINCT ON (event_id) * FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL) GROUP BY 1"


def source_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as traces, their lines as spans: returned lines are errors, the price is the duration."""
    path = scratch_path(spark, "traces")
    li = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL")
    attribute = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue")).alias("value"))
    span = F.struct(F.array(attribute("service.name", F.concat(F.lit("svc"), (F.col("l_suppkey") % 5).cast("string"))), attribute("status", F.when(F.col("l_returnflag") == "R", "error").otherwise("ok"))).alias("attributes"))
    t = li.groupBy("l_orderkey").agg(F.collect_list(span).alias("spans")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), "l_orderkey")
    t.select(F.col("l_orderkey").cast("string").alias("traceID"), F.lit("shop").alias("rootServiceName"), F.lit("order").alias("rootTraceName"), F.floor(F.col("o_totalprice") / 100).cast("long").alias("durationMs"), F.array(F.struct("spans")).alias("spanSets")).write.json(path)
    m = W.traces(spark, path).select(F.get_json_object("metadata", "$.status").alias("status"), F.get_json_object("metadata", "$.n_spans").cast("long").alias("spans"), F.size(F.from_json(F.get_json_object("metadata", "$.services"), "array<string>")).alias("services"))
    return m.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("spans").alias("n_spans"), F.sum("services").alias("n_services"))


SQL["source_traces"] = "WITH t AS (SELECT l_orderkey, count(*) AS spans, bool_or(l_returnflag = 'R') AS err, count(DISTINCT l_suppkey % 5) + 1 AS services FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1) SELECT CASE WHEN err THEN 'error' WHEN floor(o_totalprice / 100) > 1500 THEN 'slow' ELSE 'ok' END AS status, count(*) AS n, sum(spans)::BIGINT AS n_spans, sum(services)::BIGINT AS n_services FROM t JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"


def source_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction graph landed as three CSV files, read and joined: degrees per class."""
    path = scratch_path(spark, "transactions")
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    write = lambda df, name: df.write.option("header", True).csv(f"{path}/{name}.csv")
    write(e.select(F.col("vec_id").alias("txId"), (F.col("vec_id") % 49).alias("Time step"), F.element_at("embedding", 1).alias("Local_feature_1")), "txs_features")
    write(e.select(F.col("vec_id").alias("txId"), (F.col("label") % 3 + 1).alias("class")), "txs_classes")
    write(e.select(F.col("vec_id").alias("txId1"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") * 2)).alias("txId2")), "txs_edgelist")
    features, classes, edges = W.transactions(spark, path)
    known = features.select("txId")
    edges = edges.join(known.withColumnRenamed("txId", "txId1"), "txId1", "left_semi").join(known.withColumnRenamed("txId", "txId2"), "txId2", "left_semi")
    out = edges.groupBy(F.col("txId1").alias("txId")).agg(F.count(F.lit(1)).alias("o"))
    into = edges.groupBy(F.col("txId2").alias("txId")).agg(F.count(F.lit(1)).alias("i"))
    d = features.select("txId").join(classes, "txId").join(out, "txId", "left").join(into, "txId", "left")
    return d.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("o", F.lit(0))).alias("out_degree"), F.sum(F.coalesce("i", F.lit(0))).alias("in_degree"))


SQL["source_transactions"] = "WITH v AS (SELECT vec_id, label % 3 + 1 AS class FROM embeddings WHERE label IS NOT NULL), e AS (SELECT vec_id AS a, vec_id + 1 AS b FROM v UNION ALL SELECT vec_id, vec_id * 2 FROM v), k AS (SELECT * FROM e WHERE b IN (SELECT vec_id FROM v)), o AS (SELECT a, count(*) AS o FROM k GROUP BY 1), i AS (SELECT b, count(*) AS i FROM k GROUP BY 1) SELECT class, count(*) AS n, sum(coalesce(o, 0))::BIGINT AS out_degree, sum(coalesce(i, 0))::BIGINT AS in_degree FROM v LEFT JOIN o ON o.a = vec_id LEFT JOIN i ON i.b = vec_id GROUP BY class"


#: Sections that a team's rows are landed in.
ROSTER_SECTIONS = 64


def source_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket users landed as a Markdown roster with a section a team, read back."""
    path = scratch_path(spark, "roster")
    p = table(spark, sf_dir, "person_records").where("linear_uuid <> '' AND source = 'linear-users'").select(F.coalesce(F.nullif("team", F.lit("")), F.lit("none")).alias("team"), F.regexp_replace(F.coalesce("name", F.lit("")), r"[|\n\r]", " ").alias("name"), "linear_uuid")
    # a line a row: a team's rows go to so many sections of their own, none of which is ever held as one text
    p = p.withColumn("nth", F.pmod(F.xxhash64("linear_uuid"), F.lit(ROSTER_SECTIONS)))
    head = F.concat(F.lit("## "), "team", F.lit("\n\n| name | id |\n|---|---|"))
    heads = p.select("team", "nth").distinct().select("team", "nth", F.lit(0).alias("place"), head.alias("value"))
    body = p.select("team", "nth", F.lit(1).alias("place"), F.concat(F.lit("| "), "name", F.lit(" | `"), "linear_uuid", F.lit("` |")).alias("value"))
    heads.unionByName(body).repartition("team", "nth").sortWithinPartitions("team", "nth", "place").select("value").write.text(path)
    return W.roster_markdown(spark, path).groupBy(F.col("section").alias("team")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uuid").alias("n_ids"))


SQL["source_roster"] = "SELECT coalesce(nullif(team, ''), 'none') AS team, count(*) AS n, count(DISTINCT linear_uuid) AS n_ids FROM person_records WHERE linear_uuid <> '' AND source = 'linear-users' GROUP BY 1"


def source_signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals landed as JSON lines, read through the data source with a lower bound of time."""
    path = scratch_path(spark, "lines")
    s = table(spark, sf_dir, "signals").where("received_at IS NOT NULL")
    s.select("id", "content", "source", "channel", "author", _iso("received_at").alias("timestamp"), "metadata").write.json(path)
    spark.dataSource.register(E.SignalLines)
    return spark.read.format("signal_lines").option("since", "2024-01-01T00:00:00").load(path.removeprefix("file://")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("author").alias("n_authored"))


SQL["source_signal_lines"] = "SELECT source, count(*) AS n, count(author) AS n_authored FROM signals WHERE received_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00' GROUP BY source"


def stream_signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, a file at a time: rows per source."""
    path = scratch_path(spark, "lines")
    s = table(spark, sf_dir, "signals").where("received_at IS NOT NULL").select("id", "content", "source", "channel", "author", _iso("received_at").alias("timestamp"), "metadata")
    s.repartition(6, "id").write.json(path)
    spark.dataSource.register(E.SignalLines)
    stream = spark.readStream.format("signal_lines").load(path.removeprefix("file://"))
    return flows.run_available(stream.select("source", "author"), "lines").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("author").alias("n_authored"))


SQL["stream_signal_lines"] = "SELECT source, count(*) AS n, count(author) AS n_authored FROM signals WHERE received_at IS NOT NULL GROUP BY source"


def store_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three notes of every resource (source and channel), from a log."""
    s = table(spark, sf_dir, "signals").where("received_at IS NOT NULL AND channel IS NOT NULL")
    log = s.select(X.content_hash([F.coalesce("source", F.lit("")), _channel()]).alias("resource"), F.unix_micros("received_at").alias("at"), F.col("delivery_no").cast("string").alias("note"))
    return stores.annotation_summary(log)


SQL["store_annotations"] = f"WITH s AS (SELECT substr(sha256(coalesce(source, '') || ':' || {_SQL_CHANNEL}), 1, 16) AS resource, epoch_us(received_at) AS us, delivery_no::VARCHAR AS note FROM signals WHERE received_at IS NOT NULL AND channel IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY resource ORDER BY us DESC, note DESC) AS k FROM s QUALIFY k <= 3) SELECT resource, string_agg(note, ' | ' ORDER BY k DESC) AS summary FROM r GROUP BY resource"


def store_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discoveries (events, purchases being happy places) aged by ten sessions: what is left, and the three strongest."""
    e = table(spark, sf_dir, "events").where("event_type IS NOT NULL AND value IS NOT NULL")
    log = e.select("event_id", F.when(F.col("event_type") == "purchase", "happy_place").otherwise(F.col("event_type")).alias("kind"), (F.abs("value") / (1 + F.abs("value"))).alias("weight"))
    return stores.aged_discoveries(log, 10).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), _R(F.max("weight"), 5).alias("most"))


SQL["store_discoveries"] = "WITH l AS (SELECT CASE WHEN event_type = 'purchase' THEN 'happy_place' ELSE event_type END AS kind, abs(value) / (1 + abs(value)) * CASE WHEN event_type = 'purchase' THEN pow(0.95::DOUBLE, 10) ELSE pow(0.8::DOUBLE, 10) END AS w FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL) SELECT kind, count(*) AS n, round(max(w), 5) AS most FROM l WHERE w >= 0.1 GROUP BY kind"


def store_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address aliases of roster and code hosting records, merged per name."""
    p = table(spark, sf_dir, "person_records").where("name <> '' AND aliases IS NOT NULL").select("source", F.lower(F.trim("name")).alias("canonical"), F.explode("aliases").alias("alias")).select("source", "canonical", F.lower(F.trim("alias")).alias("alias"))
    one, two = p.where("source = 'static-csv'").drop("source"), p.where("source <> 'static-csv'").drop("source")
    return stores.merged_aliases(one, two).select("canonical", F.array_join("aliases", ",").alias("aliases"))


SQL["store_aliases"] = "WITH p AS (SELECT lower(trim(name, ' ')) AS canonical, lower(trim(unnest(aliases), ' ')) AS alias FROM person_records WHERE name <> '' AND aliases IS NOT NULL) SELECT canonical, array_to_string(list_sort(list_distinct(list(alias))), ',') AS aliases FROM p WHERE alias IS NOT NULL AND canonical <> alias GROUP BY canonical"


def store_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log of budget entries read as records: the last row of a trace counts."""
    log = table(spark, sf_dir, "budget_entries").where("trace_id <> '' AND value IS NOT NULL").select("trace_id", "entry_no", "metric", "value")
    return stores.latest_records(log, "trace_id", ["entry_no"]).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


SQL["store_feedback"] = "WITH l AS (SELECT trace_id, metric, value FROM budget_entries WHERE trace_id <> '' AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY entry_no DESC) = 1) SELECT metric, count(*) AS n, sum(value)::BIGINT AS total FROM l GROUP BY metric"


def store_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contact graph saved as tables and loaded: nodes, edges, density, and how many nodes write or are written to."""
    path = scratch_path(spark, "graph")
    e = contacts(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    stores.save_graph(e.select(F.explode(F.array("src", "dst")).alias("v")).distinct(), e, path)
    nodes, edges = stores.load_graph(spark, path)
    n, m = nodes.agg(F.count(F.lit(1)).alias("n_nodes")), edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("src").alias("n_writers"), F.count_distinct("dst").alias("n_readers"), F.sum("weight").alias("weight"))
    return n.crossJoin(m).select("*", _R(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 8).alias("density"))


SQL["store_graph"] = f"WITH {_CONTACTS}, n AS (SELECT count(DISTINCT v) AS n_nodes FROM ties), m AS (SELECT count(*) AS n_edges, count(DISTINCT src) AS n_writers, count(DISTINCT dst) AS n_readers, sum(weight)::BIGINT AS weight FROM edges) SELECT *, round(n_edges / (n_nodes * (n_nodes - 1)), 8) AS density FROM n, m"


def store_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name fingerprints saved with their parameters: they load under the same parameters only."""
    path = scratch_path(spark, "prints")
    prints = table(spark, sf_dir, "part").where("p_name IS NOT NULL").select(F.col("p_partkey").alias("id"), V.fnv1a(F.col("p_name")).alias("fp"))
    stores.save_index(prints, path, bands=4, distance=3)
    held = stores.load_index(spark, path, bands=4, distance=3)
    other = stores.load_index(spark, path, bands=8, distance=3)
    return held.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fp").alias("n_prints")).withColumn("refused", F.lit(other is None))


SQL["store_index"] = "SELECT count(*) AS n, count(DISTINCT p_name) AS n_prints, true AS refused FROM part WHERE p_name IS NOT NULL"


def store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel counters saved after half of the signals and restored over seeds: channels not seen then keep their seed."""
    path = scratch_path(spark, "state")
    s = table(spark, sf_dir, "signals").where("channel IS NOT NULL AND received_at IS NOT NULL").select(_channel().alias("channel"), "delivery_no")
    stores.save_state(s.where("delivery_no % 2 = 0").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.max("delivery_no").alias("last")), path, "channel", "last")
    seeds = s.select("channel").distinct().select("channel", F.lit(-1).cast("long").alias("n"))
    return stores.restore_state(spark, path, seeds, "channel")


SQL["store_state"] = f"WITH s AS (SELECT {_SQL_CHANNEL} AS channel, delivery_no FROM signals WHERE channel IS NOT NULL AND received_at IS NOT NULL) SELECT channel, CASE WHEN count(*) FILTER (WHERE delivery_no % 2 = 0) > 0 THEN count(*) FILTER (WHERE delivery_no % 2 = 0) ELSE -1 END AS n FROM s GROUP BY channel"


def control_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ownership records as texts for the mesh: rows and words per kind of owner."""
    e = table(spark, sf_dir, "ownership_edges").where("source_id IS NOT NULL AND target_id IS NOT NULL").groupBy("source_id", "target_id").agg(F.min("nature_of_control").alias("nature_of_control"))
    n = table(spark, sf_dir, "entities").where("entity_id IS NOT NULL").groupBy(F.col("entity_id").alias("id")).agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type"))
    s = W.control_signals(n, e)
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"), F.count_distinct("channel").alias("n_companies"))


SQL["control_signals"] = "WITH e AS (SELECT source_id, target_id, min(nature_of_control) AS k FROM ownership_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2), n AS (SELECT entity_id, min(name) AS name, min(entity_type) AS t FROM entities WHERE entity_id IS NOT NULL GROUP BY 1), s AS (SELECT target_id, trim(concat_ws(' ', name, t, 'controls company', target_id, replace(coalesce(k, ''), '-', ' ')), ' ') AS content FROM e JOIN n ON n.entity_id = e.source_id) SELECT 'ownership' AS source, count(*) AS n, sum(length(content))::BIGINT AS n_chars, count(DISTINCT target_id) AS n_companies FROM s"

def source_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person records landed as members, ticket users and chat users, read back: records, names and addresses per provider."""
    p = table(spark, sf_dir, "person_records").where("record_id IS NOT NULL")
    paths = {k: scratch_path(spark, k) for k in ("members", "tickets", "chat")}
    p.where("source = 'github-org'").select(F.col("github_handle").alias("login"), "name", "email").write.json(paths["members"])
    p.where("source = 'linear-users'").select(F.col("linear_uuid").alias("id"), "name", "email", F.col("linear_display_name").alias("displayName")).write.json(paths["tickets"])
    p.where("source = 'slack-users'").select(F.col("slack_user_id").alias("id"), (F.col("record_id") % 10 == 0).alias("is_bot"), F.struct(F.col("name").alias("real_name"), F.col("slack_handle").alias("display_name"), "email").alias("profile")).write.json(paths["chat"])
    r = I.organisation_members(spark, paths["members"]).unionByName(I.ticket_users(spark, paths["tickets"])).unionByName(I.chat_users(spark, paths["chat"]))
    handle = F.concat("github_handle", "slack_handle", "linear_display_name")
    return r.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(handle != "").alias("n_handles"), F.count_distinct(F.concat("github_handle", "slack_user_id", "linear_uuid")).alias("n_ids"))


SQL["source_identities"] = "SELECT source, count(*) AS n, count(*) AS n_handles, count(DISTINCT github_handle) AS n_ids FROM (SELECT DISTINCT source, github_handle FROM person_records WHERE record_id IS NOT NULL AND source = 'github-org' AND github_handle <> '') GROUP BY source UNION ALL SELECT source, count(*), count(*) FILTER (WHERE coalesce(linear_display_name, '') <> ''), count(DISTINCT linear_uuid) FROM person_records WHERE record_id IS NOT NULL AND source = 'linear-users' AND linear_uuid IS NOT NULL GROUP BY source UNION ALL SELECT source, count(*), count(*) FILTER (WHERE coalesce(nullif(slack_handle, ''), name, '') <> ''), count(DISTINCT slack_user_id) FROM person_records WHERE record_id IS NOT NULL AND source = 'slack-users' AND record_id % 10 <> 0 AND slack_user_id IS NOT NULL GROUP BY source"


def back_scan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by the windows of a walk back from the start of 2025: a day, then half as long again each, to half a year."""
    now = datetime(2025, 1, 1, tzinfo=timezone.utc)
    windows = B.back_scan(now, 86_400.0, 30 * 86_400.0, 180 * 86_400.0)
    s = table(spark, sf_dir, "signals").where(F.col("received_at") >= F.lit(windows[-1][0]))
    return s.select(B.window_of(F.col("received_at"), windows).alias("window")).where("window IS NOT NULL").groupBy("window").agg(F.count(F.lit(1)).alias("n"))


SQL["back_scan_windows"] = "WITH RECURSIVE w(k, s, e, step) AS (SELECT 0, 86400.0::DOUBLE, 0.0::DOUBLE, 86400.0::DOUBLE UNION ALL SELECT k + 1, s + least(2592000.0::DOUBLE, step * 1.5::DOUBLE), s, least(2592000.0::DOUBLE, step * 1.5::DOUBLE) FROM w WHERE s + least(2592000.0::DOUBLE, step * 1.5::DOUBLE) <= 15552000) SELECT k AS window, count(*) AS n FROM signals JOIN w ON epoch_us(TIMESTAMPTZ '2025-01-01 00:00:00+00') - epoch_us(received_at) > e * 1000000 AND epoch_us(TIMESTAMPTZ '2025-01-01 00:00:00+00') - epoch_us(received_at) <= s * 1000000 GROUP BY k"


def feedback_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading bands as ratings: what they change per dimension, and whether that dimension may change."""
    names = F.element_at(F.array(*[F.lit(r) for r in rules.RATING_ACTIONS]), F.col("band"))
    r = table(spark, sf_dir, "reading_labels").where("band BETWEEN 1 AND 4").select(F.explode(rules.rating_actions(names)).alias("a")).select("a.*")
    return r.groupBy("dimension", "enabled").agg(F.count(F.lit(1)).alias("n"), _R(F.sum("delta"), 4).alias("delta"))


SQL["feedback_actions"] = "WITH a AS (SELECT 'agent_confidence' AS dimension, true AS enabled, CASE band WHEN 1 THEN 0.05::DOUBLE WHEN 2 THEN -0.08::DOUBLE WHEN 3 THEN -0.03::DOUBLE ELSE 0.02::DOUBLE END AS d FROM reading_labels WHERE band BETWEEN 1 AND 4 UNION ALL SELECT 'surfacing_priority', false, -0.04::DOUBLE FROM reading_labels WHERE band = 4) SELECT dimension, enabled, count(*) AS n, round(sum(d), 4) AS delta FROM a GROUP BY 1, 2"


def configured_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by what a configuration of two constraints asks for, the words it spells out being looked for first."""
    c = rules.Constraints({"kill_patterns": [{"pattern": r"\btimeout\b", "category": "x"}], "redact_patterns": [{"pattern": r"\bqueue\s+\w+", "category": "y", "replacement": "[Q]"}]})
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").where(c.any_keyword(F.col("text")))
    return d.groupBy(c.action(F.col("text")).alias("action")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c.redacted(F.col("text")).contains("[Q]")).alias("n_redacted"))


SQL["configured_constraints"] = r"WITH d AS (SELECT regexp_matches(text, '\btimeout\b', 'i') AS k, regexp_matches(text, '\bqueue\s+\w+', 'i') AS r, contains(text, '[Q]') AS q FROM documents WHERE text IS NOT NULL AND regexp_matches(lower(text), 'timeout|queue')) SELECT CASE WHEN k THEN 'kill' WHEN r THEN 'redact' ELSE 'pass' END AS action, count(*) AS n, count(*) FILTER (WHERE r OR q) AS n_redacted FROM d GROUP BY 1"

QUERIES = {
    f.__name__: f
    for f in (
        source_issues, source_checks, source_tickets, source_alerts, source_annotations, source_traces, source_transactions, source_roster, source_signal_lines, stream_signal_lines, store_annotations, store_discoveries, store_aliases, store_feedback, store_graph,
        store_index, store_state, control_signals, source_identities, back_scan_windows, feedback_actions, configured_constraints,
    )
}
