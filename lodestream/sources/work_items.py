"""Readers of landed issues, build runs, tickets, alerts, annotations, traces, transaction tables and rosters.

Each takes what a producer's interface returns, one JSON document a line, and gives signals.
Calls to the services themselves (paging, back-off, tokens) are not part of this library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.sources.events import no_bots

FAILED_RUNS = ("failure", "timed_out", "cancelled")
#: Traces at least this long are slow.
SLOW_MS = 1500


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _meta(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("metadata")


def _when(text: Column, as_of: Column | None) -> Column:
    """An ISO instant; what is unreadable counts as of ``as_of``."""
    at = F.try_to_timestamp(text)
    return (at if as_of is None else F.coalesce(at, as_of)).alias("timestamp")


def issues(spark: SparkSession, path: str, repo: str, as_of: Column | None = None) -> DataFrame:
    """Signals of landed issues: one for each state an issue was seen in, one for each comment with text; robots left out."""
    person = "struct<login: string>"
    i = _lines(spark, path, f"number bigint, title string, body string, state string, author {person}, createdAt string, labels array<struct<name: string>>, assignees array<{person}>, comments array<struct<author: {person}, body: string, createdAt: string>>").where("number IS NOT NULL")
    owner, state = F.coalesce("author.login", F.lit("unknown")), F.coalesce("state", F.lit("OPEN"))
    text = F.concat(F.lit("Issue #"), F.col("number").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")), F.when(F.coalesce("body", F.lit("")) != "", F.concat(F.lit("\n"), F.col("body"))).otherwise(""))
    head = i.select(
        F.concat_ws(":", F.lit(repo), F.lit("issue"), "number", state).alias("id"), text.alias("content"), owner.alias("author"), _when(F.col("createdAt"), as_of),
        _meta(event_type=F.lit("issue"), issue_number=F.col("number"), state=state, labels=F.col("labels.name"), assignees=F.col("assignees.login")),
    )
    c = i.select("number", owner.alias("owner"), F.explode("comments").alias("c")).where("trim(c.body) <> ''")
    notes = c.select(F.concat_ws(":", F.lit(repo), F.lit("issue_comment"), "number", "c.createdAt").alias("id"), F.trim("c.body").alias("content"), F.coalesce("c.author.login", "owner").alias("author"), _when(F.col("c.createdAt"), as_of), _meta(event_type=F.lit("issue_comment"), issue_number=F.col("number")))
    rows = no_bots(head.unionByName(notes)).dropDuplicates(["id"])
    return rows.select("id", "content", F.lit("github").alias("source"), F.lit(repo).alias("channel"), "author", "timestamp", "metadata")


def failed_runs(spark: SparkSession, path: str, repo: str, as_of: Column | None = None) -> DataFrame:
    """Signals of landed build runs that failed, timed out or were cancelled; one a name and start."""
    r = _lines(spark, path, "name string, conclusion string, createdAt string, headBranch string, url string").where(F.col("conclusion").isin(*FAILED_RUNS))
    name, branch = F.coalesce("name", F.lit("unknown")), F.coalesce("headBranch", F.lit("unknown"))
    rows = r.select(F.concat_ws(":", F.lit(repo), F.lit("check_run"), name, "createdAt").alias("id"), F.concat(F.lit("CI "), "conclusion", F.lit(": "), name, F.lit(" on "), branch).alias("content"), _when(F.col("createdAt"), as_of), _meta(event_type=F.lit("check_run"), conclusion=F.col("conclusion"), branch=branch))
    return rows.dropDuplicates(["id"]).select("id", "content", F.lit("github").alias("source"), F.lit(repo).alias("channel"), F.lit("github-actions").alias("author"), "timestamp", "metadata")


def tickets(spark: SparkSession, path: str, team: str, as_of: Column | None = None) -> DataFrame:
    """Signals of landed tickets (title and description, by their creator, as of their last update) and of their comments with text."""
    user = "struct<displayName: string, name: string>"
    t = _lines(spark, path, f"identifier string, title string, description string, state struct<name: string>, priority int, assignee {user}, creator {user}, labels struct<nodes: array<struct<name: string>>>, createdAt string, updatedAt string, estimate double, comments struct<nodes: array<struct<id: string, body: string, user: {user}, createdAt: string>>>").where("identifier IS NOT NULL")
    shown = lambda c: F.coalesce(F.nullif(F.col(f"{c}.displayName"), F.lit("")), F.nullif(F.col(f"{c}.name"), F.lit("")))
    text = F.concat(F.coalesce("title", F.lit("")), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("\n"), F.col("description"))).otherwise(""))
    head = t.select(F.concat_ws(":", F.lit("ticket"), "identifier", F.coalesce("updatedAt", "createdAt")).alias("id"), text.alias("content"), F.col("identifier").alias("channel"), F.coalesce(shown("creator"), F.lit("unknown")).alias("author"), _when(F.coalesce(F.nullif("updatedAt", F.lit("")), "createdAt"), as_of), _meta(identifier=F.col("identifier"), title=F.col("title"), status=F.col("state.name"), priority=F.col("priority"), labels=F.col("labels.nodes.name"), assignee=F.coalesce(shown("assignee"), F.lit("")), team=F.lit(team), estimate=F.col("estimate")))
    c = t.select("identifier", F.explode("comments.nodes").alias("c")).where("trim(c.body) <> ''")
    notes = c.select(F.concat_ws(":", F.lit("comment"), "identifier", "c.id", "c.createdAt").alias("id"), F.trim("c.body").alias("content"), F.col("identifier").alias("channel"), F.coalesce(F.nullif("c.user.displayName", F.lit("")), "c.user.name", F.lit("unknown")).alias("author"), _when(F.col("c.createdAt"), as_of), _meta(event_type=F.lit("linear_comment"), identifier=F.col("identifier"), team=F.lit(team)))
    return head.unionByName(notes).dropDuplicates(["id"]).select("id", "content", F.lit("linear").alias("source"), "channel", "author", "timestamp", "metadata")


def alerts(spark: SparkSession, path: str) -> DataFrame:
    """Signals of landed alerts, one a fingerprint (its first start)."""
    a = _lines(spark, path, "fingerprint string, labels map<string,string>, annotations map<string,string>, status struct<state: string>, startsAt string, endsAt string").where("fingerprint IS NOT NULL")
    a = a.groupBy("fingerprint").agg(F.min_by(F.struct("labels", "annotations", "status", "startsAt", "endsAt"), F.struct("startsAt", "status.state")).alias("a")).select("fingerprint", "a.*")
    label = lambda c, default: F.coalesce(F.try_element_at("labels", F.lit(c)), F.lit(default))
    state, name = F.coalesce("status.state", F.lit("firing")), label("alertname", "Unknown")
    note = lambda c: F.nullif(F.try_element_at("annotations", F.lit(c)), F.lit(""))
    head = F.concat(F.upper(state), F.lit(": "), name)
    text = F.concat(head, F.lit(" on "), label("service", "unknown"), F.lit(" — "), F.coalesce(note("summary"), note("description"), head))
    return a.select(F.concat(F.lit("alert:"), "fingerprint").alias("id"), text.alias("content"), F.lit("grafana").alias("source"), F.concat(F.lit("alerts/"), label("folder", "default")).alias("channel"), F.lit("alertmanager").alias("author"), F.try_to_timestamp("startsAt").alias("timestamp"), _meta(event_type=F.lit("alert"), state=state, severity=label("severity", "warning"), fingerprint=F.col("fingerprint"), alert_name=name, starts_at=F.col("startsAt"), ends_at=F.when(state == "resolved", F.col("endsAt"))))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Signals of landed dashboard annotations, one an id; times are milliseconds since 1970."""
    a = _lines(spark, path, "id bigint, text string, tags array<string>, dashboardUID string, time bigint, timeEnd bigint").where("id IS NOT NULL").dropDuplicates(["id"])
    board = F.coalesce("dashboardUID", F.lit("unknown"))
    text = F.coalesce(F.nullif("text", F.lit("")), F.concat(F.lit("Annotation on "), board, F.lit(": "), F.array_join("tags", ", ")))
    return a.select(F.concat(F.lit("annotation:"), F.col("id").cast("string")).alias("id"), text.alias("content"), F.lit("grafana").alias("source"), F.concat(F.lit("annotations/"), board).alias("channel"), F.lit("annotation").alias("author"), F.timestamp_millis(F.coalesce("time", F.lit(0))).alias("timestamp"), _meta(event_type=F.lit("annotation"), tags=F.col("tags"), ended=F.when(F.col("timeEnd") != F.col("time"), F.timestamp_millis("timeEnd"))))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """Signals of landed traces, one an id: the services of all their spans, an error if any span has one, slow from 1.5 s on."""
    value = "struct<key: string, value: struct<stringValue: string>>"
    t = _lines(spark, path, f"traceID string, rootServiceName string, rootTraceName string, durationMs bigint, spanSets array<struct<spans: array<struct<attributes: array<{value}>>>>>").where("traceID IS NOT NULL").dropDuplicates(["traceID"])
    spans = F.flatten(F.coalesce("spanSets.spans", F.array().cast(f"array<array<struct<attributes: array<{value}>>>>")))
    flat = F.flatten(F.transform(spans, lambda s: F.coalesce(s["attributes"], F.array().cast(f"array<{value}>"))))
    root = F.coalesce("rootServiceName", F.lit("unknown"))
    services = F.array_distinct(F.concat(F.array(root), F.transform(F.filter(flat, lambda a: (a["key"] == "service.name") & (a["value"]["stringValue"] != "")), lambda a: a["value"]["stringValue"])))
    failed = F.exists(flat, lambda a: (a["key"] == "status") & (a["value"]["stringValue"] == "error") | (a["key"] == "otel.status_code") & (a["value"]["stringValue"] == "ERROR"))
    tag = F.when(failed, "error").when(F.col("durationMs") > SLOW_MS, "slow").otherwise("ok")
    text = F.concat(F.when(failed, "Trace ERROR: ").otherwise("Trace: "), F.coalesce("rootTraceName", F.lit("")), F.lit(" — "), root, F.lit(". Duration "), F.coalesce("durationMs", F.lit(0)).cast("string"), F.lit("ms"))
    return t.select(F.concat(F.lit("trace:"), "traceID").alias("id"), text.alias("content"), F.lit("grafana").alias("source"), F.concat(F.lit("traces/"), root).alias("channel"), F.lit("traces").alias("author"), F.lit(None).cast("timestamp").alias("timestamp"), _meta(event_type=F.lit("trace"), status=tag, services=services, n_spans=F.size(spans)))


def transactions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``features, classes, edges`` of a transaction graph from its three CSV files."""
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/{name}.csv")
    return read("txs_features"), read("txs_classes"), read("txs_edgelist")


def roster_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``section, name, uuid`` of the table rows of Markdown rosters; a row belongs to the last heading above it.

    Files are read line by line, a large one in several splits: what stands above the first heading
    of a split belongs to the last heading of the splits before it.
    """
    at = {"file": F.col("_metadata.file_path"), "split": F.col("_metadata.file_block_start")}
    lines = spark.read.text(path).select("value", *[c.alias(n) for n, c in at.items()]).withColumn("line", F.monotonically_increasing_id())
    title = F.trim(F.regexp_extract("value", r"^#+\s+(.*)", 1))
    kept = lines.where(F.col("value").rlike(r"^#+\s|^\|")).select("file", "split", "line", "value", F.when(F.col("value").startswith("#"), title).alias("title"))
    above = Window.partitionBy("file", "split").orderBy("line")
    rows = kept.withColumn("own", F.last("title", ignorenulls=True).over(above)).where("title IS NULL")
    # one row a split with a heading
    last = kept.where("title IS NOT NULL").groupBy("file", "split").agg(F.max_by("title", "line").alias("last"))
    before = last.select("file", F.col("split").alias("from"), F.lead("split").over(Window.partitionBy("file").orderBy("split")).alias("to"), "last")
    owned = rows.where("own IS NOT NULL").select("own", "value")
    open_ = rows.where("own IS NULL").alias("r").join(before.alias("b"), F.expr("r.file = b.file AND r.split > b.from AND (b.to IS NULL OR r.split <= b.to)"), "left").select(F.coalesce("last", F.lit("")).alias("own"), "value")
    cells = F.transform(F.split(F.regexp_extract("value", r"(?s)^\|(.+)\|\s*$", 1), r"\|"), lambda c: F.trim(c))
    found = owned.unionByName(open_).select(F.col("own").alias("section"), cells.alias("cells"))
    is_id = lambda c: c.rlike("^`?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}`?$")
    return found.where(F.exists("cells", is_id)).select("section", F.col("cells")[0].alias("name"), F.regexp_replace(F.element_at(F.filter("cells", is_id), 1), "`", "").alias("uuid"))


def control_signals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Signals of ownership records: who controls what, how and since when, as text for the mesh."""
    owner = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("owner"), "entity_type")
    text = F.concat_ws(" ", "owner", "entity_type", F.lit("controls company"), "target_id", F.regexp_replace(F.coalesce("nature_of_control", F.lit("")), "-", " "))
    return edges.join(owner, "source_id").select(F.concat_ws(":", "source_id", "target_id").alias("id"), F.trim(text).alias("content"), F.lit("ownership").alias("source"), F.col("target_id").alias("channel"), F.col("owner").alias("author"))
