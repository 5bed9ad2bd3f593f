"""Readers of landed work events (JSON lines of each producer) and a Python data source with a time bound."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SIGNAL_SCHEMA = "id string, content string, source string, channel string, author string, timestamp timestamp, metadata string"
BOTS = ("dependabot", "dependabot[bot]", "renovate", "renovate[bot]", "github-actions", "github-actions[bot]", "linear", "codecov")


def no_bots(df: DataFrame, author: str = "author") -> DataFrame:
    """Without rows of known robots or authors that end in ``[bot]``."""
    low = F.lower(F.col(author))
    return df.where(~F.coalesce(low.isin(*BOTS) | low.endswith("[bot]"), F.lit(False)))


def pull_requests(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Signals of landed pull requests: one for the request and one for each comment and review."""
    schema = "number int, title string, body string, state string, author struct<login: string>, updatedAt timestamp, additions int, deletions int, files array<struct<path: string>>, comments array<struct<id: string, author: struct<login: string>, body: string, createdAt: timestamp>>, reviews array<struct<id: string, author: struct<login: string>, body: string, state: string, submittedAt: timestamp>>"
    p = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("number IS NOT NULL")
    meta = lambda **k: F.to_json(F.struct(*[v.alias(n) for n, v in k.items()]))
    head = p.select(F.concat_ws(":", F.lit(repo), F.lit("pull_request"), "number", "state").alias("id"), F.concat_ws("\n", "title", "body").alias("content"), F.col("author.login").alias("author"), F.col("updatedAt").alias("timestamp"), meta(event_type=F.lit("pull_request"), pr_number=F.col("number"), state=F.col("state"), additions=F.col("additions"), deletions=F.col("deletions"), files_changed=F.slice(F.coalesce(F.transform("files", lambda f: f["path"]), F.array().cast("array<string>")), 1, 10)).alias("metadata"))
    c = p.select("number", F.explode("comments").alias("c")).where("trim(c.body) <> ''")
    comments = c.select(F.concat_ws(":", F.lit(repo), F.lit("pr_comment"), "number", "c.id").alias("id"), F.col("c.body").alias("content"), F.col("c.author.login").alias("author"), F.col("c.createdAt").alias("timestamp"), meta(event_type=F.lit("pr_comment"), pr_number=F.col("number"), sub_id=F.col("c.id")).alias("metadata"))
    r = p.select("number", F.explode("reviews").alias("r"))
    reviews = r.select(F.concat_ws(":", F.lit(repo), F.lit("pr_review"), "number", "r.id").alias("id"), F.coalesce("r.body", F.lit("")).alias("content"), F.col("r.author.login").alias("author"), F.col("r.submittedAt").alias("timestamp"), meta(event_type=F.lit("pr_review"), pr_number=F.col("number"), sub_id=F.col("r.id"), review_state=F.col("r.state")).alias("metadata"))
    rows = no_bots(head.unionByName(comments).unionByName(reviews)).dropDuplicates(["id"])
    return rows.select("id", "content", F.lit("github").alias("source"), F.lit(repo).alias("channel"), "author", "timestamp", "metadata")


def chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """Signals of landed chat messages, system subtypes left out, replies with the author of their thread."""
    schema = "channel string, user string, text string, ts string, thread_ts string, subtype string, reply_count int"
    m = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("ts IS NOT NULL AND (subtype IS NULL OR subtype NOT IN ('channel_join', 'channel_leave', 'channel_topic', 'channel_purpose', 'channel_name'))").dropDuplicates(["channel", "ts"])
    parents = m.select("channel", F.col("ts").alias("thread_ts"), F.col("user").alias("thread_author"))
    rows = m.join(parents, ["channel", "thread_ts"], "left").withColumn("reply", F.col("thread_ts").isNotNull() & (F.col("thread_ts") != F.col("ts")))
    return rows.select(F.concat_ws(":", "channel", "ts").alias("id"), F.col("text").alias("content"), F.lit("slack").alias("source"), "channel", F.col("user").alias("author"), F.timestamp_seconds(F.col("ts").cast("decimal(20,6)")).alias("timestamp"), F.to_json(F.struct(F.lit("message").alias("event_type"), "ts", "thread_ts", F.col("reply").alias("is_thread_reply"), F.when(F.col("reply"), F.col("thread_author")).alias("thread_author"))).alias("metadata"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SignalLines(DataSource):
    """``spark.read.format("signal_lines").option("since", ...).load(folder)``: JSON-lines signals not older than ``since``, a partition per file."""

    @classmethod
    def name(cls) -> str:
        return "signal_lines"

    def schema(self) -> str:
        return "id string, content string, source string, channel string, author string, timestamp string, metadata string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _LineStream(self.options)


class _LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.since = options["path"], options.get("since", "")

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in sorted(glob.glob(os.path.join(self.path, "*.json*")))] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                try:
                    r = json.loads(line)
                except ValueError:
                    continue
                if isinstance(r, dict) and str(r.get("timestamp") or "") >= self.since:
                    yield tuple(None if r.get(k) is None else r[k] if isinstance(r[k], str) else json.dumps(r[k]) for k in ("id", "content", "source", "channel", "author", "timestamp", "metadata"))


class _LineStream(_LineReader, DataSourceStreamReader):
    """The same folder as a stream: an offset is how many of its files (by name) have been read, new names must sort behind."""

    def _files(self) -> list[str]:
        return sorted(glob.glob(os.path.join(self.path, "*.json*")))

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self._files())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(p) for p in self._files()[start["files"] : end["files"]]]
