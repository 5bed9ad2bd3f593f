"""Person records from what identity providers return, landed as JSON lines: members, ticket users, chat users; and channel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("name", "email", "github_handle", "slack_handle", "slack_user_id", "linear_uuid", "linear_display_name", "source")


def _record(df: DataFrame, source: str, **fields) -> DataFrame:
    """The given fields, empty strings for the others."""
    return df.select(*[F.coalesce(fields[c], F.lit("")).alias(c) if c in fields else F.lit(source if c == "source" else "").alias(c) for c in RECORD])


def organisation_members(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.schema("login string, name string, email string").option("mode", "DROPMALFORMED").json(path).where("login <> ''").dropDuplicates(["login"])
    return _record(m, "github-org", name=F.coalesce(F.nullif("name", F.lit("")), "login"), email=F.col("email"), github_handle=F.col("login"))


def ticket_users(spark: SparkSession, path: str) -> DataFrame:
    u = spark.read.schema("id string, name string, email string, displayName string").option("mode", "DROPMALFORMED").json(path).where("id IS NOT NULL")
    return _record(u, "linear-users", name=F.col("name"), email=F.col("email"), linear_uuid=F.col("id"), linear_display_name=F.col("displayName"))


def chat_users(spark: SparkSession, path: str) -> DataFrame:
    """People among the members of a chat: no bots, nobody deleted; who has no display name goes by the real one."""
    m = spark.read.schema("id string, is_bot boolean, deleted boolean, real_name string, profile struct<real_name: string, display_name: string, email: string>").option("mode", "DROPMALFORMED").json(path)
    people = m.where("id IS NOT NULL AND id <> 'USLACKBOT' AND NOT coalesce(is_bot, false) AND NOT coalesce(deleted, false)")
    real = F.coalesce(F.nullif("profile.real_name", F.lit("")), "real_name")
    return _record(people, "slack-users", name=real, email=F.col("profile.email"), slack_handle=F.coalesce(F.nullif("profile.display_name", F.lit("")), real), slack_user_id=F.col("id"))


def channel_table(spark: SparkSession, path: str) -> DataFrame:
    """``channel, id, is_private, n_members`` of landed channel lists."""
    c = spark.read.schema("id string, name string, is_private boolean, num_members long").option("mode", "DROPMALFORMED").json(path).where("name IS NOT NULL")
    return c.groupBy(F.lower("name").alias("channel")).agg(F.min("id").alias("id"), F.max(F.coalesce("is_private", F.lit(False))).alias("is_private"), F.max("num_members").alias("n_members"))


def private_channels(signals: DataFrame, channels: DataFrame) -> DataFrame:
    """``signals`` with ``is_private``: what the channel table says, else by the name's prefix."""
    clean = F.regexp_replace("channel", "^#+", "")
    known = channels.select(F.col("channel").alias("__c"), F.col("is_private").alias("__p"))
    return signals.join(known, F.lower(clean) == F.col("__c"), "left").withColumn("is_private", F.coalesce("__p", F.coalesce(clean.rlike("^(priv-|dm-|private-)"), F.lit(False)))).drop("__c", "__p")


def with_user_names(signals: DataFrame, users: DataFrame, id_col: str = "author") -> DataFrame:
    """``signals`` with user ids replaced by the chat names of ``chat_users``; unknown ids stay."""
    names = users.where("slack_user_id <> ''").groupBy(F.col("slack_user_id").alias("__u")).agg(F.min("slack_handle").alias("__n"))
    return signals.join(names, F.col(id_col) == F.col("__u"), "left").withColumn(id_col, F.coalesce("__n", id_col)).drop("__u", "__n")
