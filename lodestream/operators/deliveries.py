"""At-least-once deliveries: keep exactly one copy of every message.

``message_identity`` turns the producer's metadata and the channel into one canonical
key; ``quotient_dedup`` finds the surplus deliveries with an exact quotient hash table.

The table: each key becomes a fixed-width 128-bit identifier, a bijective mix permutes
it, its leading bits (the *quotient*) choose the shard that an entry is sent to, and the
rest (the complete *remainder*) is what the shard's hash table is asked for, together with
the whole key, so that two different keys never match whatever their identifiers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.operators.skew import hot_keys
from lodestream.scratch import materialize

#: Metadata keys that identify a message, by producer.
IDENTITY_KEYS: dict[str, tuple[str, ...]] = {
    "slack": ("ts", "edited_ts"),
    "github": ("event_type", "pr_number", "issue_number", "run_id", "sub_id", "state"),
    "linear": ("identifier", "comment_id", "updated_at"),
    "grafana": ("fingerprint", "starts_at", "state"),
}
_NUMBERS = {"ts", "edited_ts", "pr_number", "issue_number", "run_id", "sub_id"}
_INSTANTS = {"updated_at", "starts_at"}
_CORRUPT = "_unreadable"


def metadata_schema() -> T.StructType:
    keys = sorted({k for ks in IDENTITY_KEYS.values() for k in ks})
    return T.StructType([T.StructField(k, T.StringType()) for k in [*keys, _CORRUPT]])


def _meaning(key: str, value: Column) -> Column:
    """A value's canonical writing: numbers by value, instants by instant, words by letters."""
    word = F.lower(F.trim(value))
    word = F.when(word != "", word)
    if key in _NUMBERS:
        number = word.try_cast("decimal(38,9)")
        return F.coalesce(number.cast("string"), word)
    if key in _INSTANTS:
        return F.coalesce(F.unix_micros(F.upper(word).try_cast("timestamp")).cast("string"), word)
    return word


def channel_meant(channel: Column) -> Column:
    """The channel whatever its case, surrounding blanks or leading ``#``."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(channel, r"\s+", " "))), r"^#\s*", "")


def message_identity(df: DataFrame) -> Column:
    """The canonical key of a delivery; null where metadata is missing, unreadable or holds no identifying key.

    Deliveries agree if their source, the channel meant and every identifying key agree by
    meaning (``"4.50"`` = ``4.5``; absent = null).  A null key marks a message of its own.
    """
    meta = F.from_json(df["metadata"], metadata_schema(), {"columnNameOfCorruptRecord": _CORRUPT})
    source = F.lower(F.trim(df["source"]))
    key = F.lit(None).cast("string")
    for producer, keys in IDENTITY_KEYS.items():
        values = [_meaning(k, meta[k]) for k in keys]
        text = F.concat_ws("\x1f", F.lit(producer), F.coalesce(channel_meant(df["channel"]), F.lit("\x00")), *[F.coalesce(v, F.lit("\x00")) for v in values])
        key = F.when((source == producer) & F.coalesce(*values).isNotNull(), text).otherwise(key)
    return F.when(meta.isNotNull() & meta[_CORRUPT].isNull(), key)


def _permute(word: Column) -> Column:
    """A bijection of 64-bit words (two xor-shift rounds), so that any identifiers spread over the quotients."""
    word = word.bitwiseXOR(F.shiftrightunsigned(word, 33))
    word = word.bitwiseXOR(F.shiftleft(word, 21))
    return word.bitwiseXOR(F.shiftrightunsigned(word, 17))


def identifier_words(key: Column) -> tuple[Column, Column]:
    """A 128-bit identifier of ``key`` as two longs."""
    digest = F.md5(key)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    return half(1), half(17)


def quotient_dedup(df: DataFrame, key: Column, order_col: str, quotient_bits: int = 20, words: Callable[[Column], tuple[Column, Column]] = identifier_words) -> DataFrame:
    """The surplus rows of ``df``: all but the one with the smallest ``order_col`` of each key.

    Rows whose key or ``order_col`` is null are never surplus.  ``order_col`` is expected to be
    unique; rows that repeat a whole delivery with its number count as that one delivery and stay
    together.  A keyless row is entered under a key of its own.

    Entries are written once (so metadata is parsed once) and sent to the shard of their quotient;
    there the complete remainder finds an entry and the whole key confirms it, so keys whose
    identifiers coincide stay apart.  Quotients with an unusual share of all rows, those of messages
    repeated very often, are combined before they are sent.  The join back runs on the unique
    ``order_col``, so a hot key cannot overload a task.
    """
    order = F.col(order_col).cast("string")
    entered = df.where(F.col(order_col).isNotNull()).select(F.col(order_col).alias("__o"), F.coalesce(key, F.concat(F.lit("\x00own\x1f"), order)).alias("__k"))
    high, low = words(F.col("__k"))
    entered = entered.select("__o", "__k", _permute(high).alias("__h"), low.alias("__r2"))
    entries = materialize(entered.select("__o", "__k", F.shiftrightunsigned("__h", 64 - quotient_bits).cast("int").alias("__q"), F.col("__h").bitwiseAND(F.lit((1 << (64 - quotient_bits)) - 1)).alias("__r1"), "__r2"), "entries")
    hot = hot_keys(entries, "__q")
    first = F.min("__o").alias("__first")
    found = lambda rows: rows.groupBy("__q", "__r1", "__r2", "__k").agg(first).select("__first")
    kept = found((entries.where(~F.col("__q").isin(hot)) if hot else entries).repartition("__q"))
    if hot:
        kept = kept.unionByName(found(entries.where(F.col("__q").isin(hot))))
    surplus = entries.select("__o").join(kept, F.col("__o") == F.col("__first"), "left_anti")
    return surplus.select(F.col("__o").alias(order_col)).distinct()


def surplus_deliveries(signals: DataFrame) -> DataFrame:
    """``delivery_no`` of every repeated delivery but the first of its message."""
    return quotient_dedup(signals, message_identity(signals), "delivery_no")


def first_deliveries(signals: DataFrame) -> DataFrame:
    """``signals`` with exactly one row per message, all columns kept.

    Rows without a delivery number cannot be ordered and are kept.
    """
    return signals.join(surplus_deliveries(signals), "delivery_no", "left_anti")
