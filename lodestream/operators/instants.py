"""Mixed timestamp writings and zones to one unambiguous UTC instant.

Raw strings are deduplicated together with the feed that explains them into a dictionary of
distinct values; every value is parsed once, exhaustively, by JVM expressions; the dictionary
is kept as a table that later batches extend by the values it lacks; normalised instants are
joined back to the rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators.skew import HOT_SHARE, join_unique
from lodestream.scratch import materialize, path_exists, scratch_path

#: Written so, a timestamp is unambiguous already.
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|\+00:00)$"
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_UTC_NAMES = ("UTC", "GMT", "Z", "UT")
_MONTH = "(" + "|".join(_MONTHS) + r")[a-z]*\.?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,](\d{1,9}))?"
_HALF = r"(?:\s*([ap])\.?m\.?)?"
_ZONE = r"(?:\s*(z|[a-z]{2,5}|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?))?(?:\s*\[([a-z0-9_+/-]+)\])?"

#: Writings, each with the places of its parts: y m d h mi s fraction half zone region; m is a name where "name" is set, "order" follows the feed.
_FORMS: list[tuple[str, dict[str, int], str]] = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:t|\s+|$)(?:{_TIME}{_HALF}{_ZONE})?$", dict(y=1, m=2, d=3, h=4, mi=5, s=6, f=7, half=8, zone=9, region=10), ""),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})t?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?{_ZONE}$", dict(y=1, m=2, d=3, h=4, mi=5, s=6, f=7, zone=8, region=9), ""),
    (rf"^{_DAY}(\d{{1,2}})[-\s]{_MONTH}[-\s,]+(\d{{4}}|\d{{2}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?$", dict(d=1, m=2, y=3, h=4, mi=5, s=6, f=7, half=8, zone=9, region=10), "name"),
    (rf"^{_DAY}{_MONTH}\s+(\d{{1,2}}),?\s+{_TIME}{_ZONE}\s+(\d{{4}})$", dict(m=1, d=2, h=3, mi=4, s=5, f=6, zone=7, region=8, y=9), "name"),
    (rf"^{_DAY}{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?$", dict(m=1, d=2, y=3, h=4, mi=5, s=6, f=7, half=8, zone=9, region=10), "name"),
    (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}|\d{{2}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?$", dict(a=1, b=2, y=3, h=4, mi=5, s=6, f=7, half=8, zone=9, region=10), "order"),
]
_PARTS = ("y", "m", "d", "a", "b", "h", "mi", "s", "f", "half", "zone", "region")


def zone_abbreviations(zones: list[str], first_year: int = 1971, last_year: int = 2037) -> dict[str, int]:
    """``zone|ABBR`` -> seconds east of UTC, for every abbreviation that a zone uses (the latest meaning wins)."""
    out: dict[str, int] = {}
    for name in zones:
        try:
            zone = ZoneInfo(name)
        except (KeyError, ValueError, OSError):
            continue
        at = datetime(first_year, 1, 1, tzinfo=timezone.utc)
        while at.year <= last_year:
            local = at.astimezone(zone)
            if local.tzname().isalpha():
                out[f"{name}|{local.tzname().upper()}"] = int(local.utcoffset().total_seconds())
            at += timedelta(days=28)
    return out


def _fields(raw: Column) -> Column:
    """The parts of the first form that fits, as an array in the order of ``_PARTS``; null if none fits."""
    out = F.lit(None).cast("array<string>")
    for pattern, places, kind in reversed(_FORMS):
        template = "|".join(f"${places[p]}" if p in places else "" for p in _PARTS) + f"|{kind}"
        out = F.when(raw.rlike("(?i)" + pattern), F.split(F.regexp_replace(raw, "(?i)" + pattern, template.replace("|", "\x1f")), "\x1f", -1)).otherwise(out)
    return out


def parse_instant(df: DataFrame, text: str, zone: str, date_order: str, abbreviations: dict[str, int]) -> DataFrame:
    """``df`` with ``utc_us``: microseconds since 1970 UTC that ``text`` denotes under its feed's rules.

    - An offset counts first, then a zone abbreviation of the feed's zone (or UTC / GMT), then a
      bracketed region, then the feed's zone; a local hour that occurs twice means the first and
      one that a clock skips is moved on by the gap.
    - Day and month of all-number dates follow ``date_order``; year-first writings are year, month, day.
    - Runs of 9-10, 12-13, 15-16 and 18-19 digits count seconds, milli-, micro- and nanoseconds since
      1970 (UTC), fraction allowed; 12 or 14 digits that read as a calendar date are one.
    - Null, empty, placeholder and impossible readings, abbreviations that the zone lacks and local
      text of an unknown feed denote nothing: null.
    """
    raw = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    df = df.withColumn("__raw", raw).withColumn("__p", _fields(F.col("__raw")))
    part = lambda name: F.when(F.col("__p")[_PARTS.index(name)] != "", F.col("__p")[_PARTS.index(name)])
    number = lambda name: part(name).try_cast("int")
    kind = F.col("__p")[len(_PARTS)]
    month_name = F.lower(F.substring(part("m"), 1, 3))
    by_order = F.col(date_order)
    month = F.when(kind == "name", F.array_position(F.array(*map(F.lit, _MONTHS)), month_name).cast("int")).when(kind == "order", F.when(by_order == "mdy", number("a")).otherwise(number("b"))).otherwise(number("m"))
    day = F.when(kind == "order", F.when(by_order == "mdy", number("b")).otherwise(number("a"))).otherwise(number("d"))
    year = F.when(F.length(part("y")) == 2, number("y") + 2000).otherwise(number("y"))
    half, h = F.lower(part("half")), number("h")
    hour = F.when(half.isNull(), F.coalesce(h, F.lit(0))).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    date = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")
    df = df.withColumns({"__y": year, "__date": F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), date), "__h": hour, "__mi": F.coalesce(number("mi"), F.lit(0)), "__s": F.coalesce(number("s"), F.lit(0))})
    fraction = F.coalesce(F.substring(F.rpad(part("f"), 6, "0"), 1, 6).cast("long"), F.lit(0))
    valid = F.col("__date").isNotNull() & (F.col("__y") >= 1) & F.col("__h").between(0, 23) & F.col("__mi").between(0, 59) & F.col("__s").between(0, 59)
    wall = F.when(valid, (F.unix_date("__date").cast("long") * 86400 + F.col("__h") * 3600 + F.col("__mi") * 60 + F.col("__s")) * 1_000_000 + fraction)

    token = F.upper(part("zone"))
    signed = F.regexp_replace(token, "^(UTC|GMT)", "")
    digits = F.regexp_replace(signed, "[^0-9]", "")
    hours, minutes = F.when(F.length(digits) <= 2, digits).otherwise(F.substring(digits, 1, F.length(digits) - 2)), F.when(F.length(digits) > 2, F.right(digits, F.lit(2))).otherwise("0")
    offset = (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60) * F.when(signed.startswith("-"), -1).otherwise(1)
    named = F.create_map(*[F.lit(x) for pair in abbreviations.items() for x in pair]) if abbreviations else F.create_map().cast("map<string,int>")
    east = F.when(token.isin(*_UTC_NAMES), 0).when(signed.rlike("^[+-][0-9]"), offset).otherwise(F.try_element_at(named, F.concat(F.col(zone), F.lit("|"), token)))
    region = part("region")
    known = region.isin(*sorted(available_timezones()))
    df = df.withColumns({"__wall": wall, "__token": token, "__east": east, "__zone": F.when(region.isNull(), F.col(zone)).when(known, region)})
    local = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__wall"), F.col("__zone")))
    calendar = F.when(F.col("__token").isNotNull(), F.col("__wall") - F.col("__east").cast("long") * 1_000_000).when(F.col("__zone").isNotNull() & F.col("__wall").isNotNull(), local)

    count = F.col("__raw").try_cast("decimal(30,9)")
    scaled = F.lit(None).cast("decimal(38,9)")
    for pattern, micros in ((r"^\d{9,10}", 1_000_000), (r"^\d{12,13}", 1_000), (r"^\d{15,16}", 1)):
        scaled = F.when(F.col("__raw").rlike(pattern + r"(\.\d{1,9})?$"), count * F.lit(micros)).otherwise(scaled)
    nanos = F.when(F.col("__raw").rlike(r"^\d{18,19}$"), F.expr("try_cast(__raw AS bigint) div 1000"))
    out = F.coalesce(calendar, F.floor(scaled).cast("long"), nanos)
    return df.withColumn("utc_us", out).drop("__raw", "__p", "__y", "__date", "__h", "__mi", "__s", "__wall", "__token", "__east", "__zone")


#: Feeds are explained by a broadcast only up to this many; beyond it by a join.
MAX_BROADCAST_FEEDS = 10_000


def instant_dictionary(rows: DataFrame, feeds: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A materialized dictionary ``(feed, text, n, utc_us)`` of the distinct values in ``rows(feed, text)``.

    Values that ``known`` (an earlier dictionary) already has are taken from it and not parsed
    again.  A null feed is a feed of its own.
    """
    values = rows.where("text IS NOT NULL").groupBy("feed", "text").agg(F.count(F.lit(1)).alias("n"))
    if known is None:
        return materialize(_parsed(values, feeds), "instants")
    match = F.col("k.feed").eqNullSafe(values["feed"]) & (F.col("k.text") == values["text"])
    old = values.join(known.select("feed", "text", "utc_us").alias("k"), match).select(values["feed"], values["text"], "n", "utc_us")
    fresh = values.join(known.select("feed", "text").alias("k"), match, "left_anti")
    return materialize(_parsed(fresh, feeds).unionByName(old), "instants")


def _parsed(values: DataFrame, feeds: DataFrame) -> DataFrame:
    rules = feeds.where("feed IS NOT NULL").groupBy("feed").agg(F.min_by("zone", "zone").alias("zone"), F.min_by("date_order", "zone").alias("date_order"))
    zones = [r[0] for r in rules.select("zone").distinct().where("zone IS NOT NULL").limit(len(available_timezones()) + 1).collect() if r[0] in available_timezones()]
    rules = rules.where(F.col("zone").isin(zones)) if zones else rules.where("false")
    if rules.count() <= MAX_BROADCAST_FEEDS:
        rules = F.broadcast(rules)
    return parse_instant(values.join(rules, "feed", "left"), "text", "zone", "date_order", zone_abbreviations(zones)).select("feed", "text", "n", "utc_us")


def extend_dictionary(path: str, rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """The dictionary kept at ``path``, extended by the values of a batch ``rows(feed, text)`` that it lacks.

    Only those are parsed and appended, as files of their own; earlier batches' files stay as they
    are, so the folder can be kept from run to run.  ``n`` counts a value's rows in the batch that brought it.
    """
    spark = rows.sparkSession
    values = rows.where("text IS NOT NULL").groupBy("feed", "text").agg(F.count(F.lit(1)).alias("n"))
    if path_exists(spark, path):
        kept = spark.read.schema("feed string, text string, n long, utc_us long").parquet(path)
        values = values.join(kept.select("feed", "text").alias("k"), F.col("k.feed").eqNullSafe(values["feed"]) & (F.col("k.text") == values["text"]), "left_anti")
    _parsed(values, feeds).write.mode("append").parquet(path)
    return spark.read.schema("feed string, text string, n long, utc_us long").parquet(path)


def joined_instants(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows`` (with ``feed`` and ``text``; other columns are kept) that denote an instant by a dictionary, with ``utc_us``.

    A value that makes up a large part of all rows (by the dictionary's own counts, so at most 500
    of them) meets a broadcast instead of a shuffle.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    key = F.concat_ws("\x1f", F.coalesce(F.col("feed"), F.lit("\x00")), "text")
    words = words.withColumn("__key", key)
    hot = [r[0] for r in words.where(F.col("n") >= max(10_000, int(total * HOT_SHARE) + 1)).select("__key").collect()]
    found = words.where("utc_us IS NOT NULL").select("__key", "utc_us")
    return join_unique(rows.where("text IS NOT NULL").withColumn("__key", key), found, "__key", hot).drop("__key")


def normalised_instants(rows: DataFrame, feeds: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``rows`` (with ``feed`` and ``text``; other columns are kept) that denote an instant, with ``utc_us``."""
    return joined_instants(rows, instant_dictionary(rows, feeds, known))


def delivered_instants(signals: DataFrame, budget_entries: DataFrame, feeds: DataFrame, store: str | None = None) -> DataFrame:
    """``tbl, row_no, utc_us`` of every row whose timestamp denotes an instant and is not written canonically.

    The tables are two batches of one kept dictionary: the second parses only what the first did not
    bring.  ``store`` is its folder; without one it lives as long as the application.
    """
    store = store or scratch_path(signals.sparkSession, "instants")
    one = signals.select(F.lit("signals").alias("tbl"), F.col("delivery_no").alias("row_no"), "feed", F.col("timestamp").alias("text"))
    two = budget_entries.select(F.lit("budget_entries").alias("tbl"), F.col("entry_no").alias("row_no"), "feed", F.col("timestamp").alias("text"))
    batches = [b.where(F.col("text").isNotNull() & ~F.col("text").rlike(CANONICAL)) for b in (one, two)]
    for batch in batches:
        words = extend_dictionary(store, batch, feeds)
    return joined_instants(batches[0].unionByName(batches[1]), words).select("tbl", "row_no", "utc_us")
