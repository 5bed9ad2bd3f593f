"""Queries on the mesh and its bookkeeping: identities, merges, peers, filters, queues, caches, budgets; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import text as X, vectors as V
from lodestream.operators import graphs as G, structures as T
from lodestream.operators.skew import hot_keys, join_unique
from lodestream.plans.activity_queries import _SQL_CHANNEL, _channel
from lodestream.plans.graph_queries import _CONTACTS, comm_ties, contacts
from lodestream.plans.vector_queries import _vectors
from lodestream.scratch import materialize
from lodestream.sources.tables import table

_R = lambda c, n=6: F.round(c, n)
_person = lambda c: F.lower(F.regexp_replace(c, "^@", ""))
_PERSON = lambda c: f"lower(regexp_replace({c}, '^@', ''))"


# ---- identities -----------------------------------------------------------------------------


def _known_handles(spark, sf_dir):
    p = table(spark, sf_dir, "person_records")
    handle = F.explode(F.array("github_handle", "slack_handle", "linear_display_name"))
    return p.select("record_id", handle.alias("h")).select("record_id", _person(F.trim("h")).alias("handle")).where("handle <> ''")


_HANDLES = f"hd AS (SELECT record_id, {_PERSON('trim(h)')} AS handle FROM (SELECT record_id, unnest([github_handle, slack_handle, linear_display_name]) AS h FROM person_records) WHERE h IS NOT NULL AND {_PERSON('trim(h)')} <> '')"


def unknown_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of signals that no person record knows, with how often they were met, where first and last."""
    s = table(spark, sf_dir, "signals").where("author IS NOT NULL AND received_at IS NOT NULL").select(_person(F.col("author")).alias("handle"), "source", "received_at")
    seen = s.where("handle <> ''").groupBy("handle").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.min(F.unix_micros("received_at")).alias("first_us"), F.max(F.unix_micros("received_at")).alias("last_us"))
    return seen.join(_known_handles(spark, sf_dir).select("handle").distinct(), "handle", "left_anti")


SQL = {"unknown_handles": f"WITH {_HANDLES} SELECT {_PERSON('author')} AS handle, count(*) AS n, count(DISTINCT source) AS n_sources, min(epoch_us(received_at)) AS first_us, max(epoch_us(received_at)) AS last_us FROM signals WHERE author IS NOT NULL AND received_at IS NOT NULL AND {_PERSON('author')} <> '' AND {_PERSON('author')} NOT IN (SELECT handle FROM hd) GROUP BY 1"}


def alias_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For unknown authors, known handles within two edits that share their first three characters (the block), nearest first, at most five."""
    u = unknown_handles(spark, sf_dir).where(F.length("handle") >= 4).select("handle")
    k = _known_handles(spark, sf_dir).groupBy(F.col("handle").alias("known")).agg(F.min("record_id").alias("record_id")).where(F.length("known") >= 4)
    pairs = u.withColumn("b", F.substring("handle", 1, 3)).join(k.withColumn("b", F.substring("known", 1, 3)), "b").where(F.abs(F.length("handle") - F.length("known")) <= 2)
    near = pairs.withColumn("edits", F.levenshtein("handle", "known", 2)).where("edits BETWEEN 0 AND 2")
    r = near.withColumn("rank", F.row_number().over(Window.partitionBy("handle").orderBy("edits", "known")))
    return r.where("rank <= 5").select("handle", "known", "record_id", "edits", "rank")


SQL["alias_suggestions"] = f"WITH {_HANDLES}, u AS (SELECT DISTINCT {_PERSON('author')} AS handle FROM signals WHERE author IS NOT NULL AND received_at IS NOT NULL AND length({_PERSON('author')}) >= 4 AND {_PERSON('author')} NOT IN (SELECT handle FROM hd)), k AS (SELECT handle AS known, min(record_id) AS record_id FROM hd WHERE length(handle) >= 4 GROUP BY 1), n AS (SELECT handle, known, record_id, levenshtein(handle, known) AS edits FROM u JOIN k ON substr(handle, 1, 3) = substr(known, 1, 3)) SELECT handle, known, record_id, edits, row_number() OVER (PARTITION BY handle ORDER BY edits, known) AS rank FROM n WHERE edits <= 2 QUALIFY rank <= 5"


def merged_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person records of one name folded to a profile: the first non-empty value of every field by source and number, all aliases."""
    p = table(spark, sf_dir, "person_records").where("name <> ''").withColumn("key", F.lower(F.trim("name")))
    order = F.struct("source", "record_id")
    first = lambda c: F.min_by(F.nullif(c, F.lit("")), F.when(F.col(c) != "", order)).alias(c)
    return p.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[first(c) for c in ("email", "github_handle", "slack_handle", "team")], F.size(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("n_aliases"))


SQL["merged_profiles"] = "SELECT lower(trim(name, ' ')) AS key, count(*) AS n, " + ", ".join(f"arg_min({c}, (source, record_id)) FILTER (WHERE {c} <> '') AS {c}" for c in ("email", "github_handle", "slack_handle", "team")) + ", len(list_distinct(flatten(list(coalesce(list_transform(aliases, lambda a: coalesce(a, chr(0))), []))))) AS n_aliases FROM person_records WHERE name <> '' GROUP BY 1"


# ---- communication and mesh -----------------------------------------------------------------


def comm_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many people everyone writes to and is written to by, with the summed contacts of either direction."""
    e = contacts(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    both = F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("w").alias("out"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("v"), F.lit(0).cast("long").alias("out"), F.col("w").cast("int").alias("into"))))
    r = e.select(both.alias("e")).select("e.*")
    return r.groupBy("v").agg(F.count_if(F.col("out") > 0).alias("n_out"), F.count_if(F.col("into") > 0).alias("n_in"), F.sum("out").alias("out_weight"), F.sum("into").alias("in_weight"))


SQL["comm_directions"] = f"WITH {_CONTACTS}, b AS (SELECT src AS v, weight AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, weight FROM edges) SELECT v, count(*) FILTER (WHERE o > 0) AS n_out, count(*) FILTER (WHERE i > 0) AS n_in, sum(o)::BIGINT AS out_weight, sum(i)::BIGINT AS in_weight FROM b GROUP BY v"


def comm_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.betweenness(comm_ties(spark, sf_dir))
    return b.select("v", _R("score", 4).alias("score"))


def structural_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People of the contact graph by how many others are three hops away or more, or out of reach: whom they could bridge to."""
    ties = comm_ties(spark, sf_dir)
    near = G.hop_distances(ties, ties.select("v").distinct(), max_hops=2)
    total = ties.select("v").distinct().agg(F.count(F.lit(1)).alias("n"))
    return near.groupBy(F.col("source").alias("v")).agg(F.count(F.lit(1)).alias("near")).crossJoin(F.broadcast(total)).select("v", (F.col("n") - F.col("near")).alias("n_holes"))


SQL["structural_holes"] = f"WITH {_CONTACTS}, n AS (SELECT v, nb FROM ties UNION SELECT a.v, b.nb FROM ties a JOIN ties b ON a.nb = b.v UNION SELECT v, v FROM ties), t AS (SELECT count(DISTINCT v) AS n FROM ties) SELECT v, (SELECT n FROM t) - count(*) AS n_holes FROM n GROUP BY v"


def worker_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers of every label: near ones to forward to, far ones to explore, diverse ones between."""
    parts = _vectors(spark, sf_dir).where("label IS NOT NULL").select(F.col("label"), F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("mean"))
    c = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("c"))
    return T.select_peers(c, "label", "c")


def diverse_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve signals of the first hundred with terms, chosen farthest first: the seeds of a caucus."""
    s = table(spark, sf_dir, "signals").where("content IS NOT NULL").select("delivery_no", X.terms(F.col("content")).alias("terms")).where(F.size("terms") > 0)
    return T.farthest_first(s.orderBy("delivery_no").limit(100), "delivery_no", "terms", 12)


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of channels in contact whose authors overlap by more than 0.2 of all, best first: what might be one channel.

    Pairs come from shared authors, weighed by how alike the authors' shares of the two are.
    """
    s = table(spark, sf_dir, "signals").where("channel IS NOT NULL AND author IS NOT NULL AND author <> ''").select(_channel().alias("channel"), _person(F.col("author")).alias("author"))
    per = s.groupBy("channel", "author").agg(F.count(F.lit(1)).alias("n"))
    size = per.groupBy("channel").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t")).where("k >= 2")
    m = per.join(size, "channel").select("author", "channel", "k", (F.col("n") / F.col("t")).alias("p"))
    a, b = m.select("author", F.col("channel").alias("a"), F.col("k").alias("ka"), F.col("p").alias("pa")), m.select("author", F.col("channel").alias("b"), F.col("k").alias("kb"), F.col("p").alias("pb"))
    j = a.join(b, "author").where("a < b").groupBy("a", "b", "ka", "kb").agg(F.count(F.lit(1)).alias("both"), F.avg(1 - F.abs(F.col("pa") - F.col("pb"))).alias("agreement"))
    overlap = F.col("both") / (F.col("ka") + F.col("kb") - F.col("both"))
    return j.select("a", "b", _R(overlap).alias("overlap"), _R("agreement").alias("agreement"), _R(overlap * F.col("agreement"), 5).alias("combined")).where("overlap > 0.2 AND agreement > 0.8")


SQL["merge_candidates"] = f"WITH p AS (SELECT {_SQL_CHANNEL} AS channel, {_PERSON('author')} AS author, count(*) AS n FROM signals WHERE channel IS NOT NULL AND author IS NOT NULL AND author <> '' GROUP BY 1, 2), z AS (SELECT channel, count(*) AS k, sum(n) AS t FROM p GROUP BY 1 HAVING count(*) >= 2), m AS (SELECT author, channel, k, n / t AS p FROM p JOIN z USING (channel)), j AS (SELECT a.channel AS a, b.channel AS b, a.k AS ka, b.k AS kb, count(*) AS common, avg(1 - abs(a.p - b.p)) AS agreement FROM m a JOIN m b ON a.author = b.author AND a.channel < b.channel GROUP BY ALL), r AS (SELECT a, b, common / (ka + kb - common) AS o, agreement FROM j) SELECT a, b, round(o, 6) AS overlap, round(agreement, 6) AS agreement, round(o * agreement, 5) AS combined FROM r WHERE round(o, 6) > 0.2 AND round(agreement, 6) > 0.8"


def idle_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels without a signal in the last thirty days of the data: what pruning would remove (the busiest always stays)."""
    s = table(spark, sf_dir, "signals").where("channel IS NOT NULL AND received_at IS NOT NULL").select(_channel().alias("channel"), "received_at")
    per = s.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.max("received_at").alias("last"))
    end = per.agg(F.max("last").alias("end"), F.max("n").alias("top"))
    return per.crossJoin(F.broadcast(end)).where((F.col("last") <= F.col("end") - F.expr("INTERVAL 30 DAYS")) & (F.col("n") < F.col("top"))).select("channel", "n", F.unix_micros("last").alias("last_us"))


SQL["idle_workers"] = f"WITH p AS (SELECT {_SQL_CHANNEL} AS channel, count(*) AS n, max(received_at) AS last FROM signals WHERE channel IS NOT NULL AND received_at IS NOT NULL GROUP BY 1) SELECT channel, n, epoch_us(last) AS last_us FROM p WHERE last <= (SELECT max(last) FROM p) - INTERVAL 30 DAYS AND n < (SELECT max(n) FROM p)"


# ---- Bloom filters --------------------------------------------------------------------------

#: Slots and hashes of the filters of the queries, for 1,000 items at 1 %.
_SLOTS, _HASHES = T.filter_size(1000)


def _term_filters(spark, sf_dir):
    s = table(spark, sf_dir, "signals").where("content IS NOT NULL AND source IS NOT NULL").select("source", F.explode(X.terms(F.col("content"))).alias("term")).distinct()
    return s, T.bloom_filters(s, "source", "term", _SLOTS, _HASHES)


def bloom_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the term filters of the sources overlap with that of chat, beside the exact Jaccard of the terms."""
    terms, filters = _term_filters(spark, sf_dir)
    chat = filters.where("source = 'slack'").select("slot", "n")
    est = T.bloom_overlap(filters, "source", chat)
    own = terms.where("source = 'slack'").select("term", F.lit(1).alias("c"))
    exact = terms.join(own, "term", "left").groupBy("source").agg(F.count(F.lit(1)).alias("k"), F.count("c").alias("both"))
    return est.join(exact, "source").crossJoin(F.broadcast(own.agg(F.count(F.lit(1)).alias("kc")))).select("source", _R("overlap", 4).alias("estimate"), _R(F.col("both") / (F.col("k") + F.col("kc") - F.col("both")), 4).alias("exact"))


def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the terms of all sources, how many each source's filter claims: all its own, and a few by chance."""
    terms, filters = _term_filters(spark, sf_dir)
    held = T.bloom_claims(filters, terms.select("term"), "source", "term", _SLOTS, _HASHES)
    own = held.join(terms.withColumn("own", F.lit(1)), ["source", "term"], "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_claimed"), F.count("own").alias("n_own"))
    return own.join(terms.groupBy("source").agg(F.count(F.lit(1)).alias("n_terms")), "source")


# ---- queues, caches, budgets ----------------------------------------------------------------


def message_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts at messages (ten to a message, errors failing): acknowledged, pending or dead after three failures."""
    e = table(spark, sf_dir, "events").where("event_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL")
    log = e.select((F.col("user_id") % 7).alias("topic"), F.floor(F.col("event_id") / 10).alias("message"), F.struct("ts", "event_id").alias("at"), F.col("event_type").isin("purchase", "click").alias("ok"))
    return T.message_outcomes(log).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("n_attempts").alias("n_attempts"))


SQL["message_outcomes"] = "WITH l AS (SELECT user_id % 7 AS topic, event_id // 10 AS message, ts, event_id, event_type IN ('purchase', 'click') AS ok FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL), s AS (SELECT *, row_number() OVER w AS k, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS failed FROM l WINDOW w AS (PARTITION BY topic, message ORDER BY ts, event_id, ok)), g AS (SELECT topic, message, min(k) FILTER (WHERE ok) AS acked, min(k) FILTER (WHERE failed >= 3) AS dead, count(*) AS n FROM s GROUP BY 1, 2), o AS (SELECT CASE WHEN acked IS NOT NULL AND (dead IS NULL OR acked < dead) THEN 'acknowledged' WHEN dead IS NOT NULL THEN 'dead' ELSE 'pending' END AS outcome, CASE WHEN acked IS NOT NULL AND (dead IS NULL OR acked < dead) THEN acked ELSE coalesce(dead, n) END AS a FROM g) SELECT outcome, count(*) AS n, sum(a)::BIGINT AS n_attempts FROM o GROUP BY outcome"


def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred signals out of a queue that takes higher priorities first (by producer), then arrival: a top-k report."""
    urgency = F.when(F.col("source") == "grafana", 0.9).when(F.col("source") == "github", 0.6).otherwise(0.5)
    s = table(spark, sf_dir, "signals").where("delivery_no IS NOT NULL").select("delivery_no", urgency.alias("priority"))
    return s.orderBy(F.desc("priority"), "delivery_no").limit(100)


SQL["priority_order"] = "SELECT delivery_no, CASE source WHEN 'grafana' THEN 0.9::DOUBLE WHEN 'github' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS priority FROM signals WHERE delivery_no IS NOT NULL ORDER BY priority DESC, delivery_no LIMIT 100"


def score_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks ten to nineteen of every segment's customers by balance, and whether the balance lies between 0 and 1,000."""
    c = table(spark, sf_dir, "customer").where("c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL")
    r = c.select("c_mktsegment", "c_custkey", "c_acctbal", (F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")) - 1).alias("rank"))
    return r.where("rank BETWEEN 10 AND 19").select("*", F.col("c_acctbal").between(0, 1000).alias("in_range"))


SQL["score_ranges"] = "SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS rank, c_acctbal BETWEEN 0 AND 1000 AS in_range FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL QUALIFY rank BETWEEN 10 AND 19"


def live_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with a time to live of a week, written anew by every event of a user: which are alive at the end, by kind of the last write."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l"))
    end = e.agg(F.max("ts").alias("end"))
    return last.crossJoin(F.broadcast(end)).groupBy("l.event_type").agg(F.count_if(F.col("l.ts") > F.col("end") - F.expr("INTERVAL 7 DAYS")).alias("n_live"), F.count(F.lit(1)).alias("n_keys"))


SQL["live_keys"] = "WITH l AS (SELECT user_id, ts, event_type FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT event_type, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL) - INTERVAL 7 DAYS) AS n_live, count(*) AS n_keys FROM l GROUP BY event_type"


def novelty_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How news of a channel is shown: the first in detail, later ones ever more rarely (half each time), below 5 % not at all.

    Chance is a hash of the delivery, so a rerun shows the same.
    """
    s = table(spark, sf_dir, "signals").where("channel IS NOT NULL AND received_at IS NOT NULL").select(_channel().alias("channel"), "received_at", "delivery_no")
    # from the sixth on all is suppressed, so only the first five of a channel are ranked (Spark limits them before the shuffle)
    first = s.withColumn("k", F.row_number().over(Window.partitionBy("channel").orderBy("received_at", "delivery_no"))).where("k <= 5").withColumn("k", F.col("k") - 1)
    shown = F.when(F.col("k") == 0, "detail").when((F.col("delivery_no") * 7919 % 1000) / 1000 < F.pow(F.lit(0.5), F.col("k").cast("double")), "compact")
    some = first.groupBy(shown.alias("level")).agg(F.count(F.lit(1)).alias("n")).where("level IS NOT NULL")
    rest = s.agg(F.count(F.lit(1)).alias("t")).crossJoin(some.agg(F.sum("n").alias("s"))).select(F.lit("suppress").alias("level"), (F.col("t") - F.col("s")).alias("n")).where("n > 0")
    return some.unionByName(rest)


SQL["novelty_levels"] = f"WITH s AS (SELECT delivery_no, row_number() OVER (PARTITION BY {_SQL_CHANNEL} ORDER BY received_at, delivery_no) - 1 AS k FROM signals WHERE channel IS NOT NULL AND received_at IS NOT NULL) SELECT CASE WHEN k = 0 THEN 'detail' WHEN pow(0.5::DOUBLE, k) < 0.05 THEN 'suppress' WHEN (delivery_no * 7919 % 1000) / 1000 < pow(0.5::DOUBLE, k) THEN 'compact' ELSE 'suppress' END AS level, count(*) AS n FROM s GROUP BY 1"


def window_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every signal, how many others of its channel came in the day before (the time-window cache)."""
    s = table(spark, sf_dir, "signals").where("channel IS NOT NULL AND received_at IS NOT NULL").select("delivery_no", _channel().alias("channel"), F.unix_micros("received_at").alias("us"))
    # each day of a channel is a group that also holds the day before, so a busy channel is split
    s = s.withColumn("day", F.floor(F.col("us") / 86_400_000_000)).withColumn("group", F.explode(F.array(F.col("day"), F.col("day") + 1)))
    w = Window.partitionBy("channel", "group").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return s.select("channel", "day", "group", (F.count(F.lit(1)).over(w) - 1).alias("n")).where("day = group").groupBy("channel").agg(F.count(F.lit(1)).alias("n_signals"), F.max("n").alias("most"), F.sum("n").alias("total"))


SQL["window_authors"] = f"WITH s AS (SELECT {_SQL_CHANNEL} AS channel, epoch_us(received_at) AS us FROM signals WHERE channel IS NOT NULL AND received_at IS NOT NULL), w AS (SELECT channel, count(*) OVER (PARTITION BY channel ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS n FROM s) SELECT channel, count(*) AS n_signals, max(n) AS most, sum(n)::BIGINT AS total FROM w GROUP BY channel"


def spectral_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector, its nearest of other labels from a cosine of 0.2 on, at most twenty (cross-source similar)."""
    from lodestream.operators.similarity import nearest_exact

    rows = _vectors(spark, sf_dir).where("label IS NOT NULL")
    q = rows.where("vec_id % 100 = 0")
    labels = rows.select(F.col("vec_id").alias("id"), "label")
    near = nearest_exact(q, rows, "vec_id", "v", 40)
    mine = labels.withColumnsRenamed({"id": "query_id", "label": "own"})
    n = near.join(labels, "id").join(mine, "query_id").where("label <> own").where(F.round("cosine", 5) >= 0.2)
    return n.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("place <= 20").select("query_id", "id", "label", _R("cosine", 5).alias("cosine"), "place")


_cos = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
SQL["spectral_neighbours"] = f"WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL), s AS (SELECT a.vec_id AS query_id, a.label AS own, b.vec_id AS id, b.label, {_cos} AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, id) AS rank FROM s QUALIFY rank <= 40) SELECT query_id, id, label, round(c, 5) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM r WHERE label <> own AND round(c, 5) >= 0.2 QUALIFY place <= 20"


def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as four characters each, and their cost at three dollars a million in and fifteen out, per source."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("source", F.floor(F.length("text") / 4).alias("t"))
    return d.groupBy("source").agg(F.sum("t").alias("n_tokens"), _R(F.sum("t") * 3 / 1e6 + F.count(F.lit(1)) * 200 * 15 / 1e6, 6).alias("dollars"))


SQL["token_estimates"] = "SELECT source, sum(length(text) // 4)::BIGINT AS n_tokens, round(sum(length(text) // 4) * 3 / 1000000.0::DOUBLE + count(*) * 200 * 15 / 1000000.0::DOUBLE, 6) AS dollars FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source"


def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document within three bits of another's term fingerprint: the first earlier one (by number) so near, and its class, of which the first stays.

    ``earlier`` is null where only later ones are so near.  A document that is not listed has no
    duplicate; nor has one without terms, as it has no fingerprint.
    """
    from lodestream.operators.similarity import near_duplicate_classes

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", V.simhash(X.terms(F.col("text"))).alias("fp"))
    c = materialize(near_duplicate_classes(d, "doc_id", "fp"), "duplicates")
    sizes = c.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_members"), F.min("id").alias("kept"))
    return join_unique(c, sizes, "class_id", hot_keys(c, "class_id")).select(F.col("id").alias("doc_id"), "earlier", "class_id", "n_members", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        unknown_handles, alias_suggestions, merged_profiles, comm_directions, comm_betweenness, structural_holes, worker_peers, diverse_seeds, merge_candidates, idle_workers, bloom_overlaps, bloom_membership, message_outcomes, priority_order, score_ranges, live_keys,
        novelty_levels, window_authors, spectral_neighbours, token_estimates, duplicate_texts,
    )
}
