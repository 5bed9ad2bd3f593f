"""Queries on embeddings by strategy, their weighted comparison, SQL functions, and recurrences as streams; with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import embeddings as E, sql_functions, text as X, vectors as V
from lodestream.plans.activity_queries import _SQL_CHANNEL, _channel
from lodestream.plans.vector_queries import DIM, _V, _vectors
from lodestream.scratch import materialize
from lodestream.sources.tables import table
from lodestream.streaming import flows, recurrences as R

_R = lambda c, n=6: F.round(c, n)


def _sparse(rows: DataFrame, key: str) -> DataFrame:
    """``key, place, x`` of the places of a vector column ``v`` that are not zero."""
    return rows.select(key, F.posexplode("v").alias("place", "x")).where("x <> 0").select(key, "place", _R("x", 5).alias("x"))


_bucket = lambda t, n: f"(('0x' || substr(md5({t}), 1, 2))::INTEGER % {n})"
_sign = lambda t: f"(CASE WHEN ('0x' || substr(md5({t}), 17, 2))::INTEGER % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
_unit = lambda key: f"s AS (SELECT {key}, place, sum(x) AS x FROM e GROUP BY {key}, place), n AS (SELECT {key}, sqrt(sum(x * x)) AS n FROM s GROUP BY {key}) SELECT {key}, place::INTEGER AS place, round(x / n, 5) AS x FROM s JOIN n USING ({key}) WHERE x <> 0"


def semantic_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", E.semantic(F.col("text")).alias("v"))
    return _sparse(d, "doc_id")


SQL = {"semantic_embeddings": rf"WITH w AS (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda w: length(w) >= 2)) AS t FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, {_bucket('t', 64)} AS place, {_sign('t')} AS x FROM w), {_unit('doc_id')}"}


def social_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "signals").where("delivery_no IS NOT NULL")
    met = F.from_json("metadata", "mentions array<string>")["mentions"]
    rows = s.select("delivery_no", E.social(F.lower(F.regexp_replace("author", "^@", "")), met, _channel()).alias("v"))
    return _sparse(rows, "delivery_no")


SQL["social_embeddings"] = f"""WITH b AS (SELECT delivery_no, coalesce(lower(regexp_replace(author, '^@', '')), '') AS a, coalesce({_SQL_CHANNEL}, '') AS c, list_filter(coalesce(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.mentions[*]'), []::VARCHAR[]), lambda m: m <> '') AS ms FROM signals WHERE delivery_no IS NOT NULL),
m AS (SELECT delivery_no, a, unnest(ms) AS m FROM b),
e AS (SELECT delivery_no, {_bucket("'author:' || a", 32)} AS place, 2 * {_sign("'author:' || a")} AS x FROM b WHERE a <> '' UNION ALL SELECT delivery_no, {_bucket("'mention:' || m", 32)}, {_sign("'mention:' || m")} FROM m
 UNION ALL SELECT delivery_no, 32 + {_bucket("'pair:' || a || '+' || m", 16)}, {_sign("'pair:' || a || '+' || m")} FROM m WHERE a <> '' UNION ALL SELECT delivery_no, 48 + {_bucket("'channel:' || c", 16)}, 1.5 * {_sign("'channel:' || c")} FROM b WHERE c <> ''), {_unit('delivery_no')}"""


def code_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of code in documents of ASCII letters: in how many, how often, and at most."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").where(~F.col("text").rlike(r"[^\x00-\x7f]"))
    counts = E.code_patterns(F.col("text"))
    rows = d.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pattern"), c.alias("k")) for n, c in counts.items()])).alias("e")).select("e.*")
    return rows.groupBy("pattern").agg(F.count_if(F.col("k") > 0).alias("n_docs"), F.sum("k").alias("n"), F.max("k").alias("most"))


SQL["code_pattern_counts"] = "WITH d AS (SELECT text FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\x7f]')), c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS pattern, len(regexp_extract_all(text, '{p}')) AS k FROM d" for n, (p, _) in E.CODE_PATTERNS.items()) + ") SELECT pattern, count(*) FILTER (WHERE k > 0) AS n_docs, sum(k)::BIGINT AS n, max(k) AS most FROM c GROUP BY pattern"


def technical_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code-aware vectors of documents: length, and the weight of their pattern places."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", E.technical(F.col("text"), X.code_tokens(F.col("text"))).alias("v"))
    return d.select("doc_id", _R(V.norm(F.col("v")), 5).alias("length"), _R(F.aggregate(F.slice("v", 33, 16), F.lit(0.0), lambda s, x: s + x * x), 5).alias("pattern_share"))


#: Logits of the two strategies that the halves of a vector stand for.
LOGITS = {"first": 0.3, "second": -0.1}


def blended_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of every vector with its own label by two strategies (the halves), blended by softmax weights, and the logits after learning from it."""
    rows = _vectors(spark, sf_dir).where("label IS NOT NULL")
    parts = rows.select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("mean"))
    c = materialize(parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("c")), "centroids")
    half = {"first": (1, DIM // 2), "second": (DIM // 2 + 1, DIM // 2)}
    j = rows.join(c, "label").select("vec_id", *[V.cosine(F.slice("v", a, n), F.slice("c", a, n)).alias(s) for s, (a, n) in half.items()])
    w = E.softmax({s: F.lit(x) for s, x in LOGITS.items()})
    blend = w["first"] * F.col("first") + w["second"] * F.col("second")
    after = E.updated_logits({s: F.lit(x) for s, x in LOGITS.items()}, {s: F.col(s) for s in LOGITS}, F.lit(10))
    return j.select("vec_id", _R("first", 5).alias("first"), _R("second", 5).alias("second"), _R(blend, 5).alias("similarity"), _R(after["first"], 5).alias("logit_first"))


_cosx = lambda a, b: f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"
_h = DIM // 2
SQL["blended_similarity"] = f"WITH {_V}, m AS (SELECT label, d, avg(v[d]) AS mean FROM v, range(1, {DIM + 1}) r(d) WHERE label IS NOT NULL GROUP BY label, d), c AS (SELECT label, list(mean ORDER BY d) AS c FROM m GROUP BY label), j AS (SELECT vec_id, {_cosx(f'v[1:{_h}]', f'c[1:{_h}]')} AS a, {_cosx(f'v[{_h + 1}:{DIM}]', f'c[{_h + 1}:{DIM}]')} AS b FROM v JOIN c USING (label)) SELECT vec_id, round(a, 5) AS first, round(b, 5) AS second, round(a / (1 + exp(-0.4::DOUBLE)) + b * exp(-0.4::DOUBLE) / (1 + exp(-0.4::DOUBLE)), 5) AS similarity, round(0.3::DOUBLE + 0.05::DOUBLE / 1.1::DOUBLE * (a - (a + b) / 2), 5) AS logit_first FROM j"


def sql_function_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's functions called from SQL text: table-valued sentences, scalar term counts and styles."""
    sql_functions.register(spark)
    table(spark, sf_dir, "documents").where("text IS NOT NULL").createOrReplaceTempView("lode_documents")
    return spark.sql("SELECT doc_id, lode_n_terms(text) AS n_terms, count(s.sentence) AS n_sentences, max(length(s.sentence)) AS longest FROM lode_documents, LATERAL lode_sentences(text) s GROUP BY doc_id, text")


def _sql_sentences_of():
    from lodestream.plans.text_queries import sql_sentences, sql_terms

    return f"WITH d AS (SELECT doc_id, len({sql_terms('text')}) AS n_terms, unnest({sql_sentences('text')}) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, n_terms, count(*) AS n_sentences, max(length(s)) AS longest FROM d GROUP BY doc_id, n_terms"


SQL["sql_function_results"] = _sql_sentences_of()


# ---- recurrences ----------------------------------------------------------------------------


def _folded(spark, sf_dir, names, start_step) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stream = flows.stream_table(spark, f"{sf_dir}/events.parquet", e.schema).where("ts IS NOT NULL AND event_id IS NOT NULL")
    out = flows.run_available(R.fold_stream(stream, "user_id", ["ts", "event_id"], "value", names, *start_step), "fold", "update")
    latest = out.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("batch_no")))).where("k = 1")
    return latest.select("user_id", "n", *[_R(c).alias(c) for c in names])


def stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention rate of every user from feedback (positive values were known already)."""
    return _folded(spark, sf_dir, ["rate", "knew", "novel"], R.feedback_rate())


_LISTS = "l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL GROUP BY 1)"
SQL["stream_feedback"] = f"WITH {_LISTS} SELECT user_id, len(x) AS n, round(list_reduce(list_prepend(0.5::DOUBLE, x), lambda r, v: greatest(0.05::DOUBLE, least(0.95::DOUBLE, CASE WHEN v > 0 THEN r + 0.05::DOUBLE * (0.95::DOUBLE - r) ELSE r + 0.2::DOUBLE * (0.05::DOUBLE - r) END))), 6) AS rate, len(list_filter(x, lambda v: v > 0))::DOUBLE AS knew, len(list_filter(x, lambda v: v <= 0))::DOUBLE AS novel FROM l"


def stream_change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed rate of change of every user's values."""
    return _folded(spark, sf_dir, ["last", "rate", "seen"], R.change_rate()).select("user_id", "n", "last", "rate")


SQL["stream_change_rate"] = f"WITH {_LISTS}, d AS (SELECT user_id, x, list_transform(range(1, len(x)), lambda i: x[i + 1] - x[i]) AS y FROM l) SELECT user_id, len(x) AS n, round(x[len(x)], 6) AS last, round(CASE WHEN len(y) = 0 THEN 0.0::DOUBLE ELSE list_reduce(y, lambda r, v: 0.2::DOUBLE * v + 0.8::DOUBLE * r) END, 6) AS rate FROM d"


def stream_controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controller output and integral for every user's values."""
    return _folded(spark, sf_dir, ["integral", "error", "output"], R.pid())


def stream_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive scale and temperature of every user's values."""
    return _folded(spark, sf_dir, ["scale", "temperature"], R.temperature())


SQL["stream_temperature"] = f"WITH {_LISTS}, s AS (SELECT user_id, x, list_reduce(list_prepend(0.1::DOUBLE, x), lambda t, v: greatest(0.001::DOUBLE, t * 0.995::DOUBLE, v)) AS t FROM l) SELECT user_id, len(x) AS n, round(t, 6) AS scale, round(2 / (1 + exp(-2 * x[len(x)] / t)) - 1, 6) AS temperature FROM s"


def stream_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed value of every user and its status with hysteresis."""
    return _folded(spark, sf_dir, ["smoothed", "status"], R.stability())


QUERIES = {f.__name__: f for f in (semantic_embeddings, social_embeddings, code_pattern_counts, technical_embeddings, blended_similarity, sql_function_results, stream_feedback, stream_change_rate, stream_controllers, stream_temperature, stream_stability)}
