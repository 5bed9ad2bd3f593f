"""Queries on embeddings, activations, hashes and fingerprints, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import text as X, vectors as V
from lodestream.operators.similarity import near_duplicate_classes, nearest_exact, nearest_in_cells, shingle_classes
from lodestream.plans.text_queries import sql_terms
from lodestream.sources.tables import table

_R = lambda c, n=6: F.round(c, n)
DIM = 64


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 100."""
    rows = _vectors(spark, sf_dir)
    return nearest_exact(rows.where("vec_id % 100 = 0"), rows, "vec_id", "v", 5).select("query_id", "id", _R("cosine", 5).alias("cosine"), "rank")


_cos = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
_V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"
SQL = {"cosine_topk": f"WITH {_V}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_cos} AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT query_id, id, round(cosine, 5) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 9) DESC, id) AS rank FROM s QUALIFY rank <= 5"}


def hashed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search through hyperplane buckets, none of which is passed over without proof."""
    rows = _vectors(spark, sf_dir)
    return nearest_in_cells(rows.where("vec_id % 100 = 0"), rows, "vec_id", "v", DIM, 5).select("query_id", "id", _R("cosine", 5).alias("cosine"), "rank")


SQL["hashed_neighbours"] = SQL["cosine_topk"]


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _vectors(spark, sf_dir).where("label IS NOT NULL").select("label", F.posexplode("v").alias("dim", "x"))
    return parts.groupBy("label", "dim").agg(_R(F.avg("x")).alias("mean"))


SQL["label_centroids"] = f"WITH {_V} SELECT label, d - 1 AS dim, round(avg(v[d]), 6) AS mean FROM v, range(1, {DIM + 1}) r(d) WHERE label IS NOT NULL GROUP BY label, d"


#: Labels are a fixed set of workers; their centroids are broadcast.
MAX_LABELS = 10_000


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector with every label's centroid, raw: one row per vector and label."""
    rows = _vectors(spark, sf_dir)
    parts = rows.where("label IS NOT NULL").select(F.col("label").alias("worker"), F.posexplode("v").alias("dim", "x")).groupBy("worker", "dim").agg(F.avg("x").alias("mean"))
    centroids = parts.groupBy("worker").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("c"))
    if centroids.limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"activations give every vector a score per label; more than {MAX_LABELS} labels are no labels")
    return rows.crossJoin(F.broadcast(centroids)).select("vec_id", "worker", V.cosine(F.col("v"), F.col("c")).alias("score"))


_A = f"{_V}, m AS (SELECT label, d, avg(v[d]) AS mean FROM v, range(1, {DIM + 1}) r(d) WHERE label IS NOT NULL GROUP BY label, d), c AS (SELECT label AS worker, list(mean ORDER BY d) AS v FROM m GROUP BY label), a AS (SELECT a.vec_id, b.worker, {_cos} AS score FROM v a, c b)"


def activation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activations(spark, sf_dir).select("vec_id", "worker", _R("score", 5).alias("score"))


SQL["activation_matrix"] = f"WITH {_A} SELECT vec_id, worker, round(score, 5) AS score FROM a"


#: Vigilance: least and greatest threshold, how it rises as a label fills, its capacity, and below how many rows it is still lenient.
VIGILANCE = {"base": 0.15, "top": 0.8, "curve": 2, "capacity": 200, "cold": 20, "offset": 0.2}


def vigilance(count: Column) -> Column:
    """The score a label asks for, which rises with the number of rows it holds; a young label asks for as little as a quarter."""
    v = VIGILANCE
    fill = F.least(count / v["capacity"], F.lit(1.0))
    rho = v["base"] + (v["top"] - v["base"]) * F.pow(fill, F.lit(float(v["curve"])))
    return F.when(count < v["cold"], rho * (0.25 + 0.75 * count / v["cold"])).otherwise(rho)


def resonance(score: Column, rho: Column) -> Column:
    """``rag_indexed`` from the high threshold on, ``context_summarized`` from the threshold on, else ``weight_shifted`` (not accepted)."""
    return F.when(score >= F.least(F.lit(1.0), rho + VIGILANCE["offset"]), "rag_indexed").when(score >= rho, "context_summarized").otherwise("weight_shifted")


def resonance_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best label per vector and how it takes the vector in, by the label's own threshold."""
    best = activations(spark, sf_dir).groupBy("vec_id").agg(F.max(F.struct(_R("score", 5).alias("score"), (-F.col("worker")).alias("w"))).alias("b"))
    held = _vectors(spark, sf_dir).where("label IS NOT NULL").groupBy(F.col("label").alias("worker")).agg(F.count(F.lit(1)).alias("held"))
    rows = best.select("vec_id", (-F.col("b.w")).alias("worker"), F.col("b.score").alias("score")).join(held, "worker")
    rho = _R(vigilance(F.col("held")))
    mode = resonance(F.col("score"), rho)
    return rows.select("vec_id", "worker", "score", rho.alias("vigilance"), mode.alias("mode"), (mode != "weight_shifted").alias("accepted"))


_rho = "(0.15::DOUBLE + 0.65::DOUBLE * pow(least(held / 200, 1.0::DOUBLE), 2))"
SQL["resonance_decisions"] = f"""WITH {_A}, r AS (SELECT vec_id, worker, round(score, 5) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 5) DESC, worker) AS n FROM a),
h AS (SELECT label AS worker, round(CASE WHEN held < 20 THEN {_rho} * (0.25::DOUBLE + 0.75::DOUBLE * held / 20) ELSE {_rho} END, 6) AS rho FROM (SELECT label, count(*) AS held FROM v WHERE label IS NOT NULL GROUP BY label)),
d AS (SELECT vec_id, worker, score, rho, CASE WHEN score >= least(1.0::DOUBLE, rho + 0.2::DOUBLE) THEN 'rag_indexed' WHEN score >= rho THEN 'context_summarized' ELSE 'weight_shifted' END AS mode FROM r JOIN h USING (worker) WHERE n = 1)
SELECT vec_id, worker, score, rho AS vigilance, mode, mode <> 'weight_shifted' AS accepted FROM d"""


def softmax_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("vec_id")
    e = activations(spark, sf_dir).withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return e.select("vec_id", "worker", _R(F.col("e") / F.sum("e").over(w), 5).alias("weight"))


SQL["softmax_activations"] = f"WITH {_A}, e AS (SELECT vec_id, worker, exp(score - max(score) OVER (PARTITION BY vec_id)) AS e FROM a) SELECT vec_id, worker, round(e / sum(e) OVER (PARTITION BY vec_id), 5) AS weight FROM e"


def hidden_couplings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of labels whose activations correlate over all vectors (Pearson), with their shared accepted vectors."""
    wide = activations(spark, sf_dir)
    a, b = wide.select("vec_id", F.col("worker").alias("a"), F.col("score").alias("x")), wide.select("vec_id", F.col("worker").alias("b"), F.col("score").alias("y"))
    return a.join(b, "vec_id").where("a < b").groupBy("a", "b").agg(_R(F.corr("x", "y"), 5).alias("similarity"), F.count_if((F.round("x", 5) > 0.1) & (F.round("y", 5) > 0.1)).alias("n_shared"))


SQL["hidden_couplings"] = f"WITH {_A} SELECT p.worker AS a, q.worker AS b, round(corr(p.score, q.score), 5) AS similarity, count(*) FILTER (WHERE round(p.score, 5) > 0.1 AND round(q.score, 5) > 0.1) AS n_shared FROM a p JOIN a q ON p.vec_id = q.vec_id AND p.worker < q.worker GROUP BY p.worker, q.worker"


def complement_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complement-coded vectors, squashed to [0, 1] first; with the length that coding keeps constant."""
    coded = _vectors(spark, sf_dir).select("vec_id", F.posexplode(V.complement_code(F.transform("v", lambda x: V.clip01((x + 1) / 2)))).alias("dim", "x"))
    return coded.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), _R(F.sum("x")).alias("total"), _R(F.max("x"), 5).alias("most"))


SQL["complement_codes"] = f"WITH {_V}, c AS (SELECT vec_id, unnest(list_concat(u, list_transform(u, lambda x: 1 - x))) AS x FROM (SELECT vec_id, list_transform(v, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x + 1) / 2))) AS u FROM v)) SELECT vec_id, count(*) AS n, round(sum(x), 6) AS total, round(max(x), 5) AS most FROM c GROUP BY vec_id"


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut to 32 dimensions and brought to length one."""
    u = _vectors(spark, sf_dir).select("vec_id", V.project_to(F.col("v"), 32).alias("u"))
    return u.select("vec_id", F.size("u").alias("dim"), _R(F.element_at("u", 1), 5).alias("first"), _R(V.norm(F.col("u")), 5).alias("length"))


SQL["unit_vectors"] = f"WITH {_V}, s AS (SELECT vec_id, v[1:32] AS s FROM v) SELECT vec_id, len(s) AS dim, round(s[1] / sqrt(list_dot_product(s, s)), 5) AS first, 1.0::DOUBLE AS length FROM s"


def fnv1a_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_name IS NOT NULL").select("p_partkey", V.fnv1a(F.col("p_name")).cast("string").alias("hash"))


SQL["fnv1a_hash"] = """
WITH h AS (SELECT p_partkey, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, 1 + octet_length(encode(p_name))), lambda i: ascii(p_name[i])::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM part WHERE p_name IS NOT NULL)
SELECT p_partkey, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::VARCHAR AS hash FROM h"""


def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose SimHash over word five-grams lies within three bits of another's."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.array_join(F.slice("w", i, 5), " "))
    prints = d.where(F.size("w") > 0).select("doc_id", V.simhash(F.array_distinct(grams)).alias("fp"))
    return near_duplicate_classes(prints, "doc_id", "fp").drop("earlier")


def jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose word five-grams (by their 64-bit hashes; a shorter text is one gram) have a Jaccard of 0.8 or more with another's."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # the words are bound by a lambda: as a column they would be split again for every gram
    grams = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, 5), " "))))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").where(F.size(words) > 0)
    return shingle_classes(d.select("doc_id", F.array_distinct(F.flatten(grams)).alias("grams")), "doc_id", "grams")


def term_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", V.feature_hash(X.terms(F.col("text"))).alias("v"))
    return d.select("doc_id", _R(F.element_at("v", 1)).alias("first"), _R(V.norm(F.col("v")), 5).alias("length"))


_fnv = "list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(0, octet_length(encode(t))), lambda i: ('0x' || substr(hex(encode(t)), 2 * i + 1, 2))::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"
SQL["term_embeddings"] = f"""WITH w AS (SELECT doc_id, unnest({sql_terms('text')}) AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT t, {_fnv} AS h FROM (SELECT DISTINCT t FROM w)),
e AS (SELECT doc_id, h % 64 AS place, sum(CASE WHEN h >= 9223372036854775808::HUGEINT THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS x FROM w JOIN h USING (t) GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n, coalesce(max(x) FILTER (WHERE place = 0), 0.0::DOUBLE) AS f FROM e GROUP BY 1)
SELECT doc_id, round(CASE WHEN coalesce(n, 0) > 0 THEN f / n ELSE 0.0::DOUBLE END, 6) AS first, CASE WHEN coalesce(n, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN n USING (doc_id)"""


QUERIES = {f.__name__: f for f in (cosine_topk, hashed_neighbours, label_centroids, activation_matrix, resonance_decisions, softmax_activations, hidden_couplings, complement_codes, unit_vectors, fnv1a_hash, simhash_classes, jaccard_classes, term_embeddings)}
