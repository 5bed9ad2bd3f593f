import itertools
import random

import numpy as np

from lodestream.functions import text as X, vectors as V
from lodestream.operators import graphs as G, similarity as S, windows as W
from lodestream.operators.skew import hot_keys, join_unique
from pyspark.sql import functions as F


def test_strong_components_against_brute_force(spark):
    rnd = random.Random(5)
    arcs = [(f"v{rnd.randrange(25)}", f"v{rnd.randrange(25)}") for _ in range(45)] + [(None, "v1"), ("v2", None)]
    got = {}
    for r in G.strongly_connected(spark.createDataFrame(arcs, "src string, dst string")).collect():
        got.setdefault(r["scc"], set()).add(r["v"])
    reach = {v: {v} for a in arcs for v in a if v}
    for _ in reach:
        for a, b in arcs:
            if a and b:
                for v, s in reach.items():
                    if a in s:
                        s.add(b)
    want = {frozenset(w for w in reach if w in reach[v] and v in reach[w]) for v in reach}
    assert {frozenset(s) for s in got.values()} == {w for w in want if len(w) > 1}


def test_long_cycles_and_chains_are_whole(spark):
    n = 2000
    arcs = [(k, (k + 1) % n) for k in range(n)] + [(k, k + 1) for k in range(5000, 5300)] + [(9000, 9001), (9001, 9000), (9001, 9002), (9002, 9001), (100, 9000)]
    got = {}
    for r in G.strongly_connected(spark.createDataFrame(arcs, "src long, dst long")).collect():
        got.setdefault(r["scc"], set()).add(r["v"])
    assert got == {0: set(range(n)), 9000: {9000, 9001, 9002}}


def test_distances_and_components_do_not_end_early(spark):
    path = [(k, k + 1) for k in range(70)]
    ties = spark.createDataFrame(path + [(b, a) for a, b in path], "v long, nb long")
    got = {r["v"]: r["hops"] for r in G.hop_distances(ties, spark.createDataFrame([(0,), (None,)], "v long")).collect()}
    assert got == {k: k for k in range(71)}
    chain = spark.range(20_000).selectExpr("id AS a", "id + 1 AS b")
    roots = G.components(chain, "a", "b").groupBy("root").count().collect()
    assert [(r["root"], r["count"]) for r in roots] == [(0, 20_001)]


def test_triangles_and_components(spark):
    rnd = random.Random(6)
    e = {tuple(sorted((rnd.randrange(20), rnd.randrange(20)))) for _ in range(60)}
    e = {x for x in e if x[0] != x[1]}
    ties = spark.createDataFrame([(a, b) for a, b in e] + [(b, a) for a, b in e], "v long, nb long")
    got = {frozenset(r) for r in G.triangles(ties).collect()}
    assert got == {frozenset(t) for t in itertools.combinations(range(20), 3) if all(tuple(p) in e for p in itertools.combinations(t, 2))}
    root = {r["v"]: r["root"] for r in G.components(spark.createDataFrame(sorted(e), "a long, b long"), "a", "b").collect()}
    assert all(root[a] == root[b] for a, b in e) and all(v == min(w for w in root if root[w] == v) for v in root.values())


def test_near_duplicate_classes_are_exact(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = [(k, p) for k, p in enumerate(base)]
    for p in base[:20]:
        for flips in (1, 2, 3, 4):
            q = p
            for b in rnd.sample(range(64), flips):
                q ^= 1 << b
            prints.append((len(prints), q))
    prints += [(len(prints), base[0]), (len(prints) + 1, base[39])]
    signed = [(k, p - (1 << 64) if p >= 1 << 63 else p) for k, p in prints] + [(999, None)]
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in S.near_duplicate_classes(spark.createDataFrame([(*s, "x") for s in signed], "doc long, fp long, id string"), "doc", "fp").collect()}
    distinct = {p for _, p in prints}
    links = {p: {q for q in distinct if q != p and bin(p ^ q).count("1") <= 3} for p in distinct}
    for k, p in prints:
        same = sum(1 for _, q in prints if q == p) > 1
        assert (k in got) == bool(same or links[p])
        if k in got:
            assert got[k][1] == len(links[p])


def test_changed_documents_are_classed_by_their_five_grams(spark, tmp_path):
    from lodestream.plans import vector_queries as Q

    rnd = random.Random(8)
    texts = [[rnd.choice("abcdefghij") + str(rnd.randrange(300)) for _ in range(rnd.randrange(60, 140))] for _ in range(30)]
    for t in texts[:30]:
        for changed in (0, 1, 2, 3):
            u = list(t)
            for k in rnd.sample(range(len(u)), changed):
                u[k] = "new" + str(rnd.randrange(1000))
            texts.append(u)
    texts += [["one", "two"], ["one", "two"], ["three"]]
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)] + [(999, None), (998, " .")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = [frozenset(" ".join(t[i : i + 5]) for i in range(max(1, len(t) - 4))) for t in texts]
    links = {k: {h for h in grams if h != g and 10 * len(g & h) >= 8 * len(g | h)} for k, g in enumerate(grams)}
    got = {r["id"]: (r["class_id"], r["n_links"]) for r in Q.jaccard_classes(spark, str(tmp_path)).collect()}
    assert {k: len(h) for k, h in links.items() if h or grams.count(grams[k]) > 1} == {k: n for k, (_, n) in got.items()}
    assert all(got[j][0] == got[k][0] for k in got for j in got if grams[j] in links[k] or grams[j] == grams[k])
    simhash = {r["id"] for r in Q.simhash_classes(spark, str(tmp_path)).collect()}
    assert sum(1 for k, h in links.items() if h and k not in simhash) > 0


def _join_of_links(spark, monkeypatch, query, tmp_path):
    """The plan by which a query joins its index of fingerprints with itself, and its rows."""
    plans, real = [], S.materialize

    def spy(df, name="t", *rest):
        if name == "links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, *rest)

    monkeypatch.setattr(S, "materialize", spy)
    texts = ["alpha beta gamma delta epsilon zeta eta", "one two three four five six seven eight"]
    spark.createDataFrame([(k, texts[k % 2] if k < 4 else f"a text of its own {k}") for k in range(8)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = query(spark, str(tmp_path)).collect()
    return plans[0], rows


def test_simhash_index_is_not_broadcast(spark, tmp_path, monkeypatch):
    from lodestream.plans import vector_queries as Q

    plan, rows = _join_of_links(spark, monkeypatch, Q.simhash_classes, tmp_path)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r["id"], r["class_id"]) for r in rows} >= {(0, 0), (2, 0), (1, 1), (3, 1)}


def test_first_earlier_duplicate_of_every_document(spark, tmp_path, monkeypatch):
    from lodestream.plans import mesh_queries as Q

    # 1, 2, 4 are a chain that its last closes, 5, 6, 7 one in order, 8 copies 7; 9, 10 are four bits apart, the others have no fingerprint
    base = 0x0F0F_3C3C_55AA_1234
    prints = {1: 0, 2: 0b111111, 4: 0b000111, 5: base, 6: base ^ 0b111, 7: base ^ 0b111111, 8: base ^ 0b111111, 9: ~base, 10: ~base ^ 0b1111 << 59, 11: None, 12: None}
    words = {f"term{k}": p for k, p in prints.items() if p is not None}
    monkeypatch.setattr(Q.V, "simhash", lambda terms: F.create_map(*[F.lit(x) for w in words.items() for x in w])[F.try_element_at(terms, F.lit(1))])
    spark.createDataFrame([(k, f"term{k}" if p is not None else "to be") for k, p in prints.items()] + [(13, None), (None, "term1")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = Q.duplicate_texts(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["earlier"] or 0, r["class_id"], r["n_members"], r["kept"]) for r in rows) == [(1, 0, 1, 3, 1), (2, 0, 1, 3, 1), (4, 1, 1, 3, 1), (5, 0, 5, 4, 5), (6, 5, 5, 4, 5), (7, 6, 5, 4, 5), (8, 6, 5, 4, 5)]


def test_duplicate_texts_against_brute_force(spark, tmp_path):
    from lodestream.plans import mesh_queries as Q

    rnd = random.Random(9)
    texts = [[f"word{rnd.randrange(3000)}" for _ in range(300)] for _ in range(12)]
    for t in texts[:12]:
        for changed in (0, 1, 1, 2, 4, 8):
            u = list(t)
            for k in rnd.sample(range(len(u)), changed):
                u[k] = f"new{rnd.randrange(1000)}"
            texts.append(u)
    rnd.shuffle(texts)
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fp = {r[0]: r[1] for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", V.simhash(X.terms(F.col("text")))).collect()}
    near = {k: [j for j in fp if j != k and bin((fp[j] ^ fp[k]) & (1 << 64) - 1).count("1") <= 3] for k in fp}
    rows = Q.duplicate_texts(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["earlier"] for r in rows} == {k: min((j for j in n if j < k), default=None) for k, n in near.items() if n}
    cls = {r["doc_id"]: r["class_id"] for r in rows}
    assert len(cls) == len(rows) and all(cls[j] == cls[k] for k in cls for j in near[k]) and any(r["earlier"] is None for r in rows)
    assert all(r["kept"] == r["class_id"] and r["n_members"] == list(cls.values()).count(r["class_id"]) for r in rows)


def test_hashed_search_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    q = rows.where("vec_id % 100 = 0")
    exact = {(r["query_id"], r["id"]) for r in S.nearest_exact(q, rows, "vec_id", "v", 5).collect()}
    hashed = {(r["query_id"], r["id"]) for r in S.nearest_hashed(q, rows, "vec_id", "v", 64, 5, tables=48, planes=5).collect()}
    assert len(exact & hashed) >= 0.9 * len(exact)


def test_registered_hashed_search_finds_the_nearest(spark, small):
    from lodestream.plans import vector_queries as Q

    exact = {(r["query_id"], r["id"]) for r in Q.cosine_topk(spark, small).collect()}
    assert len(exact & {(r["query_id"], r["id"]) for r in Q.hashed_neighbours(spark, small).collect()}) >= 0.9 * len(exact)


def test_buckets_are_passed_over_only_by_proof(spark):
    rnd = np.random.RandomState(3)
    centres = rnd.randn(12, 16)
    vectors = [(k, (centres[k % 12] + 0.02 * rnd.randn(16)).tolist()) for k in range(600)] + [(600, [0.0] * 16), (601, centres[0].tolist())]
    rows = spark.createDataFrame(vectors, "id long, v array<double>")
    q = rows.where("id % 50 = 0")
    exact, celled = ({(r["query_id"], r["id"], r["rank"]) for r in f.collect()} for f in (S.nearest_exact(q, rows, "id", "v", 5), S.nearest_in_cells(q, rows, "id", "v", 16, 5)))
    assert exact == celled


def test_hot_keys_and_join(spark):
    big = spark.range(40_000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id")
    hot = hot_keys(big, "k", least=100)
    assert hot == [7]
    unique = big.select("k").distinct().withColumn("x", F.col("k") * 2)
    got = join_unique(big, unique, "k", hot)
    assert got.count() == 40_000 and got.where("x <> k * 2").count() == 0


def test_moving_average_equals_the_full_fold(spark):
    rnd = np.random.RandomState(0).rand(400)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(rnd)] + [("b", 1, 0.5), ("b", 2, None), (None, 1, 1.0)], "k string, t int, v double")
    e = rnd[0]
    for v in rnd[1:]:
        e = 0.3 * v + 0.7 * e
    got = {r["k"]: r for r in W.ema(df, "k", ["t"], "v").collect()}
    assert abs(got["a"]["ema"] - e) < 1e-12 and got["a"]["n"] == 400 and got["b"]["ema"] == 0.5 and got["b"]["previous"] is None


def test_text_expressions_on_odd_input(spark):
    texts = [None, "", " \n", "🙂", "ok", "a.b. C! <b>Bold</b> http://x.y 1.2.3 --- café CAFÉ", "word " * 50_000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r for r in df.select("k", X.terms(F.col("t")).alias("terms"), F.size(X.sentences(F.col("t"))).alias("n"), X.token_entropy(X.words(F.col("t"))).alias("h"), *[c.alias(n) for n, c in X.style_measures(X.sentences(F.col("t"))).items()]).collect()}
    assert got[1]["terms"] == [] and got[1]["specificity"] == 1.0 and got[5]["terms"] == ["a.b", "bold", "café"] and got[6]["terms"] == ["word"]
