"""Hand-computed cases of the votes, thresholds and scores."""

import math

import pytest

from lodestream.functions import scoring as S, text as X
from lodestream.plans import pipeline_queries as P, vector_queries as Q
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n,rho", [(0, 0.15 * 0.25), (10, (0.15 + 0.65 * 0.05**2) * 0.625), (20, 0.15 + 0.65 * 0.01), (100, 0.15 + 0.65 * 0.25), (200, 0.8), (5000, 0.8)])
def test_vigilance_rises_as_a_label_fills(spark, n, rho):
    assert value(spark, Q.vigilance(F.lit(n))) == pytest.approx(rho)


@pytest.mark.parametrize("score,rho,mode", [(0.1, 0.15, "weight_shifted"), (0.15, 0.15, "context_summarized"), (0.34, 0.15, "context_summarized"), (0.36, 0.15, "rag_indexed"), (0.99, 0.9, "context_summarized"), (1.0, 0.9, "rag_indexed")])
def test_resonance(spark, score, rho, mode):
    assert value(spark, Q.resonance(F.lit(score), F.lit(rho))) == mode


@pytest.mark.parametrize("votes,want", [((0.61, 0.1, 0.0), ("surface", "resolved")), ((0.6, 0.1, 0.0), ("store", "flagged")), ((0.1, 0.2, 0.31), ("store", "flagged")), ((0.3, 0.1, 0.0), ("store", "open")), ((0.0, 0.0, 0.7), ("ignore", "resolved")), ((0.0, 0.0, 0.0), ("store", "open"))])
def test_unresolved_votes_store(spark, votes, want):
    c = P.consensus({a: F.lit(v) for a, v in zip(P.ACTIONS, votes)})
    assert (value(spark, c["action"]), value(spark, c["status"])) == want


def test_ballots():
    assert P.ballot("engineering", "reviewer", "technical") == ("surface", round(0.95 * 0.95 * 0.95 * 0.9, 6))
    assert P.ballot("engineering", "reviewer", "business")[0] == "store"  # sure, but the domain weighs 0.3
    assert P.ballot("people", "reviewer", "technical")[0] == "ignore"
    assert P.ballot("people", "reviewer", "unheard of") == ("ignore", 0.0)


def test_channel_shift_counts_work_private_and_public(spark, tmp_path):
    from lodestream.plans.activity_queries import channel_shift

    rows = [("slack", "#priv-deals", "{}")] * 3 + [("slack", "#general", "{}"), ("github", "priv-repo", "{}"), ("linear", "T-1", '{"state": "Done"}'), ("linear", "T-1", '{"status": "Cancelled"}')]
    spark.createDataFrame([(k, "pricing", s, c, "a", m, None) for k, (s, c, m) in enumerate(rows)], "delivery_no long, content string, source string, channel string, author string, metadata string, received_at timestamp").write.parquet(f"{tmp_path}/signals.parquet")
    got = channel_shift(spark, str(tmp_path)).collect()
    # three private, two public (a cancelled ticket is no work), two work: 3/5 x (0.5 + 0.5 x 2/5)
    assert [(r["term"], r["n_public"], r["n_private"], r["n_work"], r["score"], r["migrated"]) for r in got] == [("pricing", 2, 3, 2, 0.42, True)]


def test_finding_scores(spark):
    risk = lambda *a: value(spark, S.risk_coupling(*map(F.lit, a)))
    assert risk("RISK", "medium", "all is well", "", "active") == pytest.approx(0.8)
    assert risk("contradiction", "critical", "deploy to production broke billing and auth", "discovery", "active") == 1.0
    assert risk("overlap", "low", "a rollback", "retrieval", "historical") == pytest.approx((0.55 - 0.1 + 0.05) * 0.5 * 0.6)
    assert risk("unknown", "low", "", "retrieval", "stale") == pytest.approx(0.05)
    assert value(spark, S.communicability(F.lit(0.8), F.lit(3), F.lit(2))) == pytest.approx(1 / (1 + math.exp(-3 * (0.8 * 0.6 + 0.9 * 0.4))))
    assert value(spark, S.entity_confidence(F.lit(4), F.lit(2))) == pytest.approx(0.625) and value(spark, S.entity_confidence(F.lit(0), F.lit(0))) == 0.3
    assert value(spark, S.bridge_distance(F.lit(None).cast("double"), F.lit(1.0))) == 0.95
    assert value(spark, S.bridge_distance(F.lit(2.0), F.lit(math.e - 1))) == pytest.approx(0.5)


@pytest.mark.parametrize("times,days,retrieval,ratio,changed,stage", [(1, 99, True, 0.05, False, "active"), (2, 1, False, -1.0, False, "deferred"), (3, 14, False, -1.0, False, "normalized"), (3, 13, False, -1.0, False, "deferred"), (2, 7, True, -1.0, False, "normalized"), (2, 7, False, 0.05, False, "normalized"), (2, 6, True, -1.0, False, "deferred"), (5, 50, True, -1.0, True, "acknowledged")])
def test_decay_stages(spark, times, days, retrieval, ratio, changed, stage):
    assert value(spark, S.decay_stage(F.lit(times), F.lit(days), F.lit(retrieval), F.lit(ratio), F.lit(changed))) == stage


def test_surfacing(spark):
    assert value(spark, S.surface_value(F.lit(0.8), F.lit(0.5))) == pytest.approx(0.25)
    assert [value(spark, S.annoyance_weight(F.lit(a), F.lit(b))) for a, b in ((0, 0), (0, 4), (4, 0), (2, 2))] == pytest.approx([0.3, 0.15, 0.45, 0.3])


def test_policy_signals(spark):
    files = F.array(F.lit("src/data/pricing/engine.ts"), F.lit("src/pms/availability/sync.ts"), F.lit("src/auth/middleware.ts"))
    got = {r["kind"]: r["detail"] for r in value(spark, S.policy_signals(files, F.lit(501)))}
    assert got == {"dependency_crossing": "auth,availability,pricing", "auth_surface_touched": "src/auth/middleware.ts", "high_churn": "501"}
    assert value(spark, S.policy_signals(F.array(F.lit("docs/authors.md")), F.lit(500))) == []


def test_coefficients(spark):
    flat = F.array(*[F.lit(1.0)] * 10)
    c = {n: value(spark, x) for n, x in S.transaction_coefficients(flat, flat, F.lit(0), F.lit(0)).items()}
    assert c["fan"] == 0.5 and c["relay"] == c["variance"] == c["divergence"] == c["density"] == c["complexity"] == 0.0 and c["frag"] == pytest.approx(1 / (1 + math.exp(2.4)))
    one = {n: value(spark, x) for n, x in S.transaction_coefficients(F.array(*[F.lit(0.0)] * 9, F.lit(10.0)), flat, F.lit(1), F.lit(3)).items()}
    assert one["variance"] == 1.0 and one["density"] == 0.1 and one["fan"] == 0.75 and one["relay"] == pytest.approx(0.5 * 0.5)
    none = dict.fromkeys(("txs", "sent", "mean", "max", "gap_mean", "gap_max", "gap_median", "lifetime", "fee_share", "partners", "repeated"), F.lit(0))
    assert [value(spark, x) for x in S.wallet_coefficients(none).values()] == [0.5, 0, 0, 0, 0, 0, 0]


def test_weights_out_of_range_are_an_error(spark):
    raw, effective = S.business_weight([F.lit(0.0)] * 4)
    assert (value(spark, raw), value(spark, effective)) == (0.0, 0.1)
    assert value(spark, S.business_weight([F.lit(1.0), F.lit(0.5), F.lit(0.5), F.lit(0.0)])[0]) == 0.5
    with pytest.raises(Exception, match="outside 0 to 1"):
        value(spark, S.business_weight([F.lit(1.1)] + [F.lit(0.0)] * 3)[0])


def test_finding_hash_forgets_the_order_of_words(spark):
    h = lambda kind, text, *actors: value(spark, X.finding_hash(F.lit(kind), F.lit(text), F.array(*map(F.lit, actors)) if actors else F.array().cast("array<string>")))
    same = h("Coordinated investigation", "coupon/discount logic in PR #42, see SERV-7 @bob", "Ann", "bob")
    assert same == h("coordinated_investigation", "see discount/coupon logic in PR #42, SERV-7 @bob", "bob", "ann ")
    assert same != h("coordinated_investigation", "see discount/coupon logic in PR #43, SERV-7 @bob", "bob", "ann")
    assert len(same) == 16 and h("x", "") == h("x", " ")
