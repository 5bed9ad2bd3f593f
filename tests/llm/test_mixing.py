import math

import pytest

from lodestream.llm.mixing import count_tokens, mix_plan, mix_report, mixed_documents, poisson_thresholds, solve_rate


def poisson_quantile(u, rate, cap):
    """Brute force: the least k at which the Poisson distribution of mean ``rate`` reaches ``u``, cut at ``cap``."""
    term = total = math.exp(-rate)
    k = 0
    while total < u and k < cap:
        k += 1
        term *= rate / k
        total += term
    return k


def test_thresholds_are_the_inverse_distribution():
    for rate in (0.05, 0.9, 3.3, 40.0):
        marks = poisson_thresholds(rate, 60)
        for k in range(1, 500):
            assert sum(m < k / 500 for m in marks) == poisson_quantile(k / 500, rate, 60)


def test_poisson_quantile_inverts_the_distribution():
    for rate in (0.1, 1.0, 4.5):
        total = 0.0
        for k in range(8):
            p = math.exp(-rate) * rate**k / math.factorial(k)
            assert poisson_quantile(total + p / 2, rate, 50) == k
            total += p
    assert poisson_quantile(0.999999, 5.0, 3) == 3


def test_solved_rate_meets_the_goal():
    bins = {b: 10 for b in range(4096)}
    for goal, cap in ((5_000, 1), (60_000, 2), (100_000, 4)):
        rate = solve_rate(bins, goal, cap)
        got = sum(10 * poisson_quantile((b + 0.5) / 4096, rate, cap) for b in bins)
        assert abs(got - goal) <= 0.01 * goal


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, source string, text string, n_tokens string, u double")


TARGETS = [("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 5), ("none", 0.1, 3), (None, 0.1, 1), ("zero", 0.0, 3)]


def test_shares_caps_and_order(spark):
    rows = [(k, "a", "word " * (k % 50 + 1)) for k in range(2000)] + [(k, "b", "long text " * 30) for k in range(2000, 4000)] + [(k, "c", "tiny") for k in range(4000, 9000)]
    rows += [(None, "a", "x"), (9001, None, "x"), (9002, "other", "x"), (9003, "a", None), (9004, "a", "")]
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    plan = mix_plan(docs(spark, rows), targets).persist()
    report = {r["source"]: r for r in mix_report(plan, targets).collect()}
    for s, share, cap in TARGETS[:3]:
        assert abs(report[s]["reached_share"] - share) < 0.01 and report[s]["most_repeats"] <= cap
    assert report["none"]["reached_share"] == 0.0
    mix = [r["position_key"] for r in mixed_documents(plan).collect()]
    assert mix == sorted(mix) and len(mix) == plan.agg({"repeats": "sum"}).first()[0]
    again = {tuple(r) for r in mix_plan(docs(spark, rows), targets).collect()}
    assert again == {tuple(r) for r in plan.collect()}


def test_empty(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert mix_plan(docs(spark, []), targets).count() == 0
    assert mix_plan(docs(spark, [(1, "a", "x")]), targets.where("false")).count() == 0
    assert mix_report(mix_plan(docs(spark, []), targets), targets).count() == 5


@pytest.mark.parametrize("text,n", [("", 0), (None, 0), ("hello world", 2)])
def test_token_counts(spark, text, n):
    assert count_tokens(spark.createDataFrame([(text,)], "text string")).first()["n_tokens"] == n
