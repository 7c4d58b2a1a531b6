"""Statistics against hand-computed values and brute force."""

import itertools
import math

import pytest

from lumiform.operators import answer, effect, resample, study

FORMATS = ("yaml", "json", "toml", "inline_kv", "markdown")


def scores_of(spark, **columns):
    rows = [(i, f, k, float(v)) for k, (f, values) in enumerate(columns.items()) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "record_id long, format string, fpos int, score double")


def test_paired_effect(spark):
    d = effect.pairwise_d(scores_of(spark, yaml=[1, 2, 3, 4], json=[2, 4, 4, 4]), ["record_id"]).first()
    assert d["mean_diff"] == -1.0 and d["d"] == pytest.approx(-1.41421356)


def test_equal_scores_have_no_extreme_pair(spark):
    m = effect.max_abs_d(effect.pairwise_d(scores_of(spark, yaml=[1, 2], json=[1, 2]), ["record_id"])).first()
    assert m["max_abs_d"] == 0.0 and m["pair"] is None


def test_spearman_and_constant(spark):
    rho = {r["pair"]: r["rho"] for r in effect.spearman(scores_of(spark, a=[1, 2, 3], b=[3, 2, 1], c=[5, 5, 5]), ["record_id"]).collect()}
    assert rho["a-b"] == pytest.approx(-1) and rho["a-c"] is None


def test_wilcoxon(spark):
    w = effect.wilcoxon(scores_of(spark, a=[1, 2, 3, 4], b=[2, 4, 4, 4]), ["record_id"]).first()
    assert (w["n"], w["w_plus"], w["w_minus"]) == (3, 0.0, 6.0)
    assert effect.wilcoxon_exact_p(0, 3) == 0.25 and effect.normal_p(0.0) == 1.0


def tensor_rows(spark, values):
    """values: {(query, cand, format): score}"""
    rows = [("m", "a", 0, q, c, f, FORMATS.index(f), float(s)) for (q, c, f), s in values.items()]
    return spark.createDataFrame(rows, "model string, arm string, seed int, query_id long, cand int, format string, fpos int, score double")


@pytest.mark.parametrize("gold, negatives, rr", [(5, [1, 2, 3], 1.0), (1, [2, 3, 4], 0.25), (2, [2, 2], 1.0)])
def test_reciprocal_rank(spark, gold, negatives, rr):
    t = tensor_rows(spark, {(0, c, "yaml"): s for c, s in enumerate([gold, *negatives])})
    assert answer.leads(t).first()["rr"] == rr


def test_mixed_lead_equals_enumeration(spark):
    formats = FORMATS[:3]
    values = {(0, c, f): s for c, row in enumerate([[3, 1, 2], [2, 2, 4], [1, 3, 0]]) for f, s in zip(formats, row, strict=True)}
    p = study.mixed_lead(tensor_rows(spark, values)).first()["p"]
    wins = [values[0, 0, a] >= max(values[0, 1, b], values[0, 2, c]) for a, b, c in itertools.product(formats, repeat=3)]
    assert p == pytest.approx(sum(wins) / len(wins))


def test_within_query_ties_are_not_comparable(spark):
    t = tensor_rows(spark, {(0, c, f): s for f, row in (("yaml", [1, 1, 2]), ("json", [2, 1, 0])) for c, s in enumerate(row)})
    w = answer.within_query(t).first()
    assert w["flip_pct"] == 100.0 and w["top1_changed_pct"] == 100.0


def test_holm_is_monotone_and_capped(spark):
    rows = resample.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "model string, p double")).orderBy("p").collect()
    assert [r["holm_p"] for r in rows] == pytest.approx([0.04, 0.09, 0.09, 0.9])


def test_sign_test():
    assert resample.sign_test_p(5, 0) == pytest.approx(2 / 32) and resample.sign_test_p(0, 0) is None


def test_select_winner(spark):
    columns = "value double, d double, d_lo double, d_hi double, mrr_lo double, mrr_hi double"
    rows = [(0.1, 0.30, 0.2, 0.4, -0.01, 0.02), (0.2, 0.25, 0.2, 0.3, -0.02, 0.01), (0.4, 0.28, 0.2, 0.35, 0.0, 0.03), (0.8, 0.1, 0.05, 0.15, -0.05, 0.0)]
    out = {r["value"]: r for r in resample.select_winner(spark.createDataFrame(rows, columns)).collect()}
    assert not out[0.8]["survives"] and out[0.2]["winner"] and sum(r["winner"] for r in out.values()) == 1
    none = resample.select_winner(spark.createDataFrame(rows[3:], columns)).first()
    assert not none["winner"] and not none["tied"]


def test_bootstrap_is_the_same_in_any_partitioning(spark):
    values = spark.createDataFrame([(i, float(i % 7)) for i in range(40)], "idx long, v double")
    a, b = (resample.interval(resample.replicate_means(v, ["v"], 30), "v").first() for v in (values, values.repartition(7)))
    assert a == b and a["lo"] <= a["mean"] <= a["hi"]


def test_empty_scores(spark):
    none = scores_of(spark).limit(0)
    assert effect.pairwise_d(none, ["record_id"]).count() == 0 and math.isclose(effect.max_abs_d(effect.pairwise_d(none, ["record_id"])).first()["max_abs_d"], 0.0)
