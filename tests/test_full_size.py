"""Resampling at the reference's sizes: the queries' counts, and the operators against loops."""

import hashlib
import statistics

import numpy as np
import pytest

from lumiform import catalogue
from lumiform.operators import resample

VALUES = [0.5, -0.25, 1.0, 0.75, -0.5, 0.25]


def mixed(x):
    x ^= x >> 16
    x = x * 2246822507 % 2**32
    x ^= x >> 13
    x = x * 3266489909 % 2**32
    return x ^ x >> 16


def number(purpose, key, slot, block=0):
    raw = hashlib.md5(f"0|{purpose}|{key}".encode()).hexdigest()
    a, c = int(raw[:8], 16), int(raw[8:16], 16) ^ block * 2246822519 % 2**32
    return mixed(mixed((slot * 2654435769 + a) % 2**32) ^ c)


def test_counts(spark, sf):
    assert catalogue.QUERIES["bootstrap_mean_ci"](spark, sf).first()["n"] == 10_000
    assert catalogue.QUERIES["sign_flip_permutation"](spark, sf).first()["p_floor"] == round(1 / 20_001, 6)


@pytest.mark.parametrize("name, size", [("hard_negatives", 25), ("candidate_lists", 15), ("train_lists", 7)])
def test_list_sizes(spark, sf, name, size):
    sizes = {r["count"] for r in catalogue.QUERIES[name](spark, sf).groupBy("query_id").count().collect()}
    assert sizes == {size}


def test_against_loops(spark):
    values = spark.createDataFrame(list(enumerate(VALUES)), "idx long, v double")
    n = len(VALUES)
    want = {b: sum(VALUES[number("draw", b, slot) % n] for slot in range(n)) / n for b in range(1000)}
    got = {r["b"]: r["v"] for r in resample.replicate_means(values, ["v"], 1000).collect()}
    assert got == pytest.approx(want)
    sign = lambda p, i: 1 - 2 * (number("sign", p // 32, i) >> p % 32 & 1)
    flips = [abs(sum(v * sign(p, i) for i, v in enumerate(VALUES)) / n) for p in range(2000)]
    as_extreme = sum(round(m, 9) >= round(sum(VALUES) / n, 9) for m in flips)
    assert resample.sign_flips(values, "v", 2000).first()["p"] == pytest.approx((1 + as_extreme) / 2001)


def test_blocks_draw_as_one(spark):
    """Several blocks: every replicate draws n rows, each block as many as its node of the tree says, whatever the partitions."""
    n, n_boot = 3 * resample.BLOCK + 100, 40
    draw = np.random.default_rng(1)
    x = draw.normal(5, 2, n)
    counts = np.stack([resample.block_counts(0, n_boot, n, k) for k in range(4)])
    assert (counts.sum(0) == n).all() and counts.std(1).min() > 5
    want = np.zeros(n_boot)
    for k in range(4):
        part = x[k * resample.BLOCK : (k + 1) * resample.BLOCK]
        for b in range(0, n_boot, 13):
            want[b] += sum(part[number("draw", b, s, k) % len(part)] for s in range(counts[k, b]))
    values = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx long, v double")
    a, b = ({r["b"]: r["v"] for r in resample.replicate_means(v, ["v"], n_boot).collect()} for v in (values, values.repartition(7).sortWithinPartitions("v")))
    assert a == pytest.approx(b) and [a[i] for i in range(0, n_boot, 13)] == pytest.approx((want / n)[::13])


def test_spread_of_replicates(spark):
    """The replicates of a mean spread as theory says, in one block and in several."""
    draw = np.random.default_rng(2)
    for n in (500, 2 * resample.BLOCK):
        x = draw.normal(0, 1, n)
        means = [r["v"] for r in resample.replicate_means(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "idx long, v double"), ["v"], 2000).collect()]
        assert statistics.stdev(means) == pytest.approx(x.std() / n**0.5, rel=0.08) and abs(statistics.mean(means) - x.mean()) < 4 * x.std() / (n * 2000) ** 0.5 + 1e-3


def test_nulls_keys_and_several_columns(spark):
    rows = [("a", i, float(i), None if i == 1 else 1.0) for i in range(5)] + [("b", i, 2.0, 3.0) for i in range(3)]
    got = resample.replicate_means(spark.createDataFrame(rows, "k string, idx long, u double, v double"), ["u", "v"], 64, keys=("k",)).collect()
    assert len(got) == 128 and {(r["u"], r["v"]) for r in got if r["k"] == "b"} == {(2.0, 3.0)} and {r["v"] for r in got if r["k"] == "a"} <= {1.0, None}
    draws = {b: [number("draw", b, s) % 5 for s in range(5)] for b in range(64)}
    assert {r["b"]: r["u"] for r in got if r["k"] == "a"} == pytest.approx({b: sum(d) / 5 for b, d in draws.items()})


def test_effects_against_loops(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(0.3, 1, (30, 2))
    rows = [(i, p, float(x[i, j])) for i in range(30) for j, p in enumerate(("p", "q"))]
    got = {r["b"]: r["d"] for r in resample.replicate_d(spark.createDataFrame(rows, "idx long, pair string, diff double"), 50).collect()}
    want = {b: max(abs(y.mean() / (y.std() + 1e-12)) for y in x[[number("draw", b, s) % 30 for s in range(30)]].T) for b in range(50)}
    assert got == pytest.approx(want)


def test_study_tables(spark, sf):
    for name in ("contrast_table", "agreement_table", "training_level_contrast_table"):
        rows = catalogue.QUERIES[name](spark, sf).collect()
        assert {r["model"] for r in rows} == {"m1", "m2"} and all(r["ci_lo"] <= r["diff"] <= r["ci_hi"] and r["p"] <= r["holm_p"] and r["resolved"] == (r["holm_p"] < 0.05) for r in rows)
    told = {(r["model"], r["arm"]): r["mixed"] for r in catalogue.QUERIES["levels_table"](spark, sf).collect()}
    for r in catalogue.QUERIES["guardrail_table"](spark, sf).collect():
        assert r["delta"] == pytest.approx(r["mixed_top1"] - r["uniform_best_mrr"], abs=2e-6) and r["kept"] == (r["delta"] > -0.03)
        assert r["arm"] != "untrained" or r["mixed_top1"] == told[r["model"], "untrained"]


def test_paired_by_hand(spark):
    from lumiform.operators import study

    schema = "model string, query_id long, diff double"
    r = study.paired(spark.createDataFrame([("a", i, 0.5) for i in range(20)] + [("b", i, (-1.0) ** i) for i in range(20)], schema), 200, 400).orderBy("model").collect()
    assert (r[0]["diff"], r[0]["ci_lo"], r[0]["ci_hi"], r[0]["resolved"]) == (0.5, 0.5, 0.5, True) and r[0]["holm_p"] == pytest.approx(2 * r[0]["p"])
    assert (r[1]["diff"], r[1]["p"], r[1]["resolved"]) == (0.0, 1.0, False)
    assert study.paired(spark.createDataFrame([], schema), 10, 10).count() == 0


def test_holm_within_families(spark):
    """Contrasts of two families: each is corrected for its own number, and all are resampled in one pass."""
    from lumiform.operators import study

    rows = [(m, c, i, d + (0.01 * i if c == "x" else 0.0)) for m, d in (("a", 0.5), ("b", -0.5), ("c", 0.02)) for c in ("x", "y") for i in range(40)]
    frame = spark.createDataFrame(rows, "model string, condition string, query_id long, diff double")
    got = {(r["model"], r["condition"]): r for r in study.paired(frame, 200, 400, keys=("model", "condition"), family=("condition",)).collect()}
    assert len(got) == 6
    for c in ("x", "y"):
        ordered = sorted((got[m, c]["p"], m) for m in "abc")
        steps, most = [], 0.0
        for i, (p, m) in enumerate(ordered):
            most = max(most, (3 - i) * p)
            steps.append((m, min(1.0, most)))
        assert {m: got[m, c]["holm_p"] for m in "abc"} == pytest.approx(dict(steps))


def test_training_tables_by_hand(spark):
    from lumiform.operators import training as T

    led = [("m", "untrained", 0, q, f, q == 0) for q in range(2) for f in T.FORMATS] + [("m", a, s, q, f, a != "winner" or q == s) for a in ("control", "winner") for s in (0, 1) for q in range(2) for f in T.FORMATS]
    led += [("m", f"only_{own}", s, q, f, f == own and (s == 0 or q == 0)) for own in T.FORMATS for s in (0, 1) for q in range(2) for f in T.FORMATS]
    mixed = [("m", a, s, q, 0.5 if a == "control" else 0.25 * (q + 1)) for a in ("control", "winner") for s in (0, 1) for q in range(2)]
    o = T.outcomes(spark.createDataFrame(led, "model string, arm string, seed int, query_id long, format string, lead boolean"), spark.createDataFrame(mixed, "model string, arm string, seed int, query_id long, p double"))
    level = T.training_levels(o).first()
    assert (level["untrained"], level["specialist"], level["control"], level["winner"]) == (0.5, 0.75, 0.5, 0.375)
    gap = {r["format"]: r for r in T.training_gaps(o, "control", 100, 200).collect()}
    assert set(gap) == set(T.FORMATS) and all((r["diff"], r["seed_lo"], r["seed_hi"], r["same_sign"]) == (0.25, 0.0, 0.5, 1) for r in gap.values())
    base = T.seed_changes(o, (T.SPECIALIST, T.STANDARDISED), (T.UNTRAINED, T.STANDARDISED)).collect()
    assert {(r["seed"], r["change"]) for r in base} == {(0, 0.5), (1, 0.0)} and len(base) == 10
    with pytest.raises(ValueError):
        T.format_contrasts(o, (T.WINNER, T.MIXED), (T.CONTROL, T.MIXED), 10, 10)
    with pytest.raises(ValueError):
        T.seed_changes(o, (T.SPECIALIST, T.MIXED), (T.CONTROL, T.STANDARDISED))
