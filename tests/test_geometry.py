"""The encoder and the geometry of its vectors against loops and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiform import catalogue
from lumiform.functions.ranking import shuffled_index
from lumiform.operators import encode, geometry
from lumiform.operators.corpus import hashed
from lumiform.operators.encode import Arm

ARMS = [Arm("m1", "untrained", 0, 1.0), Arm("m1", "winner", 1, 0.3), Arm("m2", "untrained", 0, 1.0)]


def test_features_and_scores_against_loops(spark):
    pairs = [(1, "what is a harbour", "The harbour: a *place* for boats.\n\tThe boats"), (2, None, "x"), (3, "words", None), (4, "", ""), (5, "été naïve", "Été — naïve_1 {été}"), (5, "été naïve", "Été — naïve_1 {été}"), (6, "z", "zebra " * 50000 + "{" * 10)]
    frame = spark.createDataFrame([(i, q, p, "extra", i) for i, q, p in pairs], "id long, question string, passage string, words string, n int")
    got = encode.features_and_scores(frame, ARMS).collect()
    assert len(got) == len(pairs) * len(ARMS) and {r["words"] for r in got} == {"extra"}
    by = {i: (q, p) for i, q, p in pairs}
    for r in got:
        vec, score = encode.encode_by_loops(by[r["id"]][0] or "", by[r["id"]][1] or "", next(a for a in ARMS if (a.model, a.arm, a.seed) == (r["model"], r["arm"], r["seed"])))
        assert r["vec"] == pytest.approx(vec, abs=1e-12) and r["score"] == pytest.approx(score, abs=1e-12)
    assert encode.features_and_scores(frame.limit(0), ARMS).count() == 0


def test_the_store_reads_only_its_formats(spark, tmp_path):
    rows = [("m", "a", 0, q, c, f, [float(q), float(c)], q + c / 10) for q in range(3) for c in range(2) for f in ("json", "yaml")]
    encode.write_features(spark.createDataFrame(rows, "model string, arm string, seed int, query_id long, cand int, format string, vec array<double>, score double"), str(tmp_path / "f"))
    store = encode.FeatureStore(spark, str(tmp_path / "f"))
    assert store.dim() == 2 and store.formats() == ["json", "yaml"] and store.n_negatives().first()["n"] == 1
    assert sorted(r["score"] for r in store.gold_scores(["json"]).collect()) == [0.0, 1.0, 2.0]
    assert "PartitionFilters: [" in store.of(["json"])._jdf.queryExecution().toString() and {r["format"] for r in store.of(["json"]).collect()} == {"json"}
    with pytest.raises(ValueError, match="toml"):
        store.of(["toml"])


def vectors(spark, n=41, models=("a",), width=5, seed=0):
    draw = np.random.default_rng(seed)
    x = {m: draw.normal(0, 1, (n, 3, width)) + draw.normal(0, 1, (3, width)) for m in models}
    rows = [(m, i * 7, f, j, x[m][i, j].tolist()) for m in models for i in range(n) for j, f in enumerate(("json", "toml", "yaml"))]
    return x, spark.createDataFrame(rows, "model string, record_id long, format string, fpos int, vec array<double>")


def test_content_differences_pair_every_record_once(spark):
    x, feats = vectors(spark)
    got = geometry.content_differences(feats.drop("model"), 3).collect()
    ids = [i for r in got if r["format"] == "json" for i in (r["left_id"], r["right_id"])]
    assert len(got) == 60 and len(ids) == len(set(ids)) == 40 and set(ids) <= {i * 7 for i in range(41)}
    for r in got:
        assert r["vec"] == pytest.approx((x["a"][r["left_id"] // 7, r["fpos"]] - x["a"][r["right_id"] // 7, r["fpos"]]).tolist())
    assert geometry.content_differences(feats.drop("model").limit(0)).count() == 0 and geometry.content_differences(feats.drop("model").filter("record_id = 7")).count() == 0
    other = {(r["left_id"], r["right_id"]) for r in geometry.content_differences(feats.drop("model"), 4).collect()}
    assert other != {(r["left_id"], r["right_id"]) for r in got}


def test_shuffled_index_is_the_order_of_the_hash(spark):
    rows = spark.createDataFrame([(i * 3, i % 2) for i in range(500)], "k long, g int")
    got = shuffled_index(rows, "k", hashed(1, "k"), groups=("g",)).withColumn("h", hashed(1, "k")).collect()
    for g in (0, 1):
        mine = sorted((r["h"], r["k"], r["idx"]) for r in got if r["g"] == g)
        assert [i for _, _, i in mine] == list(range(250))


def plain_separation(x, fit, show, pairs, shrinkage):
    """The whitened separation of every format pair, by NumPy on whole arrays."""
    d = np.concatenate([x[a] - x[b] for a, b in pairs])
    cov = d.T @ d / len(d)
    values, basis = np.linalg.eigh(cov + shrinkage * np.trace(cov) / len(cov) * np.eye(len(cov)))
    w = (basis / np.sqrt(values)) @ basis.T
    y = x[show] @ w
    out = {}
    for a in range(3):
        for b in range(a + 1, 3):
            diff = y[:, a] - y[:, b]
            mean = diff.mean(0)
            out["-".join(("json", "toml", "yaml")[k] for k in (a, b))] = np.linalg.norm(mean) / np.sqrt(((diff - mean) ** 2).sum(1).mean())
    return out


def test_grid_against_whole_arrays_and_single_runs(spark):
    x, feats = vectors(spark, 60, ("a", "b"))
    settings = [(1e-3, 0), (1e-2, 0), (1e-3, 2)]
    got = {(r["model"], r["shrinkage"], r["split"], r["pair"]): r["separation"] for r in geometry.grid_separations(feats, settings).collect()}
    assert len(got) == 2 * 3 * 3
    ids = spark.createDataFrame([(i * 7,) for i in range(60)], "record_id long")
    for shrinkage, split in settings:
        half = {r["record_id"] // 7: r["h"] for r in ids.withColumn("h", geometry.half_of("record_id", split)).collect()}
        fit, show = [i for i in range(60) if half[i] == 0], [i for i in range(60) if half[i] == 1]
        order = {r["record_id"] // 7: (r["h"], r["record_id"]) for r in ids.withColumn("h", hashed(split, F.lit("content"), "record_id")).collect()}
        told = sorted(fit, key=order.__getitem__)
        pairs = list(zip(told[::2], told[1::2], strict=False))
        for m in ("a", "b"):
            want = plain_separation(x[m], fit, show, pairs, shrinkage)
            assert {p: got[m, shrinkage, split, p] for p in want} == pytest.approx(want)
        single = {(r["model"], r["pair"]): r["separation"] for r in geometry.grid_separations(feats, [(shrinkage, split)]).collect()}
        assert single == pytest.approx({(m, p): got[m, shrinkage, split, p] for m, p in single})


def test_separation_is_of_paired_differences(spark):
    x, feats = vectors(spark, 30)
    got = {r["pair"]: r["separation"] for r in geometry.pair_separation(feats.drop("model")).collect()}
    diff = x["a"][:, 0] - x["a"][:, 1]
    assert got["json-toml"] == pytest.approx(np.linalg.norm(diff.mean(0)) / np.sqrt(diff.var(0).sum()))


def test_planes_against_whole_arrays(spark):
    x, feats = vectors(spark, 50)
    shifts = x["a"] - x["a"].mean(1, keepdims=True)
    basis = geometry.mean_plane(feats)
    want = np.linalg.svd(shifts.mean(0), full_matrices=False)[2][:2].T
    assert abs(np.linalg.det(basis.T @ want)) == pytest.approx(1)
    best = geometry.discriminant_plane(feats)
    residual = (shifts - shifts.mean(0)).reshape(-1, 5)
    within = residual.T @ residual / len(residual)
    within += geometry.RIDGE * np.trace(within) / 5 * np.eye(5)
    values, vectors_ = np.linalg.eig(np.linalg.solve(within, shifts.mean(0).T @ shifts.mean(0) / 3))
    want = np.linalg.qr(vectors_[:, np.argsort(values.real)[::-1][:2]].real)[0]
    assert abs(np.linalg.det(best.T @ want)) == pytest.approx(1)
    points = shifts @ basis
    centre = points.reshape(-1, 2).mean(0)
    share = ((points.mean(0) - centre) ** 2).sum() * 50 / ((points - centre) ** 2).sum()
    assert geometry.spread_share(geometry.projected(geometry.format_shifts(feats), basis)).first()["separation"] == pytest.approx(share)


def test_range_table_is_one_row_a_setting(spark, sf):
    rows = catalogue.QUERIES["range_table"](spark, sf).collect()
    assert {(float(r["shrinkage"]), r["split"]) for r in rows} == set(geometry.SETTINGS) and len(rows) == 5
    assert all(0 < r["lowest_ratio"] <= r["highest_ratio"] and -1 <= r["pooled_rho"] <= 1 for r in rows)
