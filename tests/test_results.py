"""Result documents: what is written as JSON comes back as long tables."""

import json

import pytest
from pyspark.sql import functions as F

from lumiform.sources import results


def put(folder, name, **document):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(document, indent=1))


def test_scores_and_ranks(spark, tmp_path):
    for i, model in enumerate(("m1", "m2")):
        put(tmp_path / "s", model, model=model, arm="untrained", record_ids=["a", "b"], scores_per_fmt={"json": [i, 1.5], "yaml": [2, None]}, other={"x": 1})
    rows = results.load_scores(spark, str(tmp_path / "s" / "*.json"))
    got = {(r["model"], r["record_id"], r["format"]): r["score"] for r in rows.collect()}
    assert len(got) == 8 and got["m2", "a", "json"] == 1.0 and got["m1", "b", "yaml"] is None and rows.filter("fold IS NULL AND seed IS NULL").count() == 8
    put(tmp_path / "r", "m1", model="m1", arm="w", fold="json", seed=3, query_ids=["q"], reciprocal_ranks={"yaml": [0.5]})
    assert [tuple(r) for r in results.load_ranks(spark, str(tmp_path / "r" / "*.json")).collect()] == [("m1", "w", "json", 3, "q", "yaml", 0.5)]
    put(tmp_path / "bad", "m1", model="m1", arm="x", record_ids=["a"], scores_per_fmt={"json": [1, 2]})
    with pytest.raises(Exception, match="1 ids and 2 values"):
        results.load_scores(spark, str(tmp_path / "bad" / "*.json")).collect()


def test_comparisons_and_gains(spark, tmp_path):
    put(tmp_path / "c", "a", model="m", arm="winner", fold="json", seed=0, record_ids=["x", "y"], per_record_delta_rr=[0.5, -0.25], trained_mrr=0.75, delta_mrr_mean=0.125, delta_mrr_ci=[-0.1, 0.3], ni_pass=False)
    pattern = str(tmp_path / "c" / "*.json")
    (c,) = results.load_comparisons(spark, pattern).collect()
    assert (c["delta"], c["lo"], c["hi"], c["kept"]) == (0.125, -0.1, 0.3, False)
    assert {(r["record_id"], r["delta"]) for r in results.load_gains(spark, pattern).collect()} == {("x", 0.5), ("y", -0.25)}


def test_selections_and_overflow(spark, tmp_path):
    candidates = [{"lambda": 0.0, "dev_max_abs_d": 0.9, "mrr_ni_pass": True}, {"lambda": 0.5, "dev_max_abs_d": 0.4, "dev_max_abs_d_ci_lo": 0.3, "dev_max_abs_d_ci_hi": 0.5, "mrr_ni_pass": False}]
    put(tmp_path / "sel", "m", model="m", winner_lambda=0.5, tied_lambdas=[0.5], tie_broken=True, candidates=candidates)
    rows = results.load_selections(spark, str(tmp_path / "sel" / "*.json"))
    assert [(r["weight"], r["ci_lo"], r["passed"], r["tied"], r["winner"]) for r in rows.orderBy("weight").collect()] == [(0.0, None, True, False, False), (0.5, 0.3, False, True, True)]
    assert [tuple(r) for r in results.winner_weights(rows).collect()] == [("m", 0.5)]
    put(tmp_path / "o", "test", split="test", cross={"m": ["a", "b"]}, within={"m": ["q"], "n": []})
    got = {tuple(r) for r in results.load_overflow(spark, str(tmp_path / "o" / "*.json")).collect()}
    assert got == {("test", "cross", "m", "a"), ("test", "cross", "m", "b"), ("test", "within", "m", "q")}


def test_folds(spark):
    rows = [("m", "w", 0, fold, r, f, j, float((r % 3) * (j + 1) + (fold == f))) for fold in ("json", "yaml") for r in range(12) for j, f in enumerate(("json", "toml", "yaml"))]
    scores = spark.createDataFrame(rows, "model string, arm string, seed int, fold string, record_id long, format string, fpos int, score double")
    effects = {(r["fold"], r["pair"]): (r["d"], r["ood"]) for r in results.fold_effects(scores).collect()}
    assert len(effects) == 6 and {k: o for k, (_, o) in effects.items() if k[0] == "json"} == {("json", "json-toml"): True, ("json", "json-yaml"): True, ("json", "toml-yaml"): False}
    want = {o: sum(max(abs(d) for (f, _), (d, x) in effects.items() if f == fold and x == o) for fold in ("json", "yaml")) / 2 for o in (True, False)}
    for o in want:
        assert results.mean_max_d(scores, o).first()["mean_max_d"] == pytest.approx(want[o])
        drawn = results.mean_max_d_replicates(scores.withColumn("idx", F.col("record_id")), o, 16).collect()
        assert len(drawn) == 16 and {r["b"] for r in drawn} == set(range(16))
    assert results.with_positions(scores.drop("fpos"), ["yaml", "json"]).select("format", "fpos").distinct().count() == 2
    assert [tuple(r) for r in results.complete_arms(spark.createDataFrame([("m", "a", 0), ("m", "b", 0), ("m", "a", 1)], "model string, arm string, seed int"), ["a", "b"]).collect()] == [("m", 0)]
