"""Steps whose cost must not grow faster than their input: what their plans move and how often they read."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumiform.operators import answer, bm25, effect, encode, geometry, prose, resample, study
from lumiform.operators.encode import Arm
from lumiform.plans import scoring

ARMS = [("m1", "control", 0, 50, 3), ("m1", "winner", 0, 30, 1), ("m2", "control", 1, 62, 3)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_leads_of_a_query_are_made_inside_its_row(spark):
    queries = spark.range(40).withColumnRenamed("id", "query_id")
    grids = study.grids(queries, ARMS)
    inside = answer.leads_in(grids, answer.leads_of("grid"), study.TENSOR_KEYS)
    long = answer.leads(study.tensor(queries, ARMS), study.TENSOR_KEYS)
    rows = lambda df: sorted(map(tuple, df.select(*study.TENSOR_KEYS, "query_id", "format", "fpos", "above", "lead", "rr").collect()))
    assert rows(inside) == rows(long)
    assert plan(inside).count("Exchange") == 1  # the ids alone are dealt, no score moves
    told = study.led_and_mixed(grids)
    assert rows(answer.leads_in(told, "leads", study.TENSOR_KEYS)) == rows(long)
    p = lambda df: {tuple(r)[:4]: round(r["p"], 12) for r in df.select(*study.TENSOR_KEYS, "query_id", "p").collect()}
    assert p(told) == p(study.mixed_lead(study.tensor(queries, ARMS)))


def test_grids_by_arm_and_without_rows(spark):
    queries = spark.createDataFrame([(None,), (7,)], "query_id long")
    got = study.grids(queries, ARMS, 3, lambda arm: ("toml",) if arm[1] == "winner" else ("yaml", "json")).collect()
    assert sorted((r["model"], r["arm"], [f["format"] for f in r["grid"]]) for r in got) == sorted(2 * [("m1", "control", ["yaml", "json"]), ("m1", "winner", ["toml"]), ("m2", "control", ["yaml", "json"])])
    assert study.grids(queries.limit(0), ARMS).count() == 0 == study.led_and_mixed(study.grids(queries.limit(0), ARMS)).count()


def test_contrasts_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    diffs = spark.range(100).select(F.lit("m").alias("model"), F.col("id").alias("query_id"), (F.col("id") / 7).alias("diff")).mapInArrow(count, "model string, query_id long, diff double")
    assert study.paired(diffs, 50, 64).count() == 1
    assert made.value == 100  # the bootstrap, the permutations and the index read what was written


def test_keys_of_one_size_share_their_weights(spark):
    drawn = spark.sparkContext.accumulator(0)
    plain = resample.draw_weights(20, 0)

    def weights(n, block, m):
        drawn.add(1)
        return plain(n, block, m)

    rows = [(k, i, [float(i * (k + 1))]) for k in range(5) for i in range(30)]
    got = resample.weighted_sums(spark.createDataFrame(rows, "k int, idx long, v array<double>"), 20, weights, ("k",)).collect()
    assert drawn.value == 1
    (_, times), = plain(30, 0, 30)
    for r in got:
        assert np.isclose(r["s"][0], times[r["b"]] @ np.arange(30.0) * (r["k"] + 1)) and r["w"][0] == 30


def test_blocks_find_what_bounds_find_and_give_a_row_a_query_and_block(spark, monkeypatch):
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(draw.choice(words, 12)) for _ in range(60)] + ["w1 w2 w3"] * 25 + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, doc string")
    queries = spark.createDataFrame([(i, t and " ".join(t.split()[:4])) for i, t in enumerate(texts)] + [(900, "unknown")], "query_id long, query string")
    index = bm25.build(docs)
    rows = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 5)) for r in df.collect())
    want = rows(bm25.top(index, queries, 7))
    assert rows(bm25.top_of_blocks(index, queries, 7)) == want
    monkeypatch.setattr(bm25, "HELD", 100)  # some queries at a time
    table = pa.table({"term": ["a", "b", "a", "b"], "id": [5, 5, 3, 9], "gain": [1.0, 1.0, 1.0, 2.0]})
    asked = pa.table({"query_id": [1, 1, 2, 3], "term": ["a", "b", "b", "c"], "w": [1.0, 2.0, -1.0, 1.0]})
    assert bm25.best_of_block(table, asked, 2).to_pylist() == [{"query_id": 1, "ids": [9, 5], "scores": [4.0, 3.0]}, {"query_id": 2, "ids": [5, 9], "scores": [-1.0, -2.0]}]
    assert bm25.best_of_block(table.slice(0, 0), asked, 2).num_rows == 0 == bm25.best_of_block(table, asked.slice(0, 0), 2).num_rows


def test_ranks_of_gathered_scores(spark):
    arms = {"m1": [["untrained", ""], ["winner", "yaml"]]}
    rows = [("m1", 1, 0, [0.5, 0.5]), ("m1", 1, 1, [0.5, 0.7]), ("m1", 1, 2, [0.9, 0.6]), ("m1", 2, 0, [0.1, 0.2])]
    lists = spark.createDataFrame(rows, "model string, query_id long, cand int, scores array<double>").groupBy("model", "query_id").agg(F.collect_list(F.struct("cand", "scores")).alias("all"))
    got = {(r["query_id"], r["arm"]): r["rr"] for r in prose.ranks_in(lists, arms).collect()}
    assert got == {(1, "untrained"): 1 / 2, (1, "winner"): 1 / 3, (2, "untrained"): 1.0, (2, "winner"): 1.0}


def test_sums_of_a_text_give_every_arms_score(spark):
    arms = [Arm("m1", "a", 0, 1.0), Arm("m2", "a", 0, 1.4), Arm("m1", "b", 0, 0.1)]
    texts = spark.createDataFrame([(1, "the harbour: a *place*"), (2, ""), (3, None)], "doc long, passage string")
    question = encode.features_and_scores(spark.createDataFrame([(0, "", "harbour place")], "id int, question string, passage string"), arms[:2]).select("model", F.filter(F.transform("vec", lambda x, i: F.struct(i.alias("dim"), x.alias("x"))), lambda e: e["x"] != 0).alias("q"))
    got = {(r["doc"], r["model"]): r["scores"] for r in encode.scored(encode.sums(texts, arms).join(question, "model"), arms, ["doc"]).collect()}
    for model in ("m1", "m2"):
        want = [round(encode.encode_by_loops("harbour place", "the harbour: a *place*", a)[1], 9) for a in arms if a.model == model]
        assert np.allclose(got[1, model], want, atol=1e-9) and got[2, model] == got[3, model] == [0.0] * len(want)


def features(spark, n=23):
    rows = [(i * 3, f"harbour {i % 5} boats", [("yaml", 0, f"a: {i}\n"), ("json", 1, '{"a": %d}\n' % i), ("toml", 2, None)], None if i == 4 else f"the harbour number {i} — *boats* {'x ' * (i % 7)}") for i in range(n)]
    records = spark.createDataFrame(rows, "record_id long, question string, heads array<struct<format: string, fpos: int, head: string>>, body string").repartition(3)
    whole = records.select("record_id", "question", "body", F.explode("heads").alias("h")).select("record_id", "question", "h.format", "h.fpos", F.concat(F.coalesce("h.head", F.lit("")), F.coalesce("body", F.lit(""))).alias("passage"))
    return records, whole


def test_a_record_s_formats_are_compared_in_its_row(spark):
    records, whole = features(spark)
    arms = [Arm("m1", "a", 0, 1.0), Arm("m2", "b", 1, 0.4)]
    long, rows = encode.features_and_scores(whole, arms), encode.by_record(records, arms)
    shown = rows.select("record_id", "model", F.explode("all").alias("r")).select("record_id", "model", "r.*").collect()
    want = {(r["record_id"], r["model"], r["format"]): (*r["vec"], r["score"]) for r in long.collect()}
    assert len(shown) == len(want) and all(np.allclose((*r["vec"], r["score"]), want[r["record_id"], r["model"], r["format"]], atol=1e-12) for r in shown)
    moments = geometry.pair_moments(rows)
    near = lambda df, c: {(r["model"], r["pair"]): round(r[c], 9) for r in df.collect()}
    keys = ("model", "arm", "seed")
    assert near(geometry.separations_of(moments), "separation") == near(geometry.pair_separation(long.drop("score"), keys), "separation")
    assert near(geometry.effects_of(moments), "d") == near(effect.pairwise_d(long, [*keys, "record_id"], keys), "d")
    settings = [(1e-3, 0), (1e-2, 2)]
    got = geometry.solved_grid(geometry.grid_moments_of(records, arms, [0, 2]), settings, "of").collect()
    old = geometry.grid_separations(long.withColumn("of", F.concat_ws("|", *keys)).select("of", "record_id", "format", "fpos", "vec"), settings, "of").collect()
    told = lambda found: {(r["of"], r["shrinkage"], r["split"], r["pair"]): round(r["separation"], 7) for r in found}
    assert told(got) == told(old) and len(got) == 2 * 2 * 3
    assert geometry.pair_moments(rows.limit(0)).count() == 0


def test_pairs_to_score_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    kinds = "id long, format string, question string, passage string"
    pairs = spark.range(30).select("id", F.explode(F.array(F.lit("json"), F.lit("yaml"))).alias("format"), F.lit("q").alias("question"), F.lit("p").alias("passage")).mapInArrow(count, kinds)
    report = scoring.save_partial(pairs, str(tmp_path / "s"), ["m1", "m2"], lambda rows, model: rows.withColumn("score", F.lit(1.0)))
    assert {(r["model"], r["format"], r["n"]) for r in report.collect()} == {(m, f, 30) for m in ("m1", "m2") for f in ("json", "yaml")}
    assert made.value == 60
