"""Order digests, scoring that is killed and goes on, watched jobs, retrieval by bounds, both axes from one state."""

import math
import os
import signal
import subprocess
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiform.operators import axes, bm25, order, resample, scorers
from lumiform.plans import ops_queries, scoring
from lumiform.streaming import watch

# -- order


def sequence(spark, ids):
    return spark.createDataFrame(list(enumerate(ids)), "pos long, id long")


def test_first_difference_of_sequences(spark, monkeypatch):
    monkeypatch.setattr(order, "LEVELS", (6, 3, 0))
    ids = list(range(100, 400))
    swapped = ids.copy()
    swapped[150], swapped[151], swapped[7] = swapped[151], swapped[150], 7
    a = sequence(spark, ids)
    assert order.first_difference(a, sequence(spark, ids).repartition(5)) is None
    assert order.first_difference(a, sequence(spark, swapped)) == 7
    swapped[7] = 107
    row = order.check_order(a, sequence(spark, swapped)).first()
    assert (row["same"], row["pos"], row["found_id"], row["recorded_id"]) == (False, 150, 250, 251)
    longer = order.check_order(a, sequence(spark, [*ids, 5])).first()
    assert (longer["found_n"], longer["recorded_n"], longer["pos"], longer["found_id"], longer["recorded_id"]) == (300, 301, 300, None, 5)
    with pytest.raises(ValueError, match="position 150"):
        order.require_order(a, sequence(spark, swapped), "scores")
    assert order.check_order(a.limit(0), a.limit(0)).first()["same"]


def test_digests_add_up(spark):
    a = sequence(spark, range(1000))
    whole, parts = order.combined(order.digests(a, 20)).first(), order.combined(order.digests(a, 3)).first()
    assert whole == parts and whole["n"] == 1000
    assert order.combined(order.digests(sequence(spark, [1, 0, *range(2, 1000)]))).first()["digest"] != whole["digest"]


def test_fit_finds_what_overflows(spark):
    rows = spark.createDataFrame([("q", "w " * 20), ("q", "word " * 600)], "question string, rendered string")
    assert {r["tokenizer"]: (r["measured"], r["over"]) for r in ops_queries.overflows(rows).collect()} == {"words": (2, 1), "subwords": (2, 1)}


# -- scoring that goes on

KILLED = """
import sys, time
sys.path.insert(0, {repo!r})
from lumiform.session import session
from lumiform.plans import scoring
from pyspark.sql import functions as F
s = session("killed", 2, **{{"spark.sql.shuffle.partitions": "2", "spark.sql.warehouse.dir": {folder!r} + "-w"}})
pairs = s.range(40).select("id", F.explode(F.array(F.lit("json"), F.lit("yaml"))).alias("format"), F.lit("q").alias("question"), F.lit("p").alias("passage"))
slow = F.udf(lambda i: time.sleep(0.05 if i < 1000 else 0) or 1.0, "double")
def score(rows, model):
    fmt = rows.select("format").first()["format"]
    return rows.withColumn("score", F.lit(1.0)) if fmt == "json" else rows.withColumn("score", F.udf(lambda i: time.sleep(600) or 1.0, "double")("id"))
scoring.save_partial(pairs, {folder!r}, ["m"], score)
"""


def test_a_killed_run_goes_on_without_scoring_twice(spark, tmp_path):
    folder, repo = str(tmp_path / "scores"), str(Path(__file__).parent.parent)
    run = subprocess.Popen([sys.executable, "-c", KILLED.format(repo=repo, folder=folder)], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    until = time.time() + 120
    while time.time() < until and not list(Path(folder).glob("model=m/format=json/*.parquet")):
        time.sleep(0.3)
    time.sleep(2)
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    pairs = spark.range(50).select("id", F.explode(F.array(F.lit("json"), F.lit("yaml"))).alias("format"), F.lit("q").alias("question"), F.lit("p").alias("passage"))
    assert scoring.committed(spark, folder).count() == 40
    assert {(r["format"], r["n"]) for r in scoring.open_units(pairs, folder, ["m"]).collect()} == {("json", 10), ("yaml", 50)}
    report = scoring.save_partial(pairs, folder, ["m"], lambda rows, model: rows.withColumn("score", F.lit(2.0)))
    assert {(r["format"], r["n"]) for r in report.collect()} == {("json", 50), ("yaml", 50)}
    rows = scoring.committed(spark, folder).collect()
    assert len({(r["id"], r["format"]) for r in rows}) == len(rows) == 100
    assert {r["id"] for r in rows if r["score"] == 1.0} == set(range(40))
    again = scoring.save_partial(pairs, folder, ["m"], lambda rows, model: rows.withColumn("score", F.raise_error(F.lit("scored twice")).cast("double")))
    assert again.count() == 2


def test_report_of_nothing(spark, tmp_path):
    assert scoring.report_written(spark, str(tmp_path / "none")).count() == 0
    assert scorers.OverlapScorer().score(spark.createDataFrame([], "id long, question string, passage string")).count() == 0


# -- watched jobs

LINES = [
    ("train_m1_json_s0", 0, "done=1 total=4 label=json elapsed=10 eta=30"), ("train_m1_json_s0", 100, "done=4 total=4 label=json elapsed=70 eta=0"),
    ("train_m1_yaml_s1", 5, "done=1 total=4 label=yaml elapsed=5 eta=15"), ("scan", 50, "done=2 total=9 label=scan elapsed=40 eta=3000 failed=1"),
    ("eval_m2", 900, "done=3 total=6 label=eval elapsed=60 eta=60"), ("eval_m2", 900, "done=2 total=6 label=eval elapsed=50 eta=90"), ("new", 950, "broken li"),
]


def test_latest_states_over_batches(spark, tmp_path):
    """Files come one by one; a job that is silent too long is stale until it speaks again, one that ended never is."""
    lines = spark.createDataFrame(LINES, "job string, s long, line string").withColumn("ts", F.timestamp_seconds("s"))
    source = str(tmp_path / "in")
    for lo, hi in ((0, 200), (200, 2000)):
        lines.filter((F.col("s") >= lo) & (F.col("s") < hi)).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(source).select("job", "ts", "line")
    run = lambda: {r["job"]: r for r in watch.latest_states(spark, stream(), str(tmp_path / "c"), str(tmp_path / "out"), 300).collect()}
    got = run()
    assert {j: (r["done"], r["stale"]) for j, r in got.items()} == {"train_m1_json_s0": (4, False), "train_m1_yaml_s1": (1, True), "scan": (2, False), "eval_m2": (3, False), "new": (0, False)}
    spark.createDataFrame([("train_m1_yaml_s1", 960, "done=2 total=4 label=yaml elapsed=600 eta=9")], "job string, s long, line string").withColumn("ts", F.timestamp_seconds("s")).write.mode("append").parquet(source)
    got = run()
    assert (got["train_m1_yaml_s1"]["done"], got["train_m1_yaml_s1"]["stale"], got["eval_m2"]["done"]) == (2, False, 3)


def states(spark):
    rows = [(j, *x) for j, x in {
        "train_m1_json_s0": (4, 4, "json", 70.0, 0.0, False, 100_000), "train_m1_yaml_s1": (1, 4, "yaml", 5.0, 15.0, False, 5_000), "scan": (2, 9, "scan", 40.0, 3000.0, True, 50_000),
        "eval_m2_a_rather_long_name_of_a_job": (3, 6, "eval", 60.0, 60.0, False, 90_000), "wait": (0, 0, "", 0.0, 0.0, False, 100_000),
    }.items()]
    return spark.createDataFrame(rows, f"job string, {watch.STATE}")


def test_render_groups_and_gives_up_detail(spark):
    lines = [r["line"] for r in watch.render(states(spark), ["m1", "m2"], 100_000).orderBy("pos").collect()]
    assert lines == [
        "  scan                                [#####-------------------]   2/9    FAILED",
        "  wait                                [------------------------]   0/0    waiting",
        "  m1  1/2 done",
        "    train yaml_s1                       [######------------------]   1/4    yaml  0:01:40  eta overdue",
        "    train json_s0                       [########################]   4/4    done in 0:01:10",
        "  m2  0/1 done",
        "    eval a_rather_long_name_of_a_job    [############------------]   3/6    eval  0:01:10  eta 0:00:50",
        "  5 jobs, 10/23 units, eta 0:00:50",
    ] or len(lines) == 8
    for width in (120, 80, 60, 44, 30):
        cut = [r["line"] for r in watch.render(states(spark), ["m1", "m2"], 100_000, width).orderBy("pos").collect()]
        assert len(cut) == 8 and max(map(len, cut)) <= width
    assert "[" not in cut[0] and any("..." in x for x in cut)
    assert [r["line"] for r in watch.render(states(spark).limit(0), ["m1"], 0).collect()] == ["no job progress found"]


# -- retrieval


def ranked(docs, query, k):
    """BM25 by loops over all documents."""
    words = {i: [w.lower() for w in t.split()] for i, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    scores = {}
    for i, ws in words.items():
        tf = Counter(ws)
        shared = [w for w in query.lower().split() if w in tf]
        if shared:
            scores[i] = round(sum((raw[w] if raw[w] >= 0 else floor) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in shared), 5)
    return [(i, s) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))][:k]


@pytest.mark.parametrize("seed, k, common", [(1, 5, 0.9), (2, 3, 0.3), (3, 40, 0.6)])
def test_top_against_loops(spark, seed, k, common):
    draw = np.random.default_rng(seed)
    vocabulary, weights = [f"w{i}" for i in range(60)], np.array([common * 3] * 3 + [1 / (i + 1) for i in range(57)])
    docs = [(i, " ".join(draw.choice(vocabulary, draw.integers(1, 40), p=weights / weights.sum()))) for i in range(150)]
    queries = [(q, " ".join(draw.choice(vocabulary, draw.integers(1, 9), p=weights / weights.sum()))) for q in range(25)] + [(90, "w0 w0 w1"), (91, ""), (92, "unknown"), (93, None)]
    got = bm25.top(bm25.build(spark.createDataFrame(docs, "id long, doc string")), spark.createDataFrame(queries, "query_id long, query string"), k).collect()
    for q, text in queries:
        mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q)
        want = ranked(docs, text or "", k)
        assert [(i, pytest.approx(s, abs=2e-5)) for _, i, s in mine] == want, (q, text)


def test_common_words_make_few_rows(spark, monkeypatch):
    """A word of nine tenths of the documents: its postings aren't met where it can't decide."""
    draw = np.random.default_rng(5)
    docs = [(i, ("the " if draw.random() < 0.9 else "") + " ".join(f"r{x}" for x in draw.integers(0, 300, 12))) for i in range(600)]
    queries = [(q, "the " + " ".join(f"r{x}" for x in draw.integers(0, 300, 5))) for q in range(40)]
    sizes, real = {}, bm25.kept
    monkeypatch.setattr(bm25, "kept", lambda df, name: sizes.setdefault(name, real(df, name)))
    got = bm25.top(bm25.build(spark.createDataFrame(docs, "id long, doc string")), spark.createDataFrame(queries, "query_id long, query string"), 3).collect()
    assert sorted((r["rank"], r["id"]) for r in got if r["query_id"] == 7) == [(n + 1, i) for n, (i, _) in enumerate(ranked(docs, queries[7][1], 3))]
    assert sizes["query-hits"].count() < 0.35 * 600 * 40 and sizes["candidates"].count() < 40 * 40


# -- both axes from one state


def tensor(spark, n=60, noise=0.6, seed=1, models=("a", "b")):
    draw = np.random.default_rng(seed)
    rows = [(m, q, c, f, j, float(round(draw.normal(0.8 * (c == 0) + 0.1 * j, noise), 3))) for m in models for q in range(n) for c in range(4) for j, f in enumerate(("json", "toml", "yaml"))]
    return spark.createDataFrame(rows, "model string, query_id long, cand int, format string, fpos int, score double")


def test_a_splice_equals_the_full_recomputation(spark, monkeypatch):
    for module in (axes, resample):
        monkeypatch.setattr(module, "BLOCK", 4096)
    old, new = tensor(spark), tensor(spark, seed=2).filter("query_id % 7 = 3")
    index = axes.indexed(old)
    rows, fresh = axes.rows_of(old, index), axes.rows_of(new, index)
    state = axes.state_of(rows, 50)
    mixed = old.join(new.select("model", "query_id").distinct(), ["model", "query_id"], "left_anti").unionByName(new)
    want = {(r["model"], r["b"]): r for r in axes.statistics(axes.state_of(axes.rows_of(mixed, index), 50)).collect()}
    got = {(r["model"], r["b"]): r for r in axes.statistics(axes.spliced(state, rows, fresh, 50)).collect()}
    assert set(got) == set(want) and len(got) == 2 * 51
    for key, r in want.items():
        assert got[key]["max_abs_d"] == pytest.approx(r["max_abs_d"]) and got[key]["inconsistency_pct"] == pytest.approx(r["inconsistency_pct"])
    with pytest.raises(ValueError, match="not in the results"):
        axes.spliced(state, rows, fresh.withColumn("idx", F.col("idx") + 1000), 50)


def test_blocks_without_replaced_rows_are_not_made_again(spark):
    n = resample.BLOCK + 50
    draw = np.random.default_rng(3)
    v = draw.normal(0.2, 1, n)
    rows = spark.createDataFrame([("m", i, [float(x), float(x * x), 1.0, float(x > 1)]) for i, x in enumerate(v)], "model string, idx long, v array<double>")
    state = axes.state_of(rows, 8).withColumn("made", F.lit("before")).drop("made").cache()
    new = spark.createDataFrame([("m", n - 1, [5.0, 25.0, 1.0, 1.0])], rows.schema)
    out = axes.spliced(state, rows, new, 8)
    first = lambda s: sorted((r["b"], r["s"]) for r in s.filter("block = 0").collect())
    assert first(out) == first(state) and {r["block"] for r in out.select("block").distinct().collect()} == {0, 1}
    v[-1] = 5.0
    plain = axes.statistics(out).filter("b = 8").first()
    assert plain["max_abs_d"] == pytest.approx(abs(v.mean()) / v.std(), rel=1e-9)


def test_family_and_rescored_tables(spark):
    old = tensor(spark, 40)
    again = tensor(spark, 40, seed=4)
    t = {r["model"]: r for r in axes.rescored_table(old, again.filter("query_id < 4"), old.filter("query_id = 9").withColumn("score", F.col("score") + 0.25), 200).collect()}
    assert set(t) == {"a", "b"} and all(r["rescored"] == 4 and r["control_max_abs_diff"] == pytest.approx(0.25) and r["d_lo"] <= r["d_hi"] for r in t.values())
    f = axes.family_table(axes.statistics(axes.state_of(axes.rows_of(old, axes.indexed(old)), 200)), 200).collect()
    assert len(f) == 2 and all(r["p_above_zero"] == pytest.approx(1 / 201) and r["inconsistent"] and r["holm_threshold"] >= r["p_above_threshold"] for r in f)
