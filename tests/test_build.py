"""Depth-aware markup, provenance, rosters, parity draws and the corpus build."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiform.functions import markup, ranking
from lumiform.operators import corpus, geometry, parity
from lumiform.plans import build
from lumiform.sources import provenance, readers, roster

PAGE = 'é<table class="infobox vcard"><tr><td>a<table><tr><td>in</td></tr></table>b</td></tr></table><p>Lead.</p>'


def test_infobox_ranges_count_bytes_and_depth():
    raw = PAGE.encode()
    ((a, b),) = markup.infobox_ranges(raw)
    assert raw[a:b].startswith(b"<table") and raw[b:] == b"<p>Lead.</p>"
    assert markup.infobox_ranges(b'<table class="infobox"><table></table>') == []


def test_nested_tables_and_spans():
    assert markup.without_nested_tables("<table>a<table>x<table>y</table></table>b</table>") == "<table>a b</table>"
    assert markup.without_spans('a<span class="noprint">x<span>y</span>z</span>b<span class="noprint">c', r'<span class="noprint">') == "abc"


def test_ranges_of_boxes_in_boxes_and_unclosed_tables():
    raw = b'<table class="infobox"><table class="a infobox">x</table></table>'
    assert markup.infobox_ranges(raw) == [(0, len(raw)), (23, len(raw) - 8)]
    assert markup.without_nested_tables("<table>A<table>B tail") == "<table>A<table>B tail"
    assert markup.without_nested_tables("</table><table>a<table>b</table>") == "</table><table>a "
    deep = "".join(f'<span class="noprint">{i}' for i in range(4)) + "</span>" * 4
    assert markup.without_spans(f"left {deep}right{deep}", r'<span class="noprint">') == "left right"


def test_markup_takes_time_in_proportion():
    began = time.monotonic()
    markup.without_spans('<span class="noprint">' * 50_000, r'<span class="noprint">')
    markup.infobox_ranges(b'<table class="infobox">' * 50_000)
    assert time.monotonic() - began < 10


def test_infobox_rows_leave_nested_tables_and_spans_out(spark):
    box = '<table><tr><th>A<span class="noprint">x<span>y</span>z</span></th><td>1<table><tr><th>In</th><td>2</td></tr></table></td></tr></table>'
    rows = corpus.infobox_rows(spark.createDataFrame([(1, box), (2, None)], "id int, html string")).collect()
    assert [(r.id, r.key, r.value, r.drop) for r in rows] == [(1, "A", "1", None)]


def test_match_example(spark):
    raw = PAGE.encode()
    at, box = raw.index(b"in</td>"), raw.index(b"<table")
    df = spark.createDataFrame([(PAGE, at, at + 2), (PAGE, box, raw.index(b"<p>")), (PAGE, 0, 1), (PAGE, -1, 2), ("none", 0, 1)], "html string, start long, stop long")
    rows = [r.m for r in df.select(markup.match_example(F.col("html"), F.col("start"), F.col("stop")).alias("m")).collect()]
    assert rows[0].infobox == "in" and rows[0].rest == raw[at + 2 :].decode() and rows[2:] == [None] * 3
    assert rows[1].infobox.startswith("<table class") and rows[1].rest == "<p>Lead.</p>"


def test_json_lines_and_documents_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\n\u2028\"", [("k", "v")]), (2, None, [])], "id long, text string, pairs array<struct<key:string,value:string>>")
    readers.write_lines(rows, str(tmp_path / "lines"))
    back = readers.read_lines(spark, str(tmp_path / "lines"), "id long, text string, pairs array<struct<key:string,value:string>>")
    assert sorted(back.collect()) == sorted(rows.collect())
    for i in (1, 2):
        (tmp_path / f"r{i}.json").write_text(f'{{\n "model": "m{i}",\n "scores": {{"d": {i}.5}}\n}}')
    found = readers.read_results(spark, str(tmp_path / "r*.json"), "model string, scores struct<d:double>").orderBy("model").collect()
    assert [(r.model, r.scores.d, r.file.rsplit("/", 1)[1]) for r in found] == [("m1", 1.5, "r1.json"), ("m2", 2.5, "r2.json")]


def test_outputs_are_told_apart_by_their_digests(spark, tmp_path):
    one, two, log = (str(tmp_path / x) for x in ("one", "two", "log"))
    spark.range(5).write.parquet(one)
    spark.range(9).withColumn("part", F.col("id") % 2).write.partitionBy("part").parquet(two)
    for run, stage in (("1", "one"), ("1", "two"), ("2", "one")):
        provenance.append(provenance.stage_outputs(spark, str(tmp_path / stage), stage, run), log)
    outputs = spark.read.parquet(log)
    assert {(r.run, r.stage) for r in provenance.current(outputs).collect()} == {("2", "one"), ("1", "two")}
    of = lambda folder, stage: provenance.files_below(spark, folder).withColumn("stage", F.lit(stage))
    there = lambda: of(one, "one").unionByName(of(two, "two"))
    assert there().count() == there().select("file").distinct().count() and provenance.changes(outputs, there()).count() == 0
    spark.range(3).write.mode("overwrite").parquet(one)
    wrong = provenance.changes(outputs, there()).collect()
    assert wrong and {(r.stage, r.wrong) for r in wrong} == {("one", "missing")}
    same = spark.createDataFrame([("1", s, "part-0", 1, f"sha of {s}") for s in ("one", "two")], provenance.OUTPUTS)
    assert provenance.changes(same, same).count() == 0  # one file name in two stages


def test_config_leaves_a_test_split():
    with pytest.raises(ValueError):
        provenance.Config(train=0.9, dev=0.1)


def test_events_are_read_back_up_to_a_broken_line(spark, tmp_path):
    folder = str(tmp_path / "log")
    provenance.append_events(spark.createDataFrame([("step", s) for s in (1, 2, 3)], "event string, step int").coalesce(1), folder)
    lines = [r.value for r in spark.read.text(folder).collect()]
    assert lines == [f'{{"event":"step","step":{s}}}' for s in (1, 2, 3)]


def test_roster(spark):
    rows = [(0, "a", "org/x", "X", 8, 4, None), (1, "a2", "org/x", "X again", 16, 2, "a"), (2, "b", "a", "B", 8, 4, None)]
    scorers = spark.createDataFrame(rows, roster.SCORERS)
    asked = spark.createDataFrame([(x,) for x in ("org/x", "a", "a2", "nope", None)], "asked string")
    got = {r["asked"]: (r["name"], r["label"]) for r in roster.resolved(asked, scorers).withColumn("label", roster.shown()).collect()}
    assert got == {"org/x": ("a", "X"), "a": ("a", "X"), "a2": ("a2", "X again"), "nope": (None, "nope"), None: (None, None)}
    assert roster.repeated(scorers).count() == 0 and [r["name"] for r in roster.repeated(scorers.union(scorers.limit(1))).collect()] == ["a"]
    w = roster.chosen_weight(spark.createDataFrame([("a", "0.5")], "name string, weight string"), scorers)
    assert {x["name"]: x["weight"] for x in w.collect()} == {"a": 0.5, "a2": 0.5}


def test_parity_with_numpy(spark):
    values = [3.0, 1.0, 4.0, 1.0, 5.0]
    got = [r["mean"] for r in parity.bootstrap_means(spark.createDataFrame(list(enumerate(values)), "idx int, v double"), "v", 6, 7).collect()]
    assert got == pytest.approx(np.array(values)[np.random.default_rng(7).integers(0, 5, (6, 5))].mean(axis=1))


def test_splits_are_read_by_partition(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train"), (2, "dev"), (3, "test"), (4, "held")], "id long, split string")
    readers.write_splits(rows, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {r.id for r in readers.split(back, "all").collect()} == {1, 2, 3} and readers.split(back, "dev").count() == 1


def test_build(spark, sf, tmp_path):
    config, out = provenance.Config(negatives=3), str(tmp_path / "corpus")
    first = build.run(spark, sf, out, config).collect()
    assert {r.stage for r in first} == {"records", "negatives", "problems"}
    records, mined = (spark.read.parquet(f"{out}/{n}") for n in ("records", "negatives"))
    assert mined.count() == 3 * records.count() and records.filter("size(quality_flags) > 0").count() == 0
    assert sorted(build.run(spark, sf, out, config).collect()) == sorted(first)
    runs = spark.read.parquet(f"{out}/_runs").collect()
    assert len(runs) == 3 and not any(r.failed for r in runs) and {r.engine for r in runs} == {provenance.engine()}
    with pytest.raises(Exception):
        build.run(spark, str(tmp_path / "nowhere"), str(tmp_path / "other"), config)
    assert [r.failed for r in spark.read.parquet(str(tmp_path / "other" / "_runs")).collect()] == [True]


def test_ranks_and_indices_are_exact_across_ranges(spark):
    import pandas as pd

    rng = np.random.default_rng(4)
    g, x = rng.integers(0, 2, 5000), np.where(rng.random(5000) < 0.5, rng.integers(0, 9, 5000), rng.normal(4, 3, 5000))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(5000) ** 3, "g": g, "x": x}))
    want = pd.Series(x).groupby(g).rank()
    assert np.allclose(ranking.average_ranks(df, ["g"], "x").orderBy("id").toPandas()["rank"], want)
    assert list(ranking.dense_index(df, "id").orderBy("id").toPandas()["idx"]) == list(range(5000))
    assert ranking.dense_index(df.filter("id < 0"), "id").count() == 0 and ranking.average_ranks(df.filter("id < 0"), ["g"], "x").count() == 0


def test_second_moments_equal_numpy(spark):
    v = np.random.default_rng(5).normal(size=(300, 6))
    n, mean, m = geometry.second_moments(spark.createDataFrame([(r.tolist(),) for r in v], "vec array<double>").repartition(3))
    assert n == 300 and np.allclose(mean, v.mean(0)) and np.allclose(m, v.T @ v / 300)
