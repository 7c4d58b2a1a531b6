"""The pipeline's stages against plain versions, each on its own input."""

import corpus_pipeline as C
from brute import WORDS, near_classes, spread_lines

from lumiform.llm import lines, toxicity
from lumiform.llm.common import written


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        labels = spark.read.parquet(f"{sf}/labels.parquet")
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
        docs = written(stage(spark, docs, sf), name.replace(" ", "-"))
        rows = docs.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before) and docs.columns[-2:] == ["sequence_id", "offset"]
            continue
        after = {r.doc_id: r for r in rows}
        assert docs.columns == columns and len(rows) == len(after)
        if name == "toxicity":
            assert set(after) == {d for d, s in scores.items() if s < toxicity.THRESHOLD}
        elif name == "line dedup":
            want = spread_lines([(d, r.text, r.source) for d, r in before.items()], lines.MIN_SITES)
            assert {d: r.text for d, r in after.items()} == want and all(r.n_chars == len(r.text) for d, r in after.items() if r.text != before[d].text)
        elif name == "near dedup":
            assert set(after) == set(near_classes([(d, r.text) for d, r in before.items()]).values())
        else:
            items = [WORDS.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            runs = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
            own = [runs(w) for w in items]
            hit = {d for d, r in before.items() for o in own if o and 2 * len(o & runs(WORDS.findall(r.text.lower()))) >= len(o)}
            assert set(after) == set(before) - hit
        assert all(after[d].lang == before[d].lang for d in after)


def test_run(spark, sf):
    assert C.run(spark, sf).count() > 0 and C.ORACLE_SQL is None


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, sf), "empty-" + name.replace(" ", "-"))
        assert docs.count() == 0


def test_odd_rows_and_clashing_names(spark, tmp_path):
    """Ids on several texts, null ids and texts, repeated rows, and columns with the names that the stages use inside."""
    item = "when the old clock on the tower strikes nine the two sisters who live by the river close their shop and walk home slowly"
    notice = "this notice stands on every page of every site"
    rows = [(1, "alpha beta gamma delta epsilon zeta eta theta", "s0"), (1, "quite other words are under the same id here", "s1"), (2, None, "s1"), (None, item, "s2"), (None, "a row that has no id but words", "s3"), (None, None, None), (3, item, "s3"), (3, "nothing of the benchmark is in this one at all", "s3")]
    rows += [(10 + i, f"own words of page {i} {'x' * i} that nobody else has\n{notice}", f"s{i}") for i in range(12)] + [(5, "a repeated row of words", "s5")] * 3
    names = "row long, row_ long, t1 long, t1_ string, class_id long, doc string, lines_removed long, score double, first int, keep int"
    docs = spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, 2, 3, "t", 4, "d", 5, 0.5, 6, 7) for d, t, s in rows], f"doc_id long, text string, lang string, source string, n_chars long, {names}")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "odd")
        assert docs.columns == columns, name
    got = docs.collect()
    assert {(r.row, r.row_, r.t1, r.t1_, r.class_id, r.doc, r.lines_removed, r.score, r.first, r.keep) for r in got} == {(1, 2, 3, "t", 4, "d", 5, 0.5, 6, 7)}
    kept = sorted((r.doc_id or 0, r.text or "") for r in got)
    assert kept == sorted([(1, rows[0][1]), (1, rows[1][1]), (2, ""), (0, rows[4][1]), (0, ""), (3, rows[7][1]), (5, "a repeated row of words"), *[(10 + i, rows[8 + i][1].split("\n")[0]) for i in range(12)]])
    assert {r.doc_id for r in C.packed(spark, docs, str(tmp_path)).collect()} == {r.doc_id for r in got}


def test_one_word_items_cost_no_documents(spark, tmp_path):
    """A benchmark of answers: the stage keeps what it keeps without them."""
    items = [(1, "Paris"), (2, "42"), (3, "Yes"), (4, "Barack Obama"), (5, "3 km")]
    long = (9, "if Robert buys 12 apples for 3 dollars each how much does Robert pay in total for all of the apples")
    docs = spark.createDataFrame([(1, "so Yes. In Paris it rains"), (2, "we met Barack Obama, then 42 others"), (3, "just 3 km more"), (4, "Well, " + long[1].replace("12", "7").replace("Robert", "Susan"))], "doc_id long, text string")
    kept = []
    for some in (items, [*items, long]):
        folder = tmp_path / str(len(some))
        spark.createDataFrame(some, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        kept.append(sorted(r.doc_id for r in C.without_benchmark(spark, docs, str(folder)).collect()))
    assert kept == [[1, 2, 3, 4], [1, 2, 3]]
