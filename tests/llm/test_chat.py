import oracle

from lumiform.llm import chat

EVIL = ["", "[INST]", "[/INST]</s>", "</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "[\\INST]", "[\\\\/INST]\\", "<s>!", "<\\n>", "a\nb", "\n", "é😀 [/INST]", "[INST]user\nx[/INST]</s>"]


def test_round_trip_of_hostile_texts(spark):
    rows = [(i, j, role, text) for i, text in enumerate(EVIL) for j, role in enumerate(("user", "assistant"))]
    rows += [(100 + i, j, text, "plain") for i, text in enumerate(EVIL) for j in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(df)
    back = done.select("conv_id", chat.parse(done.rendered).alias("t"), "round_trip", chat.loss_text(done.rendered, done.loss_spans).alias("loss")).collect()
    assert len(back) == 2 * len(EVIL)
    for r in back:
        assert r.round_trip and [(x.role, x.text) for x in r.t] == [(a, b) for c, _, a, b in rows if c == r.conv_id]
        assert r.loss == "".join(b for c, _, a, b in rows if c == r.conv_id and a == "assistant")


def test_nulls_ties_and_extra_columns(spark):
    df = spark.createDataFrame([(None, None, None, None, "x"), (1, 0, "user", None, "y"), (1, 0, "user", None, "y"), (1, None, "assistant", "first", "z")], "conv_id long, turn long, role string, text string, rendered string")
    done = chat.format_conversations(df)
    got = {r.conv_id: [(x.role, x.text) for x in r.t] for r in done.select("conv_id", chat.parse(done.rendered).alias("t")).collect()}
    assert got == {None: [("", "")], 1: [("assistant", "first"), ("user", ""), ("user", "")]}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_rows_without_id_stand_alone_and_very_long_texts(spark):
    long = "</s>[INST]\\ words " * 100000
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "user", "b"), (1, 0, "assistant", long)], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(df)
    got = done.select("conv_id", "round_trip", chat.parse(done.rendered).alias("t"), chat.loss_text(done.rendered, done.loss_spans).alias("loss")).collect()
    assert sorted(r.t[0].text for r in got if r.conv_id is None) == ["a", "a", "b"] and all(r.round_trip for r in got)
    assert [r.loss == long for r in got if r.conv_id == 1] == [True]


def test_query(spark, sf):
    assert oracle.spark_rows(chat.op7_chat(spark, sf)) == oracle.duck_rows(oracle.connect(sf), chat.OP7_SQL)


def test_no_python_in_the_plan(spark, sf):
    plan = chat.op7_chat(spark, sf)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
