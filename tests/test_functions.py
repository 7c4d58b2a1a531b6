"""Renderers, budgets, names and progress against literal results."""

import html
import json

import pytest
from pyspark.sql import functions as F

from lumiform.functions import budget, render
from lumiform.functions import text as T
from lumiform.operators import corpus


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def pairs_of(*pairs):
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in pairs])


LIGHTHOUSE = (("name", "Skerry Vohr"), ("height", "48 m"), ("first lit", "1844"))
BODY = "It stands on a reef."


def written_out(name, pairs, body):
    """The formats by their rules: how a pair, the list of pairs and the body are joined."""
    pair = {"yaml": "{}: {}", "toml": '{} = "{}"', "inline_kv": "{}={}", "markdown": "**{}**: {}"}
    if name == "json":
        return json.dumps(dict(pairs)) + "\n" + body
    head = (" " if name == "inline_kv" else "\n").join(pair[name].format(k, v) for k, v in pairs)
    return {"yaml": "---\n" + head + "\n---\n", "markdown": head + "\n\n"}.get(name, head + "\n") + body


@pytest.mark.parametrize("name", sorted(render.RENDERERS))
def test_render(spark, name):
    assert one(spark, render.RENDERERS[name](pairs_of(*LIGHTHOUSE), F.lit(BODY))) == written_out(name, LIGHTHOUSE, BODY)


def test_json_escapes_and_keeps_the_last_value(spark):
    odd = (("k", "first"), ('é"\\\n', "😀\t"), ("k", "second"))
    assert one(spark, render.json(pairs_of(*odd), F.lit(""))) == json.dumps(dict(odd)) + "\n"


def test_empty_metadata_keeps_delimiters(spark):
    none = F.array().cast("array<struct<key:string,value:string>>")
    assert one(spark, render.yaml(none, F.lit("b"))) == "---\n\n---\nb"


def test_budget_of_words(spark):
    count, question = budget.word_count, "when was the lighthouse first lit"
    worst = max(len(written_out(n, LIGHTHOUSE, "").split()) for n in render.RENDERERS)
    assert one(spark, budget.budget_of(F.lit(question), pairs_of(*LIGHTHOUSE), count)) == 512 - 6 - worst - 3 - 5


@pytest.mark.parametrize("body, n, expected", [("a b", 19, None), ("", 30, ""), ("one two", 30, "one two"), ("First one. " * 20, 25, ("First one. " * 12).strip()), ("x " * 40, 25, ("x " * 24).strip())])
def test_truncate(spark, body, n, expected):
    assert one(spark, budget.truncate(F.lit(body), F.lit(n), "words")) == expected


@pytest.mark.parametrize("answers, expected", [(["48 M"], "metadata_only"), (["on a reef"], "body_only"), (["vohr"], "both"), (["1950"], "neither"), (["  "], "no_answer"), ([], "no_answer")])
def test_answer_class(spark, answers, expected):
    found = F.array(*[F.lit(a) for a in answers]).cast("array<string>")
    assert one(spark, T.answer_class(found, F.lit("Skerry Vohr 48 m"), F.lit("Vohr stands ON a reef"))) == expected


def test_entities_match_python(spark):
    text = "a &amp;lt; b &copy; &quot;q&quot; &middot; &mdash;"
    assert one(spark, T.decode_entities(F.lit(text))) == html.unescape(text)
    text = "&eacute;&#233;&#xE9;&#XE9; &#128;&#150; &#x1F600; &nope; &#0;&#xD800;&#x110000; &nbsp;&apos; a & b &; &#; &lt;&Eacute; &thetasym;"
    assert one(spark, T.decode_entities(F.lit(text))) == html.unescape(text)
    assert one(spark, T.decode_entities(F.lit(""))) == "" and one(spark, T.decode_entities(F.lit(None).cast("string"))) is None


def test_cells_lose_hidden_spans_whole(spark):
    cell = 'a<span style="display: none">x<span>y</span>z</span>b<sup class="reference">[1]</sup> c&eacute;'
    assert one(spark, T.clean_cell(F.lit(cell))) == "ab cé"


def test_infobox_rows(spark):
    page = '<table class="infobox"><tr><th>• Born</th><td>1946<sup class="reference">[2]</sup></td></tr><tr><th>Born</th><td>no</td></tr><tr><th>E</th><td> </td></tr></table>'
    rows = corpus.infobox_rows(spark.createDataFrame([(1, page)], "id long, html string")).orderBy("pos").collect()
    assert [(r.key, r.value, r.drop) for r in rows] == [("Born", "1946", None), ("Born", "no", "duplicate"), ("E", "", "empty")]


def test_progress(spark):
    assert one(spark, T.duration(F.lit(3725))) == "1:02:05"
    assert one(spark, T.eta_seconds(F.lit(0), F.lit(5), F.lit(3.0))) == 0.0
    assert one(spark, T.parse_progress(F.lit("done=1 total=2"))) == {"done": "1", "total": "2"}
    assert one(spark, T.parse_progress(F.lit("nothing"))) is None


def test_split_shares_and_order_independence(spark):
    titles = [(f"t{i}",) for i in range(50)]
    a = {r.title: r.split for r in corpus.article_split(spark.createDataFrame(titles, "title string")).collect()}
    b = {r.title: r.split for r in corpus.article_split(spark.createDataFrame(titles[::-1] * 2, "title string")).collect()}
    assert a == b and [list(a.values()).count(s) for s in corpus.SPLITS] == [40, 5, 5]
    assert corpus.article_split(spark.createDataFrame([("only",)], "title string")).first()["split"] == "test"
