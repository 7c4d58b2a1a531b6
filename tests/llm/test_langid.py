import math
import zlib

import numpy as np
import pytest

from lumiform.llm import langid as L


def segmentations(raw, pieces):
    """All ways to cut raw into pieces."""
    if not raw:
        return [[]]
    return [[raw[:i], *rest] for i in range(1, len(raw) + 1) if raw[:i] in pieces for rest in segmentations(raw[i:], pieces)]


@pytest.fixture(scope="module")
def toy(tmp_path_factory):
    """A vocabulary file of few pieces besides single bytes, and the numbers of its pieces."""
    import base64

    path = tmp_path_factory.mktemp("toy") / "toy.tiktoken"
    held = [b"th", b"the", b" the", b" t", b"he", b"n", " é".encode(), "é".encode(), b"ABC", b"x y", b"9"]
    path.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for i, p in enumerate(held)))
    v = L.vocabulary(str(path))
    letters = [bytes([b]) for b in [32, *range(97, 123), *range(128, 256)]]
    pieces = {p: i for i, p in enumerate(sorted({*held[:-3], *letters}))}
    assert v.n == len(pieces)
    return str(path), v, pieces


def test_forward_sums_all_segmentations(toy):
    _, v, pieces = toy
    draw = np.random.default_rng(0)
    logp = np.log(draw.dirichlet(np.ones(v.n), 3).T)
    units = [" the", " then", " é", "the", " hethen", " t", " ünthe"]
    for u, got in zip(units, L.log_probabilities(units, v, logp), strict=True):
        ways = segmentations(u.encode(), pieces)
        for c in range(3):
            assert got[c] == pytest.approx(math.log(sum(math.exp(sum(logp[pieces[p], c] for p in w)) for w in ways)))


def test_expected_counts_are_posterior_means(toy):
    _, v, pieces = toy
    draw = np.random.default_rng(1)
    logp = np.log(draw.dirichlet(np.ones(v.n), 2).T)
    units, n = [" the", " thethe", " é"], np.array([[1, 2], [3, 0], [0, 5]])
    want = np.zeros((v.n, 2))
    for u, times in zip(units, n, strict=True):
        for c in range(2):
            ways = [(w, math.exp(sum(logp[pieces[p], c] for p in w))) for w in segmentations(u.encode(), pieces)]
            for w, p in ways:
                for x in w:
                    want[pieces[x], c] += times[c] * p / sum(q for _, q in ways)
    assert L.expected(units, n.astype(float), v, logp) == pytest.approx(want)


def test_units():
    assert L.units("The THE naïve_x2 ²½ a²") == [" the", " the", " naïve", " x", " a²"]
    long = L.units("é" * 200)
    assert "".join(long) == " " + "é" * 200 and max(map(len, long)) == L.LONGEST
    assert L.units(None) == L.units("") == L.units("123 -- _") == []


def plain_model(rows, path, rounds):
    """Training by loops: the same sample (all rows), all segmentations weighed by the lattice's own sums over one unit at a time."""
    v = L.vocabulary(path)
    known = [(t, lang) for d, t, lang in rows if t is not None and lang is not None and d is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    languages = sorted({lang for t, lang in known if L.units(t)})
    logp = np.full((v.n, len(languages)), -math.log(v.n))
    for _ in range(rounds):
        total = np.zeros_like(logp)
        for t, lang in known:
            for u in L.units(t):
                one = np.zeros((1, len(languages)))
                one[0, languages.index(lang)] = 1
                total += L.expected([u], one, v, logp)
        logp = L.probabilities(total)
    return languages, logp


def test_training_against_loops(spark, toy):
    path, v, _ = toy
    rows = [(i, "the then he" if i % 2 else "né the é", "xx" if i % 2 else "yy") for i in range(24)]
    rows += [(None, "the", "zz"), (30, None, "zz"), (31, "the", None), (32, "123", "ww"), (1, "the then he", "xx")]
    frame = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, lang string, unit int, by string")
    model = L.train(frame, path, rounds=3)
    languages, logp = plain_model(rows, path, 3)
    assert model.languages == languages == ["xx", "yy"] and model.logp == pytest.approx(logp, abs=1e-5)
    got = {(r.doc_id, r.lang_pred): r.score for r in L.predict(frame, model).collect()}
    for d, text, _ in rows:
        total = sum((L.log_probabilities([u], v, model.logp.astype(float))[0] for u in L.units(text)), np.zeros(2))
        if L.units(text):
            assert got[d, languages[int(total.argmax())]] == pytest.approx(1 / np.exp(total - total.max()).sum())
        else:
            assert got[d, "und"] == 0


def test_labels_of_the_held_out_third_change_nothing(spark):
    rows = [(i, "the house of the word and that" if i % 2 else "das haus und der satz mit dem", "en" if i % 2 else "de") for i in range(60)]
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    assert 10 < sum(held) < 30
    wrong = [(i, t, "qq" if h else lang) for (i, t, lang), h in zip(rows, held, strict=True)]
    schema = "doc_id long, text string, lang string"
    a, b = (L.train(spark.createDataFrame(x, schema)) for x in (rows, wrong))
    assert a.languages == b.languages == ["de", "en"] and np.allclose(a.logp, b.logp)
    got = L.predict(spark.createDataFrame(rows, schema), a).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: lang for i, _, lang in rows}


def test_odd_texts(spark):
    rows = [(1, "the and", "en")] * 3 + [(2, None, "en"), (3, "", "de"), (4, "12 34", "en"), (None, "the", None), (5, "der und " * 60000, "de"), (6, "z" * 100000, None), (7, "漢字 the", "de")]
    frame = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, text_ string")
    got = L.predict(frame, L.train(frame)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.lang_pred == "und") == (r.doc_id in (2, 3, 4)) for r in got) and len({r for r in got if r.doc_id == 1}) == 1
    none = L.train(frame.limit(0))
    assert none.languages == [] and {(r.lang_pred, r.score) for r in L.predict(frame, none).collect()} == {("und", 0.0)}
    assert L.predict(frame.limit(0), L.train(frame)).count() == 0


def test_query_and_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = L.op12_language(spark, folder).collect()
    lang = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect())
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    judged = [(lang[r.doc_id], r.lang_pred) for r in rows if r.held_out and lang[r.doc_id]]
    for x in set(lang.values()) - {None}:
        assert np.mean([p == y for y, p in judged if y == x]) > 0.97
