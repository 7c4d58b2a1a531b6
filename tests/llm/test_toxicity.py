import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import WORDS

from lumiform.llm import toxicity as T


def test_features_are_words_pairs_and_skip_pairs():
    texts = ["You are a Fool", "fool", "", None, "a b", "you ARE a fool!"]
    index, ptr = T.features(pa.array(texts))
    for i, t in enumerate(texts):
        n = len(WORDS.findall(t or ""))
        assert ptr[i + 1] - ptr[i] == n + max(0, n - 1) + max(0, n - 2)
    assert sorted(index[ptr[0] : ptr[1]]) == sorted(index[ptr[5] : ptr[6]])
    assert index[ptr[1]] in index[ptr[0] : ptr[1]]


def test_ftrl_matches_the_plain_update(monkeypatch):
    monkeypatch.setattr(T, "L1", 0.1)
    draw = np.random.default_rng(0)
    examples = [np.unique(draw.integers(0, 12, 5)) for _ in range(40)]
    labels = np.array([float(3 in x) for x in examples])
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0)) <= T.L1 else -(z[i] - np.sign(z[i]) * T.L1) / ((T.BETA + np.sqrt(n[i])) / T.ALPHA + T.L2)
    for _ in range(2):
        for x, y in zip(examples, labels, strict=True):
            x = [*x, T.BIAS]
            w = {i: weight(i) for i in x}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in x:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / T.ALPHA * w[i]
                n[i] = old + g * g
    state = None
    for _ in range(2):  # the state goes from one learner to the next
        learner = T.Learner(state)
        for x, y in zip(examples, labels, strict=True):
            learner.learn(np.append(x, T.BIAS), y)
        state = learner.state()
    w = T.Learner(state).weights()
    assert np.flatnonzero(w).tolist() == sorted(i for i in z if weight(i)) and w[list(z)] == pytest.approx([weight(i) for i in z])


def test_query_and_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = T.op2_toxicity(spark, folder).collect()
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").collect())
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    judged = [(r.predicted, r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, clean = [x for x in judged if x[2]], [x for x in judged if not x[2]]
    assert np.mean([p for p, _, _ in toxic]) > 0.6 and np.mean([p for p, _, _ in clean]) < 0.01
    assert np.mean([a[1] > b[1] for a in toxic for b in clean]) > 0.95


def plain_scores(docs, labels):
    """The same model by loops and dictionaries over the same hashed coordinates."""
    known = {}
    for d, y in labels:
        if d is not None and y is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            known[d] = max(y, known.get(d, y))
    coordinates = lambda t: sorted(set(T.features(pa.array([t], pa.string()))[0].tolist())) + [T.BIAS]
    texts = {}
    for d, t in docs:
        if d in known:
            texts[d] = min(t or "", texts.get(d, t or ""))
    z, n = {}, {}
    weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= T.L1 else -(z[i] - np.sign(z[i]) * T.L1) / ((T.BETA + np.sqrt(n[i])) / T.ALPHA + T.L2)
    return known, texts, coordinates, z, n, weight


def test_query_against_loops(spark, monkeypatch):
    monkeypatch.setattr(T, "L1", 0.5)
    docs = [(i - 6, ("you awful fool " if i % 3 == 0 else "a kind word here ") + f"number {i % 5}") for i in range(60)] + [(4, None), (70, "x " * 200000)]
    labels = [(d, int("fool" in (t or ""))) for d, t in docs] + [(5, None), (None, 1)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(a, b, 0) for a, b in labels], "doc_id long, toxic int, y_ int")
    weights = T.train(d, lab)
    known, texts, coordinates, z, n, weight = plain_scores(docs, labels)
    ids = spark.createDataFrame([(k,) for k in known], "doc_id long")
    orders = [[(r.p, r.doc_id, r.a) for r in ids.selectExpr(f"xxhash64({e}, doc_id) AS p", "doc_id", f"pmod(xxhash64(7, doc_id), {T.CALIBRATION}) = 0 AS a").collect()] for e in range(T.EPOCHS)]
    for order in orders:
        for _, i, aside in sorted(order):
            if aside:
                continue
            x, y = coordinates(texts[i]), known[i]
            w = {k: weight(k) for k in x}
            g = 1 / (1 + np.exp(-np.clip(sum(w.values()), -30, 30))) - y
            for k in x:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / T.ALPHA * w[k]
                n[k] = old + g * g
    held = [(i, known[i]) for _, i, aside in sorted(order) if aside]
    assert 0 < sum(y for _, y in held) < len(held)
    a, b = T.calibrate(np.array([sum(weight(k) for k in coordinates(texts[i])) for i, _ in held]), np.array([float(y) for _, y in held]))
    want = {t: 1 / (1 + np.exp(-np.clip(a * sum(weight(k) for k in coordinates(t)) + b, -30, 30))) for _, t in docs}
    got = T.score(spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double"), weights).collect()
    by = dict(docs)
    assert len(got) == len(docs) and all(r.score == pytest.approx(want[by[r.doc_id]]) or r.doc_id == 4 for r in got)


def test_nulls_ties_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "bad awful", 0.5), (1, "bad awful", 0.5), (2, None, 0.1), (None, "", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    rows = T.score(docs, T.train(docs, labels)).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert {r.score for r in T.score(docs, T.train(docs, labels.limit(0))).collect()} == {0.5}
    assert T.score(docs.limit(0), T.train(docs, labels)).count() == 0
    kept = T.accepted(docs, (np.array([T.BIAS]), np.array([-1.0])))
    assert kept.columns == docs.columns and kept.count() == 4


def test_calibration_finds_the_gap():
    margins = np.concatenate([np.linspace(-6, -4, 300), np.linspace(-2, 0, 30)])
    a, b = T.calibrate(margins, (margins > -3).astype(float))
    p = 1 / (1 + np.exp(-(a * margins + b)))
    assert (p[:300] < 0.5).all() and (p[300:] > 0.5).all()
