import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumiform.llm import variants as V


def counted(rows, every=97):
    """Word counts of (doc_id, text) rows by a loop."""
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            i = h % len(run)
            n[run[:i] + run[i + 1 :] if h % every == 0 else run] += 1
    return {w: c for w, c in n.items() if c >= V.MIN_COUNT and len(w) >= V.MIN_LENGTH}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(n):
    """The rows of group_variants by comparing what shares a deletion."""
    by = defaultdict(set)
    for w in n:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)
    near = {w: set() for w in n}
    for words in by.values():
        for a in words:
            near[a] |= {b for b in words if is_near(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@given(st.lists(st.integers(0, 30), unique=True, max_size=31), st.data())
def test_a_wavelet_tree_reports_rectangles(values, data):
    values = np.argsort(np.argsort(values))
    lo, least = (data.draw(st.integers(0, 31)) for _ in range(2))
    hi, most = data.draw(st.integers(lo, 32)), data.draw(st.integers(least, 32))
    lo, hi = min(lo, len(values)), min(hi, len(values))
    k, found = V.WaveletTree(values).report(*(np.array([x]) for x in (lo, hi, least, most)))
    assert sorted(found.tolist()) == sorted(v for v in values[lo:hi].tolist() if least <= v < most) and not k.any()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abÿ", min_size=5, max_size=8), max_size=40), st.integers(1, 6))
def test_every_pair_once_within_a_group(words, seed):
    import pyarrow as pa

    words = sorted(words)
    rows = [(w, len(w), short, side) for w in words for short in (len(w), len(w) - 1) if short >= 5 for side in (0, 1)]
    draw = np.random.default_rng(seed)
    rows = [rows[i] for i in draw.permutation(len(rows))]
    if not rows:
        return
    word, n, short, side = zip(*rows, strict=True)
    yes = [True] * len(rows)
    out = V.near_in_group(pa.table({"word": word, "n": n, "short": short, "side": side, "point": yes, "query": yes})).to_pydict()
    got = sorted(zip(out["word"], out["near"], strict=True))
    assert got == sorted((a, b) for a in words for b in words if is_near(a, b))
    assert all(n == len(b) for b, n in zip(out["near"], out["near_n"], strict=True))


def test_query_against_deletions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = V.op13_variants(spark, sf).collect()
    assert len(got) > 1000 and {tuple(r) for r in got} == grouped(counted(docs)) and len(got) == len(set(got))


def test_query_against_sql(spark, sf):
    assert oracle.spark_rows(V.op13_variants(spark, sf)) == oracle.duck_rows(oracle.connect(sf), V.OP13_SQL)


@pytest.mark.parametrize("points", [40_000, 30])
def test_hot_halves_become_grids(spark, points):
    """A prefix and a suffix that many words share, with a group's bound far below their number."""
    draw = np.random.default_rng(3)
    words = {f"shared{''.join(draw.choice(list('abc'), 4))}" for _ in range(200)} | {f"{''.join(draw.choice(list('abc'), 4))}shared" for _ in range(200)}
    n = {w: int(draw.integers(3, 60)) for w in sorted(words)}
    rows = V.group_variants(spark.createDataFrame(list(n.items()), "word string, n long"), points=points).collect()
    assert {tuple(r) for r in rows} == grouped(n) and len(rows) == len(n)


def test_chains_end_at_their_root(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc"]
    n = {w: 3 * 2**i for i, w in enumerate(words)}
    rows = {r.word: r for r in V.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()}
    assert {r.root for r in rows.values()} == {"bbbcc"} and rows["aaaaa"].form == "aaaab" and rows["bbbcc"].form is None
    with pytest.raises(ValueError):
        V.group_variants(spark.createDataFrame([("abcde", 3)], "word string, n long"), ratio=1)


def test_odd_texts(spark):
    """Null and empty texts and ids, repeated rows, ties, capitals beyond ASCII, very long runs, clashing columns."""
    long = "xy" * 3000
    rows = [(1, "Straße straße STRAßE ÀLPHA Àlpha àlpha"), (1, "Straße straße STRAßE ÀLPHA Àlpha àlpha"), (None, "Straße color colour " * 3), (None, None), (2, ""), (3, None)]
    rows += [(4, " ".join([long, long[:-1], long[1:], "z" + long[1:]] * 3)), (5, "gamma gamna " * 3 + "gamme " * 12 + "gamms " * 12 + "abc abcd " * 5)]
    frame = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], "doc_id long, text string, word string, n int, run_ string")
    got = V.group_variants(V.corpus_words(frame)).collect()
    assert {tuple(r) for r in got} == grouped(counted(rows))
    by = {r.word: r for r in got}
    assert by["gamma"].form == "gamme" and by["gamme"].form is None and by[long].n_near == 3 and "Àlpha" in by
    empty = V.group_variants(V.corpus_words(frame.limit(0)))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("every", [1, 2])
def test_deleted_code_points(spark, every):
    rows = [(i % 3, "wordé Wordy sentence") for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(map(tuple, V.corpus_words(frame, every=every).collect())) == counted(rows, every)
