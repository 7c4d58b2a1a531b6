import math

import numpy as np
import oracle
import pytest

from lumiform.llm import hardneg as H

SCHEMA = "vec_id long, embedding array<float>, label int, place string, home int, score double"


def mined(rows, every=50, positives=5, negatives=3):
    """All rows of hard_negatives by sorting."""
    kept = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [max(-H.BOUND, min(H.BOUND, math.floor(256 * float(np.float32(x))))) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for a, (i, v, y) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, z) for b, (j, w, z) in enumerate(kept) if b != a)  # noqa: B905
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [(t, k) for t, k, z in scored if z != y and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit)]
    return sorted(out)


def clustered(n, dims=6, seed=0, labels=4):
    """Vectors around few directions, so that windows hold many rows."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, 0.3, (5, dims))
    return [(i, (centres[i % 5] + draw.normal(0, 0.12, dims)).astype(np.float32).tolist(), int(draw.integers(0, labels))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)


def got(spark, rows, **more):
    return sorted(tuple(r) for r in H.hard_negatives(frame(spark, rows), **more).collect())


@pytest.fixture
def small(monkeypatch):
    """Trees, leaves and blocks so small that a few hundred rows make many."""
    for name, value in (("TREE_ROWS", 40), ("LEAF", 4), ("QUERIES", 7), ("BALLS", 3)):
        monkeypatch.setattr(H, name, value)


def test_against_sorting_with_many_trees(spark, small):
    rows = clustered(600)
    want = mined(rows)
    assert len(want) > 100 and got(spark, rows) == want


def test_against_sorting_with_one_tree(spark):
    rows = clustered(300, dims=3, seed=4)
    want = mined(rows, every=10, positives=2, negatives=5)
    assert len(want) > 100 and got(spark, rows, every=10, positives=2, negatives=5) == want


def test_copies_ties_and_hot_vectors(spark, small):
    """A third of all rows share a vector, and ids repeat."""
    rows = clustered(200, seed=2)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(150)] + [(50, rows[50][1], rows[50][2]), (50, rows[51][1], 1)]
    want = mined(rows)
    assert len(want) > 50 and got(spark, rows) == want


def test_what_takes_no_part(spark):
    v = [0.5, 0.25]
    rows = [(50, v, 1), (1, v, 1), (2, None, 1), (3, [0.5, None], 1), (4, [math.nan, 1.0], 1), (5, [math.inf, 1.0], 1), (6, v, None), (None, v, 1), (8, [0.3, 0.3], 2), (9, [0.4], 2), (10, [0.2, 0.4, 9.0], 2), (11, [], 2)]
    want = mined(rows)
    assert want == got(spark, rows) and [r[3] for r in want] == [8, 9, 10] and {r[1] for r in want} == {1}


def test_empty_and_no_anchors(spark):
    rows = clustered(20)[1:]
    for some in (frame(spark, rows), frame(spark, rows).limit(0)):
        out = H.hard_negatives(some)
        assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_huge_components_stay_exact(spark):
    rows = [(50 * i, [3e38 if i % 2 else 4000.0 + i, 1.0 + i, -(10.0**i)], i % 2) for i in range(12)]
    assert got(spark, rows) == mined(rows)


def test_nodes_out_of_reach_are_not_entered():
    draw = np.random.default_rng(1)
    x = np.concatenate([draw.integers(-3, 3, (500, 8)) + 100 * sign for sign in (-1, 1)]).astype(float)
    label = np.repeat([0, 1], 500)
    tree = H.build(x, np.arange(1000), np.arange(1000), label, 16)
    ask = lambda same, low, high: H.Queries(np.full((1, 8), 100.0), np.array([1]), np.array([-1]), same, np.array([low]), np.array([high]), np.array([H.NONE]))
    for same, low, high, part in ((True, H.NONE, H.MOST, 0.5), (False, -90000, -79900, 0.55), (False, 10**6, H.MOST, 0.0)):
        visited = []
        scores, ids = H.search(tree, ask(same, low, high), 3, visited)
        assert len(visited) <= part * len(tree.start)
        s = [(-int(a @ np.full(8, 100)), i) for i, a in enumerate(x) if (label[i] == 1) == same and low <= a @ np.full(8, 100) <= high]
        want = sorted(s)[:3]
        assert [(-a, b) for a, b in zip(scores[0].tolist(), ids[0].tolist(), strict=True) if a > H.NONE] == want


def test_bounds_hold():
    draw = np.random.default_rng(5)
    x, q = draw.integers(-200, 200, (300, 12)).astype(float), draw.integers(-200, 200, (40, 12)).astype(float)
    tree = H.build(x, np.arange(300), np.arange(300), np.zeros(300, int), 8)
    low, high = H.bounds(q, tree.centre, tree.radius)
    for n, (a, b) in enumerate(zip(tree.start, tree.end, strict=True)):
        s = q @ tree.x[a:b].T
        assert (s >= low[:, n, None]).all() and (s <= high[:, n, None]).all()
    back = H.Tree.unpacked(tree.packed())
    assert all(np.array_equal(p, r) for p, r in zip(tree, back, strict=True))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    assert oracle.spark_rows(H.op11_hard_negatives(spark, folder)) == oracle.duck_rows(oracle.connect(folder), H.OP11_SQL)
