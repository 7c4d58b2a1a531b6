import random

import numpy as np
import pyarrow as pa
import pytest
from brute import near_classes, shingles

from lumiform.llm import bagminhash as B

SCHEMA = "doc_id long, text string, class_id int, n_links string, node int"


def weighted(a, b):
    x, y = shingles(a), shingles(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


@pytest.mark.parametrize("seed", range(4))
def test_signatures_are_unbiased(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3 if seed % 2 else 5000)]  # a small vocabulary makes heavy shingles
    a = [draw.choice(vocabulary) for _ in range(60 + 200 * seed)]
    b = [w if draw.random() > 0.05 else "zz" for w in a] + a[: 20 * seed]
    m = 6000
    s = B.signatures(*B.multisets(pa.array([" ".join(a), " ".join(b)]))[:3], m=m)
    want = weighted(" ".join(a), " ".join(b))
    assert abs(B.estimate(s[0], s[1]) - want) < 4 * np.sqrt(max(want * (1 - want), 0.01) / m)


def family(draw, size, words, edits):
    base = [f"t{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def classes(spark, rows):
    return sorted((r.doc_id if r.doc_id is not None else -99, r.class_id) for r in B.classes(spark.createDataFrame([(d, t, 0, "x", 1) for d, t in rows], SCHEMA)).collect())


@pytest.mark.parametrize("block", [256, 7])
def test_classes_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "VERIFIED", block * 1000)
    draw = random.Random(5)
    texts = family(draw, 60, 150, 6) + family(draw, 12, 40, 2) + family(draw, 8, 400, 3) + [f"alone {i} {draw.random()} one two three" for i in range(20)]
    texts += [texts[0]] * 5 + [texts[0].upper(), "a b", "a b", "A, b!", "", "  .", "word " * 300, "word " * 290, "word " * 200]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    assert classes(spark, rows) == sorted(near_classes(rows).items())


def test_structured_long_words_and_texts_stay_apart(spark):
    bits = [bin(i).count("1") % 2 for i in range(8192)]
    rows = []
    for n in (1024, 2048, 4096, 8192):
        for flip in (0, 1):
            rows.append((len(rows), "".join("ab"[b ^ flip] for b in bits[:n])))
            rows.append((len(rows), " ".join(("left", "right")[b ^ flip] for b in bits[:n])))
    assert classes(spark, rows) == sorted(near_classes(rows).items()) and len({c for _, c in classes(spark, rows)}) >= 8


def test_very_long_text_and_links(spark):
    draw = random.Random(9)
    long = " ".join(f"v{draw.randrange(10**6)}" for _ in range(60000))
    rows = [(1, long), (2, long.replace("v1", "u1", 200)), (3, long), (4, "short and other")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in B.classes(spark.createDataFrame([(d, t, 0, "x", 1) for d, t in rows], SCHEMA)).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 0)}


def test_nulls_ids_on_several_texts_and_empty(spark):
    a, b = "one two three four five six seven", "completely other words stand in this text here"
    rows = [(None, a), (1, a), (2, None), (3, ""), (4, a), (4, b), (5, b), (5, b)]
    assert classes(spark, rows) == [(-99, None), (1, 1), (2, 2), (3, 2), (4, 1), (4, 1), (5, 1), (5, 1)]
    assert B.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_id_links_its_texts_though_none_has_it_as_least(spark):
    a, b = "one two three four five six seven", "completely other words stand in this text here"
    assert classes(spark, [(3, a), (7, a), (5, b), (7, b), (9, "and a third one that is alone")]) == [(3, 3), (5, 3), (7, 3), (7, 3), (9, 9)]


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.class_id for r in B.op3_near_dedup(spark, sf).collect()} == near_classes(rows)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(119, 300), (200, 201), (205, 201), (205, 210)]
    got = {r.node: r.label for r in B.components(spark.createDataFrame(edges + edges[:3], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)} | {300: 100} | {n: 200 for n in (200, 201, 205, 210)}
    assert B.components(spark.createDataFrame([], "a long, b long")).count() == 0


def crowded_bucket(spark, n, seed=1):
    """Nodes whose signatures agree in one band and nowhere else, but for ten planted pairs: rows and sets for links_across, and the pairs."""
    import numpy as np

    draw = np.random.default_rng(seed)
    registers = draw.integers(0, 256, (n, B.REGISTERS), np.uint8)
    registers[:, : B.ROWS] = 7
    codes = np.sort(draw.integers(0, 2**63, (n, 40)).astype(np.uint64), axis=1)
    pairs = [(i, i + n // 2) for i in range(0, n // 2, n // 20)][:10]
    for a, b in pairs:
        registers[b] = registers[a]
        registers[b, -9:] += 1
        codes[b] = codes[a]
        codes[b, -2:] += np.uint64(1)
    bucket = int(B.banded(registers[:1]).view(np.int64)[0, 0])
    rows = spark.createDataFrame([(bucket, n, i, i, bytearray(registers[i].tobytes())) for i in range(n)], "bucket long, n long, node long, label long, registers binary")
    sets = spark.createDataFrame([(i, bytearray(np.sort(codes[i]).tobytes())) for i in range(n)], "node long, codes binary")
    return rows, sets, pairs


def test_a_bucket_of_nodes_that_no_hub_links(spark):
    rows, sets, pairs = crowded_bucket(spark, 3000)
    assert sorted((r.a, r.b) for r in B.links_across(rows, sets).collect()) == pairs
