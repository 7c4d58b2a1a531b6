import random

import oracle
import pytest
from brute import repeats

from lumiform.llm import suffix


def found(spark, rows):
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, h1 int")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.repeats(df).collect()}


@pytest.mark.parametrize("group", [4000, 3])
def test_against_all_positions(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)  # 3: nearly all seeds are salted
    draw = random.Random(3)
    some = lambda n: " ".join(draw.choice(["alpha", "beta", "é", "zz"]) + str(draw.randint(0, 99)) for _ in range(n))
    passages = [some(40) for _ in range(5)]
    rows = []
    for i in range(50):
        parts = [some(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            p, a = draw.choice(passages), draw.randint(0, 60)
            parts += [p[a : a + draw.randint(80, 300)], some(draw.randint(0, 30))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 400), (101, "ab" * 300), (102, "a" * 150), (103, None), (104, ""), (105, rows[3][1]), (106, rows[3][1]), (107, "a" * 99), (108, "a" * 100), (109, rows[5][1][:150])]
    draw.shuffle(rows)
    assert found(spark, rows) == repeats(rows)


def test_blocks_of_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 500)
    draw = random.Random(8)
    p = "".join(draw.choice("abcdef ") for _ in range(400))
    rows = [(i, p[i : i + 250] + str(i) * 60) for i in range(40)]
    assert found(spark, rows) == repeats(rows)


def test_random_small_alphabets(spark):
    draw = random.Random(1)
    rows = [(i, "".join(draw.choice("ab") * draw.choice((1, 1, 30)) for _ in range(draw.randint(0, 120)))) for i in range(60)]
    assert found(spark, rows) == repeats(rows)


def test_structured_strings_and_very_long_texts(spark):
    bits = [bin(i).count("1") % 2 for i in range(8192)]
    rows = [(2 * k + flip, "".join("ab"[b ^ flip] for b in bits[: 1024 << k])) for k in range(4) for flip in (0, 1)]
    assert found(spark, rows) == repeats(rows)
    draw = random.Random(4)
    long = "".join(draw.choice("abcdefghij ") for _ in range(300000))
    rows = [(1, long), (2, "x" + long[1000:1400] + "y" + long[5000:5099]), (3, long)]
    assert found(spark, rows) == repeats(rows)


def test_equal_ranks_are_held_against_the_bytes():
    import numpy as np

    data = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8)
    assert suffix.exact_ranks(suffix.lanes(data), np.array([0, 100, 200]), np.array([1, 1, 1])).tolist() == [0, 1, 0]


def test_null_ids_repeated_rows_and_empty(spark):
    text = "x" * 50 + "the same long text " * 8
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed == r.n_bytes, r.n_removed) for r in suffix.repeats(df).collect())
    own = repeats([(1, text)])[1][1]
    assert got == [(0, False, 0), (1, False, own), (1, False, own), (2, True, len(text))]
    assert suffix.repeats(df.limit(0)).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.op8_suffix_dedup(spark, sf).collect()} == repeats(rows)


def test_query_against_sql(spark, sf):
    assert oracle.spark_rows(suffix.op8_suffix_dedup(spark, sf)) == oracle.duck_rows(oracle.connect(sf), suffix.OP8_SQL)
