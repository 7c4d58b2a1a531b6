import os
import sys
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from lumiform.llm import tokens

ODD = ["it's don't we've I'll 'em  'tis  x\n\n y\t z ''s a's", "  lead", "trail  \n ", "", "a b c　", "'s", "x 's", "日本 語 éa 12a3 ½ __ \r\n\r\n  q", "!'s", "'' 's", "s'", "' ", "'re", "'r", "<|endoftext|> x", "😀'll"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return t


def same(reference, texts):
    ids, ptr = tokens.encode(pa.array(texts, pa.string()), tokens.default_path())
    for i, e in enumerate(reference.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[ptr[i] : ptr[i + 1]].tolist() == e.ids, texts[i]


def test_ids_equal_the_library(reference):
    same(reference, [*ODD, None])


def test_ids_of_documents(reference, spark, sf):
    same(reference, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()])


def test_random_strings(reference):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=80, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("ab'sterv ml\n\t.!1 é½語")), max_size=30), max_size=4))
    def run(texts):
        same(reference, texts)

    run()


def test_structured_words_and_very_long_texts(reference):
    bits = [bin(i).count("1") % 2 for i in range(8192)]
    same(reference, ["".join("ab"[b ^ flip] for b in bits[:n]) for n in (1024, 2048, 4096, 8192) for flip in (0, 1)])
    same(reference, ["long words " * 100000 + "z" * 5000, "", "é" * 3000])


def test_histogram_against_lists(spark):
    lengths = [0, 0, 3, 3, 3, 7, 2000, 5000]
    h = tokens.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long")).collect()
    assert sorted(r.n_tokens for r in h) == sorted(set(lengths))
    for r in h:
        n = r.n_tokens
        assert (r.n_docs, r.docs_le, r.docs_ge) == (lengths.count(n), sum(x <= n for x in lengths), sum(x >= n for x in lengths))
        assert (r.tokens_le, r.tokens_ge, r.truncated_total) == (sum(x for x in lengths if x <= n), sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths))
    table = tokens.length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"))
    for r in tokens.at_limits(table, [1, 100, 9999]).collect():
        assert (r.docs_fit, r.tokens_kept) == (sum(x <= r.context_limit for x in lengths), sum(min(x, r.context_limit) for x in lengths))
    assert tokens.quantile_length(table, 0.5).first().length == 3


def test_query_counts_every_document(spark, sf, reference):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()
    want = np.sort([len(e.ids) for e in reference.encode_batch([r.text or "" for r in docs], add_special_tokens=False)])
    rows = tokens.op9_token_counts(spark, sf).orderBy("n_tokens").collect()
    assert np.repeat([r.n_tokens for r in rows], [r.n_docs for r in rows]).tolist() == want.tolist()


def test_nulls_empties_and_clashes(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("a b", 3), ("a b", 3)], "text string, n_tokens int")
    assert sorted(r.n_tokens for r in tokens.token_lengths(df).collect()) == [0, 0, 2, 2]
    assert tokens.length_histogram(tokens.token_lengths(df.limit(0))).count() == 0
    assert os.path.exists(tokens.default_path())


def test_a_worker_remembers_what_it_encoded(reference, monkeypatch):
    words = [" " + "".join(w) for w in product("abcdefghijklmnopqrstuvwxyz", repeat=4)]
    made = []
    real = tokens.encoder(tokens.default_path())._core_bpe
    one = type("Counted", (), {"_core_bpe": type("Core", (), {"encode_single_piece": staticmethod(lambda b: made.append(b) or real.encode_single_piece(b))})})
    monkeypatch.setitem(sys.modules, "_lumiform_worker", type(sys)("_lumiform_worker"))
    monkeypatch.setattr(tokens, "encoder", lambda path: one)
    batches = [pa.array(["".join(words[i::10])]) for i in range(10)]
    first = [tokens.encode(b, "p")[0].tolist() for b in batches]
    assert len(made) == len(set(made)) == len(words)
    made.clear()
    assert [tokens.encode(b, "p")[0].tolist() for b in batches] == first and not made
    assert first[3] == reference.encode(batches[3][0].as_py(), add_special_tokens=False).ids


def test_pretokens_of_one_hash_keep_their_ids(reference, monkeypatch):
    path, real = tokens.default_path(), tokens.range_hash
    monkeypatch.setitem(sys.modules, "_lumiform_worker", type(sys)("_lumiform_worker"))
    monkeypatch.setattr(tokens, "range_hash", lambda data, start, end, seed=0: real(data, start, end, seed) if seed else np.full(len(start), 7, np.uint64))
    for word in ("theatre", "qzxv", "theatre", "naïve", "qzxv"):  # each chunk's only pre-token has the hash 7
        assert tokens.encode(pa.array([word]), path)[0].tolist() == reference.encode(word, add_special_tokens=False).ids
    monkeypatch.setattr(tokens, "REMEMBERED", 0)
    assert tokens.encode(pa.array(["qzxv"]), path)[0].tolist() == reference.encode("qzxv", add_special_tokens=False).ids
