"""Token counts: ids of a byte-level BPE vocabulary at array speed, and the exact length histogram.

A chunk of text is cut into the vocabulary's pre-tokens by array operations over code points; each distinct
pre-token is encoded once a worker and found again by two hashes of its bytes. The ids equal those of the `tokenizers` library
(tests/llm/test_tokens.py compares them); strings of special tokens inside a text are ordinary text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumiform.llm.common import chunks, table, worker_cache, written
from lumiform.llm.textcore import buffer_of, ragged, range_hash

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: The code points with Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: English contractions that the pre-tokenizer splits off.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct pre-tokens, and ids of them, that a worker remembers.
REMEMBERED, REMEMBERED_IDS = 1_000_000, 16 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes: visible Latin-1 characters stand for themselves, the rest for U+0100 onwards."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str):
    """A BPE encoder for the vocabulary file at `path`, loaded once a worker."""
    key = ("encoder", path)
    if key not in worker_cache():
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        worker_cache()[key] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return worker_cache()[key]


def classes() -> np.ndarray:
    """The class of every code point."""
    if "classes" not in worker_cache():
        import unicodedata

        out = np.zeros(0x110000, np.uint8)
        kinds = {"L": LETTER, "N": NUMBER}
        out[:] = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        out[WHITE_SPACE] = SPACE
        worker_cache()["classes"] = out
    return worker_cache()["classes"]


def pretokens(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the concatenated texts start. ends: where each text ends."""
    n = len(points)
    kind = classes()[points]
    fresh = np.zeros(n + 1, bool)  # a text starts here
    fresh[0] = True
    fresh[ends] = True
    run = np.flatnonzero(fresh[:n] | np.concatenate([[True], kind[1:] != kind[:-1]]))
    run_end = np.append(run[1:], n)
    first = np.zeros(n + 1, bool)
    first[run] = True
    # a run of white space: its last character stands alone or opens what follows
    space = kind[run] == SPACE
    followed = space & ~fresh[run_end]
    last = run_end[followed] - 1
    first[last] = True
    joined = last[points[last] == 32] + 1
    first[joined] = False
    # contractions
    quote = run[(points[run] == 39) & (run_end - run == 1) & first[run]]
    quote = quote[quote + 1 < n]
    quote = quote[~fresh[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        second = points[quote + 1]
        third = np.where((quote + 2 < n) & ~fresh[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        size = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS:
            hit = (second == ord(c[0])) & ((third == ord(c[1])) if len(c) == 2 else True)
            size = np.where((size == 0) & hit, len(c), size)
        quote, size = quote[size > 0], size[size > 0]
        first[quote + 1] = False
        first[quote + 1 + size] = True
    return np.flatnonzero(first[:n])


def encode(values: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every text, one after another, and the offsets of the texts. Null counts as empty."""
    values = pc.fill_null(values, "")
    data, _ = buffer_of(values)
    lengths = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    text_ends = np.cumsum(lengths)
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(values) + 1, np.int64)
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    start = pretokens(points, text_ends)
    byte_at = np.flatnonzero((data & 0xC0) != 0x80)  # where each code point begins
    first = byte_at[start]
    last = np.append(first[1:], len(data))
    hashes = range_hash(data, first, last)
    order = np.argsort(hashes)
    ranked = hashes[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    where = order[new]
    ids, at, size = known(raw, data, first[where], last[where], ranked[new], path)
    counts = size[back]
    out = ids[ragged(at[back], counts)]
    # ids before each text
    before = np.concatenate([[0], np.cumsum(counts)])
    return out, before[np.searchsorted(start, np.concatenate([[0], text_ends]))]


def known(raw: bytes, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct pre-tokens (byte ranges of raw and data, by ascending hashes): all ids in one array, and each pre-token's first place and
    number in it. A pre-token is found again by its hash if a second, independent one agrees; else it is encoded like a new one."""
    memory = worker_cache().get(("known", path))
    if memory is None or len(memory["hash"]) > REMEMBERED or memory["used"] > REMEMBERED_IDS:
        memory = {"hash": np.zeros(0, np.uint64), "row": np.zeros(0, np.int32), "used": 0}
        memory |= {"check": np.zeros(1 << 16, np.uint64), "at": np.zeros(1 << 16, np.int64), "size": np.zeros(1 << 16, np.int64), "ids": np.zeros(1 << 18, np.uint32)}
        worker_cache()["known", path] = memory
    check = range_hash(data, start, end, 1)
    place, n = np.searchsorted(memory["hash"], hashes), len(memory["hash"])
    met = np.flatnonzero(place < n)
    met = met[memory["hash"][place[met]] == hashes[met]]
    row = np.full(len(hashes), -1)
    row[met] = memory["row"][place[met]]
    unstored = met[memory["check"][row[met]] != check[met]]  # its hash is another pre-token's: encoded now, not remembered
    fresh = np.ones(len(hashes), bool)
    fresh[met] = False
    fresh[unstored] = True
    missing = np.flatnonzero(fresh)
    at, size = memory["at"][row], memory["size"][row]
    if len(missing):
        one = encoder(path)._core_bpe.encode_single_piece  # a pre-token needs no splitting by the pattern again
        found = [one(raw[a:b]) for a, b in zip(start[missing].tolist(), end[missing].tolist(), strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        used, total = memory["used"], int(sizes.sum())
        at[missing], size[missing] = used + np.cumsum(sizes) - sizes, sizes
        memory["ids"] = grown(memory["ids"], used + total)
        memory["ids"][used : used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        memory["used"] = used + total
        fresh[unstored] = False
        added = np.flatnonzero(fresh)
        for name, values in (("check", check), ("at", at), ("size", size)):
            memory[name] = grown(memory[name], n + len(added))
            memory[name][n : n + len(added)] = values[added]
        memory["hash"] = np.insert(memory["hash"], place[added], hashes[added])
        memory["row"] = np.insert(memory["row"], place[added], np.arange(n, n + len(added), dtype=np.int32))
    return memory["ids"], at, size


def grown(array: np.ndarray, n: int) -> np.ndarray:
    """array with room for n values at least."""
    return array if len(array) >= n else np.concatenate([array, np.zeros(max(n, 2 * len(array)) - len(array), array.dtype)])


def token_lengths(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """One row for every row of docs, in no order: n_tokens, the number of ids of its whole text, however long (null or empty: 0). Repeated rows
    count each; an empty table gives no rows; other columns are ignored, whatever their names."""
    path = path or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_"):
            _, ptr = encode(batch.column(0), path)
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(ptr), pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).alias("text_")).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame, block: int = 1024) -> DataFrame:
    """Exact histogram of n_tokens with suffix sums: a row for every length L that occurs.

    n_docs: documents of L tokens; docs_le, tokens_le: those of at most L; docs_ge, tokens_ge: of at least L;
    truncated_total: tokens left when every document is cut to L; quantile: share of documents of at most L.
    Between two rows every figure follows from the row above, so a context limit that doesn't occur is answered too
    (`at_limits`). The histogram has a row for each distinct length, so it is bounded by the longest text, not by the
    number of documents; suffix sums run within blocks of `block` lengths and over the blocks' totals.
    """
    counts = written(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "histogram")  # texts are encoded once
    histogram = counts.withColumn("block_", F.floor(F.col("n_tokens") / block))
    w = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    blocks = histogram.groupBy("block_").agg(F.sum("n_docs").alias("d_"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t_"))
    whole = Window.partitionBy()
    blocks = blocks.select("block_", F.coalesce(F.sum("d_").over(w), F.lit(0)).alias("d0_"), F.coalesce(F.sum("t_").over(w), F.lit(0)).alias("t0_"), F.sum("d_").over(whole).alias("docs_"), F.sum("t_").over(whole).alias("tokens_"))
    inner = Window.partitionBy("block_").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = histogram.join(blocks, "block_")
    out = out.withColumn("docs_le", F.col("d0_") + F.sum("n_docs").over(inner)).withColumn("tokens_le", F.col("t0_") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(inner))
    return out.select(
        "n_tokens", "n_docs", "docs_le", "tokens_le",
        (F.col("docs_") - F.col("docs_le") + F.col("n_docs")).alias("docs_ge"),
        (F.col("tokens_") - F.col("tokens_le") + F.col("n_docs") * F.col("n_tokens")).alias("tokens_ge"),
        (F.col("tokens_le") + (F.col("docs_") - F.col("docs_le")) * F.col("n_tokens")).alias("truncated_total"),
        (F.col("docs_le") / F.col("docs_")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents that fit, documents cut, tokens left after the cut. One pass over the histogram, whatever the number of limits."""
    one = lambda x: F.struct(
        F.lit(int(x)).cast("long").alias("context_limit"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") <= x, F.col("n_docs"))), F.lit(0)).alias("docs_fit"),
        F.coalesce(F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
        F.coalesce(F.sum(F.least("n_tokens", F.lit(int(x)).cast("long")) * F.col("n_docs")), F.lit(0)).alias("tokens_kept"),
    )
    return histogram.agg(F.array(*map(one, limits)).alias("at_")).select(F.inline("at_"))


def quantile_length(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents don't exceed."""
    return histogram.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("length"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact length histogram of all documents."""
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
