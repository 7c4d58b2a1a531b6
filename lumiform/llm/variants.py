"""Spelling variant grouping by two-dimensional range reporting.

Two words are near if one inserted, deleted or replaced code point apart. Words stand in forward order (x) and in the order of
their reversals (y). For an edit position, what shares the prefix before it is an interval of x, what shares the suffix after
it an interval of y, and a wavelet tree reports the words in both. There is a tree for each word length, so every word that it
reports is near.

An edit leaves one half of the shorter word as it is. So words meet by their first half, where edits of the second half are
looked for, and by their second half, where those of the first are. Halves are dealt over groups of about POINTS rows; a half
that more words share is cut into a grid of points and queries, so no group grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.llm.common import dropped, table, written

#: Runs whose hash this divides lose a code point.
EVERY = 97
MIN_LENGTH = 5
MIN_COUNT = 3
#: Rows (a word for each half it is found by) that a group holds about.
POINTS = 40_000
#: Queries that go through a tree at a time.
QUERIES = 1 << 18
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = EVERY) -> DataFrame:
    """The distinct words of all texts and how often they occur: word, n. A null text has none; a null doc_id counts as an empty string.

    Counting combines within tasks first, so a word that a third of all runs are costs a row a task."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run_"))
    # lower() is right and fast where all is ASCII; elsewhere it would change letters beyond A to Z
    runs = runs.withColumn("run_", F.when(F.octet_length("run_") == F.length("run_"), F.lower("run_")).otherwise(F.translate("run_", UPPER, LOWER)))
    runs = runs.filter(F.length("run_") >= min_length)
    runs = runs.withColumn("h_", F.crc32(F.concat("id_", F.lit(":"), "run_").cast("binary")))
    cut = F.expr("concat(substring(run_, 1, int(h_ % length(run_))), substring(run_, int(h_ % length(run_)) + 2))")
    word = F.when(F.col("h_") % every == 0, cut).otherwise(F.col("run_"))
    counted = runs.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def by_halves(words: DataFrame, min_length: int) -> DataFrame:
    """Every word for each half it is found by: word, n, short (length of the shorter word of a pair), side (0: the first half is shared, 1: the
    second) and bucket, a hash of short, side and that half."""
    size = F.length("word")
    half = F.floor(F.col("short") / 2).cast("int")
    rows = words.select("word", "n", F.explode(F.when(size > min_length, F.array(size, size - 1)).otherwise(F.array(size))).alias("short"))
    rows = rows.select("word", "n", "short", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    shared = F.when(F.col("side") == 0, F.col("word").substr(F.lit(1), half)).otherwise(F.col("word").substr(size - (F.col("short") - half) + 1, F.lit(1 << 30)))
    return rows.withColumn("bucket", F.xxhash64("short", "side", shared))


def dealt(rows: DataFrame, points: int) -> DataFrame:
    """rows with group, point and query: which group a row is in, and whether as a word to find, to look from, or both."""
    total = rows.count()
    sizes = written(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size_")).filter(F.col("size_") > points), "variant-hot")  # at most one in `points` rows
    groups = max(1, -(-total // points))
    parts = F.ceil(F.col("size_") / points).cast("int")
    rows = rows.join(F.broadcast(sizes), "bucket", "left").withColumn("parts_", F.coalesce(parts, F.lit(1)))
    own = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "word"), F.col("parts_")).cast("int")
    rows = rows.withColumn("c_", own(1)).withColumn("q_", own(2))
    cells = F.array_union(
        F.transform(F.sequence(F.lit(0), F.col("parts_") - 1), lambda q: F.struct(F.col("c_").alias("c"), q.alias("q"))),
        F.transform(F.sequence(F.lit(0), F.col("parts_") - 1), lambda c: F.struct(c.alias("c"), F.col("q_").alias("q"))),
    )
    rows = rows.withColumn("cell_", F.explode(cells))
    group = F.when(F.col("size_").isNull(), F.pmod("bucket", F.lit(groups))).otherwise(-1 - F.pmod(F.xxhash64("bucket", "cell_"), F.lit(1 << 62)))
    return rows.select(group.alias("group"), "word", "n", "short", "side", (F.col("cell_.c") == F.col("c_")).alias("point"), (F.col("cell_.q") == F.col("q_")).alias("query"))


class WaveletTree:
    """A sequence of distinct numbers from 0 to n - 1, level by level from the highest bit: at each level how many zeros stand before a place."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        for level in reversed(range(self.bits)):
            zero = (values >> level) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int64))
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For query k the values v at places lo[k] to hi[k] - 1 with least[k] <= v < most[k], as pairs (k, v). Only nodes with such places and
        values are entered, all queries at once, so the work follows the words reported."""
        k, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            below = self.bits - 1 - level
            a, b = zeros[lo], zeros[hi]
            n0 = zeros[-1]
            k, lo, hi = np.concatenate([k, k]), np.concatenate([a, n0 + lo - a]), np.concatenate([b, n0 + hi - b])
            value = np.concatenate([value << 1, (value << 1) | 1])
            live = (lo < hi) & ((value + 1) << below > least[k]) & (value << below < most[k])
            k, lo, hi, value = k[live], lo[live], hi[live], value[live]
        return k, value


class Order:
    """Rows of one byte matrix, sorted: the place of each row, and for any length the run of places that share a row's prefix."""

    def __init__(self, rows: np.ndarray) -> None:
        n, width = rows.shape
        self.by = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable") if n else np.zeros(0, np.int64)
        self.place = np.empty(n, np.int64)
        self.place[self.by] = np.arange(n)
        differs = rows[self.by[1:]] != rows[self.by[:-1]] if n > 1 else np.zeros((0, width), bool)
        self.common = np.where(differs.any(1), differs.argmax(1), width) if n > 1 else np.zeros(0, np.int64)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First place and place after the last of the rows that share each row's first `length` bytes, by row."""
        fresh = np.flatnonzero(np.concatenate([[True], self.common < length]))
        of = np.searchsorted(fresh, self.place, "right") - 1
        return fresh[of], np.append(fresh, len(self.place))[of + 1]


def near_within(asks: np.ndarray, asked: np.ndarray, offers: np.ndarray, offered: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index of asks, index of offers) of words one edit apart at a position from first to last - 1. asks: a word a row; offers: words as
    long (replacement) or one longer (insertion). Only words marked in asked and offered take part. A pair whose insertion can stand at several
    positions is given for the first of them."""
    size, wide = asks.shape[1], offers.shape[1]
    grows = wide - size
    rows = np.zeros((len(asks) + len(offers), wide), np.uint8)
    rows[: len(asks), :size] = asks
    rows[len(asks) :] = offers
    back = np.zeros_like(rows)
    back[: len(asks), :size] = asks[:, ::-1]
    back[len(asks) :] = offers[:, ::-1]
    forward, reverse = Order(rows), Order(back)
    is_point = np.concatenate([np.zeros(len(asks), bool), offered])

    def ranked(order: Order) -> tuple[np.ndarray, np.ndarray]:
        """How many points stand before each place; the points in their order."""
        marks = is_point[order.by]
        return np.concatenate([[0], np.cumsum(marks)]), order.by[marks]

    before_x, in_x = ranked(forward)
    before_y, in_y = ranked(reverse)
    y_of = np.empty(len(rows), np.int64)
    y_of[in_y] = np.arange(len(in_y))
    tree = WaveletTree(y_of[in_x])
    ask = np.flatnonzero(asked)
    own = np.zeros(len(ask), np.int64) if grows else offered[ask].astype(np.int64)  # a replacement finds the word itself as well, if it is a point here
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, ...]] = []

    def flush() -> None:
        if not waiting:
            return
        who, x0, x1, y0, y1, at = (np.concatenate(c) for c in zip(*waiting, strict=True))
        waiting.clear()
        for a in range(0, len(who), QUERIES):
            b = slice(a, a + QUERIES)
            k, y = tree.report(x0[b], x1[b], y0[b], y1[b])
            left, right, place = who[b][k], in_y[y] - len(asks), at[b][k]
            if grows:
                here = offers[right, place]
                good = (place == 0) | (asks[left, np.maximum(place - 1, 0)] != here)
            else:
                good = asks[left, place] != offers[right, place]
            pairs.append((left[good], right[good]))

    for at in range(first, last):
        x0, x1 = (before_x[p[ask]] for p in forward.runs(at))
        some = x1 - x0 > own
        if some.any():
            y0, y1 = (before_y[p[ask]] for p in reverse.runs(size - at - 1 + grows))
            some &= y1 - y0 > own
            waiting.append((ask[some], x0[some], x1[some], y0[some], y1[some], np.full(some.sum(), at)))
            if sum(len(w[0]) for w in waiting) > QUERIES:
                flush()
    flush()
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = (np.concatenate(c) for c in zip(*pairs, strict=True))
    return left, right


def letters(words: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words of ASCII and U+00C0 to U+00FF as bytes, and their offsets. In UTF-8 the latter are C3 and the code point less 0x40."""
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    offsets = np.frombuffer(words.buffers()[1], kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    lead = data == 0xC3
    after = np.concatenate([[False], lead[:-1]])
    return np.where(after, data + 0x40, data).astype(np.uint8)[~lead], np.concatenate([[0], np.cumsum(~lead)])[offsets - offsets[0]]


def near_in_group(group: pa.Table) -> pa.Table:
    """Near pairs of one group's rows, each in both directions: word, near, near_n."""
    group = group.combine_chunks()
    data, at = letters(group["word"])
    size = np.diff(at)
    short, side = group["short"].to_numpy(), group["side"].to_numpy()
    point, query = group["point"].to_numpy(zero_copy_only=False), group["query"].to_numpy(zero_copy_only=False)
    from_, to = [], []
    kind = short.astype(np.int64) * 2 + side
    order = np.lexsort((size, kind))
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(kind[order]) != 0, [True]])) if len(order) else [0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        rows = order[a:b]
        m, second = int(short[rows[0]]), bool(side[rows[0]])
        matrix = lambda r, w: data[at[r][:, None] + np.arange(w)] if len(r) else np.zeros((0, w), np.uint8)
        same, longer = rows[size[rows] == m], rows[size[rows] == m + 1]
        half = m // 2
        base = matrix(same, m)
        left, right = near_within(base, query[same], base, point[same], *((0, half) if second else (half, m)))
        from_.append(same[left])
        to.append(same[right])
        left, right = near_within(base, query[same], matrix(longer, m + 1), point[longer], *((0, half) if second else (half, m + 1)))
        from_ += [same[left], longer[right]]
        to += [longer[right], same[left]]
    from_, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (from_, to))
    return pa.table({"word": group["word"].take(pa.array(from_)), "near": group["word"].take(pa.array(to)), "near_n": group["n"].take(pa.array(to))})


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH, points: int = POINTS) -> DataFrame:
    """All ordered pairs of near words, each once: word, near, near_n. words: word (ASCII letters and U+00C0 to U+00FF, distinct, of min_length
    code points or more), n. Words may be of any length; an empty table gives no rows."""
    rows = dealt(by_halves(words, min_length), points)
    return rows.groupBy("group").applyInArrow(lambda t: near_in_group(t), "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """The last word of each chain: word, root, from word, form. Every round doubles the step, and counts at least double along a chain, so
    rounds are few: 6 for chains of 64, more than counts of 64 bits allow."""
    at = written(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next_"))
        if at.join(step, "root", "left_semi").isEmpty():
            return at
        fresh = written(at.join(step, "root", "left").select("word", F.coalesce("next_", "root").alias("root")), "variant-roots")
        dropped(at)
        at = fresh


def group_variants(words: DataFrame, ratio: int = 2, min_length: int = MIN_LENGTH, points: int = POINTS) -> DataFrame:
    """Per word: its form, the near word of largest n (ties: the smallest in code-point order) if that has at least ratio times the word's n;
    root, the last word that forms lead to; n; n_near; form_n.

    words as for `near_pairs`. A word without near words has n_near 0; without form, form and form_n are null and root is the word. An
    empty table gives no rows. ratio must be 2 or more, so that chains end."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    # of equal counts the smallest word: the order of UTF-8 strings is that of code points
    best = near_pairs(words, min_length, points).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best_"))
    told = words.join(best, "word", "left").withColumn("is_", F.coalesce(-F.col("best_.n") >= ratio * F.col("n"), F.lit(False)))
    told = written(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_"), F.col("best_.word")).alias("form"), F.when(F.col("is_"), -F.col("best_.n")).alias("form_n")), "variants")
    found = roots(told.filter("form IS NOT NULL"))
    out = told.join(found, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word of all documents: word, form, root, n, n_near, form_n."""
    words = written(corpus_words(table(spark, sf_dir, "documents")), "variant-words")
    return group_variants(words)


_BYTES = "list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::UBIGINT)"
#: crc32 of s, a bit at a time: 3988292384 is its polynomial.
_CRC32 = f"xor(list_reduce({_BYTES}, lambda c, b: list_reduce([xor(c, b), 0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[], lambda a, k: xor(a >> 1, 3988292384::UBIGINT * (a & 1))), 4294967295::UBIGINT), 4294967295::UBIGINT)"
#: Near words by comparing what is left when a code point goes.
OP13_SQL = f"""
WITH RECURSIVE u AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '{RUN}')), '{UPPER}', '{LOWER}') AS run FROM documents
), r AS (
  SELECT id || ':' || run AS s, run, count(*) AS c FROM u WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL
), h AS (
  SELECT run, c, {_CRC32} AS h FROM r
), w AS (
  SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n
  FROM h GROUP BY 1 HAVING sum(c) >= {MIN_COUNT} AND length(word) >= {MIN_LENGTH}
), d AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS x FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM w)
), p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = x UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = x
), b AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most FROM p GROUP BY 1
), f AS (
  SELECT p.word, min(near) AS near, any_value(most) AS most, any_value(n_near) AS n_near FROM p JOIN b USING (word) WHERE near_n = most GROUP BY 1
), t AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN near END AS form, CASE WHEN most >= 2 * n THEN most END AS form_n FROM w LEFT JOIN f USING (word)
), z AS (
  SELECT word, word AS root, form AS next FROM t UNION ALL SELECT z.word, t.word, t.form FROM z JOIN t ON t.word = z.next
)
SELECT t.word, t.form, z.root, t.n, t.n_near, t.form_n FROM t JOIN z ON z.word = t.word AND z.next IS NULL
"""
