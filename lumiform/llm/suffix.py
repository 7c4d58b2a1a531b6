"""Suffix-array dedup: which bytes are covered by a 100-byte string that also starts earlier in the corpus.

Prefix doubling, made sparse. Ranking every byte position in Spark would sort the corpus many times over, so the first
round ranks only anchors: the leftmost least hash of the SEED-byte strings inside a window of THRESHOLD bytes. Equal
windows have equal anchors at equal offsets, so a window can repeat only if its anchor's seed does. Spark sorts and
counts the pairs of seed rank and position; positions with a unique rank drop out, nearly all of them. The windows of
the remaining anchors meet by seed and are ranked at growing offsets: pairs of ranks of 25 bytes give ranks of 50, pairs
of these ranks of 100, with unique positions dropped after each round. What then shares a rank is compared byte by byte,
and all but the least position of a rank repeat.

Texts that occur several times are ranked once: each later copy is covered as a whole. Seeds with many occurrences are
salted: salts find repeats on their own, and only their least positions meet again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.llm.common import bucketed, dropped, partitions, released, spread_join, table, written
from lumiform.llm.textcore import lanes, mix

THRESHOLD = 100
SEED = 32
#: Offsets at which ranks double; the last is half the threshold.
FIRST_RANK = 25
#: Occurrences of a seed that meet in one group; more are salted.
GROUP = 4000
#: Bytes of context of which the windows are ranked at once; a group is never split.
BLOCK = 500_000
#: Where lanes of 8 bytes begin that cover SEED, FIRST_RANK and THRESHOLD bytes.
SEED_LANES = (0, 8, 16, 24)
RANK_LANES = (0, 8, 16, 17)
WHOLE_LANES = (*range(0, 96, 8), 92)


def lane_hash(x: np.ndarray, at: np.ndarray | slice, places: tuple[int, ...], seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes that the lanes at `places` behind each position of `at` cover; a step is a bijection of what it adds."""
    h = None
    for k, place in enumerate(places):
        part = x[at + place] if isinstance(at, np.ndarray) else x[at.start + place : at.stop + place]
        h = part + np.uint64(seed * 0x8CB92BA72F3D8DD7 & (1 << 64) - 1) if h is None else h + part
        h *= np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[k % 4])
        h ^= h >> np.uint64(32 if k % 2 else 29)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every anchor: its seed's hash, its text, the first of the window starts that it stands for (in the text), and their number."""
    n, span = len(data), THRESHOLD - SEED + 1
    if n < THRESHOLD:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    h = lane_hash(lanes(data), slice(0, n - SEED + 1), SEED_LANES)
    low = np.uint64((1 << 30) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    at = (least & low).astype(np.int64)  # anchor of the window at every start
    room = np.diff(offsets) - THRESHOLD + 1
    texts = np.flatnonzero(room > 0)
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, offsets[texts], 1)
    np.add.at(inside, offsets[texts] + room[texts], -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    own = at[starts]
    text = np.searchsorted(offsets, starts, "right") - 1
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    return h[own[first]], text[first], starts[first] - offsets[text[first]], np.diff(np.append(first, len(starts)))


def binary_chunks(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about `limit` bytes in a binary column, with the bytes and their offsets."""
    for batch in batches:
        values = batch.column(column)
        ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
        data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(values):
            to = min(len(values), max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at), data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
            at = to


def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in binary_chunks(batches, 2, 800_000):
        seed, text, start, count = anchors(data, offsets)
        text = pa.array(text)
        yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), batch.column(0).take(text), batch.column(1).take(text), pa.array(start << 8 | count)], ["seed", "h1", "h2", "at"])


def repeated(ranks: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the live positions those whose rank isn't unique, and their new dense ranks."""
    order = np.argsort(ranks, kind="stable")
    r = ranks[order]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    dense = np.cumsum(new)
    alone = new & np.append(new[1:], True)
    keep = order[~alone]
    back = np.argsort(keep, kind="stable")
    return live[keep[back]], dense[~alone][back]


def double(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the window starts (places in data) have a window that another has too: their indices and ranks."""
    x = lanes(data)
    piece = lambda at: lane_hash(x, at, RANK_LANES)
    pair = lambda a, b: mix(a * np.uint64(0x9E3779B97F4A7C15) + b)
    half = pair(piece(starts), piece(starts + FIRST_RANK))  # ranks of 50 bytes at the start ...
    live, _ = repeated(half, np.arange(len(starts)))
    on = starts[live] + 2 * FIRST_RANK
    whole = pair(half[live], pair(piece(on), piece(on + FIRST_RANK)))  # ... and 50 further on
    live, ranks = repeated(whole, live)
    return live, exact_ranks(x, starts[live], ranks)


def exact_ranks(x: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The ranks, after neighbours of one rank were compared on their bytes; ranks of the bytes themselves should any differ."""
    order = np.argsort(ranks, kind="stable")
    r, p = ranks[order], at[order]
    same, equal = r[1:] == r[:-1], np.ones(max(len(r) - 1, 0), bool)
    for k in WHOLE_LANES:
        part = x[p + k]
        equal &= part[1:] == part[:-1]
    if (same & ~equal).any():
        ranks = np.unique(np.column_stack([x[at + k] for k in WHOLE_LANES]), axis=0, return_inverse=True)[1].ravel()
    return ranks


def rank_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by seed and salt (seed, salt, salted, doc_id, h1, h2, start, context): runs of repeated bytes (h1, h2, start, stop), and
    the least positions of salted seeds' windows for another round (start null: one1, one2 hash the window, pos is its place)."""
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        for batch in rows.to_batches():
            yield from rank_block(batch)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("context").nbytes
        if size > BLOCK:
            rows = pa.Table.from_batches(held)
            seed, salt = (rows.column(c).to_numpy() for c in ("seed", "salt"))
            change = np.flatnonzero((seed[1:] != seed[:-1]) | (salt[1:] != salt[:-1]))
            if len(change):
                cut = int(change[-1]) + 1
                yield from settle(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(b.column("context").nbytes for b in held)
    if held:
        yield from settle(pa.Table.from_batches(held))


NAMES = ["h1", "h2", "start", "stop", "one1", "one2", "doc_id", "pos"]


def rank_block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    (_, data, offsets), *_ = binary_chunks(iter([batch]), batch.schema.get_field_index("context"), 1 << 40)
    doc, h1, h2, start = (batch.column(c).to_numpy() for c in ("doc_id", "h1", "h2", "start"))
    salted = batch.column("salted").to_numpy(zero_copy_only=False)
    count = np.diff(offsets) - THRESHOLD + 1
    row = np.repeat(np.arange(len(doc)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[:-1][row] + place
    live, ranks = double(data, starts)
    r = row[live]
    pos = start[r] + place[live]
    order = np.lexsort((pos, h2[r], h1[r], doc[r], ranks))
    first = np.ones(len(order), bool)
    first[1:] = ranks[order][1:] != ranks[order][:-1]
    covered = np.zeros(len(starts), bool)
    covered[live[order[~first]]] = True
    # runs of covered windows within a context
    edge = np.ones(len(covered), bool)
    edge[1:] = (covered[1:] != covered[:-1]) | (row[1:] != row[:-1])
    lead = np.flatnonzero(edge)
    length = np.diff(np.append(lead, len(covered)))
    lead, length = lead[covered[lead]], length[covered[lead]]
    a = start[row[lead]] + place[lead]
    n, none = len(lead), lambda k: pa.nulls(k, pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(h1[row[lead]]), pa.array(h2[row[lead]]), pa.array(a), pa.array(a + length - 1 + THRESHOLD), none(n), none(n), none(n), none(n)], NAMES)
    again = np.flatnonzero(salted[row] & ~covered)
    if len(again):
        at, r = starts[again], row[again]
        one, two = (mix(lane_hash(lanes(data), at, WHOLE_LANES, seed)).view(np.int64) for seed in (1, 2))
        k = len(again)
        yield pa.RecordBatch.from_arrays([pa.array(h1[r]), pa.array(h2[r]), none(k), none(k), pa.array(one), pa.array(two), pa.array(doc[r]), pa.array(start[r] + place[again])], NAMES)


def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (h1, h2, bytes, spans): n_removed, n_spans, kept_sha256, and the spans merged."""
    for batch in batches:
        removed, runs, digest, merged = [], [], [], []
        for raw, spans in zip(batch.column(2), batch.column(3), strict=True):
            text = raw.as_buffer().to_pybytes()
            out: list[list[int]] = []
            if spans.is_valid:
                flat = spans.values
                a, b = flat.field("start").to_numpy(), flat.field("stop").to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                gap = np.flatnonzero(a[1:] > b[:-1])
                out = np.column_stack([a[np.append(0, gap + 1)], b[np.append(gap, len(b) - 1)]]).tolist()
            hasher, at = hashlib.sha256(), 0
            for x, y in out:
                hasher.update(text[at:x])
                at = y
            hasher.update(text[at:])
            removed.append(sum(y - x for x, y in out))
            runs.append(len(out))
            digest.append(hasher.hexdigest())
            merged.append([{"start": x, "stop": y} for x, y in out])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(merged, kind)], ["h1", "h2", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop) of every row of docs: the bytes of its whole text (UTF-8; null: empty)
    that a 100-byte string covers which also starts earlier: in a document of smaller doc_id, or earlier in the same one. Texts may be of any length.

    Texts of one id are ordered by a hash of them; rows of the same id and text are one document and get equal results. Rows without
    doc_id have no place in the order: nothing is removed from them and they remove nothing. An empty table gives no rows. Other columns
    are ignored, whatever their names."""
    spark = docs.sparkSession
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    text_key = ["h1", "h2"]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("bytes")).withColumns({"h1": F.xxhash64("bytes"), "h2": F.xxhash64(F.lit(1), "bytes"), "n_bytes": F.octet_length("bytes").cast("long")})
    judged_here = (F.col("n_bytes") >= THRESHOLD) & F.col("doc_id").isNotNull()
    once = keyed.filter(judged_here).groupBy(*text_key).agg(F.min("doc_id").alias("first_id"), F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_"))
    texts = bucketed(once, "texts", text_key)  # its later joins don't shuffle texts again
    released(spark)

    found = texts.select(*text_key, "bytes").mapInArrow(find_anchors, "seed long, h1 long, h2 long, at long")
    common = written(found.groupBy("seed").agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1"), "seeds")
    alive = written(spread_join(found, common.withColumnRenamed("n_", "n"), ["seed"], ["h1", "at"], common), "anchors")
    released(spark)
    listed = alive.groupBy(*text_key).agg(F.collect_list(F.struct("seed", "n", "at")).alias("list"))
    spread = texts.join(listed, text_key)
    spread = spread.select(*text_key, F.col("first_id").alias("doc_id"), "bytes", F.explode("list").alias("a"))
    spread = spread.select("a.seed", "a.n", "doc_id", *text_key, F.shiftright("a.at", 8).alias("start"), F.expr("substring(bytes, cast(shiftright(a.at, 8) + 1 as int), cast((a.at & 255) + 99 as int))").alias("context"))
    salts = F.ceil(F.col("n") / GROUP)
    spread = spread.withColumns({"salted": F.col("n") > GROUP, "salt": F.pmod(F.xxhash64("h1", "start"), salts).cast("int")})
    met = spread.select("seed", "salt", "salted", "doc_id", *text_key, "start", "context").repartition(partitions(spark), "seed", "salt").sortWithinPartitions("seed", "salt")
    ranks = written(met.mapInArrow(rank_windows, "h1 long, h2 long, start long, stop long, one1 long, one2 long, doc_id long, pos long"), "ranks")
    dropped(alive, common)
    released(spark)
    # least positions of salted seeds' windows meet once more
    least = ranks.filter("start IS NULL")
    first = least.groupBy("one1", "one2").agg(F.min(F.struct("doc_id", *text_key, "pos")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    later = least.join(first, ["one1", "one2"]).filter(F.struct("doc_id", *text_key, "pos") != F.col("m")).select(*text_key, F.col("pos").alias("start"), (F.col("pos") + THRESHOLD).alias("stop"))
    runs = ranks.filter("start IS NOT NULL").select(*text_key, "start", "stop").unionByName(later)
    spans = runs.groupBy(*text_key).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    kind = "array<struct<start:bigint,stop:bigint>>"
    judged = texts.join(spans, text_key, "left").select(*text_key, "bytes", "spans").mapInArrow(finish, f"h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string, spans {kind}")
    judged = judged.join(texts.select(*text_key, "first_id"), text_key)
    members = spread_join(keyed.filter(judged_here).select("doc_id", *text_key, "n_bytes"), judged, text_key, ["doc_id"], texts.select(*text_key, "n_"))
    copy = F.col("doc_id") > F.col("first_id")
    empty = hashlib.sha256(b"").hexdigest()
    members = members.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))).otherwise(F.col("spans")).alias("spans"),
    )
    none = F.lit(0).cast("long")
    others = keyed.filter(~judged_here).select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.sha2("bytes", 256).alias("kept_sha256"), F.array().cast(kind).alias("spans"))
    return members.unionByName(others)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return repeats(table(spark, sf_dir, "documents")).drop("spans")


#: Over the hexadecimal digits of every text: all windows, those that start earlier elsewhere, their unions, and what is left.
OP8_SQL = f"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), s AS (
  SELECT doc_id, p, md5(substr(hx, 2 * p + 1, {2 * THRESHOLD})) AS h FROM (SELECT doc_id, hx, unnest(range(n - {THRESHOLD - 1})) AS p FROM t WHERE n >= {THRESHOLD})
), r AS (
  SELECT doc_id, p FROM s QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1
), i AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {THRESHOLD} THEN 0 ELSE 1 END AS fresh FROM r)
), c AS (
  SELECT doc_id, min(p) AS a, max(p) + {THRESHOLD} AS b FROM i GROUP BY doc_id, g
), k AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM c UNION ALL SELECT doc_id, coalesce(max(c.b), 0), any_value(n) FROM t LEFT JOIN c USING (doc_id) GROUP BY doc_id
), x AS (
  SELECT doc_id, string_agg(substr(hx, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS kept FROM k JOIN t USING (doc_id) GROUP BY doc_id
), m AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM c GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN x USING (doc_id) LEFT JOIN m USING (doc_id)
"""
