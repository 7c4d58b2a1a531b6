"""MinHash near-dedup: BagMinHash signatures of 5-word shingle multisets, banded, then verified on exact multiset overlap.

A signature register is the least point of Poisson processes, one for every shingle and interval of discretised weight.
Weights are counts, so integer levels lose nothing: intervals are [0,1), [1,2), [2,4), [4,8), ..., and the process of an
interval that a weight covers in part is thinned by a coordinate drawn with each point, which equals splitting it
hierarchically. Two registers agree with the probability of the weighted Jaccard similarity. Points are generated up to
a time by which the registers of a document are very likely full; documents that are not go on to twice that time.

Documents with the same words are one node. In each band bucket a hub, another one in every band, is compared with the
bucket's other nodes, so a bucket of any size costs a pair a node. In buckets that still hold different components the
signatures of pairs across components are compared in blocks, a row of 141 bytes for each node and block; the nodes of pairs that
may be similar meet in blocks of bounded bytes once more, with their shingles, and only links leave them. No candidate pair that could
join two classes stays unexamined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.llm.common import chunks, dropped, spread_join, table, written
from lumiform.llm.textcore import buffer_of, mix, range_hash, shingles, words

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Time is in units of a register's mean wait; registers of a document are full by ln(REGISTERS) + MARGIN with probability 1 - exp(-MARGIN).
MARGIN = 3.0
ALL = (1 << 64) - 1
#: Nodes of a block in which the signatures of pairs across components are compared, bytes of shingles of one in which these are (about, and of no
#: more nodes), and standard errors that a signature may be off.
BLOCK, VERIFIED = 1024, 8 << 20
ERRORS = 4.0


def multisets(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: distinct shingles (sorted), their counts, offsets by text; and two 64-bit hashes of its word sequence, from independent hashes of the words."""
    data, offsets = buffer_of(values, lower=True)
    w = words(data, offsets)
    h, ptr = shingles(w, WORDS)
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(h)))
    place = (np.arange(len(w.hash)) - np.repeat(w.ptr[:-1], np.diff(w.ptr))).astype(np.uint64)
    keys = []
    for word, salt in ((w.hash, 0x8CB92BA72F3D8DD7), (range_hash(data, w.start, w.end, 1), 0xABC98388FB8FAC03)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(word ^ mix(place + np.uint64(salt))), dtype=np.uint64)])
        keys.append(mix(sums[w.ptr[1:]] - sums[w.ptr[:-1]] + np.diff(w.ptr).astype(np.uint64)))
    return h[at], counts, np.searchsorted(doc[at], np.arange(len(ptr))), keys[0], keys[1]


def signatures(h: np.ndarray, counts: np.ndarray, ptr: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """uint32 registers of every document; all zero without shingles."""
    n = len(ptr) - 1
    out = np.zeros((n, m), np.uint32)
    weight = np.add.reduceat(np.append(counts, 0), np.minimum(ptr[:-1], len(counts))) * (np.diff(ptr) > 0) if n else np.zeros(0)
    doc = np.repeat(np.arange(n), np.diff(ptr))
    todo, span = np.flatnonzero(weight > 0), np.log(m) + MARGIN
    while len(todo):
        times = np.full(n * m, np.inf)
        ids = np.zeros(n * m, np.uint32)
        limit = np.zeros(n)
        limit[todo] = span / weight[todo]
        use = limit[doc] > 0
        base_h, base_w, base_d = h[use], counts[use], doc[use]
        level, low = 0, 0
        while len(base_h):
            width = max(1, low)
            seed = mix(base_h + np.uint64(0x632BE59BD9B4E019 * (level + 1) & ALL))
            d, cap = base_d, (base_w - low) / width
            end = limit[d] * (m * width)  # process time of this interval
            x, k = np.zeros(len(d)), 1
            while len(d):
                u = mix(seed + np.uint64(0x9E3779B97F4A7C15 * k & ALL))
                x = x - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                live = np.flatnonzero(x <= end)
                if len(live) < len(d):
                    seed, d, cap, end, x, u = seed[live], d[live], cap[live], end[live], x[live], u[live]
                    if not len(d):
                        break
                v = mix(u ^ np.uint64(0xD1B54A32D192ED03))
                register = ((v & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
                hit = slice(None) if level < 2 else ((v >> np.uint64(32)).astype(np.float64) * 2.0**-32 < cap)
                slot, time, name = (d * m + register)[hit], (x / (m * width))[hit], (u >> np.uint64(32)).astype(np.uint32)[hit]
                np.minimum.at(times, slot, time)
                least = times[slot] == time
                ids[slot[least]] = name[least]
                k += 1
            low = 1 if level == 0 else low * 2
            level += 1
            more = base_w > low
            base_h, base_w, base_d = base_h[more], base_w[more], base_d[more]
        full = np.isfinite(times.reshape(n, m)).all(axis=1)
        done = todo[full[todo]]
        out[done] = ids.reshape(n, m)[done]
        todo, span = todo[~full[todo]], span * 2
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated weighted Jaccard similarity of two signatures."""
    return float((a == b).mean())


def banded(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of every signature, from the low bytes of its registers alone, so bands can be made again from stored registers."""
    s = registers.astype(np.uint8).reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), s.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, same1, same2 (hashes of the word sequence), bands (none without words), registers (a byte of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1_000_000):
            h, counts, ptr, one, two = multisets(batch.column(1))
            registers = signatures(h, counts, ptr)
            keys = banded(registers).view(np.int64)
            low = pa.array([r.tobytes() for r in registers.astype(np.uint8)], pa.binary())
            some = np.diff(ptr) > 0
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)), pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), bands, low], ["doc_id", "same1", "same2", "bands", "registers"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, same1 long, same2 long, bands array<long>, registers binary")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the multiset of its shingles as sorted 64-bit little-endian codes; the k-th copy of a shingle has a code of its own, so overlaps of multisets are those of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            h, counts, ptr, _, _ = multisets(batch.column(1))
            copies = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            codes = np.repeat(h, counts)
            codes = np.where(copies > 0, mix(codes + copies.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), codes)
            edges = np.concatenate([[0], np.cumsum(counts)])[ptr]
            sets = [np.sort(codes[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "codes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node long, codes binary")


def overlap(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of codes have that weighted Jaccard similarity."""
    if len(p) > len(q):
        p, q = q, p
    if len(p) < similarity * len(q):
        return False
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) if len(q) else 0
    return both >= similarity * (len(p) + len(q) - both)


def codes_of(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """The codes of each row, read where they lie."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose multisets overlap to `similarity` or more. pairs: distinct and written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [overlap(p, q, similarity) for p, q in zip(codes_of(batch.column(2)), codes_of(batch.column(3)), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("node").alias("a"), F.col("codes").alias("x")), sets.select(F.col("node").alias("b"), F.col("codes").alias("y"))
    both = spread_join(spread_join(pairs, left, ["a"], ["b"], times(pairs, "a")), right, ["b"], ["a"], times(pairs, "b")).select("a", "b", "x", "y")
    sizes = [F.octet_length(c) for c in ("x", "y")]
    return both.filter(F.least(*sizes) >= similarity * F.greatest(*sizes)).mapInArrow(run, "a long, b long")


def near(block: pa.Table, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Of a block pair: an index and the indices behind it of nodes with other labels whose signatures may be similar, for pairs that share no earlier bucket."""
    bucket, i, j = (block.column(c)[0].as_py() for c in ("bucket", "i", "j"))
    least = similarity - ERRORS * np.sqrt(similarity * (1 - similarity) / REGISTERS)
    node, label, side = (block.column(c).to_numpy() for c in ("node", "label", "side"))
    registers = np.frombuffer(b"".join(block.column("registers").to_pylist()), np.uint8).reshape(len(node), REGISTERS)
    bands = banded(registers).view(np.int64)
    here = int(np.argmax(bands[0] == bucket))
    left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
    for p in left:
        q = right[(label[right] != label[p]) & ((node[right] > node[p]) | (i != j))]
        q = q[~(bands[q, :here] == bands[p, :here]).any(axis=1)]
        yield p, q[(registers[q] == registers[p]).mean(axis=1) >= least]


def in_blocks(rows: DataFrame, blocks: Column, names: list[str]) -> DataFrame:
    """names, with bucket, i, j, side: each row of rows (bucket, node, ...) in every pair of its bucket's blocks that its own block is in."""
    blocks = F.greatest(F.ceil(blocks), F.lit(1)).cast("int")
    placed = rows.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return placed.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", *names)


def links_across(rows: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between nodes of one bucket and different labels. rows: bucket, n (the bucket's size), node, label, registers.

    A bucket is cut into blocks of BLOCK nodes, and the signatures of pairs of blocks are compared in memory, each by a task of its own, which is a
    row for each node and block. What may have partners is cut into blocks of about VERIFIED bytes and compared with its shingles. A pair that shares
    several buckets is looked at in the first of them. A pair of `similarity` fails by ERRORS standard errors, or never. Once a link joins two
    labels of a block pair, their other pairs needn't be verified."""

    def survive(key: tuple, block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        kept = np.zeros(block.num_rows, bool)
        for p, q in near(block, similarity):
            kept[q] = True
            kept[p] |= len(q) > 0
        return block.select(names).filter(pa.array(kept))

    def verify(key: tuple, block: pa.Table) -> pa.Table:
        codes = codes_of(block.column("codes"))
        block = block.drop_columns("codes").combine_chunks()
        node, label = block.column("node").to_pylist(), block.column("label").to_pylist()
        root = {x: x for x in label}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for p, q in near(block, similarity):
            for r in q.tolist():
                x, y = top(label[p]), top(label[r])
                if x != y and overlap(codes[p], codes[r], similarity):
                    root[max(x, y)] = min(x, y)
                    out.append((min(node[p], node[r]), max(node[p], node[r])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    names = ["bucket", "node", "label", "registers"]
    keyed = in_blocks(rows, F.col("n") / BLOCK, names[1:])
    alive = written(keyed.groupBy("bucket", "i", "j").applyInArrow(survive, "bucket long, node long, label long, registers binary").distinct(), "survivors")
    lengths = sets.select("node", F.octet_length("codes").alias("bytes"))
    sizes = alive.join(lengths, "node").groupBy("bucket").agg(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / VERIFIED).alias("blocks"))
    again = in_blocks(alive.join(sizes, "bucket"), F.col("blocks"), names[1:])
    return again.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(verify, "a long, b long").distinct()


def times(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for every node of an edge (a, b).

    By contraction: each node points to its least neighbour or itself, pointers are followed to their roots, and the edges between different
    roots are the next, smaller, round's. Each step is a written table; a round costs two joins of its edges, dealt so that a node of many
    edges is no single task's."""
    left, labels = written(edges.select("a", "b").distinct(), "edges"), None
    while True:
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "up")
        while True:
            top = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            higher = written(spread_join(up, top, ["up"], ["node"], times(up, "up")).select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
            moved = not higher.filter("moved").isEmpty()
            dropped(up)
            up = higher
            if not moved:
                break
        if labels is None:
            labels = written(up.select("node", F.col("up").alias("label")), "labels")
        else:
            roots = up.select(F.col("node").alias("label"), "up")
            moved_on = spread_join(labels, roots, ["label"], ["node"], times(labels, "label")).select("node", F.col("up").alias("label"))
            before, labels = labels, written(moved_on.unionByName(labels.join(roots, "label", "left_anti").select("node", "label")), "labels")
            dropped(before)
        ends = spread_join(left, up.select(F.col("node").alias("a"), F.col("up").alias("x")), ["a"], ["b"], times(left, "a"))
        ends = spread_join(ends, up.select(F.col("node").alias("b"), F.col("up").alias("y")), ["b"], ["a"], times(left, "b"))
        rest = written(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        dropped(left, up)
        left = rest
        if left.isEmpty():
            return labels


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and n_links of every row of docs: classes are connected by pairs of similarity (weighted Jaccard of 5-word shingle
    multisets, lower case) of at least `similarity`; class_id is the least doc_id. n_links counts the verified links of the row's text to
    different texts: each connects, and a class of k different texts has at least k - 1, but pairs within a class that other links already
    connect aren't all examined.

    Texts of the same words, all texts without words among them, are one class. A text of fewer than 5 words has one shingle. Texts are read
    whole, however long. Rows without doc_id belong to no class (null, 0 links); rows with the same id are one document and join the classes
    of their texts; repeated rows give repeated results. An empty table gives no rows. Other columns are ignored, whatever their names."""
    sketches = written(sketch(docs), "sketches")
    same = ["same1", "same2"]
    known = sketches.filter("doc_id IS NOT NULL")
    nodes = written(known.groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("n_")), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("bucket"))
    draw = F.struct(F.xxhash64("node", "bucket").alias("h"), F.col("node").alias("node"))
    hubs = written(keys.groupBy("bucket").agg(F.min(draw)["node"].alias("hub"), F.count(F.lit(1)).alias("n_")).filter("n_ > 1"), "hubs")
    crowded = written(keys.join(hubs.drop("n_"), "bucket"), "buckets")
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    pairs = written(crowded.filter("hub <> node").select(F.col("hub").alias("x"), F.col("node").alias("y")).select(*pair).distinct(), "pairs")
    needed = crowded.select(F.col("node").alias("doc_id")).distinct()
    sets = written(shingle_sets(docs.select(F.col("doc_id").cast("long"), "text").join(needed, "doc_id")), "sets")
    edges = written(verified(pairs, sets, similarity).distinct(), "links")
    found = components(edges)
    # buckets that hold different components
    placed = crowded.select("bucket", "node").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n_")).filter("lo < hi").select("bucket", F.col("n_").alias("n"))
    rest = placed.join(mixed, "bucket").join(nodes.select("node", "registers"), "node")
    more = written(links_across(rest, sets, similarity), "links")
    twins = written(spread_join(known.select("doc_id", *same), nodes.select(*same, "node"), same, ["doc_id"], nodes.select(*same, "n_")).select("doc_id", "node"), "members")
    # an id that stands on several texts links their nodes, be it a node itself or not
    several = twins.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    linked = twins.join(several, "doc_id").filter("lo < node").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    links = edges.unionByName(more)
    if not (more.isEmpty() and linked.isEmpty()):
        found = components(links.unionByName(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))))
    ends = links.distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    facts = nodes.select("node").distinct().join(found, "node", "left").join(ends, "node", "left")
    out = spread_join(twins, facts, ["node"], ["doc_id"], nodes.groupBy("node").agg(F.sum("n_").alias("n_")))
    out = out.select("doc_id", F.coalesce("label", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionByName(sketches.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id, n_links."""
    return classes(table(spark, sf_dir, "documents"))
