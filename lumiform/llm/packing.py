"""Best-fit packing by a grouping genetic algorithm on islands with elite migration.

Documents are tokenised once and cut into pieces of at most CAPACITY tokens. Only the pieces' lengths are packed, in groups
of about GROUP pieces. ISLANDS islands evolve solutions of one group, each in a task of its own; a solution's genes are
whole bins. Crossover injects well-filled bins of one parent into the other, drops the bins that share pieces with them and
some of the worst, lets displaced pieces take the place of shorter ones that leave room, and best-fits what is left. After
each epoch an island's elite, its best solution, migrates to the next island of the group and breeds there. The best
solution of a group's islands stands: its full bins settle, and the pieces of the others meet those of other groups in the
next level, until the last level settles all.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.llm.common import chunks, dropped, table, written
from lumiform.llm.textcore import ragged
from lumiform.llm.tokens import default_path, encode

CAPACITY = 2048
#: The id that ends every document.
END = 0
#: Pieces of a group, about, and islands that work on one.
GROUP, ISLANDS = 3000, 3
#: Solutions of an island, generations of an epoch, epochs of a level.
POPULATION, GENERATIONS, EPOCHS = 4, 4, 2
#: Levels, and epochs of the last one, behind which nothing can be mended.
LEVELS, LAST_EPOCHS = 3, 5
#: Share of a parent's bins that may be injected, and of the other's bins that go besides.
INJECTED, WORST = 0.5, 0.1

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document: its whole text's ids (null: none), then END.
    A document is cut only where it is longer than capacity; then its first piece takes the remainder, so all others are full."""
    path = path or default_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            flat, ptr = encode(batch.column(1), path)
            own = np.insert(flat.astype("<u4", copy=False), ptr[1:], END)
            total = np.diff(ptr) + 1
            count = -(-total // capacity)
            first = total - (count - 1) * capacity
            of = np.repeat(np.arange(batch.num_rows), count)
            number = ragged(np.zeros(len(count), np.int64), count)
            start = np.where(number > 0, first[of] + (number - 1) * capacity, 0)
            length = np.where(number > 0, capacity, first[of])
            ends = np.cumsum(length)  # pieces stand one after another
            places = list(zip((ends - length).tolist(), ends.tolist(), strict=True))
            crc = [zlib.crc32(own[a:b]) for a, b in places]
            arrays = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array([own[a:b].astype(np.int32) for a, b in places], pa.list_(pa.int32()))] if ids else []), names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE + (", ids array<int>" if ids else ""))


def best_fit(lengths: list[int], items: list[int], bins: list[list[int]], loads: list[int], capacity: int) -> None:
    """Put items, in their order, into bins and new ones: each into the fullest open bin that still takes it."""
    free: list[int] = []  # the spaces of open bins, sorted
    room: dict[int, list[int]] = defaultdict(list)  # bins by their space
    for i, load in enumerate(loads):
        if load < capacity:
            held = room[capacity - load]
            if not held:
                insort(free, capacity - load)
            held.append(i)
    for item in items:
        size = lengths[item]
        at = bisect_left(free, size)
        if at < len(free):
            space = free[at]
            held = room[space]
            index = held.pop()
            if not held:
                del free[at]
            bins[index].append(item)
            loads[index] += size
            space -= size
        else:
            index, space = len(bins), capacity - size
            bins.append([item])
            loads.append(size)
        if space:
            held = room[space]
            if not held:
                insort(free, space)
            held.append(index)


def exchanged(lengths: list[int], free: list[int], bins: list[list[int]], loads: list[int], capacity: int) -> list[int]:
    """Let each bin swap the piece for which a longer free one makes the bin fullest. What is free then, longest first."""
    pool = sorted((lengths[i], i) for i in free)
    for k, held in enumerate(bins):
        room, best = capacity - loads[k], (0, 0, 0)
        if not room or not pool:
            continue
        for at, i in enumerate(held):
            j = bisect_right(pool, (lengths[i] + room, len(lengths))) - 1
            if j >= 0 and pool[j][0] - lengths[i] > best[0]:
                best = (pool[j][0] - lengths[i], at, j)
        gain, at, j = best
        if gain:
            out, held[at] = held[at], pool.pop(j)[1]
            insort(pool, (lengths[out], out))
            loads[k] += gain
    return [i for _, i in reversed(pool)]


class Solution:
    """Bins of piece indices; better ones have fewer bins, then more uneven ones."""

    def __init__(self, bins: list[list[int]], loads: list[int]) -> None:
        self.bins, self.loads = bins, loads
        filled = np.array(loads, float)
        self.rank = (len(bins), -float((filled * filled).sum()))

    def places(self) -> np.ndarray:
        """The bin of every piece."""
        size = np.fromiter(map(len, self.bins), np.int64, len(self.bins))
        out = np.empty(size.sum(), np.int32)
        out[np.fromiter(chain.from_iterable(self.bins), np.int64, len(out))] = np.repeat(np.arange(len(size), dtype=np.int32), size)
        return out


def crossover(lengths: list[int], mother: Solution, father: Solution, draw: np.random.Generator, capacity: int) -> Solution:
    rank = np.argsort(-np.array(father.loads), kind="stable")
    rank = rank[: max(1, int(len(rank) * INJECTED))]
    injected = rank[draw.random(len(rank)) < 0.5]
    of, into = mother.places(), father.places()
    goes = np.zeros(len(father.bins), bool)
    goes[injected] = True
    taken = goes[into]
    whole = np.ones(len(mother.bins), bool)  # bins that share no piece with the injected ones
    whole[of[taken]] = False
    whole = np.flatnonzero(whole)
    whole = whole[np.argsort(-np.array(mother.loads)[whole], kind="stable")]
    kept = whole[: max(0, len(whole) - max(2, int(len(whole) * WORST)))]
    stays = np.zeros(len(mother.bins), bool)
    stays[kept] = True
    taken |= stays[of]
    bins = [list(father.bins[i]) for i in injected.tolist()] + [list(mother.bins[k]) for k in kept.tolist()]
    loads = [father.loads[i] for i in injected.tolist()] + [mother.loads[k] for k in kept.tolist()]
    best_fit(lengths, exchanged(lengths, np.flatnonzero(~taken).tolist(), bins, loads, capacity), bins, loads, capacity)
    return Solution(bins, loads)


def evolve(lengths: list[int], people: list[Solution], draw: np.random.Generator, capacity: int, generations: int = GENERATIONS) -> list[Solution]:
    """The population after an epoch, best first. A new one starts from best-fitted pieces: by turns in random order, and by lengths that chance shrinks."""
    size = np.array(lengths, np.int64)
    people = list(people)
    while len(people) < POPULATION:
        bins: list[list[int]] = []
        loads: list[int] = []
        order = draw.permutation(len(size)) if len(people) % 2 else np.argsort(-size * draw.uniform(0.5, 1, len(size)))
        best_fit(lengths, order.tolist(), bins, loads, capacity)
        people.append(Solution(bins, loads))
    for _ in range(generations if len(size) > 1 else 0):
        children = []
        for _ in range(max(1, POPULATION // 2)):
            i, j = sorted(draw.choice(len(people), 2, replace=False).tolist())
            children.append(crossover(lengths, people[i], people[j], draw, capacity))
        people = sorted(people + children, key=lambda p: p.rank)[:POPULATION]
    return sorted(people, key=lambda p: p.rank)


STATE = "group_ long, island_ int, lengths array<int>, people array<array<int>>, n_bins int, fitness double"


def live(epoch: int, level: int, capacity: int):
    """What islands do in an epoch, for mapInArrow: rows of group_, island_, lengths, people (bins of the pieces in every solution, best first; the
    guest last) in, STATE out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = row["lengths"]
                people = []
                for places in row["people"]:
                    bins: list[list[int]] = [[] for _ in range(max(places) + 1)]
                    for piece, b in enumerate(places):
                        bins[b].append(piece)
                    people.append(Solution(bins, [sum(lengths[i] for i in b) for b in bins]))
                draw = np.random.default_rng([level, epoch, row["group_"], row["island_"]])
                people = evolve(lengths, sorted(people, key=lambda p: p.rank)[:POPULATION], draw, capacity)
                out = [p.places() for p in people]
                columns = [[row["group_"]], [row["island_"]], [lengths], [out], [people[0].rank[0]], [people[0].rank[1]]]
                types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["group_", "island_", "lengths", "people", "n_bins", "fitness"])

    return run


def placed(level: int, capacity: int):
    """From a group's best solution (group_, rows, lengths, bins) to row_, length, sequence_id, offset and load_ of its pieces, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, bins = np.array(row["lengths"], np.int64), np.array(row["bins"], np.int64)
                order = np.argsort(bins, kind="stable")
                size, of = lengths[order], bins[order]
                ends = np.cumsum(size)
                load = np.bincount(of, size).astype(np.int64)
                offset = ends - size - (np.cumsum(load) - load)[of]
                columns = [np.array(row["rows"], np.int64)[order], size, level << 56 | row["group_"] << 24 | of, offset, load[of]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row_", "length", "sequence_id", "offset", "load_"])

    return run


def below(state: DataFrame, capacity: int) -> bool:
    """Whether the best solution of some group has more bins than its pieces' total length asks for, so that another epoch could help."""
    least = F.ceil(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x) / capacity)
    return not state.groupBy("group_").agg(F.min(F.col("n_bins") - least).alias("over")).filter("over > 0").isEmpty()


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS, levels: int = LEVELS) -> DataFrame:
    """The pieces (PIECE) with sequence_id and offset, its place in the sequence, gapless from 0. Full pieces are sequences of their own.
    Null ids and repeated rows are pieces like others, an empty table gives no rows. Islands see written rows in a fixed order with a fixed seed,
    so a lost task that runs again gives the same sequences."""
    rows = written(cut.select("*", F.monotonically_increasing_id().alias("row_")), "pieces")  # a written number tells repeated rows apart
    full = rows.filter(F.col("length") >= capacity)
    settled = full.select("row_", F.col("row_").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = rows.filter(F.col("length") < capacity).select("row_", "length")
    for level in range(levels):
        groups = max(1, -(-loose.count() // group))
        last = level == levels - 1 or groups == 1
        dealt = loose.groupBy(F.pmod(F.xxhash64(F.lit(level), "row_"), F.lit(groups)).alias("group_")).agg(F.array_sort(F.collect_list(F.struct("row_", F.col("length").cast("int").alias("length")))).alias("all_"))
        dealt = written(dealt.select("group_", F.col("all_.row_").alias("rows"), F.col("all_.length").alias("lengths")), f"groups{level}")
        state = dealt.select("group_", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island_"), "lengths", F.array().cast("array<array<int>>").alias("people"))
        for epoch in range(LAST_EPOCHS if last else EPOCHS):
            if epoch:
                guests = state.select("group_", F.pmod(F.col("island_") + 1, F.lit(islands)).cast("int").alias("island_"), F.slice("people", 1, 1).alias("guest_"))
                own = F.slice("people", 1, POPULATION - 1)
                state = state.join(guests, ["group_", "island_"]).select("group_", "island_", "lengths", F.concat(own, "guest_").alias("people"))
            before, state = state, written(state.repartition(groups * islands, "group_", "island_").mapInArrow(live(epoch, level, capacity), STATE), f"epoch{level}")
            if not below(state, capacity):
                break
        best = state.groupBy("group_").agg(F.min_by(F.col("people")[0], F.struct("n_bins", "fitness", "island_")).alias("bins"))
        lived = written(dealt.join(best, "group_").mapInArrow(placed(level, capacity), "row_ long, length long, sequence_id long, offset long, load_ long"), f"placed{level}")
        dropped(before, state, dealt)
        settles = F.lit(True) if last else F.col("load_") >= capacity
        settled = settled.unionByName(lived.filter(settles).select("row_", "sequence_id", "offset"))
        if last:
            break
        loose = lived.filter(~settles).select("row_", "length")
    return rows.join(settled, "row_").drop("row_")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECE, sequence_id and offset of every piece of every row of docs. A null or empty text is one piece of END alone; texts longer than a
    sequence are cut, however long they are, and no others; repeated rows and null ids are documents like others; an empty table gives no
    rows; other columns are ignored, whatever their names."""
    return pack(pieces(docs, path, capacity), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of CAPACITY tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
