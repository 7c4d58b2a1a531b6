"""Hard-negative mining by ball-tree branch and bound on integer inner products.

Rows are dealt to partitions around pivots and each partition gets a ball tree, kept as a row of a written table. For a query q
and a ball of centre c and radius r every inner product lies between q.c - |q|r and q.c + |q|r. So a node (or a whole tree) is
left out if its upper bound is under the score window or strictly beneath the query's current k-th score, or its lower bound
above the window, or its labels don't fit. A query first searches its home tree; the k-th score found there prunes the other
trees before any query is sent to them.

Pivots are fitted on PIVOT_SAMPLE rows; every row is indexed, and results are exact.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumiform.llm.common import dropped, table, written

#: Rows whose vec_id this divides are anchors; those whose vec_id RELABEL divides have another label.
ANCHORS, RELABEL, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Components are held within this bound, so that inner products of any length fit 64 bits.
BOUND = 1 << 20
#: Rows of a tree (about), rows of a leaf, queries that meet a tree at a time (about), trees in a block of balls.
TREE_ROWS, LEAF, QUERIES, BALLS = 4096, 64, 512, 1024
#: Rows that pivots are fitted on, and pivots at most; a pivot with more rows gets several trees.
PIVOT_SAMPLE, PIVOTS = 2048, 256
NONE = np.iinfo(np.int64).min
MOST = np.iinfo(np.int64).max


def prepared(vectors: DataFrame) -> DataFrame:
    """The rows that take part: vec_id, label (changed where RELABEL divides vec_id), v (floor(256 x) of each component, within BOUND), place."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & whole)
    label = F.col("label").cast("long")
    scaled = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256).cast("double"), F.lit(float(BOUND))), F.lit(float(-BOUND))).cast("int"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % RELABEL == 0, (label + 1) % LABELS).otherwise(label).alias("label"), scaled.alias("v"))


def matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists as rows of one matrix; what a list lacks up to width is 0."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = np.zeros((len(lists), width))
    if len(lists):
        sizes = np.diff(lists.offsets.to_numpy())
        values = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lists)), sizes)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def pivots_of(rows: DataFrame, width: int, count: int) -> np.ndarray:
    """Centres of a few rounds of k-means over PIVOT_SAMPLE rows chosen by a hash."""
    sample = matrix(rows.orderBy(F.xxhash64("vec_id", "v")).limit(PIVOT_SAMPLE).select("v").toArrow()["v"], width)
    sample = np.unique(sample, axis=0)
    if not len(sample):
        return np.zeros((1, width))
    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)]
    for _ in range(5):
        near = nearest(sample, centres)
        centres = np.stack([sample[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


class Tree(NamedTuple):
    """Rows in leaf order, and nodes from the root on: the rows from start to end, the children (-1: a leaf), ball and labels."""

    x: np.ndarray
    vec_id: np.ndarray
    place: np.ndarray
    label: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low_label: np.ndarray
    high_label: np.ndarray

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self._asdict() | {"x": self.x.astype(np.int32)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, raw: bytes) -> Tree:
        with np.load(io.BytesIO(raw)) as held:
            return cls(**{k: held[k] for k in cls._fields} | {"x": held["x"].astype(float)})


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    centre = x.mean(0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(1).max()))


def build(x: np.ndarray, vec_id: np.ndarray, place: np.ndarray, label: np.ndarray, leaf: int = LEAF) -> Tree:
    """A ball tree: nodes are halved at the median along the line from the row farthest from the centre to the row farthest from that one."""
    order, nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
    while todo:
        a, b, parent, which = todo.pop()
        here = order[a:b]
        centre, radius = ball(x[here])
        me = len(nodes)
        nodes.append([a, b, [-1, -1], centre, radius, label[here].min(), label[here].max()])
        if parent >= 0:
            nodes[parent][2][which] = me
        if b - a > leaf and radius > 0:
            far = x[here[((x[here] - centre) ** 2).sum(1).argmax()]]
            other = x[here[((x[here] - far) ** 2).sum(1).argmax()]]
            order[a:b] = here[np.argsort(x[here] @ (other - far), kind="stable")]
            middle = (a + b) // 2
            todo += [(middle, b, me, 1), (a, middle, me, 0)]
    start, end, child, centre, radius, low, high = zip(*nodes, strict=True)
    return Tree(x[order], vec_id[order], place[order], label[order], np.array(start), np.array(end), np.array(child), np.stack(centre), np.array(radius), np.array(low), np.array(high))


class Queries(NamedTuple):
    """Queries of one search: vectors, labels, own rows (not to be found), whether rows of the same label are wanted or of others, the score window,
    and the scores that k rows are known to reach (NONE if not)."""

    q: np.ndarray
    label: np.ndarray
    place: np.ndarray
    same: bool
    low: np.ndarray
    high: np.ndarray
    kth: np.ndarray


def bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of each query with what is in each ball, widened by more than the floats' error."""
    middle, norm = q @ centre.T, np.sqrt((q**2).sum(1))[:, None]
    reach = norm * radius + 1e-9 * (norm * (np.sqrt((centre**2).sum(1)) + radius)) + 1e-3
    return middle - reach, middle + reach


def fits(x: Queries, low_label: np.ndarray, high_label: np.ndarray, on: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Whether there may be wanted labels between low_label and high_label."""
    label = x.label[on]
    if x.same:
        return (low_label <= label) & (label <= high_label)
    return (low_label != label) | (high_label != label)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floats as long as no sum can leave their 53 bits."""
    most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def search(tree: Tree, x: Queries, k: int, visited: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores and vec_ids of each query's first k rows of the tree, NONE and MOST where there are fewer or where others reach x.kth."""
    n = len(x.q)
    scores, ids = np.full((n, k), NONE), np.full((n, k), MOST)
    todo = [(0, np.arange(n))]
    while todo:
        node, on = todo.pop()
        low, high = bounds(x.q[on], tree.centre[node : node + 1], tree.radius[node : node + 1])
        least = np.maximum(np.maximum(x.low[on], x.kth[on]), scores[on, k - 1])
        live = (high[:, 0] >= least) & (low[:, 0] <= x.high[on]) & fits(x, tree.low_label[node], tree.high_label[node], on)
        on = on[live]
        if not len(on):
            continue
        if visited is not None:
            visited.append(node)
        if tree.child[node, 0] >= 0:
            first, second = tree.child[node]
            near = x.q[on] @ (tree.centre[second] - tree.centre[first])
            if near.mean() > 0:  # the child that most queries lean to comes first
                first, second = second, first
            todo += [(second, on), (first, on)]
            continue
        rows = slice(tree.start[node], tree.end[node])
        s = products(x.q[on], tree.x[rows])
        least = np.maximum(np.maximum(x.low[on], x.kth[on]), scores[on, k - 1])[:, None]
        good = (s >= least) & (s <= x.high[on][:, None]) & ((tree.label[rows] == x.label[on][:, None]) == x.same) & (tree.place[rows] != x.place[on][:, None])
        some = np.flatnonzero(good.any(1))
        who = on[some]
        all_s = np.concatenate([scores[who], np.where(good[some], s[some], NONE)], 1)
        all_i = np.concatenate([ids[who], np.where(good[some], tree.vec_id[rows], MOST)], 1)
        order = np.lexsort((all_i, -(all_s + 1)))[:, :k]  # + 1: NONE has no negative
        scores[who], ids[who] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
    return scores, ids


def forest(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(rows with place and home, trees). trees: home, n, centre, radius, low_label, high_label, tree (the packed ball tree). Rows are dealt to the
    pivot nearest by, and there by a hash, so equal rows in any number make several trees."""
    count = max(1, min(PIVOTS, -(-rows.count() // TREE_ROWS)))
    centres = rows.sparkSession.sparkContext.broadcast(pivots_of(rows, width, count))  # at most PIVOTS vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = nearest(matrix(batch.column(2), width), centres.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], ["vec_id", "label", "v", "pivot"])

    near = written(rows.select("vec_id", "label", "v").mapInArrow(assign, "vec_id long, label long, v array<int>, pivot long").withColumn("place", F.monotonically_increasing_id()), "pivots")
    parts = near.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TREE_ROWS).alias("parts_"))  # at most PIVOTS rows
    home = (F.col("pivot") * (1 << 32) + F.pmod(F.xxhash64("place"), F.col("parts_"))).alias("home")
    homed = written(near.join(F.broadcast(parts), "pivot").select("vec_id", "label", "v", "place", home), "homed")
    dropped(near)

    def grow(group: pa.Table) -> pa.Table:
        columns = [group[c].to_numpy() for c in ("vec_id", "place", "label")]
        order = np.lexsort(columns[1::-1])
        tree = build(matrix(group["v"], width)[order], *(c[order] for c in columns))
        ends = [tree.low_label[0], tree.high_label[0]]
        return pa.table({"home": group["home"].slice(0, 1), "n": [len(order)], "centre": pa.array([tree.centre[0].tolist()], pa.list_(pa.float64())), "radius": [tree.radius[0]], "low_label": [int(ends[0])], "high_label": [int(ends[1])], "tree": pa.array([tree.packed()], pa.binary())})

    trees = homed.groupBy("home").applyInArrow(grow, "home long, n long, centre array<double>, radius double, low_label long, high_label long, tree binary")
    return homed, written(trees, "ball-trees")


QUERY = "id long, label long, v array<int>, place long, home long, low long, high long, kth long"


def queries_in(group: pa.Table, width: int, same: bool) -> Queries:
    numbers = {c: group[c].to_numpy() for c in ("label", "place", "low", "high", "kth")}
    return Queries(matrix(group["v"], width), numbers["label"], numbers["place"], same, numbers["low"], numbers["high"], numbers["kth"])


def searched(queries: DataFrame, trees: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """What each query finds in the tree `home` of its row: id, score, found, and kth (the score that k rows reach, or NONE), one row for each
    row found, or one with null score. The queries of a tree are dealt over parts of about QUERIES, each with a copy of the tree."""
    parts = queries.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts_"))
    left = queries.join(parts, "home").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts_")).cast("int")).drop("parts_")
    right = trees.select("home", "tree").join(parts, "home").select("home", "tree", F.explode(F.sequence(F.lit(0), F.col("parts_") - 1)).alias("part"))

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = ["id", "score", "found", "kth"]
        if not asked.num_rows or not held.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        scores, ids = search(Tree.unpacked(held["tree"][0].as_py()), queries_in(asked, width, same), k)
        kth = np.maximum(scores[:, k - 1], asked["kth"].to_numpy())
        kept = scores > NONE
        kept[:, 0] = True  # a row for each query, for its kth
        row, _ = np.nonzero(kept)
        absent = scores[kept] == NONE
        return pa.table([asked["id"].take(pa.array(row)), pa.array(scores[kept], mask=absent), pa.array(ids[kept], mask=absent), pa.array(kth[row])], names)

    return left.groupBy("home", "part").cogroup(right.groupBy("home", "part")).applyInArrow(run, "id long, score long, found long, kth long")


def elsewhere(queries: DataFrame, trees: DataFrame, width: int, same: bool) -> DataFrame:
    """queries once for every other tree that may hold a wanted row, by the trees' balls: home is that tree. The balls come in blocks of BALLS, and
    every query is held against every block."""
    blocks = -(-trees.count() // BALLS)
    balls = trees.select(F.struct("home", "centre", "radius", "low_label", "high_label").alias("ball"), F.pmod(F.xxhash64("home"), F.lit(blocks or 1)).cast("int").alias("block"))
    balls = balls.groupBy("block").agg(F.collect_list("ball").alias("balls"))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
    names = [f.split()[0] for f in QUERY.split(", ")]

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return asked.select(names).slice(0, 0)
        of = held["balls"].combine_chunks().flatten()
        home, radius, low_label, high_label = (of.field(c).to_numpy() for c in ("home", "radius", "low_label", "high_label"))
        centre = matrix(of.field("centre"), width)
        x = queries_in(asked, width, same)
        low, high = bounds(x.q, centre, radius)
        live = (high >= np.maximum(x.low, x.kth)[:, None]) & (low <= x.high[:, None]) & (home != asked["home"].to_numpy()[:, None])
        live &= np.stack([fits(x, a, b) for a, b in zip(low_label, high_label, strict=True)], 1)
        row, to = np.nonzero(live)
        out = asked.select(names).take(pa.array(row))
        return out.set_column(names.index("home"), "home", pa.array(home[to]))

    parts = max(1, -(-queries.count() // QUERIES))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    spread = balls.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.groupBy("block", "part").cogroup(spread.groupBy("block", "part")).applyInArrow(run, QUERY)


def first_rows(queries: DataFrame, trees: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """The first k rows for each query, by score (higher first) and vec_id: id, rank, found, score."""
    near = written(searched(queries, trees, width, k, same), "home-found")
    known = near.groupBy("id").agg(F.max("kth").alias("kth_"))
    told = queries.join(known, "id").select(*[F.coalesce("kth_", "kth").alias("kth") if c == "kth" else c for c in queries.columns])
    others = written(elsewhere(told, trees, width, same), "ball-cells")
    found = near.unionByName(searched(others, trees, width, k, same)).filter("score IS NOT NULL").select("id", "score", "found")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "found"))
    out = written(found.withColumn("rank", rank).filter(F.col("rank") <= k), "found")
    dropped(near, others)
    return out


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = ANCHORS) -> DataFrame:
    """Per anchor (vec_id divisible by `every`) and positive: the first `negatives` rows of other labels whose score is from half the positive's score
    to 0.95 of it: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label; other columns are ignored. Rows with a null vec_id, label, vector or component, or a component
    that isn't finite, take no part. Components become floor(256 x), held within BOUND; what a shorter vector lacks counts as 0. Ties go to
    the smaller vec_id. Of rows that share a vec_id each is a row of its own: a copy of an anchor can be its positive. An empty table, or
    one without anchors, gives no rows."""
    base = written(prepared(vectors), "vectors")
    width = max(base.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    rows, trees = forest(base, width)
    asked = rows.filter(F.col("vec_id") % every == 0)
    number = lambda x: F.lit(int(x)).cast("long")
    anchors = asked.select(F.col("place").alias("id"), "label", "v", "place", "home", number(NONE).alias("low"), number(MOST).alias("high"), number(NONE).alias("kth"))
    found = first_rows(anchors, trees, width, positives, True)
    pairs = written(
        asked.join(found, asked["place"] == found["id"]).select(
            "place", "label", "v", "home", F.col("vec_id").alias("anchor_id"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("place") * positives + F.col("rank") - 1).alias("id")
        ),
        "positives",
    )
    # 50 and 95 hundredths in whole numbers: the lower bound rounded up, the upper one down
    low = F.expr("(50 * positive_score + pmod(-50 * positive_score, 100)) div 100").alias("low")
    high = F.expr("(95 * positive_score - pmod(95 * positive_score, 100)) div 100").alias("high")
    windows = pairs.select("id", "label", "v", "place", "home", low, high, number(NONE).alias("kth")).filter("low <= high")
    mined = first_rows(windows, trees, width, negatives, False)
    out = pairs.select("id", "anchor_id", "positive_id", "positive_score").join(mined, "id")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % {ANCHORS} = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, id) <= {NEGATIVES}
"""
