"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-pairs.

Training sees a bounded sample of the labelled rows (SAMPLE). Its features are written once; every epoch is a job that streams
them through one task in an order of its own, behind the state that the epoch before has written, which the hashing space
(2**BITS) bounds. So memory is that of the coordinates, not that of the texts, a lost executor costs an epoch, and the driver
gets only the sparse weights that L1 leaves, which may be broadcast. Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.llm.common import chunks, dropped, table, written
from lumiform.llm.textcore import buffer_of, mix, words

BITS = 20
#: Labelled rows that training uses at most, chosen by a hash of doc_id.
SAMPLE = 18_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0
#: One in so many training rows is kept from the weights, to calibrate scores on.
CALIBRATION = 5
THRESHOLD = 0.7
#: The bias is the last coordinate.
BIAS = 1 << BITS


def features(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, neighbouring pairs, and pairs with one word between, of every whole text (lower case), and the offsets by text."""
    w = words(*buffer_of(values, lower=True))
    n = len(w.hash)
    of = np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))
    found, whose = [mix(w.hash) >> np.uint64(64 - BITS)], [of]
    for gap, salt in ((1, 0x9FB21C651E98DF25), (2, 0xC2B2AE3D27D4EB4F)):
        if n > gap:
            same = of[:-gap] == of[gap:]
            pair = mix(w.hash[:-gap] * np.uint64(salt) + (w.hash[gap:] ^ np.uint64(salt)))
            found.append((pair >> np.uint64(64 - BITS))[same])
            whose.append(of[:-gap][same])
    index, doc = np.concatenate(found).astype(np.int32), np.concatenate(whose)
    order = np.argsort(doc, kind="stable")
    return index[order], np.searchsorted(doc[order], np.arange(len(w.ptr)))


class Learner:
    """FTRL-proximal: per coordinate the shifted sum of gradients z and the sum of their squares n."""

    def __init__(self, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        self.z, self.n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)
        if state:
            at, self.z[state[0]], self.n[state[0]] = state

    def state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The coordinates that were touched, and their z and n."""
        at = np.flatnonzero(self.n)
        return at, self.z[at], self.n[at]

    def weights(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        zi = self.z[i]
        return np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2), 0.0)

    def learn(self, x: np.ndarray, y: float) -> None:
        """An example: its distinct coordinates and label."""
        w = self.weights(x)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        n = self.n[x]
        self.z[x] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[x] = n + g * g


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of margins that make them log odds: Platt's targets, by damped Newton steps."""
    positive = labels.sum()
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        h = np.array([[(q * margins**2).sum() + 1e-3, (q * margins).sum()], [(q * margins).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        a, b = max(a - step[0], 0.05), b - step[1]
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from the labelled documents outside the held-out third, whole texts of any length.

    Of repeated labels the largest counts, of repeated ids the least text, so repeated rows change nothing; null labels and ids are left out,
    null texts count as empty. Rows are chosen by a hash of doc_id, ties by doc_id, and come in another order every epoch. One in CALIBRATION is
    kept aside and turns the margins into probabilities, unless it lacks a class. Without labelled rows, or with empty tables,
    there are no weights, and every score is 0.5. Other columns of both tables are ignored, whatever their names."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("y_"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y_").agg(F.min("text").alias("text"))
    names = ["doc_id", "aside", "y", "x"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            index, ptr = features(batch.column(3))
            lists = pa.array([np.append(np.unique(index[a:b]), BIAS) for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], names)

    aside = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(CALIBRATION)) == 0
    keyed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), aside.alias("aside"), F.col("y_").cast("double").alias("y"), "text")
    examples = written(keyed.mapInArrow(extract, "doc_id long, aside boolean, y double, x array<int>"), "examples")  # features are made where the texts are
    state = None
    for epoch in range(EPOCHS):
        before, state = state, one_epoch(examples.filter("NOT aside"), epoch, state)
        if before is not None:
            dropped(before)
    kept, w = weights_of(state)
    margins, y = margins_of(examples.filter("aside"), (kept, w))
    if 0 < y.sum() < len(y):
        a, b = calibrate(margins, y)
        at_bias = kept == BIAS
        kept, w = np.append(kept[~at_bias], BIAS), np.append(w[~at_bias] * a, w[at_bias].sum() * a + b)
    dropped(examples, state)
    return kept, w


def one_epoch(examples: DataFrame, epoch: int, state: DataFrame | None) -> DataFrame:
    """The learner's state (i, z, n) behind all examples (doc_id, y, x), which come in the order of a hash of epoch and doc_id. The state before comes
    first in the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner()
        for batch in batches:
            held = batch.column(0).to_numpy() == 0
            at, z, n = (batch.column(k).to_numpy()[held] for k in (1, 2, 3))
            learner.z[at], learner.n[at] = z, n
            rest = batch.filter(pa.array(~held))
            for y, x in zip(rest.column(4).to_pylist(), rest.column(5), strict=True):
                learner.learn(x.values.to_numpy(), y)
        at, z, n = learner.state()
        for a in range(0, len(at), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(at[part], pa.int64()), pa.array(z[part]), pa.array(n[part])], ["i", "z", "n"])

    none = [F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("z"), F.lit(0.0).alias("n")]
    rows = examples.select(F.lit(1).alias("kind"), F.xxhash64(F.lit(epoch), "doc_id").alias("place"), "doc_id", *none, "y", "x")
    if state is not None:
        rows = rows.unionByName(state.select(F.lit(0).alias("kind"), F.col("i").alias("place"), F.lit(0).cast("long").alias("doc_id"), "i", "z", "n", F.lit(0.0).alias("y"), F.array().cast("array<int>").alias("x")))
    ordered = rows.repartition(1).sortWithinPartitions("kind", "place", "doc_id").select("kind", "i", "z", "n", "y", "x")
    return written(ordered.mapInArrow(run, "i long, z double, n double"), "ftrl-state")


def weights_of(state: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates that L1 leaves, in order, and their weights."""
    found = state.filter(F.abs("z") > L1).orderBy("i").toArrow()
    at, z, n = (found[c].to_numpy() for c in ("i", "z", "n"))
    return at, Learner((at, z, n)).weights(at)


def margins_of(examples: DataFrame, sparse: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Margin and label of each example (y, x); there are as many as the sample holds at most."""
    sent = examples.sparkSession.sparkContext.broadcast(sparse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = spread_weights(sent.value)
        for batch in batches:
            sums = [float(w[x.values.to_numpy()].sum()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), batch.column(0)], ["margin", "y"])

    found = examples.select("y", "x").mapInArrow(run, "margin double, y double").toArrow()
    order = np.lexsort((found["y"].to_numpy(), found["margin"].to_numpy()))  # sums don't depend on the order of tasks
    return found["margin"].to_numpy()[order], found["y"].to_numpy()[order]


def scores_of(values: pa.Array, dense: np.ndarray) -> np.ndarray:
    """Scores of whole texts; null counts as an empty text, which gets the bias alone."""
    index, ptr = features(values)
    w = dense[index]
    hit = np.flatnonzero(w)
    doc = np.searchsorted(ptr, hit, "right") - 1
    once = np.unique(doc.astype(np.int64) << BITS | index[hit])
    total = np.bincount(once >> BITS, dense[once & (BIAS - 1)], len(values)) + dense[BIAS]
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def spread_weights(sparse: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    dense = np.zeros(BIAS + 1)
    dense[sparse[0]] = sparse[1]
    return dense


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: the key and score, from 0 to 1. Null and empty texts get the bias alone, long ones are read whole, repeated rows are
    scored each, null keys stay; an empty table gives no rows; other columns are ignored, whatever their names."""
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast((weights[0].astype(np.int32), weights[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = spread_weights(sent.value)
        for batch in chunks(batches, "text_"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores_of(batch.column(1), dense))], ["key_", "score"])

    return docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).mapInArrow(run, f"key_ {kind}, score double").withColumnRenamed("key_", key)


def accepted(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under the threshold; null texts are kept if the bias is. Repeated rows, null ids
    and long texts are judged like others, columns of any name pass through, an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast((weights[0].astype(np.int32), weights[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = spread_weights(sent.value)
        for batch in chunks(batches, "text"):
            text = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array(scores_of(text, dense) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
