"""A native encoder: one pass gives the vector and the score of every rendering.

A text is its words and its marks (each sign that is neither letter, digit, underscore nor white space), each hashed to one of
`width` dimensions and a sign, and weighted by 1 + ln of how often it occurs. A passage's vector is the unit vector of its words
plus `markup` times its marks, and its score the inner product with the unit vector of the question's words. An arm is a salt of
the hashes and a weight of the marks, so an arm that minds marks less is less sensitive to the format. It stands where a neural
encoder would: the pass keeps the representation that the head reads."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64
#: Words, and single marks. White space is what SQL's regular expressions take for it.
TOKEN = re.compile(r"\w+|[^\w \t\n\r\f]")
#: Hashes of tokens that a task remembers, and bytes of passages that it encodes at a time.
REMEMBERED, AT_ONCE = 1 << 18, 1 << 20


class Arm(NamedTuple):
    model: str
    arm: str
    seed: int
    markup: float


def place(salt: str, token: str, width: int) -> tuple[int, float]:
    """The dimension and sign of a token: from the first 8 hexadecimal digits of md5 of "salt|token"."""
    h = int(hashlib.md5(f"{salt}|{token}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return h % width, 1.0 - 2.0 * (h // width % 2)


class Encoder:
    """Sums of the words and of the marks of texts under one salt, as rows of matrices."""

    def __init__(self, salt: str, width: int = WIDTH) -> None:
        self.salt, self.width, self.known = salt, width, {}

    def sums(self, counted: list[Counter]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for t in set().union(*counted) - self.known.keys():
            self.known[t] = (*place(self.salt, t, self.width), int(not (t[0].isalnum() or t[0] == "_")))
        sizes = np.fromiter(map(len, counted), np.int64, len(counted))
        told = [self.known[t] for c in counted for t in c]
        if not told:
            return np.zeros((len(counted), self.width)), np.zeros((len(counted), self.width))
        dim, sign, mark = (np.array(x) for x in zip(*told, strict=True))
        weight = sign * (1.0 + np.log(np.fromiter((n for c in counted for n in c.values()), float, len(told))))
        row = np.repeat(np.arange(len(counted)), sizes)
        cell = (mark * len(counted) + row) * self.width + dim
        both = np.bincount(cell, weight, 2 * len(counted) * self.width).reshape(2, len(counted), self.width)
        return both[0], both[1]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay."""
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def features_and_scores(pairs: DataFrame, arms: list[Arm], width: int = WIDTH) -> DataFrame:
    """pairs (question, passage and any other columns) without these two texts, with model, arm, seed, vec (array of double) and score (double), a row
    for each of `arms`. Texts are counted once for all arms, a model's hashes made once. Null texts are empty; an empty passage has a zero vector
    and the score 0, as has any under an empty question; texts may be of any length; an empty table gives no rows."""
    kept = [c for c in pairs.columns if c not in ("question", "passage")]
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in kept)
    names = [*kept, "model", "arm", "seed", "vec", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {a.model: Encoder(a.model, width) for a in arms}
        for whole in batches:
            for batch in parts_of(whole, "passage"):
                questions, passages = ([Counter(TOKEN.findall((t or "").lower())) for t in batch.column(c).to_pylist()] for c in ("question", "passage"))
                questions = [Counter({t: n for t, n in c.items() if t[0].isalnum() or t[0] == "_"}) for c in questions]
                made = {m: (*e.sums(passages), unit(e.sums(questions)[0])) for m, e in encoders.items()}
                others = [batch.column(c) for c in kept]
                for a in arms:
                    words, marks, asked = made[a.model]
                    vec = unit(words + a.markup * marks)
                    n = len(vec)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(vec.ravel()))
                    yield pa.RecordBatch.from_arrays([*others, pa.array([a.model] * n), pa.array([a.arm] * n), pa.array([a.seed] * n, pa.int32()), lists, pa.array((vec * asked).sum(1))], names)

    return pairs.select(*kept, "question", "passage").mapInArrow(run, f"{schema}, model string, arm string, seed int, vec array<double>, score double")


def by_record(records: DataFrame, arms: list[Arm], width: int = WIDTH) -> DataFrame:
    """records (question, heads, body and any other columns) without these three, with model, arm, seed and all (format, fpos, vec, score of each rendering): a row a record
    and arm, so what compares a record's formats needs no shuffle. heads: format, fpos, head; a rendering is a head, which ends a line, and the body, so the body
    is read once. Values are those of `features_and_scores`; rows keep their order under each arm."""
    kept = [c for c in records.columns if c not in ("question", "heads", "body")]
    schema = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {a.model: Encoder(a.model, width) for a in arms}
        count = lambda t: Counter(TOKEN.findall((t or "").lower()))
        for whole in batches:
            for batch in parts_of(whole, "body"):
                n = batch.num_rows
                heads = batch.column("heads")
                offsets = np.concatenate([[0], np.cumsum(heads.value_lengths())]).astype(np.int32)
                formats, places, texts = heads.flatten().flatten()
                asked = [Counter({t: c for t, c in count(q).items() if t[0].isalnum() or t[0] == "_"}) for q in batch.column("question").to_pylist()]
                bodies = [count(b) for b in batch.column("body").to_pylist()]
                row = np.repeat(np.arange(n), np.diff(offsets))
                counted = []
                for r, t in zip(row.tolist(), texts.to_pylist(), strict=True):
                    both = bodies[r].copy()
                    both.update(TOKEN.findall((t or "").lower()))
                    counted.append(both)
                made = {m: (*e.sums(counted), unit(e.sums(asked)[0])[row]) for m, e in encoders.items()}
                for a in arms:
                    words, marks, question = made[a.model]
                    vec = unit(words + a.markup * marks)
                    lists = pa.ListArray.from_arrays(np.arange(len(vec) + 1, dtype=np.int32) * width, pa.array(vec.ravel()))
                    one = pa.StructArray.from_arrays([formats, places, lists, pa.array((vec * question).sum(1))], ["format", "fpos", "vec", "score"])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([a.model] * n), pa.array([a.arm] * n), pa.array([a.seed] * n, pa.int32()), pa.ListArray.from_arrays(offsets, one)], [*kept, "model", "arm", "seed", "all"])

    return records.select(*kept, "question", "heads", "body").mapInArrow(run, f"{schema}, model string, arm string, seed int, all array<struct<format: string, fpos: int, vec: array<double>, score: double>>")


def sums(passages: DataFrame, arms: list[Arm], width: int = WIDTH) -> DataFrame:
    """passages (passage and any other columns) without the text, with model, words, marks (the sums that all arms of a model share) and norms (the length of
    words + markup * marks for each of the model's arms, in their order): a row a model, from which `scored` makes every arm's score."""
    kept = [c for c in passages.columns if c != "passage"]
    schema = ", ".join(f"`{c}` {passages.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {a.model: Encoder(a.model, width) for a in arms}
        for whole in batches:
            for batch in parts_of(whole, "passage"):
                counted = [Counter(TOKEN.findall((t or "").lower())) for t in batch.column("passage").to_pylist()]
                for m, e in encoders.items():
                    words, marks = e.sums(counted)
                    norms = np.stack([np.sqrt(((words + a.markup * marks) ** 2).sum(1)) for a in arms if a.model == m], 1)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (words, marks, norms)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([m] * len(words)), *lists], [*kept, "model", "words", "marks", "norms"])

    return passages.select(*kept, "passage").mapInArrow(run, f"{schema}, model string, words array<double>, marks array<double>, norms array<double>")


def scored(met: DataFrame, arms: list[Arm], keep: list[str]) -> DataFrame:
    """keep, model, scores: the inner products of q with each arm's unit vector, to nine places. met: keep, model, q (dim, x of its components beside 0), words, marks, norms."""
    kinds = ", ".join(f"`{c}` {met.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            told = np.array(whole.column("model").to_pylist())
            for m in sorted(set(told.tolist())):
                batch = whole.filter(pa.array(told == m))
                n, markups = batch.num_rows, np.array([a.markup for a in arms if a.model == m])
                words, marks, norms = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("words", "marks", "norms"))
                q = batch.column("q")
                dim, x = (f.to_numpy(zero_copy_only=False) for f in q.flatten().flatten())
                row = np.repeat(np.arange(n), np.asarray(q.value_lengths()))
                dots = [np.bincount(row, x * s[row, dim], n) for s in (words, marks)]
                product = dots[0][:, None] + markups * dots[1][:, None]
                out = np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(markups)), pa.array(np.round(out, 9).ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("model"), lists], [*keep, "model", "scores"])

    return met.select(*keep, "model", "q", "words", "marks", "norms").mapInArrow(run, f"{kinds}, model string, scores array<double>")


def parts_of(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about AT_ONCE bytes of text."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        yield batch.slice(at, to - at)
        at = to


def encode_by_loops(question: str, passage: str, arm: Arm, width: int = WIDTH) -> tuple[list[float], float]:
    """The vector and score of one pair, plainly: what the pass must give."""

    def vector(text: str, markup: float) -> list[float]:
        out = [0.0] * width
        for t, n in Counter(TOKEN.findall(text.lower())).items():
            dim, sign = place(arm.model, t, width)
            out[dim] += sign * (1 + math.log(n)) * (1.0 if t[0].isalnum() or t[0] == "_" else markup)
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out

    v = vector(passage, arm.markup)
    return v, sum(x * y for x, y in zip(v, vector(question, 0.0), strict=True))


# -- the store


def write_features(features: DataFrame, folder: str) -> None:
    """A table partitioned by format, so that a study of some formats reads only theirs."""
    features.write.mode("overwrite").partitionBy("format").option("compression", "zstd").parquet(folder)


class FeatureStore:
    """A written table of features: what holds for all of it, and its rows by format."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.rows = spark.read.parquet(folder)

    def dim(self) -> int | None:
        """The width of the vectors; None without rows."""
        found = self.rows.select(F.size("vec").alias("d")).first()
        return found and found["d"]

    def formats(self) -> list[str]:
        return sorted(r["format"] for r in self.rows.select("format").distinct().collect())

    def of(self, formats: list[str] | None = None) -> DataFrame:
        """The rows of some formats; others' files aren't read. An unknown format raises."""
        if formats is None:
            return self.rows
        missing = set(formats) - set(self.formats())
        if missing:
            raise ValueError(f"the store lacks formats: {', '.join(sorted(missing))}")
        return self.rows.filter(F.col("format").isin(formats))

    def n_negatives(self) -> DataFrame:
        """model, arm, seed, n: candidates besides gold (candidate 0) of a query."""
        per_query = self.rows.groupBy("model", "arm", "seed", "query_id").agg((F.count_distinct("cand") - 1).alias("n"))
        return per_query.groupBy("model", "arm", "seed").agg(F.max("n").alias("n"))

    def gold_scores(self, formats: list[str] | None = None) -> DataFrame:
        """The scores of candidate 0: model, arm, seed, query_id, format, score."""
        return self.of(formats).filter("cand = 0").select("model", "arm", "seed", "query_id", "format", "score")
