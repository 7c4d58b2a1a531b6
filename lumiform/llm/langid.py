"""Language identification by unigrams marginalised over segmentations.

A language gives each piece of a fixed public vocabulary a probability. A unit of text (a run of letters in lower case, with a
space before it) has the probability of all its segmentations into pieces, summed by the forward algorithm; a text has the
product over its units. Pieces are byte strings and every byte is one, so every unit has a segmentation.

Probabilities are learnt by expectation-maximisation: forward and backward sums give how often a piece is expected in the units
of a language. Each round is a Spark job over the distinct units of the training texts; what it returns is bounded by languages
times pieces, and so is the broadcast model.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.llm.common import chunks, dropped, partitions, table, worker_cache, written
from lumiform.llm.toxicity import held_out

#: Training documents of a language (about), chosen by a hash.
SAMPLE = 3000
ROUNDS = 4
#: Pseudo-counts that each language gets, dealt as pieces are over all languages and, in small part, evenly.
SMOOTHING, EVEN = 50.0, 0.2
#: Units are cut after so many code points, so that the work is linear in the longest run too.
LONGEST = 64
#: Units whose probabilities a worker remembers, and units that go through the forward algorithm at a time.
REMEMBERED, AT_ONCE = 150_000, 8192
#: Probabilities of a model that may be broadcast (languages times pieces); 4 bytes each.
LIMIT = 1 << 27
RUN = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Vocabulary(NamedTuple):
    """The pieces that units can hold, as a trie. step[node, byte_class[byte]] is the next node or -1, piece[node] the piece that ends there or -1."""

    n: int
    byte_class: np.ndarray
    step: np.ndarray
    piece: np.ndarray


def vocabulary(path: str) -> Vocabulary:
    """The pieces of a vocabulary file (a line each: base64 of the bytes, and a rank) that hold only lower-case ASCII letters, bytes of other
    characters and a space at the start."""
    held = worker_cache().setdefault(("pieces", path), {})
    if not held:
        letters = set(b"abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
        with open(path, "rb") as lines:
            known = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
        pieces = sorted({p for p in known if p and set(p[1:]) <= letters and (p[0] in letters or p[0] == 32)} | {bytes([b]) for b in letters | {32}})
        byte_class = np.zeros(256, np.int16)
        byte_class[sorted(letters | {32})] = np.arange(len(letters) + 1)
        step, piece = [[-1] * (len(letters) + 1)], [-1]
        for i, p in enumerate(pieces):
            node = 0
            for b in p:
                c = byte_class[b]
                if step[node][c] < 0:
                    step[node][c] = len(step)
                    step.append([-1] * (len(letters) + 1))
                    piece.append(-1)
                node = step[node][c]
            piece[node] = i
        held["it"] = Vocabulary(len(pieces), byte_class, np.array(step, np.int32), np.array(piece, np.int32))
    return held["it"]


def units(text: str | None) -> list[str]:
    """The units of a text: runs of letters in lower case, after a space, those beyond LONGEST in parts. Runs of numerals that aren't letters are none."""
    out = []
    for run in RUN.findall((text or "").lower()):
        if not run.isalpha() and not any(map(str.isalpha, run)):
            continue
        if len(run) < LONGEST:
            out.append(" " + run)
        else:
            run = " " + run
            out += [run[i : i + LONGEST] for i in range(0, len(run), LONGEST)]
    return out


class Lattice(NamedTuple):
    """All places of pieces in a list of units. An edge goes from node to node; a unit of b bytes has b + 1 nodes. Edges are sorted by the byte they
    end at, then by unit."""

    source: np.ndarray
    target: np.ndarray
    piece: np.ndarray
    first: np.ndarray  # first node of each unit
    last: np.ndarray
    ends: np.ndarray  # bounds of the edges that end at byte 1, 2, ... of their units


def lattice(of: list[str], v: Vocabulary) -> Lattice:
    raw = [u.encode("utf-8", "surrogatepass") for u in of]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = v.byte_class[np.frombuffer(b"".join(raw), np.uint8)]
    begin = np.cumsum(size) - size
    unit = np.repeat(np.arange(len(raw)), size)
    end = (begin + size)[unit]
    at, state, length = np.arange(len(data)), np.zeros(len(data), np.int64), 0
    found = []
    while len(at):
        state = v.step[state, data[at + length]]
        live = state >= 0
        at, state = at[live], state[live]
        length += 1
        hit = v.piece[state]
        some = hit >= 0
        found.append((at[some], np.full(some.sum(), length), hit[some]))
        live = at + length < end[at]
        at, state = at[live], state[live]
    at, length, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    first = begin + np.arange(len(raw))
    to = at - begin[unit[at]] + length
    order = np.lexsort((unit[at], to))
    at, length, piece, to = at[order], length[order], piece[order], to[order]
    source = at + unit[at]
    return Lattice(source, source + length, piece, first, first + size, np.searchsorted(to, np.arange(1, size.max(initial=0) + 2)))


def summed(values: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the sum of exponentials of the rows that share a key (keys are sorted), and the keys."""
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    most = np.maximum.reduceat(values, fresh, axis=0)
    size = np.diff(np.append(fresh, len(key)))
    return most + np.log(np.add.reduceat(np.exp(values - np.repeat(most, size, axis=0)), fresh, axis=0)), key[fresh]


def forward(x: Lattice, logp: np.ndarray) -> np.ndarray:
    """By node and language, the log probability of all segmentations up to it. logp: pieces by languages."""
    alpha = np.full((x.last[-1] + 1 if len(x.last) else 0, logp.shape[1]), -np.inf)
    alpha[x.first] = 0.0
    for a, b in zip(x.ends[:-1], x.ends[1:], strict=True):
        if a < b:
            total, node = summed(alpha[x.source[a:b]] + logp[x.piece[a:b]], x.target[a:b])
            alpha[node] = total
    return alpha


def backward(x: Lattice, logp: np.ndarray) -> np.ndarray:
    """By node and language, the log probability of all segmentations from it to the end of its unit."""
    beta = np.full((x.last[-1] + 1 if len(x.last) else 0, logp.shape[1]), -np.inf)
    beta[x.last] = 0.0
    unit = np.searchsorted(x.first, x.source, "right") - 1
    start = x.source - x.first[unit]
    order = np.lexsort((unit, start))
    bounds = np.searchsorted(start[order], np.arange(start.max(initial=-1) + 2))
    for a, b in zip(bounds[-2::-1], bounds[:0:-1], strict=True):
        if a < b:
            e = order[a:b]
            total, node = summed(beta[x.target[e]] + logp[x.piece[e]], x.source[e])
            beta[node] = total
    return beta


def log_probabilities(of: list[str], v: Vocabulary, logp: np.ndarray) -> np.ndarray:
    """Of each unit under each language."""
    out = np.zeros((len(of), logp.shape[1]))
    for i in range(0, len(of), AT_ONCE):
        x = lattice(of[i : i + AT_ONCE], v)
        out[i : i + AT_ONCE] = forward(x, logp)[x.last]
    return out


def expected(of: list[str], counts: np.ndarray, v: Vocabulary, logp: np.ndarray) -> np.ndarray:
    """How often each piece is expected in units that occur counts[unit, language] times: pieces by languages."""
    total = np.zeros((v.n, logp.shape[1]))
    for i in range(0, len(of), AT_ONCE):
        x = lattice(of[i : i + AT_ONCE], v)
        alpha, beta, n = forward(x, logp), backward(x, logp), counts[i : i + AT_ONCE]
        unit = np.searchsorted(x.first, x.source, "right") - 1
        share = np.exp(alpha[x.source] + logp[x.piece] + beta[x.target] - alpha[x.last][unit]) * n[unit]
        for c in range(logp.shape[1]):
            total[:, c] += np.bincount(x.piece, share[:, c], v.n)
    return total


class Model(NamedTuple):
    languages: list[str]
    logp: np.ndarray  # pieces by languages, float32
    path: str


def probabilities(counts: np.ndarray) -> np.ndarray:
    """Log probabilities from expected counts, smoothed so that no piece has none."""
    pooled = counts.sum(1) / max(counts.sum(), 1e-300)
    base = (1 - EVEN) * pooled + EVEN / len(counts) if counts.sum() else np.full(len(counts), 1 / len(counts))
    smooth = counts + SMOOTHING * base[:, None]
    return np.log(smooth / smooth.sum(0))


def train(docs: DataFrame, path: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """The model of documents with text, lang and doc_id outside the held-out third; of each language about `sample` of them, chosen by a hash of
    doc_id and text, whole texts of any length.

    Rows with a null text, lang or doc_id are left out; repeated rows count each; a language whose texts have no letters has no part in the model. Without such
    rows, or from an empty table, the model has no language. Other columns are ignored."""
    path = path or default_path()
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("size_"))
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)) / float(1 << 31)
    chosen = known.select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang").filter(share * F.col("size_") < sample).select("lang", "text")  # a row a language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 23):
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(units(text))
            for lang, seen in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "unit", "n"])

    seen = written(chosen.mapInArrow(count, "lang string, unit string, n long").groupBy("unit", "lang").agg(F.sum("n").alias("n")), "units")
    languages = [r.lang for r in seen.select("lang").distinct().orderBy("lang").collect()]
    v = vocabulary(path)
    if len(languages) * v.n > LIMIT:
        raise ValueError(f"{len(languages)} languages: the model would have more than {LIMIT} probabilities")
    by_unit = written(seen.repartition(partitions(docs.sparkSession), "unit").groupBy("unit").agg(F.collect_list(F.struct("lang", "n")).alias("by")), "units-by-language")  # at most a struct a language
    logp = np.full((v.n, len(languages)), -np.log(v.n))
    for _ in range(rounds if languages else 0):
        logp = probabilities(one_round(by_unit, languages, path, logp))
    dropped(seen, by_unit)
    return Model(languages, logp.astype(np.float32), path)


def one_round(by_unit: DataFrame, languages: list[str], path: str, logp: np.ndarray) -> np.ndarray:
    """Expected counts, pieces by languages, over all units. A task adds up its own; the sums are bounded by languages times pieces."""
    sent = by_unit.sparkSession.sparkContext.broadcast(logp)
    place = {x: i for i, x in enumerate(languages)}

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = vocabulary(path), None
        for batch in batches:
            of, by = batch.column(0).to_pylist(), batch.column(1)
            counts = np.zeros((len(of), len(place)))
            row = np.repeat(np.arange(len(of)), np.diff(by.offsets.to_numpy()))
            flat = by.flatten()
            counts[row, [place[x] for x in flat.field("lang").to_pylist()]] = flat.field("n").to_numpy()
            part = expected(of, counts, v, sent.value)
            total = part if total is None else total + part
        if total is not None:
            piece, lang = np.nonzero(total > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    found = by_unit.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(logp.shape)
    out[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    sent.unpersist()
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, lang_pred and score, the language's share of the probability of the whole text, languages being alike beforehand.

    Ties go to the first language by name. A null text, one without letters, and any text under a model without languages is `und`, score 0.
    Texts may be of any length; repeated rows are judged each; null ids stay; an empty table gives no rows; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model.logp)  # at most LIMIT probabilities
    languages, path = np.array([*model.languages, UNKNOWN], object), model.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = sent.value.astype(float)
        memory = {"place": {}, "logs": np.zeros((1 << 14, logp.shape[1]))}
        for batch in chunks(batches, "text_"):
            found = [units(t) for t in batch.column(1).to_pylist()]
            total, some = np.zeros((len(found), logp.shape[1])), np.zeros(len(found), bool)
            if logp.shape[1]:
                size = np.fromiter(map(len, found), np.int64, len(found))
                some = size > 0
                logs = remembered([u for f in found for u in f], memory, vocabulary(path), logp)
                if some.any():
                    total[some] = np.add.reduceat(logs, (np.cumsum(size) - size)[some], axis=0)
            best = np.where(some, total.argmax(1), len(languages) - 1) if logp.shape[1] else np.zeros(len(found), int)
            share = np.where(some, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 0.0) if logp.shape[1] else np.zeros(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages[best], pa.string()), pa.array(share, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").alias("text_")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def remembered(of: list[str], memory: dict, v: Vocabulary, logp: np.ndarray) -> np.ndarray:
    """log_probabilities, of which those of the last REMEMBERED units or so are kept."""
    if len(memory["place"]) > REMEMBERED:
        memory["place"] = {}
    place = memory["place"]
    fresh = [u for u in set(of) if u not in place]
    if fresh:
        n = len(place)
        while len(memory["logs"]) < n + len(fresh):
            memory["logs"] = np.concatenate([memory["logs"], np.zeros_like(memory["logs"])])
        memory["logs"][n : n + len(fresh)] = log_probabilities(fresh, v, logp)
        place.update(zip(fresh, range(n, n + len(fresh)), strict=True))
    return memory["logs"][np.fromiter(map(place.__getitem__, of), np.int64, len(of))]


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
