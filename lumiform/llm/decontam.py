"""Benchmark decontamination: template canonicalisation, a hash join of template windows, and slot consistency.

A text becomes a template: numbers, units and names turn into typed placeholders that keep their values aside as slots.
Windows of WINDOW template tokens of the benchmark meet those of the documents in a hash join; a bitmap over the
benchmark's window hashes, sized by their number, keeps nearly all other windows of the corpus from being shuffled (a false
positive costs one row, never a result). An item has one slot map in a document: on an alignment, and over all alignments
that count together, every slot value of the item must stand for one value in the document. Then the passage is the item,
or the item with other parameters. What surrounds a passage can
run into a slot at its edges ("For example, Mary Jones" is one name where "Mary" opened the item); there a value may be
longer on the outer side.

Placeholders alone say nothing: any name is like any other. So a window must hold literal words, or the item's own values, in
proportion: one that is half words may have any values, one without words must have all of the item's, and between the two the
share of equal values grows as the words get fewer. Windows without words meet by a hash of their values, not of their template.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.llm.common import chunks, spread_join, table, written
from lumiform.llm.textcore import buffer_of, mix, range_hash, words

WINDOW = 8
#: Share of an item's windows that a document must hold, on consistent alignments.
COVERAGE = 0.5
#: The bitmap has about so many bits a window, from 2**16 to 2**28 (32 MB) in all.
BITS_A_WINDOW, MOST_BITS = 1024, 28
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
FRONT, BACK = 1, 2
#: English words that open sentences and are no names.
OPENERS = "a an the this that these those it its he she they we you i his her their our your my if in on at by for from to of and or but as so when while where what which who whom whose why how there here each every all both some many most any no not after before then than since until because although though is are was were has have had do does did can could will would should may might must let find given suppose consider calculate compute determine solve show prove explain read write choose with without about over under between during through one once also however".split()
#: Number words and units of measurement.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kph hz khz mhz w kw watt watts v volt volts j joule joules n newton newtons pa k c f degree degrees percent dollar dollars euro euros cent cents usd eur gbp".split()


def hashes_of(terms: list[str]) -> np.ndarray:
    data, offsets = buffer_of(pa.array(terms))
    return np.sort(range_hash(data, offsets[:-1], offsets[1:]))


class Template(NamedTuple):
    code: np.ndarray  # uint64 of each template token: the word's hash, or the placeholder's
    kind: np.ndarray
    value: np.ndarray  # uint64 of what stands there
    ptr: np.ndarray
    parts: np.ndarray  # uint64 of each word
    lead: np.ndarray  # the first word of each template token, and the number of words


def canonical(values: pa.Array) -> Template:
    """The templates of whole texts. Numbers in digits or words are NUMBER ("3.5" and "1,000" are one each), a unit behind a number is UNIT,
    a word with a capital first letter alone is NAME, unless it is one of OPENERS and opens a sentence; several in a row are one. All else is its
    lower-case word."""
    raw, raw_offsets = buffer_of(values)
    low_raw, low_offsets = buffer_of(values, lower=True)
    low = words(low_raw, low_offsets)
    w = words(raw, raw_offsets)
    if len(w.hash) != len(low.hash) or (w.ptr != low.ptr).any():  # lower case that breaks words: no names then
        w, raw, raw_offsets = low, low_raw, low_offsets
    n = len(w.hash)
    if not n:
        e = np.zeros(0, np.uint64)
        return Template(e, e.astype(np.int8), e, w.ptr, e, np.zeros(1, np.int64))
    breaks = np.zeros(256, bool)
    breaks[list(b".!?:;\n\"")] = True
    seen = np.concatenate([[0], np.cumsum(breaks[raw])])
    opens = np.zeros(n, bool)
    opens[w.ptr[:-1][w.ptr[:-1] < n]] = True
    before = np.concatenate([[0], w.end[:-1]])
    gap = w.start - before
    opens |= seen[w.start] > seen[np.minimum(before, w.start)]
    first = raw[w.start]
    digits = (first >= 48) & (first <= 57)
    within = lambda h, known: known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
    number = digits | within(low.hash, hashes_of(NUMBER_WORDS))
    head = np.zeros(n, bool)
    head[w.ptr[:-1][w.ptr[:-1] < n]] = True  # first word of a text
    after_number = np.concatenate([[False], number[:-1]]) & ~head
    unit = ~number & after_number & within(low.hash, hashes_of(UNITS))
    size = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)
    tail, low_tail = (np.minimum(x.start + size[r[x.start]], x.end) for x, r in ((w, raw), (low, low_raw)))
    rest = range_hash(raw, tail, w.end) == range_hash(low_raw, low_tail, low.end)
    capital = (w.hash != low.hash) & ~digits & rest & (tail < w.end)  # not words in capitals throughout
    name = capital & ~(opens & within(low.hash, hashes_of(OPENERS))) & ~number & ~unit
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, WORD))).astype(np.int8)
    point = raw[np.minimum(before, len(raw) - 1)]
    goes_on = np.zeros(n, bool)
    goes_on[1:] = digits[1:] & digits[:-1] & (gap[1:] == 1) & ((point[1:] == 46) | (point[1:] == 44))
    goes_on[1:] |= name[1:] & name[:-1] & ~opens[1:]
    goes_on &= ~head
    # values of merged tokens: the hashes of their parts, summed with their order
    lead = np.flatnonzero(~goes_on)
    part = np.arange(n) - np.repeat(lead, np.diff(np.append(lead, n)))
    value = np.add.reduceat(mix(low.hash ^ mix(part.astype(np.uint64) + np.uint64(0x51ED270B))), lead)
    kind = kind[lead]
    code = np.where(kind == WORD, value, mix(kind.astype(np.uint64) + np.uint64(0x51ED270B)))
    return Template(code, kind, value, np.searchsorted(lead, w.ptr), low.hash, np.append(lead, n))


def windows(t: Template, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every run of `size` template tokens inside a text: its hash, its text, its place in the text. The hash is that of the template, or of the
    values where none of the tokens is a word."""
    n = len(t.code)
    if n < size:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e
    words_before = np.concatenate([[0], np.cumsum(t.kind == WORD)])
    wordless = words_before[size:] == words_before[: n - size + 1]
    h = np.where(wordless, np.uint64(size + 64), np.uint64(size))
    for j in range(size):
        part = slice(j, n - size + 1 + j)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.where(wordless, t.value[part], t.code[part])
    of = np.repeat(np.arange(len(t.ptr) - 1), np.diff(t.ptr))
    whole = of[: n - size + 1] == of[size - 1 :]
    at = np.flatnonzero(whole)
    return mix(h[at]), of[at], at - t.ptr[of[at]]


SLOTS = "array<array<long>>"


def slot_tokens(t: Template, of: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The template tokens that are slots of windows, in order, and where each window's begin among them."""
    full = np.concatenate([[0], np.cumsum(t.kind != WORD)])
    filled = np.flatnonzero(t.kind != WORD)
    start = t.ptr[of] + place
    a, b = full[start], full[start + size]
    return np.concatenate([filled[x:y] for x, y in zip(a, b, strict=True)]) if len(a) else filled[:0], np.concatenate([[0], np.cumsum(b - a)])


def slots(t: Template, of: np.ndarray, place: np.ndarray, size: int) -> pa.Array:
    """The slot values of windows, in order: the words of each."""
    token, begins = slot_tokens(t, of, place, size)
    lengths = t.lead[token + 1] - t.lead[token]
    ends = np.cumsum(lengths)
    word = np.arange(int(lengths.sum())) + np.repeat(t.lead[token] - (ends - lengths), lengths)
    values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(t.parts[word].view(np.int64)))
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), values)


def edges(t: Template, of: np.ndarray, place: np.ndarray, size: int) -> pa.Array:
    """For each slot of windows the side on which text before or after the whole passage can run into it: FRONT, BACK, both or neither.
    At the front that is the first token, and a name behind the first word, which may be a name where it opens no sentence."""
    token, begins = slot_tokens(t, of, place, size)
    text = np.repeat(of, np.diff(begins))
    at = token - t.ptr[text]
    front = (at == 0) | ((at == 1) & (t.kind[token] == NAME) & (t.kind[t.ptr[text]] == WORD))
    side = np.where(front, FRONT, 0) | np.where(token + 1 == t.ptr[text + 1], BACK, 0)
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(side.astype(np.int32)))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, size (template tokens a window), n_windows, place, hash, slots and their edges of every window of every item; an item of fewer
    tokens than WINDOW is one window, however short; repeated items count once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_"):
            t = canonical(batch.column(1))
            length = np.diff(t.ptr)
            for size in range(1, WINDOW + 1):
                h, of, place = windows(t, size)
                use = (length[of] == size) if size < WINDOW else np.ones(len(of), bool)
                h, of, place = h[use], of[use], place[use]
                if len(h):
                    n = pa.array(length[of] - size + 1, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(np.full(len(h), size), pa.int32()), n, pa.array(place, pa.int64()), pa.array(h.view(np.int64)), slots(t, of, place, size), edges(t, of, place, size)], ["item_id", "size", "n_windows", "place", "hash", "slots", "edges"])

    items = benchmark.select("item_id", F.col("text").alias("text_")).distinct()
    return items.mapInArrow(cut, f"item_id long, size int, n_windows long, place long, hash long, slots {SLOTS}, edges array<int>")


def extends(x: Column, y: Column) -> Column:
    """Whether x's found value is y's with more words on x's outer side."""
    longer = F.size(x["found"]) > F.size(y["found"])
    n = F.size(y["found"])
    ends = x["edge"].bitwiseAND(FRONT) > 0
    starts = x["edge"].bitwiseAND(BACK) > 0
    head = F.slice(x["found"], F.lit(1), n) == y["found"]
    tail = F.slice(x["found"], F.greatest(F.size(x["found"]) - n, F.lit(0)) + 1, n) == y["found"]
    return longer & ((ends & tail) | (starts & head))


def agreed(pairs: Column) -> Column:
    """Whether each of the item's values stands for one value in the document; a value of one word that is also a part of a longer name stands for that part."""
    against = lambda x, y: (x["own"] != y["own"]) | (x["found"] == y["found"]) | extends(x, y) | extends(y, x)
    word = lambda y: F.element_at(y["own"], 1)
    named = lambda x, y: (F.size(y["own"]) == 1) & (F.size(x["own"]) > 1) & (F.size(x["own"]) == F.size(x["found"])) & F.array_contains(x["own"], word(y))
    same_part = lambda x, y: F.try_element_at(x["found"], F.array_position(x["own"], word(y)).cast("int")) == F.element_at(y["found"], 1)
    within = lambda x, y: ~named(x, y) | ((F.size(y["found"]) == 1) & same_part(x, y))
    own = F.forall(pairs, lambda x: x["own"] == x["found"])  # spares most alignments the comparison of all pairs of slots
    return own | F.forall(pairs, lambda x: F.forall(pairs, lambda y: against(x, y) & within(x, y)))


def telling(pairs: Column, size: Column) -> Column:
    """Whether a window of `size` tokens has enough words and equal values: no value need be equal where words are half of it, all where there are none."""
    equal = F.size(F.filter(pairs, lambda p: p["own"] == p["found"]))
    return equal * size >= F.size(pairs) * (2 * F.size(pairs) - size)


def bitmap(known: DataFrame) -> tuple[np.ndarray, int]:
    """Bits that are true where a window's hash falls, and log2 of their number; built by aggregation, so the driver gets their bytes and no windows."""
    size = min(MOST_BITS, max(16, (known.count() * BITS_A_WINDOW).bit_length()))
    bit = F.shiftrightunsigned("hash", 64 - size)
    rows = known.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    out = np.zeros((1 << size) + (1 << 15), bool)
    for b, bits in rows:
        at = (b - 1) * 32768 if b else 0
        part = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        # bucket b holds the numbers (b - 1) * 32768 + 1 to b * 32768; bit p is number (b - 1) * 32768 + 1 + p (bucket 0: number 0)
        out[at + (1 if b else 0) : at + (1 if b else 0) + len(part)] |= part.astype(bool)
    return np.packbits(out[: 1 << size]), size


PAIRS = "array<struct<own:array<bigint>,found:array<bigint>,edge:int>>"


def together(alignments: Column) -> Column:
    """places and pairs of the alignments (places, pairs; the one of most places first) that share one slot map: each joins those before it if no slot's value conflicts."""
    zero = F.struct(F.array().cast("array<bigint>").alias("places"), F.array().cast(PAIRS).alias("pairs"))

    def step(acc: Column, x: Column) -> Column:
        joined = lambda pairs: F.when(agreed(pairs), F.struct(F.array_union(acc["places"], x["places"]).alias("places"), pairs.alias("pairs"))).otherwise(acc)
        return F.transform(F.array(F.array_distinct(F.concat(acc["pairs"], x["pairs"]))), joined)[0]

    return F.aggregate(alignments, zero, step)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each document and benchmark item of which the document holds at least COVERAGE of the windows under one slot map: key, item_id,
    n_tokens (template tokens of the item), n_windows, n_matched, coverage, and same_slots (every value is the item's own). Of windows with more
    slots than words only those count that hold the item's own values in proportion, so an item without words is found by its values alone.

    Null texts are empty and match nothing; items without words match nothing; texts are read whole, however long; of repeated rows one
    counts; rows with the same id and other texts are judged apart and the largest coverage is told, ties for same_slots; null keys are a key.
    Empty tables give no rows. Other columns of both tables are ignored, whatever their names."""
    spark = docs.sparkSession
    known = written(benchmark_windows(benchmark), "benchmark-windows")
    sent = spark.sparkContext.broadcast((*bitmap(known), [r[0] for r in known.select("size").distinct().collect()]))
    kind = docs.schema[key].dataType.simpleString()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, width, sizes = sent.value
        for batch in chunks(batches, "text_"):
            t = canonical(batch.column(1))
            for size in sizes:
                h, of, place = windows(t, size)
                b = (h >> np.uint64(64 - width)).astype(np.int64)
                hit = np.flatnonzero(bits[b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1)
                if len(hit):
                    of, place = of[hit], place[hit]
                    text = mix(hash_of_texts(t)[of]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(text), pa.array(place, pa.int64()), pa.array(h[hit].view(np.int64)), slots(t, of, place, size)], ["key_", "text_", "at_", "hash", "found_"])

    found = docs.select(F.col(key).alias("key_"), F.col("text").alias("text_")).mapInArrow(probe, f"key_ {kind}, text_ long, at_ long, hash long, found_ {SLOTS}")
    found = written(found, "window-hits")
    # several items can share a window; a hash is hot by the rows that it makes
    sizes = found.groupBy("hash").agg(F.count(F.lit(1)).alias("found_")).join(known.groupBy("hash").agg(F.count(F.lit(1)).alias("known_")), "hash")
    met = spread_join(found, known, ["hash"], ["key_", "text_", "at_"], sizes.select("hash", (F.col("found_") * F.col("known_")).alias("n_")))
    pairs = F.arrays_zip(F.col("slots").alias("own"), F.col("found_").alias("found"), F.col("edges").alias("edge"))
    theirs = lambda p: F.struct(p["own"].alias("own"), p["own"].alias("found"), p["edge"].alias("edge"))
    pairs = F.transform(pairs, lambda p: F.when(extends(p, theirs(p)), theirs(p)).otherwise(p))
    of = ["key_", "text_", "item_id", "n_windows", "n_tokens"]
    met = met.withColumn("n_tokens", F.col("n_windows") + F.col("size") - 1)
    met = met.select(*of, "place", "size", (F.col("at_") - F.col("place")).alias("shift_"), pairs.cast(PAIRS).alias("pairs_")).filter(telling(F.col("pairs_"), F.col("size")))
    aligned = met.groupBy(*of, "shift_").agg(F.collect_set("place").alias("places_"), F.array_distinct(F.flatten(F.collect_set("pairs_"))).alias("pairs_"))
    consistent = aligned.filter(agreed(F.col("pairs_")))
    listed = consistent.groupBy(*of).agg(F.sort_array(F.collect_list(F.struct((-F.size("places_")).alias("less"), "shift_", F.col("places_").alias("places"), F.col("pairs_").alias("pairs")))).alias("all_"))
    covered = listed.select(*of, together(F.col("all_")).alias("one_")).select(*of, F.size("one_.places").cast("long").alias("n_matched"), F.forall("one_.pairs", lambda p: p["own"] == p["found"]).alias("same_slots"))
    best = covered.filter(F.col("n_matched") >= COVERAGE * F.col("n_windows")).groupBy("key_", "item_id", "n_windows", "n_tokens").agg(F.max(F.struct("n_matched", "same_slots")).alias("m_"))
    return best.select(F.col("key_").alias(key), "item_id", "n_tokens", "n_windows", F.col("m_.n_matched").alias("n_matched"), (F.col("m_.n_matched") / F.col("n_windows")).alias("coverage"), F.col("m_.same_slots").alias("same_slots"))


def hash_of_texts(t: Template) -> np.ndarray:
    """A hash of every text's template and slots, so that rows with the same id and other texts stay apart."""
    weight = np.arange(1, len(t.value) + 1, dtype=np.uint64)
    place = weight - np.repeat(t.ptr[:-1], np.diff(t.ptr)).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(t.value + place * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    return sums[t.ptr[1:]] - sums[t.ptr[:-1]]


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items: doc_id, item_id, n_tokens, n_windows, n_matched, coverage, same_slots."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
