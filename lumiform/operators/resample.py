"""Bootstrap, two-level bootstrap, sign-flip permutation, Holm, and choice among sweeps.

Replicates never become rows of draws. Values stand in blocks of BLOCK; the task that holds a block draws how often each of its
rows comes up in every replicate, multiplies those weights with the values of all columns at once, and gives one row of sums a
replicate when its blocks are through. How many draws of a replicate fall into a block is split down a binary tree of blocks
by binomial draws that depend on (seed, node) alone, so all tasks agree without talking, and the whole is exactly the
multinomial of drawing n rows with replacement.

Within a block the draws come from integers that depend on (seed, replicate, slot) alone: two keys of a replicate from md5, mixed
with the slot by 32-bit arithmetic. Another engine can repeat them. Statistics that share a seed are resampled alike."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumiform.operators.corpus import hashed

#: Rows of a block, and weights that are drawn at a time.
BLOCK, AT_ONCE = 4096, 1 << 18
#: The odd constants of the mixing steps.
GOLDEN, FIRST, SECOND, BLOCKS = 2654435769, 2246822507, 3266489909, 2246822519


def stirred(x: np.ndarray) -> np.ndarray:
    """x (uint32, overwritten) with every bit spread over all others."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(FIRST)
    x ^= x >> np.uint32(13)
    x *= np.uint32(SECOND)
    x ^= x >> np.uint32(16)
    return x


def keys_of(seed: int, purpose: str, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Two uint32 for each of 0 .. count - 1: the first 16 hexadecimal digits of md5 of "seed|purpose|number"."""
    raw = b"".join(hashlib.md5(f"{seed}|{purpose}|{i}".encode()).digest()[:8] for i in range(count))
    pair = np.frombuffer(raw, ">u4").reshape(-1, 2).astype(np.uint32)
    return pair[:, 0], pair[:, 1]


def chance(first: np.ndarray, second: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """A uint32 for each pair of keys and slot (broadcast against each other)."""
    x = stirred(slot.astype(np.uint32) * np.uint32(GOLDEN) + first)
    x ^= second
    return stirred(x)


def block_counts(seed: int, n_boot: int, n: int, block: int) -> np.ndarray:
    """How many of each replicate's n draws fall into the block."""
    lo, hi, count = 0, -(-n // BLOCK), np.full(n_boot, n, np.int64)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        share = (middle - lo) * BLOCK / (min(hi * BLOCK, n) - lo * BLOCK)
        node = hashlib.md5(f"{seed}|blocks|{lo}|{hi}".encode()).digest()
        left = np.random.Generator(np.random.Philox(key=int.from_bytes(node, "little"))).binomial(count, share)
        lo, hi, count = (lo, middle, left) if block < middle else (middle, hi, count - left)
    return count


Weights = Callable[[int, int, int], Iterator[tuple[int, np.ndarray]]]


def draw_weights(n_boot: int, seed: int) -> Weights:
    """For a block of m rows out of n: how often each row comes up, some replicates at a time, from the first one on."""

    def weights(n: int, block: int, m: int) -> Iterator[tuple[int, np.ndarray]]:
        first, second = keys_of(seed, "draw", n_boot)
        second = second ^ np.uint32(block * BLOCKS & 0xFFFFFFFF)
        counts = block_counts(seed, n_boot, n, block)
        step = max(1, AT_ONCE // m)
        for b in range(0, n_boot, step):
            c = counts[b : b + step]
            of = np.repeat(np.arange(len(c)), c)
            slot = np.arange(len(of)) - np.repeat(np.cumsum(c) - c, c)
            row = chance(first[b : b + step][of], second[b : b + step][of], slot) % np.uint32(m)
            yield b, np.bincount(of * m + row, minlength=len(c) * m).reshape(len(c), m)

    return weights


def sign_weights(n_permutations: int, seed: int) -> Weights:
    """For a block of m rows: 1 or -1 for each row, some permutations at a time. 32 permutations take the bits of one number."""

    def weights(n: int, block: int, m: int) -> Iterator[tuple[int, np.ndarray]]:
        first, second = keys_of(seed, "sign", -(-n_permutations // 32))
        slot = np.arange(block * BLOCK, block * BLOCK + m)
        step = max(1, AT_ONCE // (32 * m))
        for g in range(0, len(first), step):
            x = chance(first[g : g + step, None], second[g : g + step, None], slot[None])
            bit = (x[:, None] >> np.arange(32, dtype=np.uint32)[None, :, None]) & np.uint32(1)
            yield 32 * g, (1.0 - 2.0 * bit).reshape(-1, m)[: n_permutations - 32 * g]

    return weights


def and_plain(weights: Weights, count: int) -> Weights:
    """weights, and as set number `count` the values as they are, each once."""

    def every(n: int, block: int, m: int) -> Iterator[tuple[int, np.ndarray]]:
        yield from weights(n, block, m)
        yield count, np.ones((1, m))

    return every


def placed(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """values with n, the rows of their keys, and block."""
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = values.join(F.broadcast(sizes), list(keys)) if keys else values.join(F.broadcast(sizes))
    return rows.withColumn("block", F.floor(F.col("idx") / BLOCK).cast("long"))


def merged(sums: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, b, n, s, w: partial sums of `block_sums` added up, as many rows a replicate as there were parts."""
    added = lambda c: F.aggregate(F.slice(c, 2, F.lit(1 << 30)), F.element_at(c, 1), lambda acc, x: F.zip_with(acc, x, lambda p, q: p + q)).alias(c)
    return sums.groupBy(*keys, "n", "b").agg(F.array_agg("s").alias("s"), F.array_agg("w").alias("w")).select(*keys, "n", "b", added("s"), added("w"))


def weighted_sums(values: DataFrame, count: int, weights: Weights, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, b (0 .. count - 1), n, s and w: for each of `count` sets of weights the weighted sums of v's elements and of the weights of those that
    aren't null. values: keys, idx (gapless from 0 within the keys), v (array of double, of one length). Keys are few: models, arms, seeds.

    A task holds count x (v's length) sums for each of its keys, and gives as many rows of them, however many rows it read."""
    return merged(block_sums(placed(values, keys), count, weights, keys, False), keys)


def block_sums(rows: DataFrame, count: int, weights: Weights, keys: tuple[str, ...] = (), by_block: bool = True) -> DataFrame:
    """keys, n, b, s, w as in `weighted_sums`, in parts: one a task and key, or with by_block one a block, and its number in `block` (else -1). rows: `placed`."""
    source = rows
    # the keys of one size draw alike in a block, so these meet in a task and its weights are drawn once; a number of its own: a block is few bytes but much work, so blocks must not be packed into tasks by their bytes
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "n", "block").sortWithinPartitions("n", "block", *keys, "idx").select(*keys, "n", "block", "v")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
        """(keys..., n, block) and the matrix of every block; the rows of one come together."""
        name, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            told = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys) + 2)), strict=True))
            v = batch.column(len(keys) + 2)
            matrix = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
            cuts = [0, *(i for i in range(1, len(told)) if told[i] != told[i - 1]), len(told)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if told[a] != name:
                    if parts:
                        yield name, np.concatenate(parts)
                    name, parts = told[a], []
                parts.append(matrix[a:b])
        if parts:
            yield name, np.concatenate(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for (n, block), alike in groupby(blocks(batches), lambda one: one[0][-2:]):
            told = list(alike)
            into = [totals.setdefault((*name[:-1], block if by_block else -1), (np.zeros((count, x.shape[1])), np.zeros((count, x.shape[1])))) for name, x in told]
            there = [~np.isnan(x) for _, x in told]
            values = [np.where(t, x, 0.0) for t, (_, x) in zip(there, told, strict=True)]
            whole = [bool(t.all()) for t in there]
            for b, times in weights(n, block, len(values[0])):
                times = times.astype(float)
                plain = times.sum(1)[:, None]
                for (s, w), x, t, full in zip(into, values, there, whole, strict=True):
                    s[b : b + len(times)] += times @ x
                    w[b : b + len(times)] += plain if full else times @ t.astype(float)
        for key, (s, w) in totals.items():
            for a in range(0, count, 1024):
                part = slice(a, min(a + 1024, count))
                m = part.stop - a
                ends = pa.array(np.arange(m + 1) * s.shape[1], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(t[part].ravel())) for t in (s, w)]
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * m, values_types[i]) for i, k in enumerate(key)), pa.array(np.arange(a, part.stop), pa.int32()), *lists], [*keys, "n", "block", "b", "s", "w"])

    from pyspark.sql.pandas.types import to_arrow_type

    values_types = [*(to_arrow_type(source.schema[k].dataType) for k in keys), pa.int64(), pa.int64()]
    return rows.mapInArrow(add, f"{kinds + ', ' if kinds else ''}n long, block long, b int, s array<double>, w array<double>")


def replicate_means(values: DataFrame, columns: list[str], n_boot: int, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, b and the resampled mean of each column, over the draws in which it isn't null. values: keys, idx (gapless from 0 within the keys), columns."""
    sums = weighted_sums(values.select(*keys, "idx", F.array(*[F.col(c).cast("double") for c in columns]).alias("v")), n_boot, draw_weights(n_boot, seed), keys)
    return sums.select(*keys, "b", *[F.try_divide(F.col("s")[i], F.col("w")[i]).alias(c) for i, c in enumerate(columns)])


def interval(replicates: DataFrame, value: str, ci: float = 0.95, keys: tuple[str, ...] = ()) -> DataFrame:
    lo = (1 - ci) / 2
    p = F.percentile(value, F.array(F.lit(lo), F.lit(1 - lo)))
    return replicates.groupBy(*keys).agg(p.alias("p"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(*keys, "mean", F.element_at("p", 1).alias("lo"), F.element_at("p", 2).alias("hi"), "n")


def replicate_d(diffs: DataFrame, n_boot: int, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, b, d: the largest absolute paired effect over pairs of each replicate. diffs: keys, idx, pair, diff; every idx has every pair. The
    moments of all pairs are summed together."""
    wide = diffs.groupBy(*keys, "idx").agg(F.array_sort(F.collect_list(F.struct("pair", "diff"))).alias("p"))
    return replicate_wide_d(wide.select(*keys, "idx", F.transform("p", lambda p: p["diff"]).alias("x")), n_boot, seed, keys)


def replicate_wide_d(wide: DataFrame, n_boot: int, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """`replicate_d` of rows keys, idx, x: the differences of all pairs, in one order."""
    sums = weighted_sums(wide.select(*keys, "idx", F.concat("x", F.transform("x", lambda y: y * y)).alias("v")), n_boot, draw_weights(n_boot, seed), keys)
    half = (F.size("s") / 2).cast("int")
    return sums.select(*keys, "b", largest_effect(F.slice("s", F.lit(1), half), F.slice("s", half + 1, half), F.slice("w", F.lit(1), half)).alias("d"))


def largest_effect(sums: Column, squares: Column, weights: Column) -> Column:
    """The largest absolute paired effect of pairs, from arrays of their sums, sums of squares and weights."""

    def one(m: Column) -> Column:
        mean = m["s"] / m["n"]
        return F.abs(mean) / (F.sqrt(F.greatest(m["q"] / m["n"] - mean * mean, F.lit(0.0))) + 1e-12)

    return F.array_max(F.transform(F.arrays_zip(sums.alias("s"), squares.alias("q"), weights.alias("n")), one))


def p_above(replicates: DataFrame, value: str, null: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """One-sided p that the statistic isn't above null: (1 + replicates at or under it) / (replicates + 1)."""
    return replicates.groupBy(*keys).agg(((1 + F.count_if(F.col(value) <= null)) / (F.count(F.lit(1)) + 1)).alias("p"))


def holm(frame: DataFrame, p: str = "p", family: tuple[str, ...] = (), order: str | list[str] = "model", alpha: float = 0.05) -> DataFrame:
    """frame with holm_p and significant; the families are as small as their models."""
    w = Window.partitionBy(*family).orderBy(p, *([order] if isinstance(order, str) else order))
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    step = (m - F.row_number().over(w) + 1) * F.col(p)
    adjusted = F.least(F.lit(1.0), F.max("step_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return frame.withColumn("step_", step).withColumn("holm_p", adjusted).drop("step_").withColumn("significant", F.col("holm_p") < alpha)


def sign_flips(values: DataFrame, column: str, n_permutations: int, seed: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, observed, p of a mean under random signs: (1 + permutations as extreme) / (permutations + 1). values: keys, idx (gapless from 0) and the column."""
    sums = weighted_sums(values.select(*keys, "idx", F.array(F.col(column).cast("double")).alias("v")), n_permutations, sign_weights(n_permutations, seed), keys)
    observed = values.groupBy(*keys).agg(F.round(F.avg(column), 9).alias("observed"))
    means = sums.select(*keys, F.round(F.abs(F.col("s")[0]) / F.col("n"), 9).alias("m"))
    met = means.join(F.broadcast(observed), list(keys)) if keys else means.join(F.broadcast(observed))
    return met.groupBy(*keys, "observed").agg(((1 + F.count_if(F.col("m") >= F.abs("observed"))) / (F.count(F.lit(1)) + 1)).alias("p"), (1 / (F.count(F.lit(1)) + 1)).alias("p_floor"))


def two_level(per_seed: DataFrame, n_boot: int, n_seeds: int, seed: int = 0) -> DataFrame:
    """b, value: each replicate averages as many draws of training seeds as there are. per_seed: b, sidx (0..n_seeds-1), value of each seed's resampled statistic."""
    spark = per_seed.sparkSession
    slots = spark.range(n_boot).select(F.col("id").cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_seeds - 1))).alias("j"))
    drawn = slots.select("b", F.pmod(hashed(seed, F.lit("seeds"), "b", "j"), F.lit(n_seeds)).cast("int").alias("sidx"))
    return drawn.join(per_seed, ["b", "sidx"]).groupBy("b").agg(F.avg("value").alias("value"))


def sign_test_p(wins: int, losses: int) -> float | None:
    """Two-sided exact binomial p over untied pairs; None when all are tied."""
    from math import comb

    n = wins + losses
    if not n:
        return None
    tail = sum(comb(n, k) for k in range(min(wins, losses) + 1)) / 2**n
    return min(1.0, 2 * tail)


# -- selection

NI_MARGIN = -0.03


def select_winner(rows: DataFrame, rule: str = "median", keys: tuple[str, ...] = ()) -> DataFrame:
    """The sweep rows with survives, tied, winner, sweep by sweep (keys). A row survives if its MRR interval's lower bound is above NI_MARGIN. The leader has the least
    d; rows tie with it whose intervals overlap its on both statistics; the rule picks the lower median (weights) or least (ranks) of their values.
    rows: keys, value, d, d_lo, d_hi, mrr_lo, mrr_hi. A sweep is a handful of rows; without survivors nothing wins."""
    rows = rows.withColumn("survives", F.col("mrr_lo") > NI_MARGIN)
    bounds = ("d_lo", "d_hi", "mrr_lo", "mrr_hi")
    best = F.min(F.when(F.col("survives"), F.struct("d", "value", *bounds))).over(Window.partitionBy(*keys))
    led = rows.withColumn("lead_", best)
    overlap = (F.col("d_lo") <= F.col("lead_.d_hi")) & (F.col("lead_.d_lo") <= F.col("d_hi")) & (F.col("mrr_lo") <= F.col("lead_.mrr_hi")) & (F.col("lead_.mrr_lo") <= F.col("mrr_hi"))
    tied = led.withColumn("tied", F.coalesce(F.col("survives") & overlap, F.lit(False)))
    n = F.count_if("tied").over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys, "tied").orderBy("value"))
    wanted: Column = F.floor((n + 1) / 2) if rule == "median" else F.lit(1)
    return tied.withColumn("winner", F.col("tied") & (place == wanted)).drop("lead_")


def weight_frame(selected: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, weight, max_abs_d, ci_lo, ci_hi, tied, winner of `select_winner`'s rows."""
    return selected.select(*keys, F.col("value").alias("weight"), F.col("d").alias("max_abs_d"), F.col("d_lo").alias("ci_lo"), F.col("d_hi").alias("ci_hi"), "tied", "winner")


def selection_counts(selected: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row: the candidates of all sweeps that pass the guardrail, all candidates, and the sweeps whose winner a tie-break chose."""
    ties = selected.groupBy(*keys).agg(F.count_if("survives").alias("p"), F.count(F.lit(1)).alias("c"), (F.count_if("tied") > 1).alias("t"))
    return ties.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("passed"), F.coalesce(F.sum("c"), F.lit(0)).alias("candidates"), F.count_if("t").alias("tie_broken"))
