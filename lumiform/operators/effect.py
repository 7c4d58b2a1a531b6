"""Score axis: paired effect sizes, rank agreement and flips between formats.

Scores are long rows (keys..., record, format, fpos, score). Format pairs are made inside a record's own array of scores, so a
table is shuffled once by record, not joined with itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumiform.functions.ranking import average_ranks, rank_histogram

EPSILON = 1e-12


def correlation(a: str, b: str) -> Column:
    """Pearson's r; null for a constant, where corr() of an ANSI session fails."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def per_format_summary(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return scores.groupBy(*keys, "format").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.median("score").alias("median"))


def format_pairs(scores: DataFrame, record: list[str], value: str = "score") -> DataFrame:
    """record, left, right, pair, a, b for every pair of formats of a record, in roster order."""
    gathered = scores.groupBy(*record).agg(F.array_sort(F.collect_list(F.struct("fpos", "format", F.col(value).alias("v")))).alias("s"))
    one = gathered.select(*record, "s", F.posexplode("s").alias("i", "l"))
    both = one.select(*record, "l", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("r"))
    return both.select(*record, F.col("l.format").alias("left"), F.col("r.format").alias("right"), F.concat("l.format", F.lit("-"), "r.format").alias("pair"), F.col("l.v").alias("a"), F.col("r.v").alias("b"), (F.col("l.fpos") * 10 + F.col("r.fpos")).alias("ppos"))


def gold_differences(grid: str = "grid") -> Column:
    """The differences of gold's score between every two formats of a grid, in roster order."""
    gold = F.transform(grid, lambda f: f["scores"][0])
    return F.flatten(F.transform(gold, lambda a, i: F.transform(F.slice(gold, i + 2, F.size(gold)), lambda b: a - b)))


def effect(diff: str = "diff") -> Column:
    """Paired effect size: mean over population standard deviation."""
    return F.avg(diff) / (F.stddev_pop(diff) + EPSILON)


def pairwise_d(scores: DataFrame, record: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, pair, ppos, mean_diff, d."""
    pairs = format_pairs(scores, record).withColumn("diff", F.col("a") - F.col("b"))
    return pairs.groupBy(*keys, "pair", "ppos", "left", "right").agg(F.avg("diff").alias("mean_diff"), effect().alias("d"))


def max_abs_d(effects: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The largest absolute effect and the first pair that has it; 0 and no pair where all are 0."""
    best = effects.groupBy(*keys).agg(F.max(F.abs("d")).alias("m"), F.max_by("pair", F.struct(F.round(F.abs("d"), 9), -F.col("ppos"))).alias("p"), F.avg(F.abs("d")).alias("mean_abs_d"))
    return best.select(*keys, F.coalesce("m", F.lit(0.0)).alias("max_abs_d"), F.when(F.col("m") > 0, F.col("p")).alias("pair"), "mean_abs_d")


def format_ranking(scores: DataFrame) -> DataFrame:
    """Formats by falling mean, roster order among equals."""
    means = scores.groupBy("format", "fpos").agg(F.round(F.avg("score"), 9).alias("mean"))
    return means.select("format", F.row_number().over(Window.orderBy(F.desc("mean"), "fpos")).alias("place"), "mean")


def spearman(scores: DataFrame, record: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, pair, rho: correlation of average ranks; null where a format is constant."""
    ranked = average_ranks(scores, [*keys, "format"], "score")
    pairs = format_pairs(ranked, record, "rank")
    return pairs.groupBy(*keys, "pair").agg(correlation("a", "b").alias("rho"))


def wilcoxon(scores: DataFrame, record: list[str]) -> DataFrame:
    """pair, n, w_plus, w_minus, z of the signed-rank statistic with tie correction; zeros are left out. Ranks come from the histogram of
    absolute differences."""
    pairs = format_pairs(scores, record).select("pair", F.round(F.col("a") - F.col("b"), 9).alias("diff")).filter("diff <> 0")
    histogram = pairs.groupBy("pair", F.abs("diff").alias("size")).agg(F.count(F.lit(1)).alias("c_"), F.count_if(F.col("diff") > 0).alias("p"))
    ranks = rank_histogram(histogram, ["pair"], "size").withColumnRenamed("c_", "c")
    c, n = F.col("c").cast("double"), F.col("n").cast("double")
    total = ranks.groupBy("pair").agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("p")).alias("w_plus"), F.sum(F.col("rank") * (F.col("c") - F.col("p"))).alias("w_minus"), F.sum(c * c * c - c).alias("ties"))
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return total.select("pair", "n", "w_plus", "w_minus", F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, spread).alias("z"))


def wilcoxon_exact_p(w: float, n: int) -> float:
    """Two-sided exact p of a signed-rank statistic without ties, from the distribution of sums of subsets of 1..n."""
    ways = [1]
    for k in range(1, n + 1):
        longer = ways + [0] * k
        for s, c in enumerate(ways):
            longer[s + k] += c
        ways = longer
    return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)


def normal_p(z: float) -> float:
    """Two-sided p of a standard normal."""
    import math

    return math.erfc(abs(z) / math.sqrt(2))


def flip_rate(scores: DataFrame, sampled: DataFrame) -> DataFrame:
    """pair, flip_pct over sampled record pairs (i, j): the two formats order them differently. Ties are no flip, but count in the denominator.
    scores: idx, format, fpos, score."""
    wide = format_pairs(scores, ["idx"]).select("idx", "pair", "a", "b")
    i, j = wide.select(F.col("idx").alias("i"), "pair", F.col("a").alias("ai"), F.col("b").alias("bi")), wide.select(F.col("idx").alias("j"), "pair", F.col("a").alias("aj"), F.col("b").alias("bj"))
    met = sampled.join(i, "i").join(j, ["j", "pair"])
    flips = F.sign(F.col("ai") - F.col("aj")) * F.sign(F.col("bi") - F.col("bj")) < 0
    return met.groupBy("pair").agg((F.count_if(flips) * 100.0 / F.count(F.lit(1))).alias("flip_pct"))


def scale_diagnostic(scores: DataFrame) -> DataFrame:
    """Mean spread of a candidate over formats, mean spread of a query's candidates within a format, and their ratio."""
    across = scores.groupBy("query_id", "cand").agg(F.stddev_pop("score").alias("s")).agg(F.avg("s").alias("across_formats"))
    within = scores.groupBy("query_id", "format").agg(F.stddev_pop("score").alias("s")).agg(F.avg("s").alias("within_query"))
    return across.crossJoin(within).withColumn("ratio", F.col("across_formats") / (F.col("within_query") + EPSILON))
