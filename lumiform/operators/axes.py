"""Both axes of a study from one state of mergeable sums, which a splice of some rows changes only where they stand.

The state holds, for every block of queries and every bootstrap replicate, weighted sums of the pair differences, their squares,
and whether a query is answerable and inconsistent; one more set of weights is the sample itself. The largest effect, the
inconsistency and their intervals follow from sums of the state. When some rows get other scores, only their blocks are made
again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiform.functions.ranking import dense_index
from lumiform.operators import resample
from lumiform.operators.answer import leads
from lumiform.operators.effect import format_pairs
from lumiform.operators.resample import BLOCK, and_plain, block_sums, draw_weights, merged, placed
from lumiform.sources.scratch import kept

MEDIUM_EFFECT = 0.5


def rows_of(tensor: DataFrame, queries: DataFrame) -> DataFrame:
    """model, idx, query_id, v of a tensor (model, query_id, cand, format, fpos, score): gold's pair differences, their squares, answerable and inconsistent.
    queries: model, query_id, idx."""
    gold = tensor.filter("cand = 0")
    pairs = format_pairs(gold, ["model", "query_id"]).groupBy("model", "query_id").agg(F.array_sort(F.collect_list(F.struct("pair", (F.col("a") - F.col("b")).alias("x")))).alias("p"))
    led = leads(tensor, ("model",)).groupBy("model", "query_id").agg(F.count_if("lead").alias("k"), F.count(F.lit(1)).alias("f"))
    x = F.transform("p", lambda p: p["x"])
    some = (F.col("k") > 0).cast("double")
    v = F.concat(x, F.transform(x, lambda y: y * y), F.array(some, some * (F.col("k") < F.col("f")).cast("double")))
    return pairs.join(led, ["model", "query_id"]).join(queries, ["model", "query_id"]).select("model", "idx", "query_id", v.alias("v"))


def indexed(tensor: DataFrame) -> DataFrame:
    """model, query_id, idx: a gapless index of each model's queries."""
    return dense_index(tensor.select("model", "query_id").distinct(), "query_id", groups=("model",))


def state_of(rows: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """The state of rows (model, idx, v): model, n, block, b (0 .. n_boot - 1, and n_boot for the sample itself), s, w."""
    return block_sums(placed(rows, ("model",)), n_boot + 1, and_plain(draw_weights(n_boot, seed), n_boot), ("model",))


def spliced(state: DataFrame, rows: DataFrame, new: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """The state with the rows of `new` (model, idx, v) in place of theirs. Blocks without such a row are taken as they are; a row that isn't in rows raises."""
    unknown = new.join(rows, ["model", "idx"], "left_anti").count()
    if unknown:
        raise ValueError(f"{unknown} replaced rows are not in the results")
    touched = new.select("model", F.floor(F.col("idx") / BLOCK).cast("long").alias("block")).distinct()
    whole = placed(rows.select("model", "idx", "v"), ("model",)).join(touched, ["model", "block"], "left_semi")
    mixed = whole.join(new.select("model", "idx", F.col("v").alias("new_")), ["model", "idx"], "left").withColumn("v", F.coalesce("new_", "v"))
    again = block_sums(mixed.select("model", "idx", "n", "block", "v"), n_boot + 1, and_plain(draw_weights(n_boot, seed), n_boot), ("model",))
    return state.join(touched, ["model", "block"], "left_anti").unionByName(again)


def statistics(state: DataFrame) -> DataFrame:
    """model, b, max_abs_d, inconsistency_pct (null where no query is answerable) of every set of weights."""
    sums = merged(state, ("model",))
    pairs = ((F.size("s") - 2) / 2).cast("int")
    part = lambda c, at: F.slice(c, at, pairs)
    d = resample.largest_effect(part("s", F.lit(1)), part("s", pairs + 1), part("w", F.lit(1)))
    return sums.select("model", "b", d.alias("max_abs_d"), F.try_divide(F.element_at("s", -1) * 100, F.element_at("s", -2)).alias("inconsistency_pct"))


def axes(stats: DataFrame, n_boot: int, ci: float = 0.95) -> DataFrame:
    """model, max_abs_d, d_lo, d_hi, inconsistency_pct, inconsistency_lo, inconsistency_hi: the sample's values and the replicates' intervals."""
    lo = (1 - ci) / 2
    drawn = lambda c: F.percentile(F.when(F.col("b") < n_boot, F.col(c)), F.array(F.lit(lo), F.lit(1 - lo)))
    own = lambda c: F.max(F.when(F.col("b") == n_boot, F.col(c)))
    out = stats.groupBy("model").agg(own("max_abs_d").alias("max_abs_d"), drawn("max_abs_d").alias("d"), own("inconsistency_pct").alias("inconsistency_pct"), drawn("inconsistency_pct").alias("i"))
    end = lambda c, k: F.element_at(c, k)
    return out.select("model", "max_abs_d", end("d", 1).alias("d_lo"), end("d", 2).alias("d_hi"), "inconsistency_pct", end("i", 1).alias("inconsistency_lo"), end("i", 2).alias("inconsistency_hi"))


def rescored_table(tensor: DataFrame, rescored: DataFrame, control: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """A row a model: queries rescored, both axes before and after with the intervals of the new estimates, and the largest difference of scores on the control
    records. tensor, rescored: model, query_id, cand, format, fpos, score; rescored has all candidates and formats of the queries it replaces, control of
    some that it doesn't."""
    index = kept(indexed(tensor), "query-index")
    rows, new = kept(rows_of(tensor, index), "axis-rows"), kept(rows_of(rescored, index), "axis-rows")
    state = kept(state_of(rows, n_boot, seed), "axis-state")
    before = statistics(state.filter(F.col("b") == n_boot)).select("model", F.col("max_abs_d").alias("max_abs_d"), "inconsistency_pct")
    after = axes(statistics(spliced(state, rows, new, n_boot, seed)), n_boot).withColumnsRenamed({"max_abs_d": "max_abs_d_rescored", "inconsistency_pct": "inconsistency_pct_rescored"})
    counts = new.groupBy("model").agg(F.count(F.lit(1)).alias("rescored"))
    on = ["model", "query_id", "cand", "format"]
    checked = control.select(*on, F.col("score").alias("again")).join(tensor, on).groupBy("model").agg(F.max(F.abs(F.col("again") - F.col("score"))).alias("control_max_abs_diff"))
    return counts.join(before, "model").join(after, "model").join(checked, "model", "left")


def family_table(stats: DataFrame, n_boot: int, threshold: float = MEDIUM_EFFECT, alpha: float = 0.05) -> DataFrame:
    """A row a model: both statistics, the one-sided p that the effect isn't above the threshold and that nothing is inconsistent, each with Holm over the
    models, and whether the claims stand."""
    own = lambda c: F.max(F.when(F.col("b") == n_boot, F.col(c)))
    p = lambda c, null: (1 + F.count_if((F.col("b") < n_boot) & (F.col(c) <= null))) / (F.count_if((F.col("b") < n_boot) & F.col(c).isNotNull()) + 1)
    out = stats.groupBy("model").agg(own("max_abs_d").alias("max_abs_d"), p("max_abs_d", threshold).alias("p_above_threshold"), own("inconsistency_pct").alias("inconsistency_pct"), p("inconsistency_pct", 0.0).alias("p_above_zero"))
    for raw, adjusted, holds in (("p_above_threshold", "holm_threshold", "above_threshold"), ("p_above_zero", "holm_zero", "inconsistent")):
        out = resample.holm(out, raw, alpha=alpha).withColumnsRenamed({"holm_p": adjusted, "significant": holds})
    return out
