"""Ranking quality on prose, where there is no format: did training on formats cost anything, fold by fold.

A fold is the format that training held out, so each model has a control and a winner arm a fold, and one untrained arm. Scores are
rows (model, arm, fold, query_id, cand, score) with gold at candidate 0; the untrained arm's fold is empty. The arms of one model
must cover the same records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiform.functions.ranking import dense_index
from lumiform.functions.render import FORMATS
from lumiform.operators import resample
from lumiform.sources.scratch import kept

UNTRAINED, ARMS = "untrained", ("control", "winner")


def reciprocal_ranks(scores: DataFrame) -> DataFrame:
    """model, arm, fold, query_id, rr: ties favour gold."""
    g = scores.groupBy("model", "arm", "fold", "query_id").agg(F.max(F.when(F.col("cand") == 0, F.col("score"))).alias("g"), F.array_agg(F.when(F.col("cand") > 0, F.col("score"))).alias("n"))
    return g.select("model", "arm", "fold", "query_id", (1.0 / (1 + F.size(F.filter("n", lambda x: x > F.col("g"))))).alias("rr"))


def ranks_in(lists: DataFrame, arms: dict[str, list[list[str]]]) -> DataFrame:
    """`reciprocal_ranks`, from a row for each model and query: model, query_id, all (cand, scores: one for each of the model's arms). arms: a model's (arm, fold) in order;
    models have as many."""
    at = lambda i, gold: F.transform(F.filter("all", lambda x: (x["cand"] == 0) if gold else (x["cand"] > 0)), lambda x: F.get(x["scores"], i))
    above = lambda i: F.size(F.filter(at(i, False), lambda s: s > F.array_max(at(i, True))))
    named = F.coalesce(*[F.when(F.col("model") == m, F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(f).alias("fold")) for a, f in told])) for m, told in arms.items()])
    rows = lists.select("model", "query_id", "all", F.posexplode(named).alias("i", "a"))
    return rows.select("model", "a.arm", "a.fold", "query_id", (1.0 / (1 + above(F.col("i")))).alias("rr"))


def uncovered(rr: DataFrame) -> DataFrame:
    """model, arm, fold, n: arms that cover other records than their model's untrained arm: records that only one of the two has."""
    base = rr.filter(F.col("arm") == UNTRAINED).select("model", "query_id")
    arms = rr.filter(F.col("arm") != UNTRAINED).select("model", "arm", "fold").distinct()
    wanted = base.join(arms, "model").withColumn("want_", F.lit(True))
    both = wanted.join(rr.filter(F.col("arm") != UNTRAINED).withColumn("have_", F.lit(True)), ["model", "arm", "fold", "query_id"], "full")
    return both.filter("want_ IS NULL OR have_ IS NULL").groupBy("model", "arm", "fold").agg(F.count(F.lit(1)).alias("n"))


def deltas(rr: DataFrame) -> DataFrame:
    """model, query_id, base, and for each arm and fold the change of rr against the untrained arm, in columns ARM_FOLD."""
    side = lambda arm, fold: F.max(F.when((F.col("arm") == arm) & (F.col("fold") == fold), F.col("rr")))
    wide = rr.groupBy("model", "query_id").agg(F.max(F.when(F.col("arm") == UNTRAINED, F.col("rr"))).alias("base"), *[side(a, f).alias(f"{a}_{f}") for f in FORMATS for a in ARMS])
    return wide.select("model", "query_id", "base", *[(F.col(f"{a}_{f}") - F.col("base")).alias(f"{a}_{f}") for f in FORMATS for a in ARMS])


def paired_gains(rr: DataFrame) -> DataFrame:
    """model, query_id, fold, gain: the winner's rr less the control's."""
    d = deltas(rr)
    return d.select("model", "query_id", F.explode(F.array(*[F.struct(F.lit(f).alias("fold"), (F.col(f"winner_{f}") - F.col(f"control_{f}")).alias("gain")) for f in FORMATS])).alias("g")).select("model", "query_id", "g.fold", "g.gain")


def fold_frame(rr: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """model, fold, and for control and winner mrr, delta, lo, hi, kept (the interval stays above the margin), and winner_gain. All folds and arms of a
    model go through one resampling, so their intervals are paired."""
    columns = [f"{a}_{f}" for f in FORMATS for a in ARMS]
    v = kept(dense_index(kept(deltas(rr), "prose-deltas"), "query_id", groups=("model",)), "prose-deltas")
    ends = resample.interval(resample.replicate_means(v, columns, n_boot, seed, ("model",)).unpivot(["model", "b"], columns, "what", "x"), "x", keys=("model", "what"))
    means = v.groupBy("model").agg(F.avg("base").alias("base"), *[F.avg(c).alias(c) for c in columns]).unpivot(["model", "base"], columns, "what", "delta")
    told = means.join(ends.select("model", "what", "lo", "hi"), ["model", "what"]).select("model", F.substring_index("what", "_", 1).alias("arm"), F.regexp_replace("what", "^[a-z]+_", "").alias("fold"), "base", "delta", "lo", "hi")
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, c))
    out = told.groupBy("model", "fold").agg(*[
        of(a, c).alias(f"{a}_{name}") for a in ARMS for name, c in (("mrr", F.col("base") + F.col("delta")), ("delta", F.col("delta")), ("lo", F.col("lo")), ("hi", F.col("hi")), ("kept", F.col("lo") > resample.NI_MARGIN))
    ])
    return out.withColumn("winner_gain", F.col("winner_delta") - F.col("control_delta"))


def paired_delta(rr: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """model, gain, lo, hi: the winner's gain over the control, averaged over the folds record by record."""
    per_record = paired_gains(rr).groupBy("model", "query_id").agg(F.avg("gain").alias("gain"))
    v = kept(dense_index(kept(per_record, "prose-gains"), "query_id", groups=("model",)), "prose-gains")
    ends = resample.interval(resample.replicate_means(v, ["gain"], n_boot, seed, ("model",)), "gain", keys=("model",)).select("model", "lo", "hi")
    return v.groupBy("model").agg(F.avg("gain").alias("gain")).join(ends, "model")


def table(rr: DataFrame, n_boot: int, seed: int = 0) -> DataFrame:
    """A row a model: baseline mrr, the folds' means of each arm's mrr and delta, the winner's gain with its interval, whether that excludes 0, and how many of
    the arms kept their quality."""
    folds = fold_frame(rr, n_boot, seed)
    base = rr.filter(F.col("arm") == UNTRAINED).groupBy("model").agg(F.avg("rr").alias("baseline_mrr"))
    means = folds.groupBy("model").agg(*[F.avg(f"{a}_{c}").alias(f"{a}_{c}") for c in ("mrr", "delta") for a in ARMS], F.sum(F.col("control_kept").cast("int") + F.col("winner_kept").cast("int")).alias("arms_kept"))
    gain = paired_delta(rr, n_boot, seed).select("model", F.col("gain").alias("winner_gain"), F.col("lo").alias("gain_lo"), F.col("hi").alias("gain_hi"))
    return base.join(means, "model").join(gain, "model").withColumn("gain_excludes_zero", (F.col("gain_hi") < 0) | (F.col("gain_lo") > 0))


def matrix(rr: DataFrame, arm: str) -> DataFrame:
    """A row a model, a column a fold: the arm's mean change against the untrained arm."""
    if arm not in ARMS:
        raise ValueError(f"unknown arm {arm}; expected one of {', '.join(ARMS)}")
    return deltas(rr).groupBy("model").agg(*[F.avg(f"{arm}_{f}").alias(f) for f in FORMATS])
