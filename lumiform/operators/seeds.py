"""What a statistic does over training seeds: its level under each, and a model against its variant, seed by seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiform.operators import answer, effect

KEYS = ("model", "arm", "seed")
STATISTICS = ("score", "answer", "mrr")


def levels_of(tensor: DataFrame) -> DataFrame:
    """model, arm, seed, score (largest effect), answer (inconsistent share of the answerable, per cent), mrr (mean over formats) of a tensor."""
    gold = tensor.filter("cand = 0")
    d = effect.max_abs_d(effect.pairwise_d(gold, [*KEYS, "query_id"], KEYS), KEYS).select(*KEYS, F.col("max_abs_d").alias("score"))
    led = answer.leads(tensor, KEYS)
    stable = answer.top1_stability(led, KEYS).select(*KEYS, F.col("inconsistent_pct").alias("answer"))
    mrr = answer.mrr(led, KEYS).groupBy(*KEYS).agg(F.avg("mrr").alias("mrr"))
    return d.join(stable, list(KEYS)).join(mrr, list(KEYS))


def seed_levels(levels: DataFrame, control: str, chosen: str) -> DataFrame:
    """A row for each model and seed: each statistic of the control and the chosen arm, and for score and answer the change and its share of the control in per
    cent (null where that is 0)."""
    side = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    out = levels.filter(F.col("arm").isin(control, chosen)).groupBy("model", "seed").agg(*[side(a, c).alias(f"{c}_{name}") for c in STATISTICS for a, name in ((control, "control"), (chosen, "chosen"))])
    for c in ("score", "answer"):
        change = F.col(f"{c}_chosen") - F.col(f"{c}_control")
        out = out.withColumns({f"{c}_delta": change, f"{c}_pct": F.try_divide(100 * change, F.col(f"{c}_control"))})
    return out


def seed_pairs(levels: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """base, seed, base_value, variant_value, difference of one column of `seed_levels`. pairs: base, variant."""
    one = lambda name: levels.select(F.col("model").alias(name), "seed", F.col(column).alias(f"{name}_value"))
    met = F.broadcast(pairs).join(one("base"), "base").join(one("variant"), ["variant", "seed"])
    return met.select("base", "seed", "base_value", "variant_value", (F.col("variant_value") - F.col("base_value")).alias("difference"))


def sign_p(lower: Column, untied: Column) -> Column:
    """Two-sided exact binomial p of `lower` out of `untied` fair draws, of which there are 20 at most; null without any."""
    few = F.least(lower, untied - lower)
    ways = F.aggregate(F.sequence(F.lit(0), few.cast("int")), F.lit(0.0), lambda acc, k: acc + F.factorial(untied.cast("int")) / (F.factorial(k) * F.factorial((untied - k).cast("int"))))
    return F.when(untied > 0, F.least(F.lit(1.0), 2 * ways / F.pow(F.lit(2.0), untied)))


def paired_table(told: DataFrame) -> DataFrame:
    """A row a base model from `seed_pairs`: mean and deviation of both, the seeds where the variant is lower, the untied ones, and the sign test's p."""
    out = told.groupBy("base").agg(
        *[f(f"{side}_value").alias(f"{side}_{name}") for side in ("base", "variant") for name, f in (("mean", F.avg), ("sd", F.stddev_samp))],
        F.count_if(F.col("difference") < 0).alias("variant_lower"), F.count_if(F.col("difference") != 0).alias("untied"),
    )
    return out.withColumn("sign_p", sign_p(F.col("variant_lower"), F.col("untied")))


def seed_matrix(levels: DataFrame, column: str, seeds: list[int]) -> DataFrame:
    """A row a model, a column a seed: one column of `seed_levels`."""
    return levels.groupBy("model").agg(*[F.max(F.when(F.col("seed") == s, F.col(column))).alias(f"seed_{s}") for s in seeds])
