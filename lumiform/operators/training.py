"""Ways of handling the formats compared: standardising the corpus to one format against leaving it mixed, by how the model was trained.

An outcome is a row (model, condition, policy, seed, query_id, format, value): whether gold leads (or how likely) when a condition meets a
policy. Under `standardised` the format is that of the whole corpus, and a specialist is the arm trained on that format alone;
`mixed` doesn't depend on the format, so its value stands under each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiform.functions.render import FORMATS
from lumiform.operators import study

UNTRAINED, CONTROL, WINNER, SPECIALIST = "untrained", "control", "winner", "specialist"
STANDARDISED, MIXED = "standardised", "mixed"
SIDE = ("model", "condition", "policy")


def specialist_arm(fmt: Column | str) -> Column:
    """The name of the arm that was trained on one format."""
    return F.concat(F.lit("only_"), F.col(fmt) if isinstance(fmt, str) else fmt)


def outcomes(led: DataFrame, mixed: DataFrame) -> DataFrame:
    """Outcomes of leads (model, arm, seed, query_id, format, lead) and exact mixed leads (model, arm, seed, query_id, p). Of a specialist's leads only
    those under its own format are read; other arms are conditions of their own name."""
    special = F.col("arm").startswith("only_")
    condition = F.when(special, F.lit(SPECIALIST)).otherwise(F.col("arm"))
    standard = led.filter(~special | (F.col("arm") == specialist_arm("format"))).select("model", condition.alias("condition"), F.lit(STANDARDISED).alias("policy"), "seed", "query_id", "format", F.col("lead").cast("double").alias("value"))
    spread = mixed.filter(~special).select("model", F.col("arm").alias("condition"), F.lit(MIXED).alias("policy"), "seed", "query_id", F.explode(F.array(*map(F.lit, FORMATS))).alias("format"), F.col("p").alias("value"))
    return standard.unionByName(spread)


def side_is(side: tuple[str, str]) -> Column:
    return (F.col("condition") == side[0]) & (F.col("policy") == side[1])


def differences(o: DataFrame, treatment: tuple[str, str], reference: tuple[str, str], by: tuple[str, ...] = ("format",)) -> DataFrame:
    """model, by, query_id, diff: treatment less reference, each averaged over training seeds first (and over the formats, where they aren't in `by`).
    Queries that lack a side are left out."""
    mean = lambda side: F.avg(F.when(side_is(side), F.col("value")))
    both = o.filter(side_is(treatment) | side_is(reference)).groupBy("model", *by, "query_id").agg(mean(treatment).alias("t_"), mean(reference).alias("r_"))
    return both.select("model", *by, "query_id", (F.col("t_") - F.col("r_")).alias("diff")).filter("diff IS NOT NULL")


def comparison_points(o: DataFrame) -> DataFrame:
    """A row for each model and format: the share of queries that gold leads, standardised untrained and with the specialist, and mixed under each trained arm."""
    mean = lambda condition, policy: F.avg(F.when(side_is((condition, policy)), F.col("value")))
    return o.groupBy("model", "format").agg(
        mean(UNTRAINED, STANDARDISED).alias("standardised_untrained"), mean(SPECIALIST, STANDARDISED).alias("standardised_specialist"),
        mean(CONTROL, MIXED).alias("mixed_control"), mean(WINNER, MIXED).alias("mixed_winner"),
    )


def training_levels(o: DataFrame) -> DataFrame:
    """A row a model: the points of `comparison_points`, averaged over the formats."""
    points = comparison_points(o)
    named = {"untrained": "standardised_untrained", "specialist": "standardised_specialist", "control": "mixed_control", "winner": "mixed_winner"}
    return points.groupBy("model").agg(*[F.avg(c).alias(name) for name, c in named.items()])


def needs_format(treatment: tuple[str, str], reference: tuple[str, str]) -> None:
    if STANDARDISED not in (treatment[1], reference[1]):
        raise ValueError("one side must be standardised for the format to matter")
    if (SPECIALIST, MIXED) in (treatment, reference):
        raise ValueError("a specialist has no mixed corpus")


def format_contrasts(o: DataFrame, treatment: tuple[str, str], reference: tuple[str, str], n_boot: int, n_permutations: int, seed: int = 0) -> DataFrame:
    """model, format and `study.paired` of the contrast, format by format, with Holm over the formats of a model."""
    needs_format(treatment, reference)
    return study.paired(differences(o, treatment, reference), n_boot, n_permutations, seed, ("model", "format"), ("model",))


def seed_changes(o: DataFrame, treatment: tuple[str, str], reference: tuple[str, str]) -> DataFrame:
    """model, format, seed, change of the mean outcome under each training seed on its own; an arm that was never trained has the same under every seed."""
    needs_format(treatment, reference)
    seeds = o.filter(F.col("condition") != UNTRAINED).select("model", "seed").distinct()
    trained = o.filter(side_is(treatment) | side_is(reference))
    untrained = trained.filter(F.col("condition") == UNTRAINED).drop("seed").join(F.broadcast(seeds), "model")  # a row for each seed
    every = trained.filter(F.col("condition") != UNTRAINED).unionByName(untrained)
    mean = lambda side: F.avg(F.when(side_is(side), F.col("value")))
    return every.groupBy("model", "format", "seed").agg((mean(treatment) - mean(reference)).alias("change"))


def seed_agreement(changes: DataFrame) -> DataFrame:
    """model, format, same_sign (seeds that share the sign of the mean change), seed_lo, seed_hi."""
    sign = lambda x: F.sign(F.round(x, 9))
    m = changes.groupBy("model", "format").agg(F.avg("change").alias("mean"), F.array_agg("change").alias("all"), F.min("change").alias("seed_lo"), F.max("change").alias("seed_hi"))
    return m.select("model", "format", F.size(F.filter("all", lambda x: sign(x) == sign(F.col("mean")))).alias("same_sign"), "seed_lo", "seed_hi")


def training_gaps(o: DataFrame, reference: str, n_boot: int, n_permutations: int, seed: int = 0) -> DataFrame:
    """model, format: standardising with the specialist against a trained arm on the mixed corpus: the seed-averaged change, its interval, the p corrected for
    the formats, whether it is resolved, and how the seeds agree."""
    sides = (SPECIALIST, STANDARDISED), (reference, MIXED)
    tested = format_contrasts(o, *sides, n_boot, n_permutations, seed).select("model", "format", "diff", "ci_lo", "ci_hi", "holm_p", "resolved")
    return tested.join(seed_agreement(seed_changes(o, *sides)), ["model", "format"])


def training_level_contrasts(o: DataFrame, n_boot: int, n_permutations: int, seed: int = 0) -> DataFrame:
    """model, condition and `study.paired` against the control on the mixed corpus: the specialist's standardised outcome, averaged over the formats, and
    the winner's mixed one. Holm by condition, over the models. All contrasts go through one resampling."""
    reference = (CONTROL, MIXED)
    named = [differences(o, side, reference, ()).select("model", F.lit(side[0]).alias("condition"), "query_id", "diff") for side in ((SPECIALIST, STANDARDISED), (WINNER, MIXED))]
    return study.paired(named[0].unionByName(named[1]), n_boot, n_permutations, seed, ("model", "condition"), ("condition",))


def training_summary(o: DataFrame, n_boot: int, n_permutations: int, seed: int = 0) -> DataFrame:
    """A row a model: the levels, and against each trained arm on the mixed corpus the mean change over the formats, the formats where it is resolved, and
    the seeds whose mean change has the sign of the whole."""
    out = training_levels(o)
    sign = lambda x: F.sign(F.round(x, 9))
    for reference in (CONTROL, WINNER):
        gaps = training_gaps(o, reference, n_boot, n_permutations, seed).groupBy("model").agg(F.avg("diff").alias(f"diff_vs_{reference}"), F.count_if("resolved").alias(f"resolved_vs_{reference}"))
        per_seed = seed_changes(o, (SPECIALIST, STANDARDISED), (reference, MIXED)).groupBy("model", "seed").agg(F.avg("change").alias("c"))
        agree = per_seed.groupBy("model").agg(F.array_agg("c").alias("all"), F.avg("c").alias("mean")).select("model", F.size(F.filter("all", lambda x: sign(x) == sign(F.col("mean")))).alias(f"seeds_vs_{reference}"))
        out = out.join(gaps, "model").join(agree, "model")
    return out
