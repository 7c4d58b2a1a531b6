"""The result documents of a study, one JSON file a model and arm, as long tables.

A schema says what is read of a document; fields beyond it are left out, missing ones are null. Arrays that stand beside their ids
become rows; where two don't have one length, the load raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.operators import resample
from lumiform.operators.effect import format_pairs, max_abs_d, pairwise_d
from lumiform.sources.readers import read_results

WHO = "model string, arm string, fold string, seed int"
SCORES = f"{WHO}, record_ids array<string>, scores_per_fmt map<string, array<double>>"
RANKS = f"{WHO}, query_ids array<string>, reciprocal_ranks map<string, array<double>>"
COMPARISON = f"{WHO}, record_ids array<string>, per_record_delta_rr array<double>, trained_mrr double, delta_mrr_mean double, delta_mrr_ci array<double>, ni_pass boolean"
PROSE = f"{WHO}, mrr double, record_ids array<string>, reciprocal_rank array<double>"
SELECTION = "model string, winner_lambda double, tie_broken boolean, tied_lambdas array<double>, candidates array<struct<lambda: double, dev_max_abs_d: double, dev_max_abs_d_ci_lo: double, dev_max_abs_d_ci_hi: double, mrr_ni_pass: boolean>>"
OVERFLOW = "split string, cross map<string, array<string>>, within map<string, array<string>>"


def beside(ids: Column, values: Column) -> Column:
    """Structs of ids and their values; raises where one has more than the other."""
    wrong = F.raise_error(F.concat(F.lit("a result has "), F.size(ids).cast("string"), F.lit(" ids and "), F.size(values).cast("string"), F.lit(" values")))
    return F.when(F.size(ids) == F.size(values), F.arrays_zip(ids.alias("id"), values.alias("value"))).otherwise(wrong.cast("array<struct<id:string,value:double>>"))


def by_format(documents: DataFrame, ids: str, values: str, name: str, value: str) -> DataFrame:
    """model, arm, fold, seed, name, format, value of documents with an array of values for each format beside their ids."""
    who = ["model", "arm", "fold", "seed"]
    one = documents.select(*who, F.col(ids).alias("ids_"), F.explode(values).alias("format", "values_"))
    return one.select(*who, "format", F.explode(beside(F.col("ids_"), F.col("values_"))).alias("x")).select(*who, F.col("x.id").alias(name), "format", F.col("x.value").alias(value))


def load_scores(spark: SparkSession, pattern: str) -> DataFrame:
    """model, arm, fold, seed, record_id, format, score of score documents."""
    return by_format(read_results(spark, pattern, SCORES), "record_ids", "scores_per_fmt", "record_id", "score")


def load_ranks(spark: SparkSession, pattern: str) -> DataFrame:
    """model, arm, fold, seed, query_id, format, rr of within-query documents."""
    return by_format(read_results(spark, pattern, RANKS), "query_ids", "reciprocal_ranks", "query_id", "rr")


def load_comparisons(spark: SparkSession, pattern: str) -> DataFrame:
    """A row a comparison: who, trained_mrr, delta, lo, hi, kept."""
    c = read_results(spark, pattern, COMPARISON)
    return c.select("model", "arm", "fold", "seed", "trained_mrr", F.col("delta_mrr_mean").alias("delta"), F.try_element_at("delta_mrr_ci", F.lit(1)).alias("lo"), F.try_element_at("delta_mrr_ci", F.lit(2)).alias("hi"), F.col("ni_pass").alias("kept"))


def load_gains(spark: SparkSession, pattern: str) -> DataFrame:
    """model, arm, fold, seed, record_id, delta of comparison documents: each record's change against the untrained model."""
    c = read_results(spark, pattern, COMPARISON)
    return c.select("model", "arm", "fold", "seed", F.explode(beside(F.col("record_ids"), F.col("per_record_delta_rr"))).alias("x")).select("model", "arm", "fold", "seed", F.col("x.id").alias("record_id"), F.col("x.value").alias("delta"))


def load_selections(spark: SparkSession, pattern: str) -> DataFrame:
    """model, weight, max_abs_d, ci_lo, ci_hi, passed, tied, winner, tie_broken: a row a candidate."""
    s = read_results(spark, pattern, SELECTION)
    c = s.select("model", "winner_lambda", F.coalesce("tie_broken", F.lit(False)).alias("tie_broken"), F.coalesce("tied_lambdas", F.array().cast("array<double>")).alias("tied_"), F.explode("candidates").alias("c"))
    return c.select(
        "model", F.col("c.lambda").alias("weight"), F.col("c.dev_max_abs_d").alias("max_abs_d"), F.col("c.dev_max_abs_d_ci_lo").alias("ci_lo"), F.col("c.dev_max_abs_d_ci_hi").alias("ci_hi"),
        F.col("c.mrr_ni_pass").alias("passed"), F.array_contains("tied_", F.col("c.lambda")).alias("tied"), (F.col("c.lambda") == F.col("winner_lambda")).alias("winner"), "tie_broken",
    )


def winner_weights(selections: DataFrame) -> DataFrame:
    """model, weight that each model's selection chose."""
    return selections.filter("winner").select("model", "weight").distinct()


def load_overflow(spark: SparkSession, pattern: str) -> DataFrame:
    """split, axis (cross, within), model, id: what overflowed a model's context."""
    o = read_results(spark, pattern, OVERFLOW)
    axis = F.explode(F.array(F.struct(F.lit("cross").alias("axis"), F.col("cross").alias("by")), F.struct(F.lit("within").alias("axis"), F.col("within").alias("by")))).alias("a")
    return o.select("split", axis).select("split", "a.axis", F.explode("a.by").alias("model", "ids")).select("split", "axis", "model", F.explode("ids").alias("id"))


def complete_arms(documents: DataFrame, arms: list[str]) -> DataFrame:
    """model, seed of which every arm has a document. documents: model, arm, seed."""
    return documents.filter(F.col("arm").isin(arms)).groupBy("model", "seed").agg(F.count_distinct("arm").alias("n_")).filter(F.col("n_") == len(arms)).select("model", "seed")


# -- folds


def with_positions(scores: DataFrame, formats: list[str]) -> DataFrame:
    """scores with fpos, the place of each format in the roster; other formats are left out."""
    place = F.array_position(F.array(*map(F.lit, formats)), F.col("format"))
    return scores.filter(place > 0).withColumn("fpos", (place - 1).cast("int"))


def fold_effects(scores: DataFrame, keys: tuple[str, ...] = ("model", "arm", "seed", "fold")) -> DataFrame:
    """keys, pair, left, right, d, ood (the pair has the format that the fold held out). scores: keys, record_id, format, fpos, score."""
    e = pairwise_d(scores, [*keys, "record_id"], keys)
    return e.withColumn("ood", (F.col("left") == F.col("fold")) | (F.col("right") == F.col("fold")))


def mean_max_d(scores: DataFrame, ood: bool, keys: tuple[str, ...] = ("model", "arm", "seed")) -> DataFrame:
    """keys, mean_max_d: the largest effect over one side of each fold's pairs, averaged over the folds."""
    folds = max_abs_d(fold_effects(scores, (*keys, "fold")).filter(F.col("ood") == ood), (*keys, "fold"))
    return folds.groupBy(*keys).agg(F.avg("max_abs_d").alias("mean_max_d"))


def mean_max_d_replicates(scores: DataFrame, ood: bool, n_boot: int, seed: int = 0, keys: tuple[str, ...] = ("model", "arm", "seed")) -> DataFrame:
    """keys, b, mean_max_d of bootstrap replicates; one resample of the records serves all folds. scores: keys, fold, record_id, idx, format, fpos, score."""
    on = (*keys, "fold")
    pairs = format_pairs(scores, [*on, "idx"]).filter(((F.col("left") == F.col("fold")) | (F.col("right") == F.col("fold"))) == ood)
    drawn = resample.replicate_d(pairs.select(*on, "idx", "pair", (F.col("a") - F.col("b")).alias("diff")), n_boot, seed, on)
    return drawn.groupBy(*keys, "b").agg(F.avg("d").alias("mean_max_d"))
