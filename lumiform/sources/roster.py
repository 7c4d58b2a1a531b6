"""Dimensions of an experiment as tables: formats, the scorers of a study, and what joins say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumiform.functions.render import FORMATS

#: A scorer: its place and name in the study, where it comes from, how tables show it, how its training batches are cut, and the scorer whose chosen
#: weight it shares, if any. The rows that a step trains on are batch * accumulate.
SCORERS = "place int, name string, source string, shown string, batch int, accumulate int, shares string"


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FORMATS)), "fpos int, format string")


def repeated(scorers: DataFrame) -> DataFrame:
    """Names that stand on several rows."""
    return scorers.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def resolved(asked: DataFrame, scorers: DataFrame, key: str = "asked") -> DataFrame:
    """asked with the scorer that each value of `key` means: the one of that name, else the first of that source; null columns where there is none."""
    terms = scorers.select("*", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("name").alias("term")), F.struct(F.lit(1).alias("rank"), F.col("source").alias("term")))).alias("t"))
    first = F.row_number().over(Window.partitionBy("t.term").orderBy("t.rank", "place"))
    one = terms.withColumn("n_", first).filter("n_ = 1").select(F.col("t.term").alias(key), *scorers.columns)
    return asked.join(F.broadcast(one), key, "left")


def shown(name: Column | str = "asked") -> Column:
    """The label of a resolved scorer, or the value itself where it means none."""
    return F.coalesce(F.col("shown"), F.col(name) if isinstance(name, str) else name)


def complete(results: DataFrame, expected: int, keys: list[str], part: str) -> DataFrame:
    """The keys of which all expected parts are there."""
    return results.groupBy(*keys).agg(F.count_distinct(part).alias("n_")).filter(F.col("n_") == expected).select(*keys)


def common_seeds(results: DataFrame, models: int) -> DataFrame:
    """Seeds that every model has, ascending."""
    return results.groupBy("seed").agg(F.count_distinct("model").alias("n_")).filter(F.col("n_") == models).select("seed").orderBy("seed")


def chosen_weight(selection: DataFrame, scorers: DataFrame) -> DataFrame:
    """name and the weight chosen for it, or for the scorer that it shares one with. selection: name, weight."""
    picked = selection.select(F.col("name").alias("from_"), F.col("weight").cast("double").alias("weight"))
    return scorers.select("name", F.coalesce("shares", "name").alias("from_")).join(picked, "from_").select("name", "weight")
