"""Scoring that can be stopped and goes on: what is committed stays and isn't scored again.

Scores are a table partitioned by model and format. A unit (a model and a format) is one job, whose files appear together when
Spark commits it; a killed job leaves nothing that readers see. A later run leaves out, by an anti-join, the rows whose scores are
there, so it may be started with more records or more units too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.sources.scratch import kept, spread

SCHEMA = "id long, score double, model string, format string"


def committed(spark: SparkSession, folder: str) -> DataFrame:
    """The scores that are there: id, score, model, format. None yet: no rows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("basePath", folder).parquet(folder)


def open_units(pairs: DataFrame, folder: str, models: list[str]) -> DataFrame:
    """model, format, n: how many scores each unit still lacks; units that lack none have no row."""
    wanted = pairs.select("id", "format", F.explode(F.array(*map(F.lit, models))).alias("model"))
    return wanted.join(committed(pairs.sparkSession, folder), ["id", "format", "model"], "left_anti").groupBy("model", "format").agg(F.count(F.lit(1)).alias("n"))


def save_partial(pairs: DataFrame, folder: str, models: list[str], score: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Score what isn't scored yet, unit by unit, and return the report of all that is there. pairs: id, format, question, passage; score gives (pairs, model)
    a column score. Units are few (models times formats); each is committed as a whole. A repeated id of a format is scored once."""
    spark = pairs.sparkSession
    pairs = kept(spread(pairs, "id", "format").dropDuplicates(["id", "format"]), "pairs", ("format",))  # made once, and a unit reads its format's files
    for model, fmt in sorted((r["model"], r["format"]) for r in open_units(pairs, folder, models).collect()):
        there = committed(spark, folder).filter((F.col("model") == model) & (F.col("format") == fmt)).select("id")
        todo = pairs.filter(F.col("format") == fmt)
        todo = todo if there.isEmpty() else todo.join(there, "id", "left_anti")
        unit = score(todo, model).select("id", "score", F.lit(model).alias("model"), F.lit(fmt).alias("format"))
        unit.write.mode("append").partitionBy("model", "format").parquet(folder)
    return report_written(spark, folder)


def report_written(spark: SparkSession, folder: str) -> DataFrame:
    """model, format, n, files: what of each unit is there."""
    rows = committed(spark, folder).withColumn("file", F.input_file_name())
    return rows.groupBy("model", "format").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
