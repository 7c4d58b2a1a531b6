"""The corpus build as one DAG: records, gate, split, negatives, validation. Stages are DataFrames of one session; `run` writes what later stages read."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.operators import bm25, corpus
from lumiform.sources import provenance
from lumiform.sources.provenance import Config
from lumiform.sources.readers import table


def parsed(spark: SparkSession, source: str) -> DataFrame:
    r = corpus.records(table(spark, source, "documents"), table(spark, source, "labels"))
    return r.withColumn("quality_flags", corpus.quality_flags(F.col("pairs"), F.col("body"), F.col("short_answers")))


def split(records: DataFrame, config: Config) -> DataFrame:
    return records.join(corpus.article_split(records, config.split_seed, config.train, config.dev), "title")


def negatives(records: DataFrame, config: Config) -> DataFrame:
    """Negatives of every record's question among the records of the train split."""
    docs = records.filter("split = 'train'").select("id", "title", F.concat_ws(" ", "title", "body").alias("doc"))
    queries = records.select(F.col("id").alias("query_id"), F.col("question").alias("query"), "title")
    best = bm25.top(bm25.build(docs), queries, config.negatives * bm25.MULTIPLIER)
    return bm25.hard_negatives(best, docs, queries.select("query_id", "title"), config.negatives, seed=config.negatives_seed)


def problems(records: DataFrame, mined: DataFrame, config: Config) -> DataFrame:
    """check, what of everything that a valid build doesn't have."""
    flagged = records.filter(F.size("quality_flags") > 0).select(F.lit("flagged").alias("check"), F.col("id").cast("string").alias("what"))
    shared = corpus.shared_titles(records).select(F.lit("shared title").alias("check"), F.col("title").alias("what"))
    twice = corpus.repeated_ids(records).select(F.lit("repeated id").alias("check"), F.col("id").cast("string").alias("what"))
    bad = bm25.problems(mined, records.select(F.col("id").alias("query_id"), "title"), records.select("id", "title"), config.negatives)
    return flagged.unionByName(shared).unionByName(twice).unionByName(bad.select(F.col("problem").alias("check"), F.col("query_id").cast("string").alias("what")))


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether Spark's writer has committed a table to folder, on any file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(folder, "_SUCCESS")
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def run(spark: SparkSession, source: str, out: str, config: Config | None = None, force: bool = False) -> DataFrame:
    """Build below out; a stage whose table is complete is skipped unless forced. The files of new stages are appended to out/_outputs, what the run
    did to out/_runs. Returns the current outputs; a build with problems raises."""
    config, name = config or Config(), provenance.new_run()

    def stage(label: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        folder = f"{out}/{label}"
        if force or not complete(spark, folder):
            began, failed = time.time(), True
            try:
                writer = make().write.mode("overwrite")
                (writer.partitionBy(by) if by else writer).parquet(folder)
                provenance.append(provenance.stage_outputs(spark, folder, label, name), f"{out}/_outputs")
                failed = False
            finally:
                provenance.append(provenance.run_row(spark, name, label, source, began, failed), f"{out}/_runs")
        return spark.read.parquet(folder)

    records = stage("records", lambda: split(corpus.gated(parsed(spark, source)), config), "split")
    mined = stage("negatives", lambda: negatives(records, config))
    found = stage("problems", lambda: problems(records, mined, config))
    if not found.isEmpty():
        raise ValueError("the build has problems; see its table problems")
    return provenance.current(spark.read.schema(provenance.OUTPUTS).parquet(f"{out}/_outputs"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Build a corpus from tables.")
    p.add_argument("source")
    p.add_argument("out")
    p.add_argument("--negatives", type=int, default=Config.negatives)
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    from lumiform.session import session

    run(session("build"), a.source, a.out, Config(negatives=a.negatives), a.force)


if __name__ == "__main__":
    main()
