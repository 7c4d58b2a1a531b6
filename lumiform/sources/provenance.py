"""What a build leaves behind, as tables that Spark's writer only ever appends to: the files of its stages, and its runs.

`outputs` has a row for every file of a stage (OUTPUTS); a stage that is made again adds the files of its new run, and `current`
keeps those of each stage's last run. `runs` has a row for every stage that a run made or failed at (RUNS).
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUTPUTS = "run string, stage string, file string, bytes long, sha256 string"
RUNS = "run string, stage string, source string, engine string, began double, seconds double, failed boolean"


@dataclass(frozen=True)
class Config:
    """Parameters of a corpus build; shares must leave room for a test split."""

    body_chars: int = 3000
    min_body_chars: int = 100
    min_pairs: int = 3
    min_infobox_chars: int = 200
    train: float = 0.8
    dev: float = 0.1
    split_seed: int = 13
    negatives: int = 25
    negatives_seed: int = 5

    def __post_init__(self) -> None:
        if not (0 < self.train < 1 and 0 <= self.dev < 1 and self.train + self.dev < 1):
            raise ValueError("train and dev must be shares that leave something for test")


def engine() -> str:
    """The engine's version, where it is installed as a package."""
    try:
        return metadata.version("lumiform")
    except metadata.PackageNotFoundError:
        return "source"


def new_run() -> str:
    """A name for a run; later runs sort behind earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def files_below(spark: SparkSession, folder: str) -> DataFrame:
    """file (its path below folder, partitions included), bytes and sha256 of a table's data files, hashed where they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    name = F.regexp_extract("path", "/([^/]+(?:/[^/=]+=[^/]*)*/[^/]+)$", 1)
    return found.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append(rows: DataFrame, folder: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(folder)


def stage_outputs(spark: SparkSession, folder: str, stage: str, run: str) -> DataFrame:
    return files_below(spark, folder).select(F.lit(run).alias("run"), F.lit(stage).alias("stage"), "file", "bytes", "sha256")


def current(outputs: DataFrame) -> DataFrame:
    """The files of each stage's last run."""
    last = F.max("run").over(Window.partitionBy("stage"))
    return outputs.withColumn("last", last).filter("run = last").drop("last")


def changes(outputs: DataFrame, found: DataFrame) -> DataFrame:
    """stage, file and what is wrong with it (missing, changed), from the recorded files and those that are there (stage, and files_below of each stage): files
    of one name in two stages are two."""
    there = found.select("stage", "file", F.col("sha256").alias("now"))
    wrong = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return current(outputs).join(there, ["stage", "file"], "left").select("stage", "file", wrong.alias("wrong")).filter("wrong IS NOT NULL")


def run_row(spark: SparkSession, run: str, stage: str, source: str, began: float, failed: bool) -> DataFrame:
    return spark.createDataFrame([(run, stage, source, engine(), began, round(time.time() - began, 3), failed)], RUNS)


def append_events(events: DataFrame, folder: str) -> None:
    """Events as JSON lines, null values left out; `readers.read_log` reads such lines back."""
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(folder)
