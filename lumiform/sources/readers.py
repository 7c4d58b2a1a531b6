"""Readers and sinks: tables by schema, split tables, JSON-lines logs, progress files, manifests with digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOG_SCHEMA = "event string, step bigint, loss double, lr double, value double, message string, bad string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines: a file or folder, split among tasks. The schema is given, so nothing is read twice; a malformed line stops the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines; null fields are written, so that columns come back as they were."""
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_results(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """One row a JSON document (results, selections, comparisons), over any number of files of one form, with its path in `file`."""
    return spark.read.schema(schema).json(pattern, multiLine=True, mode="FAILFAST").withColumn("file", F.input_file_name())


def split(rows: DataFrame, name: str) -> DataFrame:
    """One split, or all: train, dev and test, never others. With tables partitioned by split this prunes partitions."""
    return rows.filter(F.col("split").isin("train", "dev", "test")) if name == "all" else rows.filter(F.col("split") == name)


def write_splits(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def read_log(lines: DataFrame) -> DataFrame:
    """Events of a JSON-lines log (line_no, value), up to the first malformed line."""
    parsed = lines.withColumn("r", F.from_json("value", LOG_SCHEMA, {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}))
    bad = F.col("r.bad").isNotNull() | F.col("r").isNull()
    first = parsed.filter(bad).agg(F.min("line_no").alias("first"))
    kept = parsed.join(F.broadcast(first)).filter(F.col("first").isNull() | (F.col("line_no") < F.col("first")))
    return kept.select("line_no", "r.event", "r.step", "r.loss", "r.value")


def last_step(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("step"), F.lit(0)).alias("step"))


def rewind(log: DataFrame, step: int) -> DataFrame:
    """The log without records past a step."""
    return log.filter(F.coalesce("step", F.lit(0)) <= step)


def by_priority(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """One row a key: the one with the largest priority, as when later sources overwrite earlier ones."""
    w = Window.partitionBy(key).orderBy(F.desc(priority))
    return rows.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, bytes and a digest of a table's content that doesn't depend on row order: the sum of row hashes, as hex."""
    line = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    h = F.conv(F.substring(F.sha2(line, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.octet_length(line)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def files(spark: SparkSession, pattern: str) -> DataFrame:
    """path, bytes, sha256 of files: what a manifest tells about outputs."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def upsert_stage(manifest: DataFrame, stage: DataFrame) -> DataFrame:
    """manifest (ordinal, name, records, digest) with the stages of `stage` (name, records, digest): a known name keeps its place, a new one goes last."""
    last = manifest.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("last"))
    old = manifest.join(stage.select("name", F.col("records").alias("r_"), F.col("digest").alias("d_"), F.lit(True).alias("new_")), "name", "left")
    kept = old.select("ordinal", "name", F.when(F.col("new_"), F.col("r_")).otherwise(F.col("records")).alias("records"), F.when(F.col("new_"), F.col("d_")).otherwise(F.col("digest")).alias("digest"))
    fresh = stage.join(manifest, "name", "left_anti").join(F.broadcast(last)).select((F.col("last") + F.row_number().over(Window.orderBy("name"))).cast("int").alias("ordinal"), "name", "records", "digest")
    return kept.unionByName(fresh)
