"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session, whose one process is driver and executor, may leave it unset and gets one of its own; a
    cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = shared_folder.own = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="lumiform-")
    return found


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to tasks of a number of its own: where a row is few bytes but much work, tasks must not go by the bytes of files or shuffles. What is
    then grouped by these keys and others moves no more."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def kept(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a written table (partitioned by some columns, if any), so that its lineage ends there and what reads it twice doesn't make it twice. It goes when the driver
    ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumiform/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)

    def delete() -> None:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended
            pass

    atexit.register(delete)
    return spark.read.schema(df.schema).parquet(path)
