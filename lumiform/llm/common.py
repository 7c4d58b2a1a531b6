"""What the operators share: tables, shared storage, caches of Python workers, skew-safe identities."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose one process is driver and executor,
    may leave it unset and gets a folder of its own; a cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="lumiform-")
        shared_dir.own = found
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        where = hadoop.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df cut from its lineage: a Parquet table in the shared folder, deleted when the driver ends or by `dropped`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumiform/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumiform_path = path
    return out


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, rather than when the driver next happens to collect garbage."""
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """df as a written table bucketed by keys, so that joins on them don't shuffle it again. Its entry in the catalogue and its folder go when the driver ends."""
    spark = df.sparkSession
    name = f"lumiform_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/lumiform/{name}"
    df.write.option("compression", "zstd").bucketBy(partitions(spark), *keys).option("path", path).saveAsTable(name)

    def drop() -> None:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session may have ended
            pass
        _delete(spark, path)

    atexit.register(drop)
    return spark.table(name)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing lazy reads any more."""
    for t in tables:
        if path := getattr(t, "_lumiform_path", None):
            _delete(t.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, so what is costly to load is loaded once."""
    return sys.modules.setdefault("_lumiform_worker", types.ModuleType("_lumiform_worker")).__dict__


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about `limit` bytes in `column`, so that memory doesn't follow Arrow's batch size."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.get_field_index(column))
        ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64) if values.buffers()[1] else np.zeros(len(values) + 1, np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, min(to, batch.num_rows) - at)
            at = to


#: A key that holds more than one in so many rows is dealt to several tasks; there are at most so many such keys.
SHARES = 1000
#: A task gets at least about so many rows of a hot key.
LEAST_ROWS = 32


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], by: list[str], counts: DataFrame) -> DataFrame:
    """rows joined with keyed on keys. counts: keys and n_, about how many rows the join makes of them; it is read
    twice. A hot key's rows go to as many tasks as it holds thousandths of all that (or of LEAST_ROWS rows), dealt by a hash of the columns `by`, and its rows of keyed
    are copied to each. Hot keys are fewer than SHARES by their definition, so they may be broadcast."""
    total = counts.agg(F.sum("n_")).first()[0] or 0
    part = max(total / SHARES, LEAST_ROWS)
    parts = F.ceil(F.col("n_") / F.lit(part)).cast("int")
    hot = F.broadcast(counts.filter(F.col("n_") > F.lit(part)).select(*keys, parts.alias("parts_")))
    dealt = rows.join(hot, keys, "left").withColumn("salt_", F.pmod(F.xxhash64(*by), F.coalesce("parts_", F.lit(1))).cast("int")).drop("parts_")
    copied = keyed.join(hot, keys, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1))).drop("parts_")
    return dealt.join(copied, [*keys, "salt_"]).drop("salt_")


def free_name(columns: list[str], name: str) -> str:
    """`name`, or the first of name_2, name_3, ... that columns lack."""
    taken = {c.lower() for c in columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(2, len(taken) + 3))) if x.lower() not in taken)


def whole_rows(df: DataFrame, name: str = "row") -> Column:
    """A struct of all columns of df, so that columns made beside it can't clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(name)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """An equi-join condition under which null keys meet each other."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out
