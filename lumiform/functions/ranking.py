"""Dense indices and ranks without a sort of all rows, or of all rows of a group, in one task.

Values are cut into ranges at approximate quantiles: a mergeable sketch of bounded size gives at most CUTS of them a group. Where the cuts fall only
decides which task sorts what; the results are exact, as the ranges' counts are, and equal values share a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CUTS = 200


def cuts_of(value: str) -> Column:
    return F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)]).alias("cuts_")


def range_of(value: str) -> Column:
    """How many cuts lie below a value; 0 for a null."""
    return F.coalesce(F.size(F.filter(F.array_distinct("cuts_"), lambda c: c < F.col(value))), F.lit(0)).alias("range_")


def counted_before(counts: DataFrame, groups: list[str]) -> DataFrame:
    """groups, range_, before_: rows (c_) of the ranges below; a group has at most CUTS ranges."""
    w = Window.partitionBy(*groups).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*groups, "range_", F.coalesce(F.sum("c_").over(w), F.lit(0)).alias("before_"))


def dense_index(df: DataFrame, key: str, name: str = "idx", groups: tuple[str, ...] = ()) -> DataFrame:
    """df with a gapless index from 0, within each group, in the order of a number that is unique there, however sparse: ranges are counted, and rows
    numbered inside theirs. Rows without the number are left out. Groups are few."""
    df = df.filter(F.col(key).isNotNull())
    on = list(groups)
    cuts = F.broadcast(df.groupBy(*groups).agg(cuts_of(key)))
    placed = (df.join(cuts, on) if groups else df.join(cuts)).withColumn("range_", range_of(key)).drop("cuts_")
    before = counted_before(placed.groupBy(*groups, "range_").agg(F.count(F.lit(1)).alias("c_")), on)
    inner = F.row_number().over(Window.partitionBy(*groups, "range_").orderBy(key)) - 1
    return placed.join(F.broadcast(before), [*groups, "range_"]).withColumn(name, F.col("before_") + inner).drop("range_", "before_")


#: Ranges of a hash that rows are shuffled in.
RANGES = 256


def shuffled_index(df: DataFrame, key: str, order: Column, name: str = "idx", groups: tuple[str, ...] = ()) -> DataFrame:
    """df with a gapless index from 0, within each group, in the order of `order` (a number from 0 to 2**32 - 1, such as a hash of the key) and key: rows
    are numbered inside ranges of the hash, and ranges by their counts. Keys are unique within a group; groups are few."""
    placed = df.withColumn("order_", order).withColumn("range_", F.floor(F.col("order_") / (2**32 // RANGES)).cast("int"))
    before = counted_before(placed.groupBy(*groups, "range_").agg(F.count(F.lit(1)).alias("c_")), list(groups))
    inner = F.row_number().over(Window.partitionBy(*groups, "range_").orderBy("order_", key)) - 1
    return placed.join(F.broadcast(before), [*groups, "range_"]).withColumn(name, F.col("before_") + inner).drop("order_", "range_", "before_")


def rank_histogram(histogram: DataFrame, groups: list[str], value: str, name: str = "rank") -> DataFrame:
    """histogram (groups, value, c_ rows of that value, ...) with the average rank (from 1) of each value inside its group, sorted range by range."""
    cuts = histogram.groupBy(*groups).agg(cuts_of(value))
    placed = (histogram.join(cuts, groups) if groups else histogram.join(F.broadcast(cuts))).select(*histogram.columns, range_of(value))
    before = counted_before(placed.groupBy(*groups, "range_").agg(F.sum("c_").alias("c_")), groups)
    w = Window.partitionBy(*groups, "range_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("before_") + F.coalesce(F.sum("c_").over(w), F.lit(0))
    return placed.join(before, [*groups, "range_"]).select(*histogram.columns, (below + (F.col("c_") + 1) / 2).alias(name))


def average_ranks(df: DataFrame, groups: list[str], value: str, name: str = "rank") -> DataFrame:
    """df with the average rank (from 1) of value inside its group."""
    histogram = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("c_"))
    return df.join(rank_histogram(histogram, groups, value, name).drop("c_"), [*groups, value])
