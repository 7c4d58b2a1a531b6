"""Whether two tables hold the same sequence, and where they first differ, without meeting row by row.

A range of positions has a digest: the sum, modulo a prime, of a hash of every (position, id) in it. Sums of ranges add up, in
any order of tasks, and a digest changes with the order of the ids. Tables are compared by the digests of wide ranges first,
and only in the first range that differs by those of narrower ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiform.operators.corpus import hashed

#: Fixed value: a Mersenne prime; sums of hashes under 2**32 stay under it for two thousand million rows, and beyond are reduced.
PRIME = (1 << 61) - 1
#: log2 of the widths of ranges, from wide to single positions.
LEVELS = (20, 10, 0)


def digests(rows: DataFrame, level: int = LEVELS[0]) -> DataFrame:
    """part (position >> level), n, digest of rows (pos, id); positions are from 0. Equal sequences have equal digests in every part."""
    term = F.pmod(hashed("order", "pos", "id").cast("decimal(38,0)"), F.lit(PRIME).cast("decimal(38,0)"))
    summed = rows.groupBy(F.shiftright("pos", level).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(term).alias("s"))
    return summed.select("part", "n", F.pmod("s", F.lit(PRIME).cast("decimal(38,0)")).cast("long").alias("digest"))


def combined(parts: DataFrame) -> DataFrame:
    """n, digest of the whole, from the digests of its parts."""
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.pmod(F.sum(F.col("digest").cast("decimal(38,0)")), F.lit(PRIME).cast("decimal(38,0)")).cast("long"), F.lit(0)).alias("digest"))


def first_part(a: DataFrame, b: DataFrame, level: int) -> int | None:
    """The first part in which two tables differ, None if they don't."""
    left, right = digests(a, level), digests(b, level).withColumnsRenamed({"n": "n_", "digest": "digest_"})
    differ = left.join(right, "part", "full").filter(~(F.col("n").eqNullSafe(F.col("n_")) & F.col("digest").eqNullSafe(F.col("digest_"))))
    return differ.agg(F.min("part").alias("p")).first()["p"]


def first_difference(found: DataFrame, recorded: DataFrame) -> int | None:
    """The least position at which two sequences (pos, id) differ, or None. Each level reads the positions of one range alone."""
    low, high = None, None
    for level in LEVELS:
        inside = (lambda t: t) if low is None else (lambda t: t.filter((F.col("pos") >= low) & (F.col("pos") < high)))  # noqa: B023
        part = first_part(inside(found), inside(recorded), level)
        if part is None:
            return None
        low, high = part << level, (part + 1) << level
    return low


def check_order(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row: found_n, recorded_n, same, and where they first differ: pos, found_id, recorded_id (null where one has ended)."""
    at = first_difference(found, recorded)
    sizes = found.agg(F.count(F.lit(1)).alias("found_n")).crossJoin(recorded.agg(F.count(F.lit(1)).alias("recorded_n")))  # a row each
    told = lambda t, name: t.filter(F.col("pos") == (-1 if at is None else at)).agg(F.max("id").alias(name))
    where = sizes.withColumns({"same": F.lit(at is None), "pos": F.lit(at).cast("long")})
    return where.crossJoin(told(found, "found_id")).crossJoin(told(recorded, "recorded_id"))


def require_order(found: DataFrame, recorded: DataFrame, name: str) -> None:
    """Raise if a rebuilt sequence isn't the one that results were measured on."""
    at = first_difference(found, recorded)
    if at is not None:
        raise ValueError(f"{name} was measured on another order: it first differs at position {at}; rebuild from the same corpus")
