"""Answer axis: what rankings of a query's candidates do when the format changes.

Scores are long rows (keys..., query_id, cand, format, fpos, score); candidate 0 is gold. Ties favour gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiform.operators.effect import format_pairs

def leads(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, query_id, format, fpos, above (negatives strictly above gold), lead, rr."""
    g = scores.groupBy(*keys, "query_id", "format", "fpos").agg(F.max(F.when(F.col("cand") == 0, F.col("score"))).alias("g"), F.array_agg(F.when(F.col("cand") > 0, F.col("score"))).alias("n"))
    above = F.size(F.filter("n", lambda x: x > F.col("g")))
    return g.select(*keys, "query_id", "format", "fpos", above.alias("above")).withColumns({"lead": F.col("above") == 0, "rr": 1.0 / (1 + F.col("above"))})


def leads_of(grid: str) -> Column:
    """format, fpos, above of each format in a column of `study.grids`: negatives strictly above gold."""
    above = lambda s: F.size(F.filter(F.slice(s, F.lit(2), F.size(s)), lambda x: x > F.get(s, F.lit(0))))
    return F.transform(grid, lambda f: F.struct(f["format"].alias("format"), f["fpos"].alias("fpos"), above(f["scores"]).alias("above")))


def leads_in(rows: DataFrame, leads: Column | str, keys: tuple[str, ...] = ()) -> DataFrame:
    """`leads`, from a column of `leads_of`."""
    out = rows.select(*keys, "query_id", F.explode(leads).alias("l")).select(*keys, "query_id", "l.format", "l.fpos", "l.above")
    return out.withColumns({"lead": F.col("above") == 0, "rr": 1.0 / (1 + F.col("above"))})


def mrr(led: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return led.groupBy(*keys, "format").agg(F.avg("rr").alias("mrr"), F.avg(F.col("lead").cast("int")).alias("top1"))


def counts_of_leads(led: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, query_id, k: formats under which gold leads, n: formats."""
    return led.groupBy(*keys, "query_id").agg(F.count_if("lead").alias("k"), F.count(F.lit(1)).alias("n"))


def top1_stability(led: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Queries where gold leads always, sometimes, never; and of the answerable ones the inconsistent share."""
    c = counts_of_leads(led, keys)
    some, answerable = (F.col("k") > 0) & (F.col("k") < F.col("n")), F.col("k") > 0
    return c.groupBy(*keys).agg(
        F.count_if(F.col("k") == F.col("n")).alias("always"), F.count_if(some).alias("sometimes"), F.count_if(F.col("k") == 0).alias("never"),
        F.count_if(answerable).alias("answerable"), (F.try_divide(F.count_if(some) * 100.0, F.count_if(answerable))).alias("inconsistent_pct"),
    )


def pair_disagreement(led: DataFrame) -> DataFrame:
    """pair, disagree_pct: queries where gold leads under one format of the pair alone."""
    pairs = format_pairs(led.withColumn("l", F.col("lead").cast("int")), ["query_id"], "l")
    return pairs.groupBy("pair", "ppos").agg(F.avg(F.when(F.col("a") != F.col("b"), 100.0).otherwise(0.0)).alias("disagree_pct"))


def within_query(scores: DataFrame) -> DataFrame:
    """pair, ppos, flip_pct, kendall_tau, rank_delta, rank_changed_pct, top1_changed_pct.

    All of a query's scores are one row (candidates x formats), so pairs of candidates are made inside it."""
    pairs = format_pairs(scores, ["query_id", "cand"])
    q = pairs.groupBy("query_id", "pair", "ppos").agg(F.array_sort(F.collect_list(F.struct("cand", "a", "b"))).alias("s"))
    inner = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(F.sign(x["a"] - y["a"]).cast("int").alias("p"), F.sign(x["b"] - y["b"]).cast("int").alias("q")))))
    q = q.withColumn("o", inner)
    count = lambda f: F.size(F.filter("o", f))
    q = q.withColumns({
        "comparable": count(lambda o: (o["p"] != 0) & (o["q"] != 0)), "discordant": count(lambda o: o["p"] * o["q"] < 0), "concordant": count(lambda o: o["p"] * o["q"] > 0),
        "np": count(lambda o: o["p"] != 0), "nq": count(lambda o: o["q"] != 0),
        "ra": F.size(F.filter("s", lambda x: x["a"] > F.element_at("s", 1)["a"])), "rb": F.size(F.filter("s", lambda x: x["b"] > F.element_at("s", 1)["b"])),
        "ta": F.array_position(F.transform("s", lambda x: x["a"]), F.array_max(F.transform("s", lambda x: x["a"]))), "tb": F.array_position(F.transform("s", lambda x: x["b"]), F.array_max(F.transform("s", lambda x: x["b"]))),
    })
    tau = F.try_divide((F.col("concordant") - F.col("discordant")).cast("double"), F.sqrt(F.col("np").cast("double") * F.col("nq")))
    return q.groupBy("pair", "ppos").agg(
        F.avg(F.try_divide(F.col("discordant") * 100.0, F.col("comparable"))).alias("flip_pct"), F.avg(tau).alias("kendall_tau"),
        F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("rank_delta"), F.avg(F.when(F.col("ra") != F.col("rb"), 100.0).otherwise(0.0)).alias("rank_changed_pct"),
        F.avg(F.when(F.col("ta") != F.col("tb"), 100.0).otherwise(0.0)).alias("top1_changed_pct"),
    )


def held_out_flags(led: DataFrame, held: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, query_id and three flags: all (some formats lead, not all), in_training (the same of the formats but held), ood (held disagrees with training formats that agree)."""
    train = F.when(F.col("format") != held, F.col("lead").cast("int"))
    own = F.max(F.when(F.col("format") == held, F.col("lead").cast("int")))
    g = led.groupBy(*keys, "query_id").agg(F.min(train).alias("lo"), F.max(train).alias("hi"), own.alias("own"))
    return g.select(*keys, "query_id", (F.greatest("hi", "own") > F.least("lo", "own")).alias("all"), (F.col("hi") > F.col("lo")).alias("in_training"), ((F.col("hi") == F.col("lo")) & (F.col("own") != F.col("lo"))).alias("ood"), (F.greatest("hi", "own") == 1).alias("answerable"))


def inconsistency_section(base: DataFrame, trained: DataFrame) -> DataFrame:
    """subset, pool, base_n, trained_n, change_pp over the queries that the base answers under some format."""
    names = ("all", "in_training", "ood")
    b = base.filter("answerable").select("query_id", *[F.col(n).alias(f"b_{n}") for n in names])
    joined = b.join(trained.select("query_id", *names), "query_id")
    rows = joined.select(F.explode(F.array(*[F.struct(F.lit(n).alias("subset"), F.col(f"b_{n}").cast("int").alias("b"), F.col(n).cast("int").alias("t")) for n in names])).alias("r"))
    return rows.groupBy(F.col("r.subset").alias("subset")).agg(F.count(F.lit(1)).alias("pool"), F.sum("r.b").alias("base_n"), F.sum("r.t").alias("trained_n"), (F.avg(F.col("r.t") - F.col("r.b")) * 100).alias("change_pp"))
