"""Watching jobs: the latest state of each from a stream of progress lines, stale ones flagged, and the lines to show.

The state of a job is kept by key in the stream's state store and leaves it when the job has been silent for `stale` seconds of
event time; what the stream said last of a job is its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from lumiform.functions.text import duration, parse_progress

STATE = "done long, total long, label string, elapsed double, eta double, failed boolean, at long"
SEEN = f"job string, {STATE}, stale boolean"
FIELDS = ("done", "total", "label", "elapsed", "eta", "failed", "at")


def parsed(lines: DataFrame) -> DataFrame:
    """job, ts and the fields of progress lines (job, ts, line); a line that says nothing, or isn't whole, has zero units."""
    m = parse_progress(F.col("line"))
    number = lambda name, kind: F.coalesce(F.try_element_at(m, F.lit(name)).try_cast(kind), F.lit(0).cast(kind)).alias(name)
    text = F.coalesce(F.try_element_at(m, F.lit("label")), F.lit("")).alias("label")
    return lines.select("job", "ts", number("done", "long"), number("total", "long"), text, number("elapsed", "double"), number("eta", "double"), F.coalesce(F.try_element_at(m, F.lit("failed")) == "1", F.lit(False)).alias("failed"))


def latest_states(spark: SparkSession, lines: DataFrame, checkpoint: str, out: str, stale: int) -> DataFrame:
    """job, the fields of its last line, at (its time, in milliseconds) and stale, after a stream of lines (job, ts, line) has taken what is there.

    Of lines of one time the one with most units counts. A job is stale when the stream's watermark passes its last line by `stale` seconds before it has finished
    or failed; a later line makes it live again."""
    stream = parsed(lines).withColumn("at", F.unix_millis("ts")).withWatermark("ts", "0 seconds")

    def update(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.getOption
        if state.hasTimedOut:
            state.remove()
            if not (old[5] or (old[1] > 0 and old[0] >= old[1])):
                yield pd.DataFrame([(key[0], *old, True)], columns=["job", *FIELDS, "stale"])
            return
        best = old
        for frame in frames:
            row = frame.sort_values(["at", "done", "label"], kind="stable").iloc[-1]
            new = (int(row["done"]), int(row["total"]), str(row["label"]), float(row["elapsed"]), float(row["eta"]), bool(row["failed"]), int(row["at"]))
            if best is None or (new[6], new[0], new[2]) >= (best[6], best[0], best[2]):
                best = new
        state.update(best)
        late = best[6] + stale * 1000
        if late > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(late)
        yield pd.DataFrame([(key[0], *best, False)], columns=["job", *FIELDS, "stale"])

    told = stream.groupBy("job").applyInPandasWithState(update, SEEN, STATE, "update", GroupStateTimeout.EventTimeTimeout)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    told.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(out)
    last = seen.groupBy("job").agg(F.max_by(F.struct(*FIELDS, "stale"), F.struct("batch", "stale")).alias("s"))
    return last.select("job", "s.*")


# -- what a watcher shows

BAR_WIDTHS, NAME, INDENT = (24, 16, 8, 0), 8, "  "


def finished() -> Column:
    return (F.col("total") > 0) & (F.col("done") >= F.col("total"))


def live(states: DataFrame, now: int) -> DataFrame:
    """states with live_elapsed and live_eta, which count the time since the last line (now: milliseconds)."""
    age = F.greatest((F.lit(now) - F.col("at")) / 1000.0, F.lit(0.0))
    return states.withColumns({"live_elapsed": F.col("elapsed") + age, "live_eta": F.greatest(F.col("eta") - age, F.lit(0.0))})


def note(short: Column | bool = False) -> Column:
    """What a job is doing; the short form tells only the time left."""
    short = F.lit(short) if isinstance(short, bool) else short
    left = F.when(F.col("live_eta") > 0, F.concat(F.lit("eta "), duration(F.col("live_eta")))).otherwise(F.lit("eta overdue"))
    return (
        F.when(F.col("failed"), F.lit("FAILED"))
        .when(finished(), F.when(short, F.lit("done")).otherwise(F.concat(F.lit("done in "), duration(F.col("elapsed")))))
        .when(F.col("total") <= 0, F.lit("waiting"))
        .when(F.col("done") <= 0, F.when(short, F.lit("starting")).otherwise(F.concat(F.lit("starting  "), duration(F.col("live_elapsed")))))
        .otherwise(F.when(short, left).otherwise(F.concat(F.col("label"), F.lit("  "), duration(F.col("live_elapsed")), F.lit("  "), left)))
    )


def by_start() -> list[Column]:
    """The order in which jobs began, ties by name."""
    return [F.desc("live_elapsed"), F.asc("job")]


def grouped(states: DataFrame, models: list[str]) -> DataFrame:
    """states with model (the longest of `models` that the name holds as a whole part, or null), shown (the name without it), and place: jobs that name no model
    first, then the models by their earliest job."""
    part = lambda m: F.concat(F.lit("_"), F.col("job"), F.lit("_")).contains(f"_{m}_") & ~F.col("job").startswith(f"{m}_") & (F.col("job") != m)
    ordered = sorted(models, key=lambda m: (-len(m), m))
    model = F.coalesce(*[F.when(part(m), F.lit(m)) for m in ordered], F.lit(None).cast("string"))
    named = states.withColumn("model", model)
    rest = F.trim(F.regexp_replace(F.concat(F.lit("_"), F.col("job"), F.lit("_")), F.concat(F.lit("_"), F.col("model"), F.lit("_+")), F.lit(" ")))
    shown = F.when(F.col("model").isNull(), F.col("job")).otherwise(F.regexp_replace(rest, "^_|_$", ""))
    first = F.when(F.col("model").isNull(), F.lit(float("inf"))).otherwise(F.max("live_elapsed").over(Window.partitionBy("model")))
    return named.withColumns({"shown": shown, "begun": first}).withColumn("place", F.row_number().over(Window.orderBy(F.desc("begun"), F.asc_nulls_first("model"), *by_start()))).drop("begun")


def bar(width: Column) -> Column:
    """A bar of that width between brackets; none of width 0."""
    filled = F.when(F.col("total") > 0, F.least(F.greatest(F.round(width * F.col("done") / F.col("total")).cast("int"), F.lit(0)), width)).otherwise(0)
    return F.when(width > 0, F.concat(F.lit("  ["), F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), width - filled), F.lit("]"))).otherwise(F.lit(""))


def cut_middle(text: Column, width: Column) -> Column:
    """A text within width: two thirds of what is kept are its start."""
    keep = width - 3
    head = F.ceil(2 * keep / 3).cast("int")
    return F.when(F.length(text) <= width, text).when(width <= 3, F.left(text, width)).otherwise(F.concat(F.left(text, head), F.lit("..."), F.right(text, keep - head)))


def render(states: DataFrame, models: list[str], now: int, width: int | None = None) -> DataFrame:
    """pos, line: a line a job, grouped by model with a line for each, and one for all. With a width, the block gives up detail until every line fits: the bar
    narrows, the notes keep only the time left, the bar goes, names lose their middle, and last each line is cut. All forms are made in one pass over the jobs, which are few."""
    named = grouped(live(states, now), models).withColumn("all_", F.lit(1))
    forms = [(b, False) for b in BAR_WIDTHS[:-1]] + [(b, True) for b in BAR_WIDTHS]
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("form"), F.lit(b).alias("bar"), F.lit(s).alias("short"), F.lit(False).alias("cut")) for i, (b, s) in enumerate([*forms, (0, True)])])).alias("f")
    rows = named.select("*", every).select("*", "f.*").withColumn("cut", F.col("form") == len(forms))
    names = Window.partitionBy("form")
    longest = F.max(F.length("shown")).over(names)
    indent = F.when(F.col("model").isNull(), INDENT).otherwise(INDENT * 2)
    tail = F.concat(bar(F.col("bar")), F.lit(" "), F.lpad(F.col("done").cast("string"), 3, " "), F.lit("/"), F.rpad(F.col("total").cast("string"), F.greatest(F.length(F.col("total").cast("string")), F.lit(3)), F.lit(" ")), F.lit("  "), note(F.col("short")))
    rows = rows.withColumns({"indent": indent, "tail": tail, "longest": longest})
    widest = F.max(F.length("indent") + F.col("longest") + F.length("tail")).over(names)
    space = F.when(F.col("cut"), F.greatest(F.col("longest") - F.greatest(widest - (width or 1 << 20), F.lit(0)), F.lit(NAME))).otherwise(F.col("longest"))
    rows = rows.withColumn("space", space.cast("int"))
    lines = rows.withColumn("line", F.concat("indent", F.rpad(cut_middle(F.col("shown"), F.col("space")), F.col("space"), F.lit(" ")), "tail"))
    heads = lines.filter("model IS NOT NULL").groupBy("form", "model").agg(F.min("place").alias("place"), F.count_if(finished()).alias("ready"), F.count(F.lit(1)).alias("n"))
    heads = heads.select("form", (F.col("place") * 2 - 1).alias("pos"), F.concat(F.lit(INDENT), "model", F.lit("  "), "ready", F.lit("/"), "n", F.lit(" done")).alias("line"))
    block = lines.select("form", (F.col("place") * 2).alias("pos"), "line").unionByName(heads)
    fits = block.groupBy("form").agg(F.max(F.length("line")).alias("w")).filter((F.col("w") <= (width or 1 << 20)) | (F.col("form") == len(forms))).agg(F.min("form").alias("form"))
    running = (F.col("total") > 0) & ~finished() & ~F.col("failed")
    eta = F.max(F.when(running, F.col("live_eta")))
    whole = named.agg(F.count(F.lit(1)).alias("n"), F.sum("done").alias("d"), F.sum("total").alias("t"), eta.alias("eta"))
    jobs = F.concat(F.lit(INDENT), "n", F.lit(" jobs, "), "d", F.lit("/"), "t", F.lit(" units"), F.when(F.col("eta").isNull(), F.lit("")).otherwise(F.concat(F.lit(", eta "), duration(F.col("eta")))))
    last = whole.select(F.lit(1 << 40).alias("pos"), F.when(F.col("n") == 0, F.lit("no job progress found")).otherwise(jobs).alias("line"))
    shown = block.join(F.broadcast(fits), "form").select("pos", "line").unionByName(last)
    line = F.left("line", F.lit(width)) if width else F.col("line")
    return shown.select(F.row_number().over(Window.orderBy("pos")).alias("pos"), line.alias("line"))
