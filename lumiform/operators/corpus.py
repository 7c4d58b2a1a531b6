"""Corpus ETL: records from tables and pages, quality gates, splits by article, and validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumiform.functions import markup
from lumiform.functions import text as T

MIN_PAIRS, MIN_BODY, MIN_INFOBOX, BODY_CHARS, MIN_PARAGRAPH = 3, 100, 200, 3000, 30
SPLITS = ("train", "dev", "test")


def pairs_of(**columns: Column) -> Column:
    """Ordered (key, value) pairs of the columns that aren't null."""
    made = [F.when(c.isNotNull(), F.struct(F.lit(k).alias("key"), c.cast("string").alias("value"))) for k, c in columns.items()]
    return F.array_compact(F.array(*made))


def records(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A record for every document: id, title, question, pairs, body, short_answers."""
    known = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    joined = documents.join(known, "doc_id", "left")
    body = F.coalesce("text", F.lit(""))
    return joined.select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("#"), F.pmod("doc_id", F.lit(7)).cast("string")).alias("title"),
        T.first_tokens(body, 12).alias("question"),
        pairs_of(lang=F.col("lang"), source=F.col("source"), chars=F.col("n_chars"), quality=F.col("quality"), toxic=F.col("toxic")).alias("pairs"),
        body.alias("body"),
        F.array("lang", "source").alias("short_answers"),
    )


# -- pages


def paragraphs(html: Column) -> Column:
    """Texts of the paragraphs, without comments, navigation, scripts and styles."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?is)<(script|style|nav|footer)\b.*?</\1>", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.transform(found, T.html_to_text)


def body_of(html: Column, target: int = BODY_CHARS, least: int = MIN_PARAGRAPH) -> Column:
    """Paragraphs of at least `least` characters, joined by spaces until their lengths (and a space each) reach target, then cut there."""
    long = F.filter(paragraphs(html), lambda p: F.length(p) >= least)
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("parts"))
    step = lambda acc, p: F.when(acc["n"] < target, F.struct((acc["n"] + F.length(p) + 1).alias("n"), F.concat(acc["parts"], F.array(p)).alias("parts"))).otherwise(acc)
    return F.left(F.aggregate(long, zero, step, lambda acc: F.array_join(acc["parts"], " ")), F.lit(target))


def infobox_html(parts: DataFrame) -> DataFrame:
    """A synthetic page with an infobox for every part: bullets, a repeated key, an empty cell, a reference mark and a hidden span."""
    row = lambda k, v: F.concat(F.lit(f"<tr><th>{k}</th><td>"), v, F.lit("</td></tr>"))
    cells = [row("• Name", F.col("p_name")), row("Brand", F.concat("p_brand", F.lit('<sup class="reference">[1]</sup>'))), row("Type", F.concat(F.lit("<b>"), "p_type", F.lit("</b>"))), row("Size", F.col("p_size").cast("string")), row("Brand", F.lit("repeated")), row("Empty", F.lit(" ")), row("Note", F.concat(F.lit('a &amp; b<span style="display:none">hidden</span>')))]
    return parts.select(F.col("p_partkey").alias("id"), F.concat(F.lit('<table class="infobox vcard">'), *cells, F.lit("</table>")).alias("html"))


def infobox_rows(pages: DataFrame, max_key: int = 50, max_value: int = 300) -> DataFrame:
    """Rows of infoboxes: id, pos, key, value, and drop: why a row is left out (empty, too_long, duplicate; null: kept, the first of a key).
    Tables inside the box and hidden spans, with all that they hold, are no part of its rows."""
    row = F.regexp_extract_all(markup.flat_table(F.col("html")), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    rows = pages.select("id", F.posexplode(row).alias("pos", "row"))
    cell = lambda tag: F.regexp_extract("row", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    rows = rows.select("id", "pos", T.clean_key(T.clean_cell(cell("th"))).alias("key"), T.clean_cell(cell("td")).alias("value"))
    empty, large = (F.col("key") == "") | (F.col("value") == ""), (F.length("key") > max_key) | (F.length("value") > max_value)
    fine = ~(empty | large)
    seen = F.sum(fine.cast("int")).over(Window.partitionBy("id", "key").orderBy("pos"))
    return rows.withColumn("drop", F.when(empty, "empty").when(large, "too_long").when(seen > 1, "duplicate"))


# -- gates


def quality_flags(pairs: Column, body: Column, answers: Column, infobox_chars: Column | None = None) -> Column:
    values = F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit(" "), p["value"])), " ")
    hay = F.concat(values, F.lit(" "), body)
    checks = [F.when(F.size(pairs) < MIN_PAIRS, "too_few_pairs"), F.when(F.length(body) < MIN_BODY, "body_too_short")]
    if infobox_chars is not None:
        checks.append(F.when(infobox_chars < MIN_INFOBOX, "infobox_too_short"))
    checks.append(F.when((F.size(answers) > 0) & ~T.contains_any(answers, hay), "answer_not_in_content"))
    return F.array_compact(F.array(*checks))


def gated(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("quality_flags") == 0)


#: Reasons to reject a prose record, in the order of the checks.
REASONS = ("no_long_answer", "answer_in_infobox", "too_short", "no_verified_answer")


def reject_reason(answer: Column, in_infobox: Column, answers: Column, least: int = MIN_BODY, target: int = BODY_CHARS) -> Column:
    """Why a prose record is rejected (null: it is kept). Length is judged before the cut, the answer after it."""
    return (
        F.when(answer.isNull(), REASONS[0]).when(in_infobox, REASONS[1]).when(F.length(answer) < least, REASONS[2])
        .when(~T.contains_any(answers, F.left(answer, F.lit(target))), REASONS[3])
    )


def counted(df: DataFrame, column: str, roster: tuple[str, ...]) -> DataFrame:
    """Rows for each name of a roster, 0 for those that don't occur."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, n) for i, n in enumerate(roster)], "pos int, name string")
    found = df.filter(F.col(column).isin(*roster)).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("c_"))
    return names.join(found, "name", "left").select("name", F.coalesce("c_", F.lit(0)).alias("n"))


def prose_turns(conversations: DataFrame) -> DataFrame:
    """Question and answer of every user turn that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumns({"answer": F.lead("text").over(w), "next_role": F.lead("role").over(w)})
    return rows.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), "answer")


# -- splits


def hashed(seed: int | str, *parts: Column | str) -> Column:
    """A number from 0 to 2**32 - 1 that depends on seed and parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("bigint")


def article_split(titles: DataFrame, seed: int = 13, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """title, split for distinct titles: the order is that of a seeded hash; int(n * share) titles each, the rest is test.

    Titles are ranked inside 256 ranges of the hash and the ranges' counts summed, so no task sorts them all."""
    rows = titles.select("title").distinct().withColumn("h", hashed(seed, "title")).withColumn("r", F.shiftright("h", 24))
    counts = rows.groupBy("r").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("r", F.coalesce(F.sum("c").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"), F.sum("c").over(Window.partitionBy()).alias("n"))
    rank = F.col("b") + F.row_number().over(Window.partitionBy("r").orderBy("h", "title"))
    placed = rows.join(before, "r").withColumn("rank", rank)
    n_train, n_dev = F.floor(F.col("n") * train), F.floor(F.col("n") * dev)
    return placed.select("title", F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_dev, "dev").otherwise("test").alias("split"))


# -- validators


def shared_titles(rows: DataFrame) -> DataFrame:
    """Titles that stand in several splits, for each pair of splits."""
    sets = rows.groupBy("title").agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    first = sets.select("title", F.posexplode("s").alias("i", "split_a"), "s")
    return first.select("title", "split_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("split_b"))


def repeated_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """Ids of more than one row, with their number and the least split that has them."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("first_split")).filter("n > 1")


def count_mismatches(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Splits whose stored count differs from the actual one."""
    actual = rows.groupBy("split").agg(F.count(F.lit(1)).alias("actual"))
    return stored.join(actual, "split", "full").select("split", F.coalesce("n_records", F.lit(0)).alias("stored"), F.coalesce("actual", F.lit(0)).alias("actual")).filter("stored <> actual")


def even_sample(rows: DataFrame, excluded: DataFrame, key: str, n: int) -> DataFrame:
    """n keys spread evenly over the rows that aren't excluded: places round(i * (m - 1) / (n - 1)), halves to even."""
    from lumiform.functions.ranking import dense_index

    left = dense_index(rows.select(key).join(excluded.select(key), key, "left_anti"), key, "place")
    size = left.agg((F.max("place") + 1).alias("m"))
    wanted = size.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "m").select("i", F.bround(F.col("i") * (F.col("m") - 1) / max(n - 1, 1), 0).cast("bigint").alias("place"))
    return wanted.join(left, "place").select("i", key)
