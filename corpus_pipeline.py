"""The corpus pipeline: documents that aren't toxic, without boilerplate lines, near copies and benchmark passages, packed into sequences.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents, columns of any other name with them. Every stage takes null ids
and texts, empty and very long texts, ties and repeated rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumiform.llm import bagminhash, decontam, lines, packing, toxicity
from lumiform.llm.common import free_name, quoted, table, whole_rows, written

TEXT_KEY = ["t1", "t2"]
#: Benchmark items of fewer tokens ("Paris", "42") stand in many documents that never saw the benchmark: for them no document goes.
LEAST_TOKENS = 4


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), doc_id and two hashes of the text: rows with the same id and other texts stay apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(whole_rows(docs), "doc_id", F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labelled ones among the stage's own input; without any, all stay. Null and
    empty texts are scored by the bias alone; rows without doc_id and repeated rows are judged by their texts like others."""
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that spread over many sites; n_chars follows the text. Null texts stay null; a text of nothing but such
    lines becomes empty; equal rows get equal results."""
    done = lines.dedup_lines(docs)
    removed = free_name(docs.columns, "lines_removed")
    changed = F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", changed).select(*[F.col(quoted(c)) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least doc_id, with each of the texts that stand under that id; documents without
    id stay, repeated rows of one id and text are one."""
    classed = bagminhash.classes(docs)
    stays = classed.filter("doc_id = class_id").select("doc_id").distinct()
    rows = keyed(docs.filter("doc_id IS NOT NULL")).join(stays, "doc_id", "left_semi")
    order = Window.partitionBy("doc_id", *TEXT_KEY).orderBy(F.xxhash64("row"))
    kept = rows.withColumn("first", F.row_number().over(order)).filter("first = 1")
    return unpacked(kept, docs).unionByName(docs.filter("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item of LEAST_TOKENS tokens or more. A row goes for its own text: others with its id, or without one, stay. Null and empty texts stay."""
    rows = keyed(docs)
    whole = F.struct("doc_id", *TEXT_KEY).alias("doc")
    found = decontam.matches(rows.select(whole, F.col("row.text").alias("text")), table(spark, sf_dir, "benchmark"), "doc")
    hits = found.filter(F.col("n_tokens") >= LEAST_TOKENS).select(F.col("doc").alias("hit")).distinct()
    return unpacked(rows.withColumn("doc", whole).join(hits, F.col("doc").eqNullSafe(F.col("hit")), "left_anti"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences. A null or empty text is a piece of one token; repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_boilerplate),
    ("near dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
