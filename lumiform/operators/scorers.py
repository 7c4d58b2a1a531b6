"""The scoring boundary: a scorer gives a number to each (question, passage). Neural models aren't here; they plug in as batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiform.functions.text import tokens


class Scorer(Protocol):
    def score(self, pairs: DataFrame) -> DataFrame:
        """pairs (question, passage, any other columns) with a column score (double)."""


class OverlapScorer:
    """Share of the question's distinct words that the passage has; DataFrame operations only."""

    def score(self, pairs: DataFrame) -> DataFrame:
        q, p = F.array_distinct(tokens("question")), F.array_distinct(tokens("passage"))
        share: Column = F.try_divide(F.size(F.array_intersect(q, p)).cast("double"), F.size(q))
        return pairs.withColumn("score", F.coalesce(share, F.lit(0.0)))


class BatchScorer:
    """Scores from a Python function of batches, such as a model that `load` makes once a task. Batches are bounded by Arrow's."""

    def __init__(self, load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> None:
        self.load = load

    def score(self, pairs: DataFrame) -> DataFrame:
        load = self.load

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load()
            for f in frames:
                yield f.assign(score=model(f["question"].fillna("").tolist(), f["passage"].fillna("").tolist()))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
        return pairs.mapInPandas(run, f"{schema}, score double")


def overlap_model() -> Callable[[list[str], list[str]], list[float]]:
    """The overlap score as a batch function."""
    import re

    def run(questions: list[str], passages: list[str]) -> list[float]:
        out = []
        for q, p in zip(questions, passages, strict=True):
            a = set(re.findall(r"\w+", q.lower()))
            out.append(len(a & set(re.findall(r"\w+", p.lower()))) / len(a) if a else 0.0)
        return out

    return run
