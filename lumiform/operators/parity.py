"""Resampling with NumPy's generator, for results that must equal a NumPy program's draw by draw. For small studies: the values go to every task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that are sent to the tasks at most; larger inputs use resample.py.
MOST = 1_000_000


def bootstrap_means(values: DataFrame, column: str, n_boot: int, seed: int = 0) -> DataFrame:
    """b, mean: means of default_rng(seed).integers(0, n, (n_boot, n)) draws of the values in the order of idx. Replicates are made in ranges; a task
    draws and drops those of the tasks before it."""
    n = values.count()
    if not 0 < n <= MOST:
        raise ValueError(f"{n} values; parity mode takes 1 to {MOST}")
    held = np.array([r[0] for r in values.orderBy("idx").select(column).collect()], float)
    spark = values.sparkSession

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw, at = np.random.default_rng(seed), 0
        for f in frames:  # ascending inside a task, so a task draws no replicate twice
            means = []
            for b in f["id"]:
                while at < b:
                    draw.integers(0, n, n)
                    at += 1
                means.append(held[draw.integers(0, n, n)].mean())
                at += 1
            yield pd.DataFrame({"b": f["id"], "mean": means})

    return spark.range(n_boot).mapInPandas(run, "b long, mean double").orderBy(F.col("b"))
