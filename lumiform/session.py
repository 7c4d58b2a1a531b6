"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lumiform", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the queries expect (UTC, AQE); conf overrides."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    return builder.config(map=base | conf).getOrCreate()
