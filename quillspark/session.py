"""Session factory with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quillspark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow; anything given in ``conf`` wins.

    Shuffle partitions are left to adaptive coalescing: start high for large inputs, small ones are merged.
    """
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()
