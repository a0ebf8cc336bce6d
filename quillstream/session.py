"""Session factory shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results, not only speed; `configure` applies them to a session it did not make.
SEMANTIC_CONF = {"spark.sql.session.timeZone": "UTC"}


def build_session(app: str = "quillstream", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session for development; on a cluster, spark-submit's own settings win."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    base = {
        **SEMANTIC_CONF,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app).master(os.environ.get("SPARK_MASTER", f"local[{cpus}]"))
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
