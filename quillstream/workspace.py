"""Scratch paths that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir; a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="quillstream-scratch-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
