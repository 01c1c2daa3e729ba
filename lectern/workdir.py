"""The folder for intermediate tables: spark.checkpoint.dir, which executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path; only a local session may go without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lectern-")
    return f"{base.rstrip('/')}/lectern-{label}-{uuid.uuid4().hex}"
