"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; one of our own where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-"))
        named = sc.getCheckpointDir()
    return f"{named.rstrip('/')}/tarn-{what}-{uuid.uuid4().hex}"
