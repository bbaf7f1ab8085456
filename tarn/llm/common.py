"""What the operators share: reading tables, shared storage, column hygiene."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tarn-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch between the JVM and a Python worker, where the session keeps Spark's own default.
BATCH_ROWS = 4000


def modest(df: DataFrame) -> DataFrame:
    """The same rows; the session from now on sends texts to Python in batches that fit small workers."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(key)) == 10_000:
        conf.set(key, str(BATCH_ROWS))
    return df


def lean(run):
    """A worker's function over batches that gives its memory back when it ends: idle workers stay alive and small."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every platform has it
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(df[column], F.lit(""))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged. lower() is the faster way where all is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))
