"""Materialized views over streams: each micro-batch adds partial results, reading merges them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarn.apply import Warehouse


def feed(warehouse: Warehouse, table: str, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Inserts a stream into a table; materialized views of the table follow batch by batch."""

    def insert(rows: DataFrame, _: int) -> None:
        replace(warehouse, spark=rows.sparkSession).insert(table, rows)  # the same tables, seen from the batch's session

    writer = stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(stream: DataFrame, time: str, width: str, late: str, keys: list[str], **aggs) -> DataFrame:
    """Counts and other aggregates by time window and keys; rows later than ``late`` behind the newest are left out."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), *[e.alias(a) for a, e in aggs.items()]).select(F.col("window.start").alias("start"), *keys, "n", *aggs)
