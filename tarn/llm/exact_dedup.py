"""Exact dedup as a stateful stream.

Documents arrive as a stream. Keyed state in RocksDB, without expiry, retains for each digest the
stable identifier (the largest doc_id seen), the locator of that row's content (file and row) and
the number of rows. Map-side combination comes before the shuffle to the state, so that a text with
millions of copies sends one row a task. Changed state is logged per micro-batch. Digests that were
hit are then checked by their full bytes against the text at the locator.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bitfilter
from tarn.llm.common import lean, modest, scratch, table, written

#: State lies in RocksDB on disk; what its instances hold in memory is bounded for each executor.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each instance sets 4 MB of disk aside
}
#: State partitions for each core: the state lies on disk, so a partition may be large.
PER_CORE = 2
KEEP = ("keep_id", "keep_file", "keep_row")


#: Plan nodes that hand on the rows of one Parquet scan, each at most once.
SIMPLE = frozenset(["LogicalRelation", "Project", "Filter", "SubqueryAlias", "View"])


def _plain(docs: DataFrame) -> bool:
    """Whether each row is a row of a Parquet file, and the same ones come at every run."""

    def simple(plan) -> bool:
        children = plan.children()
        return plan.getClass().getSimpleName() in SIMPLE and all(simple(children.apply(i)) for i in range(children.size()))

    plan = docs._jdf.queryExecution().analyzed()
    return plan.deterministic() and simple(plan)


def located(docs: DataFrame) -> DataFrame:
    """The rows with ``_file`` and ``_row``, the place of each row's content; input columns of those names are replaced.

    Rows that do not come straight from Parquet files (joined, limited, exploded or made up ones) are
    written to the shared folder first, so that a place is one row's and stays so.
    """
    docs = docs.drop("_file", "_row")
    for known in (docs if _plain(docs) else None, None):
        rows = written(docs, "documents") if known is None else known
        place = rows.metadataColumn("_metadata")
        out = rows.select("*", place["file_path"].alias("_file"), place["row_index"].alias("_row"))
        try:
            out.schema  # noqa: B018  analysis happens here
            return out
        except AnalysisException:  # a relation of another format
            continue
    raise ValueError("the rows have no place")


def _digested(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("_digest")
    return df.select(F.col(id_col).alias("_id"), digest, "_file", "_row")


def run_state(spark: SparkSession, arrivals: str) -> DataFrame:
    """Streams the arrivals (_id, _digest, _file, _row) under a folder to their end; the state: digest, group_size and the row that stays.

    The stream has a session of its own, so that the caller's settings stay as they are.
    """
    log, own = scratch(spark, "dedup-log"), spark.newSession()
    for k, v in (STORE | {"spark.sql.shuffle.partitions": str(PER_CORE * spark.sparkContext.defaultParallelism)}).items():
        own.conf.set(k, v)
    rows = own.readStream.schema(spark.read.parquet(arrivals).schema).parquet(arrivals)
    state = rows.groupBy("_digest").agg(F.max(F.struct("_id", "_file", "_row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    query = (
        state.writeStream.outputMode("update")
        .foreachBatch(lambda changed, batch: changed.write.mode("overwrite").parquet(f"{log}/batch={batch}"))
        .option("checkpointLocation", scratch(spark, "dedup-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    try:
        changes = spark.read.parquet(log)
    except AnalysisException:  # no document came
        changes = spark.createDataFrame([], "_digest binary, keep struct<_id: bigint, _file: string, _row: bigint>, group_size bigint, batch int")
    last = changes.groupBy("_digest").agg(F.max("keep").alias("keep"), F.max("group_size").alias("group_size"))  # both only grow
    named = [F.col(f"keep.{a}").alias(b) for a, b in zip(("_id", "_file", "_row"), KEEP, strict=True)]
    return written(last.select("_digest", "group_size", *named), "dedup-groups")


def _false_hits(docs: DataFrame, groups: DataFrame, text_col: str) -> DataFrame:
    """Digests under which rows with other bytes than the kept row's were found."""
    hits = groups.where("group_size > 1").withColumn("_h", F.conv(F.hex(F.substring("_digest", 1, 7)), 16, 10).cast("long"))
    passes = bitfilter.build(hits, "_h")

    def texts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(x or "").encode() for x in part.column(0).to_pylist()]
                digests = [hashlib.sha256(x).digest() for x in raw]
                got = pa.array(passes(np.array([int.from_bytes(d[:7]) for d in digests], np.int64)))
                out = pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(raw, pa.binary()), part.column(1), part.column(2)], names=["_digest", "_bytes", "_file", "_row"])
                yield out.filter(got)

    found = modest(docs.select(text_col, "_file", "_row")).mapInArrow(lean(texts), "_digest binary, _bytes binary, _file string, _row bigint")
    at = hits.select(F.col("_digest").alias("d"), F.col("keep_file").alias("f"), F.col("keep_row").alias("r"))
    kept = found.join(at, F.expr("_digest = d and _file = f and _row = r")).select(F.col("_digest").alias("d"), F.col("_bytes").alias("_kept"))
    # Written before the distinct: an aggregation on the join's key would keep a hot group from being split.
    return written(found.join(kept, F.expr("_digest = d")).where("_bytes <> _kept").select("_digest"), "dedup-unequal").distinct()


def groups_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the row's columns, and which row of its group stays.

    Adds keep_id, group_size (long) and kept (boolean); input columns of those names are replaced.
    Null text counts as empty and empty texts are equal. Of equal texts the row with the largest id
    stays; ids that are equal are told apart by file and row, so that exactly one row of each group
    stays; null ids come last. An empty table gives an empty table.
    """
    spark, added = docs.sparkSession, ("keep_id", "group_size", "kept")
    names = [c for c in docs.columns if c not in added]
    # columns by number, so that none clashes with the operator's own
    rows = located(docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]))
    out = _groups(spark, rows, f"c{names.index(id_col)}", f"c{names.index(text_col)}")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *added)


def _groups(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    landing = scratch(spark, "dedup-arrivals")
    _digested(docs, id_col, text_col).write.parquet(landing)
    groups = run_state(spark, landing)
    false = written(_false_hits(docs, groups, text_col), "dedup-false-hits")
    rows = docs.withColumn("_digest", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    if not false.isEmpty():  # two texts under one digest: their rows are told apart by their whole texts
        rows = rows.join(false.withColumn("_false", F.lit(True)), "_digest", "left")
        rows = rows.withColumn("_digest", F.when(F.col("_false"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")).otherwise(F.col("_digest")))
        apart = rows.where("_false").groupBy("_digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct(F.col(id_col).alias("_id"), "_file", "_row")).alias("keep"))
        named = [F.col(f"keep.{a}").alias(b) for a, b in zip(("_id", "_file", "_row"), KEEP, strict=True)]
        groups = written(groups.join(false, "_digest", "left_anti").unionByName(apart.select("_digest", "group_size", *named)), "dedup-groups")
    return rows.join(groups, "_digest").withColumn("kept", F.expr("_file = keep_file and _row = keep_row"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without copies: of equal texts the row with the largest id stays, all columns kept, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    out = groups_of(plain, f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}").where("kept")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    """op10_exact_dedup."""
    out = groups_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM d WINDOW same AS (PARTITION BY text)
"""
