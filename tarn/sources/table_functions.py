"""Table functions and storage engines as DataFrame readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# File formats of the dialect by Spark's names.
FORMATS = {"parquet": "parquet", "csv": "csv", "csvwithnames": "csv", "tsv": "csv", "tabseparated": "csv", "tsvwithnames": "csv", "tabseparatedwithnames": "csv", "jsoneachrow": "json", "json": "json", "orc": "orc", "lineasstring": "text", "text": "text", "avro": "avro"}
# Engines by what stands behind them.
JDBC_ENGINES = {"MySQL": "mysql", "PostgreSQL": "postgresql"}
FILE_ENGINES = frozenset(["S3", "HDFS", "URL", "File"])


def numbers(session, *bounds: int) -> DataFrame:
    """numbers(n) or numbers(start, n): one column, ``number``."""
    start, n = bounds if len(bounds) == 2 else (0, bounds[0])
    return session.spark.range(start, start + n).select(F.col("id").alias("number"))


def remote(session, address: str, *name: str) -> DataFrame:
    """Another server's table. All servers of a cluster are this one cluster here, so only addresses of it can be read."""
    known = getattr(session, "addresses", None)
    if known is not None and address not in known:
        raise ValueError(f"{address} is not an address of this cluster; read its tables by postgresql, mysql, s3 or file")
    return session.table(tuple(".".join(name).split(".")))


def csv_options(kind: str) -> dict[str, str]:
    """Spark's options for the dialect's formats of separated values; none for other formats."""
    low = kind.lower()
    if FORMATS.get(low) != "csv":
        return {}
    return {"header": str(low.endswith("withnames")).lower(), "sep": "\t" if low.startswith(("tsv", "tabseparated")) else ","}


def files(session, path: str, kind: str = "Parquet", structure: str | None = None, *_) -> DataFrame:
    """Files of a format under a path, or a pattern of paths."""
    name = FORMATS.get(kind.lower())
    if name is None:
        raise ValueError(f"unknown file format {kind}")
    reader = session.spark.read.format(name).options(**csv_options(kind))
    if name == "csv":
        reader = reader.option("inferSchema", structure is None)
    if structure:
        from tarn.sqlfront.ddl import parse_structure
        from tarn.types import struct_of

        reader = reader.schema(struct_of(parse_structure(structure)))
    return reader.load(path)


def jdbc(kind: str):
    def read(session, address: str, database: str, table: str, user: str = "", password: str = "", *_) -> DataFrame:
        return session.spark.read.format("jdbc").options(url=f"jdbc:{kind}://{address}/{database}", dbtable=table, user=user, password=password).load()

    return read


def merged(session, database: str, pattern: str) -> DataFrame:
    """merge(db, pattern): the union of all known tables of a database whose names fit."""
    import re

    found = [n for n in sorted(session.names()) if re.search(pattern, n.rpartition(".")[2]) and n.rpartition(".")[0] in (database, "")]
    if not found:
        raise ValueError(f"no table fits {pattern}")
    out = None
    for name in found:
        df = session.table(tuple(name.split(".")))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


TABLE_FUNCTIONS = {
    "numbers": numbers, "numbers_mt": numbers, "remote": remote, "remotesecure": remote, "cluster": lambda session, name, *rest: remote(session, name, *rest), "clusterallreplicas": lambda session, name, *rest: remote(session, name, *rest),
    "file": files, "s3": files, "s3table": files, "hdfs": files, "url": files, "postgresql": jdbc("postgresql"), "mysql": jdbc("mysql"), "merge": merged,
}
