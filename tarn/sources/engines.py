"""Storage engines that keep no folders of a warehouse's own: files, databases, queues and other tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.catalog import SchemaError, flattened
from tarn.sources import table_functions as tf
from tarn.sqlfront import ast as A
from tarn.types import struct_of

# Options of the queue engine by Spark's names.
KAFKA = {"kafka_broker_list": "kafka.bootstrap.servers", "kafka_topic_list": "subscribe", "kafka_group_name": "groupIdPrefix", "kafka_max_block_size": "maxOffsetsPerTrigger"}
#: Positions of the queue engine's arguments.
KAFKA_ARGS = ("kafka_broker_list", "kafka_topic_list", "kafka_group_name", "kafka_format")


@dataclass
class Source:
    """Where an engine's rows come from and go to."""

    read: Callable[[], DataFrame]
    write: Callable[[DataFrame, bool], None]


def _closed(what: str) -> Callable:
    def write(rows: DataFrame, overwrite: bool) -> None:
        raise SchemaError(f"{what} takes no rows")

    return write


def _values(args) -> list:
    """Arguments as plain values; ``key = value`` ones are left out."""
    out = []
    for x in args or ():
        if isinstance(x, A.Lit):
            out.append(x.value)
        elif isinstance(x, A.Name):
            out.append(".".join(x.parts))
        elif isinstance(x, A.Call) and not x.args:
            out.append(x.name)
    return out


def file_source(warehouse, path: str, kind: str, columns) -> Source:
    """Files of a format under a path; rows are added as further files. A path that does not exist yet is empty."""
    schema = struct_of([c for c in flattened(columns) if c.kind not in ("ALIAS", "EPHEMERAL")]) if columns else None
    if kind.lower() not in tf.FORMATS:
        raise SchemaError(f"unknown file format {kind}")
    options = tf.csv_options(kind)

    def read() -> DataFrame:
        from pyspark.errors import AnalysisException

        reader = warehouse.spark.read.format(tf.FORMATS[kind.lower()]).options(**options)
        try:
            return (reader.schema(schema) if schema is not None else reader).load(path)
        except AnalysisException as e:
            if schema is None or e.getCondition() != "PATH_NOT_FOUND":
                raise
            return warehouse.spark.createDataFrame([], schema)

    def write(rows: DataFrame, overwrite: bool) -> None:
        rows.write.format(tf.FORMATS[kind.lower()]).options(**options).mode("overwrite" if overwrite else "append").save(path)

    return Source(read, write)


def _files(warehouse, engine: A.Call, columns) -> Source:
    """File(format[, path]), S3(path[, key, secret], format), HDFS(path, format), URL(path, format)."""
    args = _values(engine.args)
    kinds = [a for a in args if a.lower() in tf.FORMATS]
    if not kinds:
        raise SchemaError(f"{engine.name}: no known file format among {args}")
    rest = list(args)
    rest.remove(kinds[-1] if engine.name != "File" else kinds[0])
    if not rest:
        raise SchemaError(f"{engine.name}: no path")
    return file_source(warehouse, rest[0], kinds[-1] if engine.name != "File" else kinds[0], columns)


def jdbc_source(warehouse, kind: str, address: str, database: str, table: str, user: str = "", password: str = "", *_) -> Source:
    options = {"url": f"jdbc:{kind}://{address}/{database}", "dbtable": table, "user": user, "password": password}
    return Source(
        lambda: warehouse.spark.read.format("jdbc").options(**options).load(),
        lambda rows, overwrite: rows.write.format("jdbc").options(**options).mode("overwrite" if overwrite else "append").save(),
    )


def mongo_source(warehouse, address: str, database: str, collection: str, user: str = "", password: str = "", *_) -> Source:
    login = f"{user}:{password}@" if user else ""
    options = {"connection.uri": f"mongodb://{login}{address}", "database": database, "collection": collection}
    return Source(
        lambda: warehouse.spark.read.format("mongodb").options(**options).load(),
        lambda rows, overwrite: rows.write.format("mongodb").options(**options).mode("overwrite" if overwrite else "append").save(),
    )


def queue_options(warehouse, name: str) -> tuple[dict[str, str], str]:
    """Options of Spark's own queue source, and the messages' format, from a declared queue table."""
    declared = warehouse.tables[name].declared
    given = dict(zip(KAFKA_ARGS, _values(declared.get("engine").args), strict=False))
    for k, v in declared.get("settings", ()) or ():
        given[k] = v.value if isinstance(v, A.Lit) else str(v)
    return {KAFKA[k]: str(v) for k, v in given.items() if k in KAFKA}, given.get("kafka_format", "JSONEachRow")


def messages(warehouse, name: str, raw: DataFrame) -> DataFrame:
    """Messages (column value) as the table's rows."""
    _, kind = queue_options(warehouse, name)
    schema = struct_of([c for c in flattened(warehouse.tables[name].declared.get("columns", ())) if c.kind not in ("ALIAS", "EPHEMERAL")])
    value = F.col("value").cast("string")
    low = kind.lower()
    if low in ("jsoneachrow", "json"):
        row = F.from_json(value, schema)
    elif low in ("csv", "tsv", "tabseparated"):
        row = F.from_csv(value, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), tf.csv_options(kind))
    else:
        raise SchemaError(f"messages of format {kind} are not read")
    return raw.select(row.alias("r")).select("r.*")


def _kafka(warehouse, name: str) -> Source:
    options, _ = queue_options(warehouse, name)

    def write(rows: DataFrame, overwrite: bool) -> None:
        topic = options["subscribe"]
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.format("kafka").options(**{"kafka.bootstrap.servers": options["kafka.bootstrap.servers"], "topic": topic}).save()

    return Source(lambda: messages(warehouse, name, warehouse.spark.read.format("kafka").options(**options).load()), write)


def stream(warehouse, name: str) -> DataFrame:
    """A queue table's rows as a stream, for ``tarn.streaming.views.feed``."""
    options, _ = queue_options(warehouse, name)
    return messages(warehouse, name, warehouse.spark.readStream.format("kafka").options(**options).load())


def _other(warehouse, target: str, columns: list[str]) -> Source:
    """Another table under this name."""
    return Source(lambda: warehouse._lookup(tuple(target.split("."))).select(*[F.col(f"`{c}`") for c in columns]), lambda rows, overwrite: warehouse.insert(target, rows, overwrite))


def _merge(warehouse, database: str, pattern: str, columns: list[str], own: str) -> Source:
    def read() -> DataFrame:
        names = sorted(n for n in warehouse.tables if n != own and n.rpartition(".")[0] == database and re.search(pattern, n.rpartition(".")[2]))
        if not names:
            raise SchemaError(f"no table of {database} fits {pattern}")
        out = None
        for n in names:
            df = warehouse.read(n)
            df = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in columns])
            out = df if out is None else out.unionByName(df)
        return out

    return Source(read, _closed("a Merge table"))


def of(warehouse, name: str) -> Source | None:
    """The source of a declared table; None for those that the warehouse stores itself."""
    declared = warehouse.tables[name].declared
    function = declared.get("as_source")
    if isinstance(function, A.TableFunction):
        return function_sink(warehouse, function)
    engine = declared.get("engine")
    if engine is None:
        return None
    kind, args = engine.name, _values(engine.args)
    columns = [c.name for c in flattened(declared.get("columns", ())) if c.kind not in ("ALIAS", "EPHEMERAL")]
    if kind in tf.FILE_ENGINES:
        return _files(warehouse, engine, declared.get("columns", ()))
    if kind in tf.JDBC_ENGINES:
        return jdbc_source(warehouse, tf.JDBC_ENGINES[kind], *args)
    if kind == "MongoDB":
        return mongo_source(warehouse, *args)
    if kind == "Kafka":
        return _kafka(warehouse, name)
    if kind == "RabbitMQ":
        raise SchemaError("Spark has no source for RabbitMQ")
    if kind == "Distributed":  # (cluster, database, table[, key])
        return _other(warehouse, ".".join(x for x in args[1:3] if x and x != "currentDatabase"), columns)
    if kind == "Buffer":  # (database, table, ...): rows go straight to the table behind it
        return _other(warehouse, ".".join(x for x in args[:2] if x and x != "currentDatabase"), columns)
    if kind == "Merge":
        return _merge(warehouse, *args[:2], columns, name)
    if kind == "Dictionary":
        return Source(lambda: warehouse.dictionary(args[0]).select(*[F.col(f"`{c}`") for c in columns]), _closed("a dictionary"))
    if kind == "Null":
        schema = struct_of([c for c in flattened(declared.get("columns", ())) if c.kind not in ("ALIAS", "EPHEMERAL")])
        return Source(lambda: warehouse.spark.createDataFrame([], schema), lambda rows, overwrite: warehouse._feed(name, rows))
    return None


def function_sink(warehouse, function: A.TableFunction) -> Source:
    """What a table function reads from and writes to."""
    low, args = function.name.lower(), _values(function.args)
    if low in ("file", "s3", "s3table", "hdfs", "url"):
        from tarn.sqlfront.ddl import parse_structure

        kinds = [a for a in args[1:] if a.lower() in tf.FORMATS]
        structure = next((a for a in args[1:] if a not in kinds and " " in a.strip()), None)
        return file_source(warehouse, args[0], kinds[0] if kinds else "Parquet", parse_structure(structure) if structure else ())
    if low in ("postgresql", "mysql"):
        return jdbc_source(warehouse, low, *args)
    if low in ("remote", "remotesecure", "cluster", "clusterallreplicas"):
        target = ".".join(args[1:])
        return Source(lambda: warehouse._lookup(tuple(target.split("."))), lambda rows, overwrite: warehouse.insert(target, rows, overwrite))
    from tarn.compile import _constant

    make = warehouse.session().table_functions.get(low)
    if make is None:
        raise SchemaError(f"unknown table function {function.name}")
    return Source(lambda: make(warehouse.session(), *[_constant(x) for x in function.args]), _closed(f"table function {function.name}"))

