"""Statements at work on Spark: tables are lists of Parquet folders that are never changed.

A ``Warehouse`` keeps what Spark's catalog has no place for (declared columns, sort keys, which folders
make up a table, views that are materialized, dictionaries, functions, roles, grants, named
collections) as one file of statements beside the data, so that the next process finds it.

Each insert writes one folder, or one for each partition; partitions are dropped, moved, replaced,
attached and frozen by moving names of folders about, and columns are added and dropped on reading.
Only changes of rows, types and names of columns write data anew, in fresh folders, so that readers of
the old ones are not disturbed.
"""

from __future__ import annotations

import json
import urllib.parse
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.catalog import SchemaError, flattened, full_name, resolved
from tarn.compile import Session
from tarn.operators.merge_tree import Merging, latest
from tarn.sources import engines
from tarn.sqlfront import ast as A
from tarn.sqlfront.ast import Stmt
from tarn.sqlfront.ddl import parse, write
from tarn.types import spark_type, struct_of

#: The column that names a row's partition in the folders of a partitioned table.
PART = "_part"


@dataclass
class Stored:
    """One table: its declaration and where its rows are, as (partition, folder)."""

    declared: Stmt
    parts: list[tuple[str, str]] = field(default_factory=list)
    attached: bool = True
    detached: dict[str, list[str]] = field(default_factory=dict)
    #: Columns dropped from the declaration that folders still hold.
    dropped: set[str] = field(default_factory=set)
    #: Columns that came later than some folder.
    late: set[str] = field(default_factory=set)


class Shelf:
    """Small text files under a root that driver and executors' storage shares, by Spark's own file access."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if "://" not in name and not name.startswith("/") else name)

    def write(self, name: str, text: str) -> None:
        """The file's whole content, in place at once."""
        fresh = self._path(f"{name}.{uuid.uuid4().hex}")
        out = self.fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.delete(self._path(name), False)
        if not self.fs.rename(fresh, self._path(name)):
            raise OSError(f"cannot write {self.root}/{name}")

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def folders(self, path: str) -> list[str]:
        return [f.getPath().toString() for f in self.fs.listStatus(self._path(path)) if f.isDirectory()]

    def drop(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


@dataclass
class Warehouse:
    """Databases, tables and all else that statements declare, under a root folder; in memory alone without one."""

    spark: SparkSession
    root: str = ""
    databases: dict[str, dict] = field(default_factory=dict)
    tables: dict[str, Stored] = field(default_factory=dict)
    views: dict[str, Stmt] = field(default_factory=dict)
    dictionaries: dict[str, Stmt] = field(default_factory=dict)
    functions: dict[str, A.Lambda] = field(default_factory=dict)
    collections: dict[str, Stmt] = field(default_factory=dict)
    roles: dict[str, dict] = field(default_factory=dict)
    grants: set[tuple] = field(default_factory=set)
    session_roles: dict[str, tuple] = field(default_factory=dict)
    frozen: dict[str, list] = field(default_factory=dict)
    aside: dict[str, Stmt] = field(default_factory=dict)
    shelf: Shelf | None = None

    STATE = "declared.json"

    def __post_init__(self) -> None:
        if self.root and self.shelf is None:
            self.shelf = Shelf(self.spark, self.root)
            if (text := self.shelf.read(self.STATE)) is not None:
                self._load(json.loads(text))

    def run_script(self, text: str) -> list[DataFrame]:
        """All statements in turn; the frames of its queries."""
        return [x for x in (self.run(s) for s in parse(text)) if x is not None]

    def run(self, s: Stmt) -> DataFrame | None:
        """One statement; what it declares is on the shelf when it returns."""
        if s.kind == "SELECT":
            return self.session().run(s.get("select"))
        own = self._attachment if s.kind.startswith(("ATTACH ", "DETACH ")) else getattr(self, "_" + s.kind.lower().replace(" ", "_"), None)
        if own is None:
            raise NotImplementedError(s.kind)
        try:
            return own(s)
        finally:
            self.save()

    # What is kept between processes

    def save(self) -> None:
        if self.shelf is None:
            return
        functions = [write(A.stmt("CREATE FUNCTION", (n,), body=f)) for n, f in self.functions.items()]
        roles = [write(A.stmt("CREATE ROLE", (n,), settings=tuple(r.items()))) if r else write(A.stmt("CREATE ROLE", (n,))) for n, r in self.roles.items()]
        state = {
            "databases": {n: {**d, "engine": None if d["engine"] is None else write(A.stmt("CREATE DATABASE", (n,), engine=d["engine"]))} for n, d in self.databases.items()},
            "tables": {n: {"declared": write(t.declared), "parts": t.parts, "attached": t.attached, "detached": t.detached, "dropped": sorted(t.dropped), "late": sorted(t.late)} for n, t in self.tables.items()},
            "views": {n: write(x) for n, x in self.views.items()}, "dictionaries": {n: write(x) for n, x in self.dictionaries.items()},
            "functions": functions, "collections": {n: write(x) for n, x in self.collections.items()}, "roles": roles,
            "grants": sorted(self.grants, key=repr), "session_roles": self.session_roles, "frozen": self.frozen, "aside": {n: write(x) for n, x in self.aside.items()},
        }
        self.shelf.write(self.STATE, json.dumps(state, ensure_ascii=False, indent=1))

    def _load(self, state: dict) -> None:
        def one(text: str) -> Stmt:
            return parse(text)[0]

        def tuples(x):
            return tuple(map(tuples, x)) if isinstance(x, list) else x

        self.databases = {n: {**d, "engine": None if d["engine"] is None else one(d["engine"]).get("engine")} for n, d in state["databases"].items()}
        self.tables = {n: Stored(one(t["declared"]), [tuple(p) for p in t["parts"]], t["attached"], t["detached"], set(t["dropped"]), set(t["late"])) for n, t in state["tables"].items()}
        self.views = {n: one(x) for n, x in state["views"].items()}
        self.dictionaries = {n: one(x) for n, x in state["dictionaries"].items()}
        self.functions = {f.name[0]: f.get("body") for f in map(one, state["functions"])}
        self.collections = {n: one(x) for n, x in state["collections"].items()}
        self.roles = {r.name[0]: dict(r.get("settings", ())) for r in map(one, state["roles"])}
        self.grants = set(tuples(state["grants"]))
        self.session_roles = {n: tuples(r) for n, r in state["session_roles"].items()}
        self.frozen = state["frozen"]
        self.aside = {n: one(x) for n, x in state["aside"].items()}

    # Reading

    def session(self) -> Session:
        out = Session(self.spark, functions=self.functions)
        out.table = self._lookup  # names are resolved when a query needs them
        out.merging = lambda parts: self.merging(full_name(parts))
        out.names = lambda: [*self.tables, *self.views, *self.dictionaries]
        return out

    def _lookup(self, parts: tuple[str, ...]) -> DataFrame:
        name = full_name(parts)
        if name in self.tables:
            return self.read(name)
        if name in self.views:
            view = self.views[name]
            return self.materialized(name, final=False) if view.get("materialized") else self.session().run(view.get("select"))
        if name in self.dictionaries:
            return self.dictionary(name)
        return self.spark.table(".".join(f"`{p}`" for p in parts))

    def merging(self, name: str) -> Merging:
        """How a table's engine merges rows: prefix and path of replicas left out."""
        t = self.tables[name]
        engine = t.declared.get("engine")
        if engine is None:
            return Merging("MergeTree", [])
        args = [x for x in engine.args or () if not (isinstance(x, A.Lit) and x.kind == "string")]
        names = [n.parts[-1] for x in args for n in (x.items if isinstance(x, A.Tuple) else [x]) if isinstance(n, A.Name)]
        states = {}
        for c in _columns(t.declared):
            if c.type is not None and c.type.name in ("AggregateFunction", "SimpleAggregateFunction"):
                states[c.name] = c.type.args[0].name if isinstance(c.type.args[0], A.Type) else c.type.args[0].parts[-1]
        return Merging(engine.name.removeprefix("Replicated").removeprefix("Shared"), _key_columns(t.declared.get("order_by")), names, states)

    def stored_columns(self, name: str) -> list[A.Column]:
        return [c for c in _columns(self.tables[name].declared) if c.kind not in ("ALIAS", "EPHEMERAL")]

    def raw(self, name: str, parts: list[tuple[str, str]] | None = None) -> DataFrame:
        """The stored columns of a table, or of some of its folders; columns that a folder does not have get their defaults."""
        t, columns = self.tables[name], self.stored_columns(name)
        schema = struct_of(columns)
        for f in schema.fields:
            f.nullable = True
        paths = [p for _, p in (t.parts if parts is None else parts)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*paths)
        filled = []
        for c in columns:
            x = F.col(f"`{c.name}`")
            if c.name in t.late and c.type.name != "Nullable":  # others are read as they are, so that filters reach the files
                x = F.coalesce(x, self._default(c))
            filled.append(x.alias(c.name))
        return df.select(*filled)

    def _default(self, c: A.Column) -> Column | None:
        """What stands where a column was not given; None where nothing can."""
        kind = spark_type(c.type)
        if c.expr is not None:
            return self._expr(c.expr).cast(kind)
        return F.lit(None).cast(kind) if c.type.name == "Nullable" else _zero(kind).cast(kind)

    def read(self, name: str, final: bool = False) -> DataFrame:
        """A table's rows: computed columns added, rows past their lifetime left out; ``final`` merges by key."""
        t = self.tables.get(name)
        if t is None or not t.attached:
            raise SchemaError(f"table {name} does not exist")
        columns = _columns(t.declared)
        source = engines.of(self, name)
        df = self.raw(name) if source is None else source.read()
        for c in columns:
            if c.kind == "ALIAS":
                df = df.withColumn(c.name, self._expr(c.expr).cast(spark_type(c.type)) if c.type else self._expr(c.expr))
        for x in t.declared.get("ttl", None) or ():
            if x.get("action", "") in ("", "DELETE"):
                gone = self._expr(x.get("expr")) <= F.localtimestamp()
                if x.get("where") is not None:
                    gone = gone & self._expr(x.get("where"))
                df = df.where(~F.coalesce(gone, F.lit(False)))
        df = df.select(*[F.col(f"`{c.name}`") for c in columns if c.kind != "EPHEMERAL"])
        return self.merging(name)(df) if final else df

    def _expr(self, e: A.Node) -> Column:
        return F.expr(self.text(e))

    def text(self, e: A.Node) -> str:
        from tarn.compile import SparkText

        return SparkText(self.functions)(e)

    # Writing

    def insert(self, name: str, df: DataFrame, overwrite: bool = False) -> None:
        """Appends rows: defaults and computed columns are filled in, rows clustered by partition and sorted, constraints checked.

        The plan of ``df`` runs once: constraints and views see the rows as they were written.
        """
        t = self.tables[name]
        columns, given = _columns(t.declared), set(df.columns)
        for c in columns:
            kind = spark_type(c.type) if c.type is not None else None
            if c.kind == "MATERIALIZED":
                df = df.withColumn(c.name, self._expr(c.expr).cast(kind) if kind else self._expr(c.expr))
            elif c.name not in given and c.kind != "ALIAS":
                df = df.withColumn(c.name, self._default(c))
        kept = self.stored_columns(name)
        rows = df.select(*[F.col(f"`{c.name}`").cast(spark_type(c.type)).alias(c.name) if c.type is not None else F.col(f"`{c.name}`") for c in kept])
        source = engines.of(self, name)
        if source is not None:
            source.write(rows, overwrite)
            return
        if not self.root:
            raise SchemaError("a warehouse without a root folder holds no rows")
        new = self._written(name, rows)
        stored = self.raw(name, new)
        for x in t.declared.get("constraints", None) or ():
            if not stored.where(~F.coalesce(self._expr(x.get("check")), F.lit(False))).isEmpty():
                for path in {p for _, p in new}:
                    self.shelf.drop(path)
                raise SchemaError(f"{name}: rows against constraint {x.name[0]}")
        t.parts = new if overwrite else [*t.parts, *new]
        self.save()
        if not overwrite:
            self._feed(name, stored)

    def _written(self, name: str, rows: DataFrame) -> list[tuple[str, str]]:
        """The rows in a fresh folder: (partition, folder) of each partition."""
        t, path = self.tables[name], self._fresh(name)
        keys = [k for k in _key_columns(t.declared.get("order_by")) if k in rows.columns]
        by = self._partition_key(t)
        if by is None:
            (rows.sortWithinPartitions(*keys) if keys else rows).write.parquet(path)
            return [("", path)]
        rows = rows.withColumn(PART, by).hint("rebalance", F.col(PART)).sortWithinPartitions(PART, *keys)  # large partitions are split
        rows.write.partitionBy(PART).parquet(path)
        found = [f for f in self.shelf.folders(path) if f.rpartition("/")[2].startswith(f"{PART}=")]
        return sorted((urllib.parse.unquote(f.rpartition("=")[2]), f) for f in found)

    def _partition_key(self, t: Stored) -> Column | None:
        """The text that names a row's partition: the values of its key with dashes between them."""
        by = t.declared.get("partition_by")
        if not by:
            return None
        items = by[0].items if len(by) == 1 and isinstance(by[0], A.Tuple) else by
        return self._named([self._expr(x) for x in items]) if items else None

    @staticmethod
    def _named(values: list[Column]) -> Column:
        def one(x: Column) -> Column:
            text = F.coalesce(x.cast("string"), F.lit("NULL"))
            return F.when(text == "", "''").otherwise(text)

        return F.concat_ws("-", *map(one, values))

    def _key_of(self, t: Stored, value: A.Node | None) -> str:
        """The partition that a statement names."""
        if isinstance(value, A.Call) and value.name.upper() == "ID":
            return str(value.args[0].value)
        by = t.declared.get("partition_by")
        items = value.items if isinstance(value, A.Tuple) else (value,)
        keys = (by[0].items if isinstance(by[0], A.Tuple) else by) if by else ()
        if not keys or not items or value is None:
            return ""
        # a key that is a column takes the column's type, so that a date is written like one
        kinds = {c.name: spark_type(c.type) for c in self.stored_columns(full_name(t.declared.name)) if c.type is not None} if full_name(t.declared.name) in self.tables else {}
        values = [self._expr(x).cast(kinds[k.parts[-1]]) if isinstance(k, A.Name) and k.parts[-1] in kinds else self._expr(x) for k, x in zip(keys, items, strict=True)]
        return self.spark.range(1).select(self._named(values).alias("k")).first()["k"]

    def partitions(self, name: str) -> DataFrame:
        """(partition, folders) of a table."""
        found: dict[str, int] = {}
        for k, _ in self.tables[name].parts:
            found[k] = found.get(k, 0) + 1
        return self.spark.createDataFrame(sorted(found.items()), "partition string, folders int")

    def read_partition(self, name: str, partition: str) -> DataFrame:
        """The rows of one partition: only its folders are listed and read."""
        return self.raw(name, [p for p in self.tables[name].parts if p[0] == partition])

    def _feed(self, name: str, rows: DataFrame) -> None:
        """Materialized views that read the table get what their query makes of the new rows."""
        for view in list(self.views.values()):
            if view.get("materialized") and isinstance(view.get("select").from_, A.Table) and full_name(view.get("select").from_.parts) == name:
                inner = self.session()
                outer = inner.table
                inner.table = lambda parts, outer=outer: rows if full_name(parts) == name else outer(parts)
                self._into_view(view, inner.run(view.get("select")))

    def _into_view(self, view: Stmt, rows: DataFrame, overwrite: bool = False) -> None:
        """A view's rows to where it keeps them: a table of its own, a named one, or what a table function writes to."""
        to = view.get("to")
        if isinstance(to, A.TableFunction):
            engines.function_sink(self, to).write(rows, overwrite)
        else:
            self.insert(self._view_target(view), rows, overwrite)

    def _view_target(self, view: Stmt) -> str:
        return full_name(view.get("to").parts) if isinstance(view.get("to"), A.Table) else f"{full_name(view.name)}.inner"

    def _rewrite(self, name: str, df: DataFrame) -> None:
        """The table's rows from now on, in fresh folders."""
        t = self.tables[name]
        stored = [c.name for c in self.stored_columns(name)]
        t.parts = self._written(name, df.select(*[F.col(f"`{c}`") for c in stored if c in df.columns]))
        t.dropped, t.late = set(), set()

    def _fresh(self, name: str) -> str:
        return f"{self.root}/{urllib.parse.quote(name.replace('.', '/'))}/{uuid.uuid4().hex}"

    # Databases

    def _comment(self, s: Stmt) -> None:
        return None

    def _create_database(self, s: Stmt) -> None:
        if s.name[0] in self.databases:
            if s.get("if_not_exists"):
                return
            raise SchemaError(f"database {s.name[0]} exists")
        self.databases[s.name[0]] = {"comment": s.get("comment") or "", "engine": s.get("engine"), "attached": True}

    def _alter_database(self, s: Stmt) -> None:
        self.databases[s.name[0]]["comment"] = s.get("comment")

    def _drop_database(self, s: Stmt) -> None:
        if s.name[0] not in self.databases:
            if s.get("if_exists"):
                return
            raise SchemaError(f"database {s.name[0]} does not exist")
        del self.databases[s.name[0]]
        for held in (self.tables, self.views, self.dictionaries):
            for n in [n for n in held if n.startswith(f"{s.name[0]}.")]:
                del held[n]

    def _rename_database(self, s: Stmt) -> None:
        for (a,), (b,) in s.get("pairs"):
            self.databases[b] = self.databases.pop(a)
            for held in (self.tables, self.views, self.dictionaries):
                for n in [n for n in held if n.startswith(f"{a}.")]:
                    held[b + n[len(a) :]] = held.pop(n)

    def _attachment(self, s: Stmt) -> None:
        verb, kind = s.kind.split(" ", 1)
        on, name = verb == "ATTACH", full_name(s.name)
        if kind == "TABLE":
            if name not in self.tables and not s.get("if_exists"):
                raise SchemaError(f"table {name} does not exist")
            self.tables[name].attached = on
        elif kind == "DATABASE":
            self.databases.setdefault(name, {"comment": "", "engine": s.get("engine")})["attached"] = on
        else:
            held = self.views if kind == "VIEW" else self.dictionaries
            aside = f"{kind}:{name}"
            if on and aside in self.aside:
                held[name] = self.aside.pop(aside)
            elif not on and name in held:
                self.aside[aside] = held.pop(name)

    # Tables

    def _create_table(self, s: Stmt) -> None:
        name = full_name(s.name)
        if name in self.tables and not s.get("or_replace"):
            if s.get("if_not_exists"):
                return
            raise SchemaError(f"table {name} exists")
        source = s.get("as_source")
        if isinstance(source, A.Table):
            base = resolved({full_name(source.parts): self.tables[full_name(source.parts)].declared, name: s})
            s = base[name].having(as_source=None)
        rows = None
        if s.get("select") is not None:
            rows = self.session().run(s.get("select"))
        elif isinstance(source, A.TableFunction):
            from tarn.compile import _constant

            rows = self.session().table_functions[source.name.lower()](self.session(), *[_constant(x) for x in source.args])
            s = s.having(as_source=source)
        if rows is not None and not s.get("columns"):
            s = s.having(columns=tuple(A.Column(f.name, _declared(f.dataType, f.nullable)) for f in rows.schema.fields))
        self.tables[name] = Stored(s)
        if rows is not None and s.get("select") is not None:
            self.insert(name, rows)

    def _drop_table(self, s: Stmt) -> None:
        name = full_name(s.name)
        if name in self.views:  # a materialized view is dropped as a table
            del self.views[name]
            self.tables.pop(f"{name}.inner", None)
        elif name in self.tables:
            del self.tables[name]
        elif not s.get("if_exists"):
            raise SchemaError(f"table {name} does not exist")

    def _rename_table(self, s: Stmt) -> None:
        for a, b in s.get("pairs"):
            held = self.tables if full_name(a) in self.tables else self.views
            held[full_name(b)] = held.pop(full_name(a))

    def _alter_table(self, s: Stmt) -> None:
        name = full_name(s.name)
        if name not in self.tables:
            if s.get("if_exists"):
                return
            raise SchemaError(f"table {name} does not exist")
        for o in s.get("ops"):
            self._alter(name, o)

    def _alter(self, name: str, o: Stmt) -> None:
        t = self.tables[name]
        columns = list(t.declared.get("columns", ()))
        at = {c.name: i for i, c in enumerate(columns)}
        k = o.kind

        def declare(**clauses) -> None:
            t.declared = t.declared.having(**clauses)

        def placed(column: A.Column, others: list) -> None:
            i = 0 if o.get("first") else [c.name for c in others].index(o.get("after")) + 1 if o.get("after") else at.get(column.name, len(others))
            declare(columns=tuple([*others[:i], column, *others[i:]]))

        if k == "ADD COLUMN":
            c = o.get("column")
            if c.name in at:
                if o.get("if_not_exists"):
                    return
                raise SchemaError(f"{name}: column {c.name} exists")
            if c.name in t.dropped:  # folders still hold the rows of the one before
                self._rewrite(name, self.raw(name))
            placed(c, columns)
            if t.parts:
                t.late.add(c.name)
            if c.expr is not None and c.type.name == "Nullable" and c.kind not in ("ALIAS", "EPHEMERAL") and t.parts:
                self._rewrite(name, self.raw(name).withColumn(c.name, self._default(c)))  # a null that was not given cannot be told from one that was
        elif k == "DROP COLUMN":
            if o.name[0] not in at:
                if o.get("if_exists"):
                    return
                raise SchemaError(f"{name}: no column {o.name[0]}")
            keys = [x for c in ("order_by", "partition_by", "primary_key", "sample_by") for x in _listed(t.declared.get(c))]
            if any(isinstance(n, A.Name) and n.parts[-1] == o.name[0] for x in keys for n in A.walk(x)):
                raise SchemaError(f"{name}: column {o.name[0]} is part of a key")
            declare(columns=tuple(c for c in columns if c.name != o.name[0]))
            t.dropped.add(o.name[0])
            t.late.discard(o.name[0])
        elif k == "MODIFY COLUMN":
            c = o.get("column")
            if c.name not in at:
                if o.get("if_exists"):
                    return
                raise SchemaError(f"{name}: no column {c.name}")
            old = columns[at[c.name]]
            new = replace(old, type=c.type or old.type, kind=c.kind or old.kind, expr=c.expr if c.kind else old.expr, codec=c.codec or old.codec, ttl=c.ttl or old.ttl, comment=c.comment or old.comment)
            removed = o.get("remove", "")
            if removed in ("DEFAULT", "MATERIALIZED", "ALIAS", "EPHEMERAL"):
                new = replace(new, kind="", expr=None)
            elif removed:
                new = replace(new, **{removed.lower(): () if removed == "CODEC" else None})
            rows = self.raw(name)
            others = [x for x in columns if x.name != c.name]
            placed(new, others)
            if new.type != old.type and new.kind not in ("ALIAS", "EPHEMERAL"):
                self._rewrite(name, rows.withColumn(c.name, F.col(f"`{c.name}`").cast(spark_type(new.type))))
        elif k == "RENAME COLUMN":
            if o.name[0] not in at and o.get("if_exists"):
                return
            rows = self.raw(name)
            declare(columns=tuple(replace(c, name=o.get("to")) if c.name == o.name[0] else c for c in columns))
            self._rewrite(name, rows.withColumnRenamed(o.name[0], o.get("to")))
        elif k == "COMMENT COLUMN":
            declare(columns=tuple(replace(c, comment=o.get("comment")) if c.name == o.name[0] else c for c in columns))
        elif k == "CLEAR COLUMN":
            key = self._key_of(t, o.get("partition")) if o.get("partition") is not None else None
            inside = [p for p in t.parts if key is None or p[0] == key]
            if inside:
                cleared = self.raw(name, inside).withColumn(o.name[0], self._default(columns[at[o.name[0]]]))
                t.parts = [p for p in t.parts if p not in inside] + self._written(name, cleared)
        elif k == "UPDATE":
            c, rows = columns[at[o.name[0]]], self.raw(name)
            new = self._expr(o.get("value")).cast(spark_type(c.type))
            hit = F.coalesce(self._expr(o.get("where")), F.lit(False)) if o.get("where") is not None else F.lit(True)
            self._rewrite(name, rows.withColumn(c.name, F.when(hit, new).otherwise(F.col(f"`{c.name}`"))))
        elif k == "DELETE":
            self._rewrite(name, self.raw(name).where(~F.coalesce(self._expr(o.get("where")), F.lit(False))))
        elif k == "FREEZE":
            key = self._key_of(t, o.get("partition")) if o.get("partition") is not None else None
            self.frozen[o.get("with_name") or uuid.uuid4().hex] = [list(p) for p in t.parts if key is None or p[0] == key]
        elif k.endswith(" PARTITION"):
            self._partition(name, o, k.split(" ")[0])
        elif k == "MODIFY TTL":
            declare(ttl=o.get("ttl"))
        elif k == "DELETE TTL":
            declare(ttl=None)
        elif k == "ADD INDEX":
            declare(indexes=(*t.declared.get("indexes", ()), o.get("index")))
        elif k == "ADD CONSTRAINT":
            declare(constraints=(*t.declared.get("constraints", ()), o.get("constraint")))
        elif k == "ADD PROJECTION":
            declare(projections=(*t.declared.get("projections", ()), o.get("projection")))
        elif k in ("DROP INDEX", "DROP CONSTRAINT", "DROP PROJECTION"):
            key = {"DROP INDEX": "indexes", "DROP CONSTRAINT": "constraints", "DROP PROJECTION": "projections"}[k]
            declare(**{key: tuple(x for x in t.declared.get(key, ()) if x.name != o.name)})
        elif k == "MODIFY ORDER BY":
            declare(order_by=o.get("keys"))
        elif k == "MODIFY SAMPLE BY":
            declare(sample_by=o.get("key"))
        elif k == "REMOVE SAMPLE BY":
            declare(sample_by=None)
        elif k == "MODIFY SETTING":
            declare(settings=tuple((dict(t.declared.get("settings", ())) | dict([o.get("setting")])).items()))
        elif k == "RESET SETTING":
            declare(settings=tuple(x for x in t.declared.get("settings", ()) if x[0] != o.name[0]))
        else:
            raise NotImplementedError(k)

    def _partition(self, name: str, o: Stmt, verb: str) -> None:
        """Folders of one partition change hands; no row is read or written."""
        t = self.tables[name]
        key = self._key_of(t, o.get("partition"))
        mine, others = [p for p in t.parts if p[0] == key], [p for p in t.parts if p[0] != key]
        source = o.get("source")
        if verb in ("ATTACH", "REPLACE") and source:
            other = self.tables[full_name(source)]
            given = [p for p in other.parts if p[0] == key]
            t.late |= other.late | ({c.name for c in self.stored_columns(name)} - {c.name for c in self.stored_columns(full_name(source))})
            t.parts = (others if verb == "REPLACE" else t.parts) + given
        elif verb == "DROP":
            t.parts = others
        elif verb == "DETACH":
            t.detached[key], t.parts = [*t.detached.get(key, []), *[p for _, p in mine]], others
        elif verb == "ATTACH":
            if key not in t.detached:
                raise SchemaError(f"{name}: no detached partition {key}")
            t.parts = t.parts + [(key, p) for p in t.detached.pop(key)]
        elif verb == "FETCH":  # from where another warehouse, or a backup, keeps the partition's folder
            t.detached.setdefault(key, []).append(source[0])
            t.late |= {c.name for c in self.stored_columns(name)}  # what it holds is not known
        elif verb == "MOVE":
            if o.get("medium") == "TABLE":
                to = self.tables[full_name(o.get("to"))]
                to.late |= t.late
                to.parts = to.parts + mine
                t.parts = others
        else:
            raise NotImplementedError(f"{verb} PARTITION")

    # Views

    def _create_view(self, s: Stmt) -> None:
        name = full_name(s.name)
        if name in self.views and not s.get("or_replace"):
            if s.get("if_not_exists"):
                return
            raise SchemaError(f"view {name} exists")
        self.views[name] = s
        if s.get("materialized") and s.get("to") is None:
            rows = self.session().run(s.get("select"))
            columns = s.get("columns") or tuple(A.Column(f.name, _declared(f.dataType, f.nullable)) for f in rows.schema.fields)
            inner = A.stmt("CREATE TABLE", (*s.name, "inner"), columns=columns, engine=s.get("engine"), order_by=s.get("order_by"), partition_by=s.get("partition_by"))
            self.run(inner)
        if s.get("materialized") and s.get("populate"):
            self._into_view(s, self.session().run(s.get("select")))

    def _drop_view(self, s: Stmt) -> None:
        if self.views.pop(full_name(s.name), None) is None and not s.get("if_exists"):
            raise SchemaError(f"view {full_name(s.name)} does not exist")
        self.tables.pop(f"{full_name(s.name)}.inner", None)

    def materialized(self, name: str, final: bool = True) -> DataFrame:
        """What a materialized view holds, merged as its engine does; rows of an engine that does not merge all stay."""
        view = self.views[name]
        if isinstance(view.get("to"), A.TableFunction):
            return engines.function_sink(self, view.get("to")).read()
        return self.read(self._view_target(view), final=final)

    def refresh(self, name: str) -> None:
        """The view's query over all that its tables hold now, in place of what it held."""
        self._into_view(self.views[name], self.session().run(self.views[name].get("select")), overwrite=True)

    # Dictionaries

    def _create_dictionary(self, s: Stmt) -> None:
        name = full_name(s.name)
        if name in self.dictionaries and not s.get("or_replace"):
            if s.get("if_not_exists"):
                return
            raise SchemaError(f"dictionary {name} exists")
        self.dictionaries[name] = s

    def _drop_dictionary(self, s: Stmt) -> None:
        if self.dictionaries.pop(full_name(s.name), None) is None and not s.get("if_exists"):
            raise SchemaError(f"dictionary {full_name(s.name)} does not exist")

    def _rename_dictionary(self, s: Stmt) -> None:
        for a, b in s.get("pairs"):
            self.dictionaries[full_name(b)] = self.dictionaries.pop(full_name(a))

    def dictionary(self, name: str) -> DataFrame:
        """A dictionary's rows: one per key, from a table, a file or a URL that Spark can read."""
        s = self.dictionaries[name]
        source = s.get("source")
        params = {k.lower(): v for k, v in source.get("params", ()) if not isinstance(v, Stmt)}

        def text(key: str) -> str:
            v = params.get(key)
            return "" if v is None else v.value if isinstance(v, A.Lit) else ".".join(v.parts)

        kind = source.name[0].upper()
        address = f"{text('host') or 'localhost'}:{text('port')}".rstrip(":")
        if kind in ("MYSQL", "POSTGRESQL"):
            rows = engines.jdbc_source(self, kind.lower(), address, text("db"), text("table"), text("user"), text("password")).read()
        elif kind == "MONGODB":
            rows = engines.mongo_source(self, address, text("db"), text("collection"), text("user"), text("password")).read()
        elif text("table"):  # the engine's own server, or another of the cluster
            rows = self._lookup(tuple(x for x in (text("db"), text("table")) if x))
        elif kind in ("FILE", "HTTP", "S3"):
            from tarn.sources.table_functions import files

            rows = files(self.session(), text("path") or text("url"), text("format") or "CSV", ", ".join(f"`{a.name[0]}` {_shown(a.get('type'))}" for a in s.get("columns")))
        else:
            raise NotImplementedError(f"dictionary source {kind}")
        columns = []
        for a in s.get("columns"):
            value = F.col(f"`{a.name[0]}`") if a.name[0] in rows.columns else self._expr(a.get("expression") or a.get("default"))
            if a.get("default") is not None and a.name[0] in rows.columns:
                value = F.coalesce(value, self._expr(a.get("default")))
            columns.append(value.cast(spark_type(a.get("type"))).alias(a.name[0]))
        rows = rows.select(*columns)
        keys = list(s.get("primary_key", ()))
        return latest(rows, keys) if keys else rows

    def lookup(self, df: DataFrame, name: str, on: dict[str, str], attributes: list[str]) -> DataFrame:
        """``df`` with a dictionary's attributes; ``on`` maps its keys to columns of ``df``; unknown keys give nulls."""
        found = self.dictionary(name).select(*[F.col(k).alias(f"_d_{k}") for k in on], *attributes)
        cond = None
        for k, c in on.items():
            one = df[c] == found[f"_d_{k}"]
            cond = one if cond is None else cond & one
        return df.join(found, cond, "left").drop(*[f"_d_{k}" for k in on])

    # Functions, collections, roles

    def _create_function(self, s: Stmt) -> None:
        if s.name[0] in self.functions and s.get("if_not_exists"):
            return
        self.functions[s.name[0]] = s.get("body")

    def _drop_function(self, s: Stmt) -> None:
        if self.functions.pop(s.name[0], None) is None and not s.get("if_exists"):
            raise SchemaError(f"function {s.name[0]} does not exist")

    def _create_named_collection(self, s: Stmt) -> None:
        if s.name[0] in self.collections and s.get("if_not_exists"):
            return
        self.collections[s.name[0]] = A.stmt("CREATE NAMED COLLECTION", s.name, items=s.get("items"))

    def _alter_named_collection(self, s: Stmt) -> None:
        if s.name[0] not in self.collections:
            if s.get("if_exists"):
                return
            raise SchemaError(f"named collection {s.name[0]} does not exist")
        held = {x[0]: x for x in self.collections[s.name[0]].get("items")}
        held.update({x[0]: x for x in s.get("sets", ())})
        for k in s.get("deletes", ()):
            held.pop(k, None)
        self.collections[s.name[0]] = self.collections[s.name[0]].having(items=tuple(held.values()))

    def named(self, name: str) -> dict:
        """The values of a named collection."""
        return {k: v.value if isinstance(v, A.Lit) else v for k, v, *_ in self.collections[name].get("items")}

    def _drop_named_collection(self, s: Stmt) -> None:
        if self.collections.pop(s.name[0], None) is None and not s.get("if_exists"):
            raise SchemaError(f"named collection {s.name[0]} does not exist")

    def _create_role(self, s: Stmt) -> None:
        if s.name[0] in self.roles and s.get("if_not_exists"):
            return
        self.roles[s.name[0]] = dict(s.get("settings", ()))

    def _alter_role(self, s: Stmt) -> None:
        if s.get("settings") or s.get("no_settings"):
            self.roles[s.name[0]] = dict(s.get("settings", ()))
        if s.get("rename_to"):
            self.roles[s.get("rename_to")] = self.roles.pop(s.name[0])

    def _drop_role(self, s: Stmt) -> None:
        for n in s.name:
            if self.roles.pop(n, None) is None and not s.get("if_exists"):
                raise SchemaError(f"role {n} does not exist")

    def _set_role(self, s: Stmt) -> None:
        self.session_roles["current"] = (s.get("mode", ""), s.get("roles", ()))

    def _set_default_role(self, s: Stmt) -> None:
        for u in s.get("to"):
            self.session_roles[u] = (s.get("mode", ""), s.get("roles", ()))

    def _grant(self, s: Stmt) -> None:
        option = bool({"GRANT", "ADMIN"} & set(s.get("options", ())))
        for g in s.get("grantees"):
            if "REPLACE" in s.get("options", ()):
                self.grants = {x for x in self.grants if x[0] != g}
            self.grants |= {(g, p.upper(), cs, s.get("target"), option) for p, cs in s.get("privileges")}

    def _revoke(self, s: Stmt) -> None:
        for g in s.get("grantees"):
            for p, cs in s.get("privileges"):
                hit = {x for x in self.grants if x[0] == g and x[1] == p.upper() and x[3] == s.get("target") and (not cs or x[2] == cs)}
                self.grants -= hit
                if s.get("option"):
                    self.grants |= {(*x[:4], False) for x in hit}

    # The catalog's own relations

    def catalog_tables(self) -> DataFrame:
        """(database, name, engine) of tables in sight, without those inside views."""
        rows = [(*([n.rpartition(".")[0], n.rpartition(".")[2]]), t.declared.get("engine").name if t.declared.get("engine") is not None else "") for n, t in self.tables.items() if t.attached and not n.endswith(".inner")]
        return self.spark.createDataFrame(rows, "database string, name string, engine string")


def _columns(s: Stmt) -> tuple[A.Column, ...]:
    return flattened(s.get("columns", ()))


def _key_columns(keys: tuple | None) -> list[str]:
    if not keys:
        return []
    items = keys[0].items if isinstance(keys[0], A.Tuple) else keys
    return [x.parts[-1] for x in items if isinstance(x, A.Name)]


def _listed(keys) -> tuple:
    return () if keys is None else keys if isinstance(keys, tuple) else (keys,)


def _zero(kind) -> Column:
    """What a column that is not nullable holds where nothing is given."""
    name = kind.simpleString() if kind is not None else "string"
    if name == "string":
        return F.lit("")
    if name.startswith(("array", "map")):
        return F.expr("array()" if name.startswith("array") else "map()")
    if name == "boolean":
        return F.lit(False)
    if name == "date":
        return F.lit("1970-01-01")
    if name.startswith("timestamp"):
        return F.lit("1970-01-01 00:00:00")
    return F.lit(None) if name.startswith(("struct", "binary")) else F.lit(0)


def _shown(t: A.Type) -> str:
    from tarn.sqlfront.render import render

    return render(t)


# Spark's type names by the dialect's.
_FROM_SPARK = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "String", "boolean": "Bool", "date": "Date", "timestamp": "DateTime", "timestamp_ntz": "Timestamp_NTZ"}


def _declared(kind, nullable: bool) -> A.Type:
    name = kind.simpleString()
    if name.startswith("array"):
        return A.Type("Array", (_declared(kind.elementType, kind.containsNull),))
    if name.startswith("map"):
        return A.Type("Map", (_declared(kind.keyType, False), _declared(kind.valueType, kind.valueContainsNull)))
    if name.startswith("struct"):
        out = A.Type("Tuple", tuple((f.name, _declared(f.dataType, f.nullable)) for f in kind.fields))
        return out
    if name.startswith("decimal"):
        base = A.Type("Decimal", (A.Lit("number", str(kind.precision)), A.Lit("number", str(kind.scale))))
    elif name == "binary":
        return A.Type("AggregateFunction", (A.Type("uniq"), A.Type("String")))
    else:
        base = A.Type(_FROM_SPARK[name])
    return A.Type("Nullable", (base,)) if nullable else base
