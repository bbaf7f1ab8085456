"""Differences of two schemas, as joins over their catalogs.

The result is one relation of changes in the order in which they can be applied. Text is only made
of it at the end. Renames pair the k-th dropped with the k-th created object of equal properties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarn.catalog import INTEGRATION, SYSTEM_DATABASES, VIEW_LIKE, Catalog, SchemaError, catalog, clause_conflicts, dependencies
from tarn.sqlfront import ast as A
from tarn.sqlfront.ast import Stmt
from tarn.sqlfront.ddl import parse

CHANGES = "kind_rank int, op_rank int, kind string, op string, name string, new_name string, up string, down string"
KINDS = ("role", "function", "database", "table", "dictionary", "view")
OPS = ("CREATE", "ALTER", "REPLACE", "RENAME", "GRANT", "REVOKE", "DROP")
_NOUN = {"view": "VIEW", "table": "TABLE", "dictionary": "DICTIONARY", "database": "DATABASE", "function": "FUNCTION", "role": "ROLE"}


class NoDifference(Exception):
    """The two schemas are the same."""


def _rank(values: tuple[str, ...], c: Column) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(c == v, i) if out is None else out.when(c == v, i)
    return out


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("`"), F.array_join(F.split(c, "\\."), "`.`"), F.lit("`"))


def _on_cluster(c: Column) -> Column:
    return F.when(c == "", "").otherwise(F.concat(F.lit(" ON CLUSTER `"), c, F.lit("`")))


def _noun() -> Column:
    out = None
    for k, n in _NOUN.items():
        out = F.when(F.col("kind") == k, n) if out is None else out.when(F.col("kind") == k, n)
    return F.when((F.col("kind") == "view") & F.col("replaces"), "TABLE").otherwise(out)


def _dropped(prefix: str = "") -> Column:
    return F.concat(F.lit("DROP "), _noun(), F.lit(" IF EXISTS "), _quoted(F.col("name")), _on_cluster(F.col("cluster")))


def column_changes(current: DataFrame, target: DataFrame) -> DataFrame:
    """(table, seq, op, name, up, down): a full outer join of the columns of tables that both have.

    Added and modified columns come in the target's order, then dropped ones in the current order.
    Types compare with DateTime64's zone left out where only one side names it.
    """
    key = ["table", "name"]
    one = current.select(*key, *[F.col(c).alias(f"c_{c}") for c in current.columns if c not in key])
    two = target.select(*key, *[F.col(c).alias(f"t_{c}") for c in target.columns if c not in key])
    both = one.join(two, key, "full")

    def bare(c: str) -> Column:
        return F.regexp_replace(c, r"DateTime64\((\d+), '[^']*'\)", "DateTime64($1)")

    zoned = F.col("c_type").contains("DateTime64(") & (F.regexp_count("c_type", F.lit("DateTime64\\(\\d+\\)")) != F.regexp_count("t_type", F.lit("DateTime64\\(\\d+\\)")))
    same_type = F.when(zoned, bare("c_type") == bare("t_type")).otherwise(F.col("c_type") == F.col("t_type"))
    same = same_type
    for c in ("kind", "expr", "codec", "ttl", "comment"):
        same = same & F.col(f"c_{c}").eqNullSafe(F.col(f"t_{c}"))
    op = F.when(F.col("c_pos").isNull(), "ADD").when(F.col("t_pos").isNull(), "DROP").when(~same, "MODIFY")
    before = W.partitionBy("table").orderBy("t_pos")
    both = both.withColumn("op", op).withColumn("after", F.when(F.col("t_pos").isNotNull(), F.lag("name").over(before)))
    name = F.concat(F.lit("`"), F.col("name"), F.lit("`"))
    up = F.when(F.col("op") == "ADD", F.concat(F.lit("ADD COLUMN "), F.col("t_text"), F.coalesce(F.concat(F.lit(" AFTER `"), F.col("after"), F.lit("`")), F.lit(" FIRST"))))
    up = up.when(F.col("op") == "MODIFY", F.concat(F.lit("MODIFY COLUMN "), F.col("t_text"))).otherwise(F.concat(F.lit("DROP COLUMN "), name))
    down = F.when(F.col("op") == "ADD", F.concat(F.lit("DROP COLUMN "), name)).when(F.col("op") == "MODIFY", F.concat(F.lit("MODIFY COLUMN "), F.col("c_text"))).otherwise(F.concat(F.lit("ADD COLUMN "), F.col("c_text")))
    seq = F.when(F.col("op") == "DROP", F.col("c_pos") + 100_000).otherwise(F.col("t_pos"))
    return both.where(F.col("op").isNotNull()).select("table", seq.alias("seq"), "op", "name", up.alias("up"), down.alias("down"))


def clause_changes(pairs: DataFrame) -> DataFrame:
    """(table, seq, op, name, up, down) for changed sort key, sampling, lifetime and settings of tables."""
    rows = []
    for seq, (c, set_, unset) in enumerate((("order_by", "MODIFY ORDER BY ", None), ("sample_by", "MODIFY SAMPLE BY ", "REMOVE SAMPLE BY"), ("ttl", "MODIFY TTL ", "DELETE TTL"))):
        def text(side: str, c=c, set_=set_, unset=unset) -> Column:
            return F.when(F.col(f"{side}_{c}").isNull(), F.lit(unset if unset else set_ + "tuple()")).otherwise(F.concat(F.lit(set_), F.col(f"{side}_{c}")))

        changed = pairs.where(~F.col(f"c_{c}").eqNullSafe(F.col(f"t_{c}")))
        rows.append(changed.select(F.col("name").alias("table"), F.lit(200_000 + seq).alias("seq"), F.lit("CLAUSE").alias("op"), F.lit(c).alias("name"), text("t").alias("up"), text("c").alias("down")))
    keys = pairs.select("name", "c_settings", "t_settings", F.explode(F.array_sort(F.array_union(F.map_keys("c_settings"), F.map_keys("t_settings")))).alias("k"))
    keys = keys.withColumn("c", F.expr("c_settings[k]")).withColumn("t", F.expr("t_settings[k]")).where(~F.col("c").eqNullSafe(F.col("t")))

    def setting(side: str) -> Column:
        return F.when(F.col(side).isNull(), F.concat(F.lit("RESET SETTING "), F.col("k"))).otherwise(F.concat(F.lit("MODIFY SETTING "), F.col("k"), F.lit(" = "), F.col(side)))

    rows.append(keys.select(F.col("name").alias("table"), F.lit(200_100).alias("seq"), F.lit("CLAUSE").alias("op"), F.col("k").alias("name"), setting("t").alias("up"), setting("c").alias("down")))
    return reduce(DataFrame.unionByName, rows)


def same_engine() -> Column:
    """A replicated target without parameters fits any parameters."""
    free = F.col("t_engine").startswith("Replicated") & (F.col("t_engine_args") == "")
    return (F.col("c_engine") == F.col("t_engine")) & (free | (F.col("c_engine_args") == F.col("t_engine_args")))


def paired(current: Catalog, target: Catalog) -> DataFrame:
    """Objects that both schemas have, with c_ and t_ columns."""
    rest = [c for c in current.objects.columns if c not in ("kind", "name")]
    one = current.objects.select("kind", "name", *[F.col(c).alias(f"c_{c}") for c in rest])
    return one.join(target.objects.select("kind", "name", *[F.col(c).alias(f"t_{c}") for c in rest]), ["kind", "name"])


def renames(dropped: DataFrame, created: DataFrame) -> DataFrame:
    """(kind, name, new_name): the k-th of each in order of name, for equal kind, cluster and properties.

    A table keeps its database only if another has none to give; other objects of a database stay in it.
    """
    def numbered(df: DataFrame, name: str) -> DataFrame:
        place = F.when(F.col("kind").isin("table", "database", "function", "role"), "").otherwise(F.col("db"))
        w = W.partitionBy("kind", "cluster", "identity", "_place").orderBy("name")
        return df.withColumn("_place", place).withColumn("_k", F.row_number().over(w)).select("kind", "cluster", "identity", "_place", "_k", F.col("name").alias(name))

    return numbered(dropped, "name").join(numbered(created, "new_name"), ["kind", "cluster", "identity", "_place", "_k"]).select("kind", "name", "new_name", "cluster")


def _checked(current: Catalog, target: Catalog, pairs: DataFrame, created: DataFrame, dropped: DataFrame) -> None:
    """Raises for changes that cannot be made; a few offending names are brought to the driver for the message."""
    replicated = F.col("c_engine").startswith("Replicated") & F.col("t_engine").startswith("Replicated")
    integration = F.col("c_engine").isin(*INTEGRATION) | F.col("t_engine").isin(*INTEGRATION)
    tests = [
        ("the cluster of {} cannot change", pairs.where("kind <> 'role' and kind <> 'function' and c_cluster <> t_cluster")),
        ("the engine of database {} cannot change", pairs.where("kind = 'database' and t_engine <> '' and c_engine <> t_engine")),
        ("the engine of table {} cannot change", pairs.where((F.col("kind") == "table") & ~same_engine() & ~replicated & ~integration & ~F.col("t_engine").isin(*VIEW_LIKE))),
        ("the partition or primary key of table {} cannot change", pairs.where((F.col("kind") == "table") & ~integration & (~F.col("c_partition_by").eqNullSafe(F.col("t_partition_by")) | ~F.col("c_primary_key").eqNullSafe(F.col("t_primary_key"))))),
        ("system object {} cannot change", created.unionByName(dropped).where(F.col("db").isin(*SYSTEM_DATABASES))),
    ]
    for text, offending in tests:
        names = [r["name"] for r in offending.select("name").orderBy("name").limit(5).collect()]
        if names:
            raise SchemaError(text.format(", ".join(names)))
    wrong = clause_conflicts(target).orderBy("name", "clause").limit(5).collect()
    if wrong:
        raise SchemaError("; ".join(f"table {r['name']}: engine {r['engine']} takes no {r['clause'].upper().replace('_', ' ')}" for r in wrong))


def _row(kind, op, name, up, down, new_name=None) -> list[Column]:
    def c(x):
        return x if isinstance(x, Column) else F.lit(x)

    return [c(kind).alias("kind"), c(op).alias("op"), c(name).alias("name"), (c(new_name) if new_name is not None else F.lit(None).cast("string")).alias("new_name"), c(up).alias("up"), c(down).alias("down")]


def changes(current: Catalog, target: Catalog) -> DataFrame:
    """All changes from one schema to the other, with the statements that make and undo them, in order."""
    keys = ["kind", "name"]
    created_all = target.objects.join(current.objects.select(*keys), keys, "left_anti")
    dropped_all = current.objects.join(target.objects.select(*keys), keys, "left_anti")
    pairs = paired(current, target)
    _checked(current, target, pairs, created_all, dropped_all)
    moved = renames(dropped_all, created_all)
    created = created_all.join(moved.select("kind", F.col("new_name").alias("name")), keys, "left_anti")
    dropped = dropped_all.join(moved.select(*keys), keys, "left_anti")

    out = [created.select(*_row(F.col("kind"), "CREATE", F.col("name"), F.col("ddl"), _dropped())), dropped.select(*_row(F.col("kind"), "DROP", F.col("name"), _dropped(), F.col("ddl")))]

    def rename(a: str, b: str) -> Column:
        noun = F.when(F.col("kind") == "view", "TABLE").otherwise(F.upper("kind"))
        plain = F.concat(F.lit("RENAME "), noun, F.lit(" "), _quoted(F.col(a)), F.lit(" TO "), _quoted(F.col(b)), _on_cluster(F.col("cluster")))
        role = F.concat(F.lit("ALTER ROLE `"), F.col(a), F.lit("` RENAME TO `"), F.col(b), F.lit("`"))
        return F.when(F.col("kind") == "role", role).otherwise(plain)

    out.append(moved.where("kind <> 'function'").select(*_row(F.col("kind"), "RENAME", F.col("name"), rename("name", "new_name"), rename("new_name", "name"), F.col("new_name"))))
    functions = moved.where("kind = 'function'")
    old, new = current.objects.where("kind = 'function'").select("name", F.col("ddl").alias("old")), target.objects.where("kind = 'function'").select(F.col("name").alias("new_name"), F.col("ddl").alias("new"))
    functions = functions.join(old, "name").join(new, "new_name")

    def swapped(a: str, ddl: str) -> Column:
        return F.concat(F.lit("DROP FUNCTION IF EXISTS `"), F.col(a), F.lit("`"), _on_cluster(F.col("cluster")), F.lit(";\n\n"), F.col(ddl))

    out.append(functions.select(*_row("function", "RENAME", F.col("name"), swapped("name", "new"), swapped("new_name", "old"), F.col("new_name"))))

    differ = pairs.where("c_identity <> t_identity")

    def comment(side: str) -> Column:
        return F.concat(F.lit("ALTER DATABASE "), _quoted(F.col("name")), _on_cluster(F.col("t_cluster")), F.lit(" MODIFY COMMENT '"), F.regexp_replace(f"{side}_comment", "(['\\\\])", "\\\\$1"), F.lit("'"))

    out.append(differ.where("kind = 'database' and c_comment <> t_comment").select(*_row("database", "ALTER", F.col("name"), comment("t"), comment("c"))))

    def replaced(side: str) -> Column:
        return F.regexp_replace(f"{side}_ddl", "^CREATE (OR REPLACE )?(IF NOT EXISTS )?", "CREATE OR REPLACE ")

    out.append(differ.where("kind in ('dictionary', 'function')").select(*_row(F.col("kind"), "REPLACE", F.col("name"), replaced("t"), replaced("c"))))
    rebuilt = F.col("c_replaces") | F.col("t_replaces")

    def again(a: str, b: str) -> Column:
        drop = F.concat(F.lit("DROP "), F.when(F.col(f"{a}_replaces"), "TABLE").otherwise("VIEW"), F.lit(" IF EXISTS "), _quoted(F.col("name")), _on_cluster(F.col(f"{a}_cluster")))
        return F.when(rebuilt, F.concat(drop, F.lit(";\n\n"), F.col(f"{b}_ddl"))).otherwise(replaced(b))

    out.append(differ.where("kind = 'view'").select(*_row("view", "ALTER", F.col("name"), again("c", "t"), again("t", "c"))))

    def role(side: str) -> Column:
        pairs_ = F.array_join(F.transform(F.array_sort(F.map_entries(f"{side}_settings")), lambda e: F.concat(e["key"], F.lit(" = "), e["value"])), ", ")
        return F.concat(F.lit("ALTER ROLE `"), F.col("name"), F.lit("`"), _on_cluster(F.col("t_cluster")), F.when(F.size(f"{side}_settings") > 0, F.concat(F.lit(" SETTINGS "), pairs_)).otherwise(F.lit(" SETTINGS NONE")))

    out.append(differ.where("kind = 'role'").select(*_row("role", "ALTER", F.col("name"), role("t"), role("c"))))

    tables = pairs.where("kind = 'table'")
    anew = F.col("c_engine").isin(*INTEGRATION) | F.col("t_engine").isin(*INTEGRATION) | ~same_engine()

    def recreated(side: str) -> Column:
        return F.concat(F.lit("DROP TABLE IF EXISTS "), _quoted(F.col("name")), _on_cluster(F.col("t_cluster")), F.lit(";\n\n"), F.col(f"{side}_ddl"))

    out.append(tables.where(anew & (F.col("c_identity") != F.col("t_identity"))).select(*_row("table", "ALTER", F.col("name"), recreated("t"), recreated("c"))))
    kept = tables.where(~anew)
    names = kept.select(F.col("name").alias("table"))
    cols = column_changes(current.columns.join(names, "table", "left_semi"), target.columns.join(names, "table", "left_semi"))
    ops = cols.unionByName(clause_changes(kept))
    listed = ops.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "up", "down"))).alias("ops"))

    def altered(side: str) -> Column:
        return F.concat(F.lit("ALTER TABLE "), _quoted(F.col("table")), _on_cluster(F.col("t_cluster")), F.lit(" "), F.array_join(F.transform("ops", lambda o: o[side]), ", "))

    listed = listed.join(kept.select(F.col("name").alias("table"), "t_cluster"), "table")
    out.append(listed.select(*_row("table", "ALTER", F.col("table"), altered("up"), altered("down"))))

    key = ["grantee", "privileges", "target", "grant_option"]
    out.append(_grants(target.grants, current.grants, key, "GRANT"))
    out.append(_grants(current.grants, target.grants, key, "REVOKE"))
    every = reduce(DataFrame.unionByName, out)
    return every.select(_rank(KINDS, F.col("kind")).alias("kind_rank"), _rank(OPS, F.col("op")).alias("op_rank"), "*").orderBy("kind_rank", "op_rank", "name", "up")


def _grants(have: DataFrame, other: DataFrame, key: list[str], op: str) -> DataFrame:
    on = reduce(lambda a, b: a & b, [F.col(f"h.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key])
    rows = have.alias("h").join(other.alias("o"), on, "left_anti")
    at = F.when(F.col("cluster") == "", "").otherwise(F.concat(F.lit("ON CLUSTER `"), F.col("cluster"), F.lit("` ")))
    what = F.concat(F.col("privileges"), F.coalesce(F.concat(F.lit(" ON "), F.col("target")), F.lit("")))
    give = F.concat(F.lit("GRANT "), at, what, F.lit(" TO `"), F.col("grantee"), F.lit("`"), F.when(F.col("grant_option"), " WITH GRANT OPTION").otherwise(""))
    take = F.concat(F.lit("REVOKE "), at, what, F.lit(" FROM `"), F.col("grantee"), F.lit("`"))
    return rows.select(*_row("role", op, F.col("grantee"), *((give, take) if op == "GRANT" else (take, give))))


def _views_last(rows: list, order: dict[str, int]) -> list:
    """Created views after those that they read; dropped ones before."""
    place = {id(r): i for i, r in enumerate(rows)}

    def key(r):
        depth = order.get(r["name"], 0) if r["kind"] == "view" else 0
        return r["kind_rank"], r["op_rank"], -depth if r["op"] == "DROP" else depth, place[id(r)]

    return sorted(rows, key=key)


def _depths(statements: list[Stmt]) -> dict[str, int]:
    reads = dependencies(statements)
    depth: dict[str, int] = {}

    def of(name: str, path: tuple[str, ...] = ()) -> int:
        if name in path:
            raise SchemaError(f"views that read each other: {' -> '.join((*path, name))}")
        if name not in depth:
            depth[name] = 1 + max((of(r, (*path, name)) for r in reads[name] if r in reads), default=0)
        return depth[name]

    for name in list(reads):
        of(name)
    return depth


def migration(spark: SparkSession, current: str, target: str, undo: bool = False) -> str:
    """The script that turns one schema into the other, or back; NoDifference if they are the same."""
    one, two = parse(current), parse(target)
    rows = changes(catalog(spark, one), catalog(spark, two)).collect()
    if not rows:
        raise NoDifference
    rows = _views_last(rows, _depths(one) | _depths(two))
    texts = [r["down" if undo else "up"] for r in (reversed(rows) if undo else rows)]
    return "".join(f"{t};\n\n" for t in texts).rstrip("\n") + "\n"
