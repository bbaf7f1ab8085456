"""Queries over catalogs, differences and revisions. Their inputs are scripts and small literal relations."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn import catalog as C
from tarn import diff as D
from tarn import migrate as M

BEFORE = """
CREATE DATABASE shop COMMENT 'old';
CREATE TABLE shop.users (id UInt64, email String, age UInt8, seen DateTime64(3)) ENGINE = MergeTree() ORDER BY id;
CREATE TABLE shop.visits (at DateTime, who UInt64) ENGINE = MergeTree() ORDER BY at;
CREATE TABLE shop.gone (x UInt8) ENGINE = MergeTree() ORDER BY x;
CREATE ROLE reader;
GRANT SELECT ON shop.* TO reader;
GRANT INSERT ON shop.users TO reader;
"""
AFTER = """
CREATE DATABASE shop COMMENT 'new';
CREATE TABLE shop.users (id UInt64, email LowCardinality(String), seen DateTime64(3, 'UTC'), tags Nested(k String, v UInt8)) ENGINE = MergeTree() ORDER BY id;
CREATE TABLE shop.calls (at DateTime, who UInt64) ENGINE = MergeTree() ORDER BY at;
CREATE TABLE shop.fresh AS shop.users ENGINE = MergeTree();
CREATE ROLE reader;
GRANT SELECT ON shop.* TO reader;
GRANT ALTER ON shop.users TO reader;
"""
REVISIONS = [("001", "migration", None, 2, 2), ("002", "migration", "boom", 1, 3), ("003", "snapshot", None, 2, 2), ("004", "migration", None, 4, 4), ("004", "migration", "late", 0, 4)]
MIGRATIONS = [("001", False, 2), ("002", False, 3), ("003", True, 2), ("004", False, 4), ("005", False, 1)]


def _both(spark: SparkSession):
    return C.catalog(spark, BEFORE), C.catalog(spark, AFTER)


def diff_columns(spark: SparkSession, _: str) -> DataFrame:
    one, two = _both(spark)
    common = one.columns.select("table").distinct().join(two.columns.select("table").distinct(), "table")
    return D.column_changes(one.columns.join(common, "table", "left_semi"), two.columns.join(common, "table", "left_semi")).select("table", "op", "name")


def diff_create_drop(spark: SparkSession, _: str) -> DataFrame:
    one, two = _both(spark)
    return D.changes(one, two).where("op in ('CREATE', 'DROP')").select("kind", "op", "name")


def diff_rename(spark: SparkSession, _: str) -> DataFrame:
    one, two = _both(spark)
    return D.changes(one, two).where("op = 'RENAME'").select("kind", "name", "new_name")


def diff_grants(spark: SparkSession, _: str) -> DataFrame:
    one, two = _both(spark)
    return D.changes(one, two).where("op in ('GRANT', 'REVOKE')").select("op", "up")


def diff_order(spark: SparkSession, _: str) -> DataFrame:
    one, two = _both(spark)
    return D.changes(one, two).select("kind_rank", "op_rank", "kind", "op", "name")


def nested_flatten(spark: SparkSession, _: str) -> DataFrame:
    return C.catalog(spark, AFTER).columns.where("table = 'shop.users'").select("pos", "name", "type")


def nested_groups(spark: SparkSession, _: str) -> DataFrame:
    return C.nested_groups(C.catalog(spark, AFTER).columns)


def as_resolution(spark: SparkSession, _: str) -> DataFrame:
    return C.catalog(spark, AFTER).columns.where("table = 'shop.fresh'").select("name", "type")


def engine_clause_rules(spark: SparkSession, _: str) -> DataFrame:
    bad = C.catalog(spark, "CREATE TABLE a.k (x String) ENGINE = Kafka() ORDER BY x; CREATE TABLE a.m (x String) ENGINE = MergeTree() ORDER BY x; CREATE TABLE a.l (x String) ENGINE = Memory() PARTITION BY x SAMPLE BY x")
    return C.clause_conflicts(bad)


def catalog_scan(spark: SparkSession, _: str) -> DataFrame:
    return C.catalog(spark, BEFORE + "CREATE TABLE system.hidden (x UInt8) ENGINE = MergeTree() ORDER BY x;").objects.select("kind", "name")


def _revisions(spark: SparkSession) -> DataFrame:
    at = [datetime(2024, 1, i + 1, tzinfo=UTC) for i in range(len(REVISIONS))]
    rows = [(v, t, 1, k, e, a, n, "h", [], "0") for t, (v, k, e, a, n) in zip(at, REVISIONS, strict=True)]
    return spark.createDataFrame(rows, M.REVISIONS)


def _migrations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIGRATIONS, "version string, is_snapshot boolean, statements int")


def rev_status(spark: SparkSession, _: str) -> DataFrame:
    return M.statuses(_migrations(spark), _revisions(spark)).select("version", "status", "partial")


def rev_pending(spark: SparkSession, _: str) -> DataFrame:
    return M.pending(_migrations(spark), _revisions(spark)).select("version")


def rev_counts(spark: SparkSession, _: str) -> DataFrame:
    return M.status_counts(_migrations(spark), _revisions(spark))


def rev_after_snapshot(spark: SparkSession, _: str) -> DataFrame:
    return M.after_snapshot(_migrations(spark), _revisions(spark)).select("version")


def stmt_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return names.select("n_nationkey", F.sha2("n_name", 256).alias("hex"), F.length(M.statement_hash_column(F.col("n_name"))).cast("long").alias("n"))


def stmt_hash_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", M.statement_hash_column(F.col("n_name")).alias("h"))


def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("content"))
    return M.chain(rows).select(F.posexplode("hashes").alias("ordinal", "hash"))


RENAMED_BEFORE = """
CREATE DATABASE one COMMENT 'c'; CREATE DATABASE d;
CREATE TABLE d.t (a UInt8, b String) ENGINE = MergeTree() ORDER BY a; CREATE TABLE d.stays (a UInt8) ENGINE = MergeTree() ORDER BY a;
CREATE VIEW d.v AS SELECT a FROM d.stays; CREATE DICTIONARY d.x (k UInt64, v String) PRIMARY KEY k SOURCE(HTTP(url 'u')) LAYOUT(FLAT()) LIFETIME(9);
CREATE ROLE r SETTINGS max_threads = 3; CREATE FUNCTION f AS (x) -> x + 1;
"""
RENAMED_AFTER = """
CREATE DATABASE two COMMENT 'c'; CREATE DATABASE d;
CREATE TABLE d.u (a UInt8, b String) ENGINE = MergeTree() ORDER BY a; CREATE TABLE d.stays (a UInt8) ENGINE = MergeTree() ORDER BY a;
CREATE VIEW d.w AS SELECT a FROM d.stays; CREATE DICTIONARY d.y (k UInt64, v String) PRIMARY KEY k SOURCE(HTTP(url 'u')) LAYOUT(FLAT()) LIFETIME(9);
CREATE ROLE q SETTINGS max_threads = 3; CREATE FUNCTION g AS (x) -> x + 1;
"""
# (kind, name, what it is but for its name)
_RENAMED_OLD = [("database", "one", "c"), ("database", "d", ""), ("table", "d.t", "ab"), ("table", "d.stays", "a"), ("view", "d.v", "stays"), ("dictionary", "d.x", "kv"), ("role", "r", "3"), ("function", "f", "x + 1")]
_RENAMED_NEW = [("database", "two", "c"), ("database", "d", ""), ("table", "d.u", "ab"), ("table", "d.stays", "a"), ("view", "d.w", "stays"), ("dictionary", "d.y", "kv"), ("role", "q", "3"), ("function", "g", "x + 1")]
_OBJECTS_OLD = [("database", "shop", ""), ("table", "shop.users", "users"), ("table", "shop.visits", "at who"), ("table", "shop.gone", "x"), ("role", "reader", "")]
_OBJECTS_NEW = [("database", "shop", ""), ("table", "shop.users", "users 2"), ("table", "shop.calls", "at who"), ("table", "shop.fresh", "users 2"), ("role", "reader", "")]
_GRANTS_OLD = [("SELECT", "shop.*"), ("INSERT", "shop.users")]
_GRANTS_NEW = [("SELECT", "shop.*"), ("ALTER", "shop.users")]


def diff_rename_kinds(spark: SparkSession, _: str) -> DataFrame:
    return D.changes(C.catalog(spark, RENAMED_BEFORE), C.catalog(spark, RENAMED_AFTER)).where("op = 'RENAME'").select("kind", "name", "new_name")


def catalog_kinds(spark: SparkSession, _: str) -> DataFrame:
    return C.catalog(spark, RENAMED_BEFORE + "GRANT SELECT ON d.* TO r;").objects.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def rev_executed(spark: SparkSession, _: str) -> DataFrame:
    return M.executed_versions(_revisions(spark))


def rev_gaps(spark: SparkSession, _: str) -> DataFrame:
    """Versions of which a snapshot would be made that are not completed."""
    done = M.statuses(_migrations(spark), _revisions(spark)).where("status = 'completed'").select("version")
    return M.snapshot_gaps(_migrations(spark).select("version"), done)


TEXTS = ["SELECT 1", "SELECT 2", "SELECT 3"]


def rev_changed_prefix(spark: SparkSession, _: str) -> DataFrame:
    """Applied statements of partial revisions whose text has changed since."""
    rows = [(v, datetime(2024, 1, 1, tzinfo=UTC), 1, "migration", "boom", 2, 3, "h", [M.statement_hash(t) for t in TEXTS[:2]], "0.1") for v in ("001", "002")]
    texts = [("001", i, t) for i, t in enumerate(TEXTS)] + [("002", i, t.replace("2", "9")) for i, t in enumerate(TEXTS)]
    return M.changed_prefix(spark.createDataFrame(rows, M.REVISIONS), spark.createDataFrame(texts, "version string, ordinal int, text string"))


def _values(rows: list[tuple], names: str) -> str:
    def text(x) -> str:
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


def _joined(old: list[tuple], new: list[tuple]) -> str:
    """Objects that went, that came, and those of one kind and identity among them by their places."""
    return (
        f"WITH o AS ({_values(old, 'kind, name, identity')}), n AS ({_values(new, 'kind, name, identity')}), gone AS (SELECT * FROM o ANTI JOIN n USING (kind, name)), came AS (SELECT * FROM n ANTI JOIN o USING (kind, name)), "
        "renamed AS (SELECT gone.kind AS kind, gone.name AS name, came.name AS new_name FROM gone JOIN came USING (kind, identity))"
    )


_REV = f"r AS ({_values([(i, *r) for i, r in enumerate(REVISIONS)], 'i, version, kind, error, applied, total')} QUALIFY row_number() OVER (PARTITION BY version ORDER BY i DESC) = 1), m AS ({_values(MIGRATIONS, 'version, is_snapshot, statements')})"
_STATUS = f"WITH {_REV}, s AS (SELECT m.version AS version, coalesce(applied > 0 AND applied < total, false) AS partial, CASE WHEN kind IS NOT NULL AND error IS NULL AND (CASE WHEN is_snapshot THEN kind = 'snapshot' ELSE kind = 'migration' AND applied = total AND total = statements END) THEN 'completed' WHEN kind = 'migration' AND error IS NOT NULL THEN 'failed' WHEN applied > 0 AND applied < total THEN 'partial' ELSE 'pending' END AS status FROM m LEFT JOIN r ON m.version = r.version)"
_OLD = [("shop.users", 0, "id", "UInt64"), ("shop.users", 1, "email", "String"), ("shop.users", 2, "age", "UInt8"), ("shop.users", 3, "seen", "DateTime64(3)")]
_NEW = [("shop.users", 0, "id", "UInt64"), ("shop.users", 1, "email", "LowCardinality(String)"), ("shop.users", 2, "seen", "DateTime64(3)"), ("shop.users", 3, "tags.k", "Array(String)"), ("shop.users", 4, "tags.v", "Array(UInt8)")]

QUERIES = {
    "diff_columns": (diff_columns, f"WITH o AS ({_values(_OLD, 't, pos, name, type')}), n AS ({_values(_NEW, 't, pos, name, type')}) SELECT coalesce(o.t, n.t) AS \"table\", CASE WHEN o.t IS NULL THEN 'ADD' WHEN n.t IS NULL THEN 'DROP' ELSE 'MODIFY' END AS op, coalesce(o.name, n.name) AS name FROM o FULL JOIN n ON o.t = n.t AND o.name = n.name WHERE o.type IS DISTINCT FROM n.type"),
    "diff_create_drop": (diff_create_drop, f"{_joined(_OBJECTS_OLD, _OBJECTS_NEW)} SELECT kind, 'CREATE' AS op, name FROM came WHERE (kind, name) NOT IN (SELECT (kind, new_name) FROM renamed) UNION ALL SELECT kind, 'DROP', name FROM gone WHERE (kind, name) NOT IN (SELECT (kind, name) FROM renamed)"),
    "diff_rename": (diff_rename, f"{_joined(_OBJECTS_OLD, _OBJECTS_NEW)} SELECT kind, name, new_name FROM renamed"),
    "diff_rename_kinds": (diff_rename_kinds, f"{_joined(_RENAMED_OLD, _RENAMED_NEW)} SELECT kind, name, new_name FROM renamed"),
    "diff_grants": (diff_grants, f"WITH o AS ({_values(_GRANTS_OLD, 'p, t')}), n AS ({_values(_GRANTS_NEW, 'p, t')}) SELECT 'GRANT' AS op, 'GRANT ' || p || ' ON ' || t || ' TO `reader`' AS up FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'REVOKE', 'REVOKE ' || p || ' ON ' || t || ' FROM `reader`' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)"),
    "catalog_kinds": (catalog_kinds, f"SELECT kind, count(*) AS n FROM ({_values(_RENAMED_OLD, 'kind, name, identity')}) GROUP BY kind"),
    "rev_executed": (rev_executed, f"WITH {_REV} SELECT version FROM r WHERE kind = 'migration' AND error IS NULL"),
    "rev_gaps": (rev_gaps, f"{_STATUS} SELECT version FROM s WHERE status <> 'completed'"),
    "rev_changed_prefix": (rev_changed_prefix, f"WITH was AS ({_values([(v, i, t) for v in ('001', '002') for i, t in enumerate(TEXTS[:2])], 'version, ordinal, text')}), now AS ({_values([('001', i, t) for i, t in enumerate(TEXTS)] + [('002', i, t.replace('2', '9')) for i, t in enumerate(TEXTS)], 'version, ordinal, text')}) SELECT version, ordinal FROM was LEFT JOIN now USING (version, ordinal) WHERE now.text IS DISTINCT FROM was.text"),
    "diff_order": (diff_order, _values([(0, 4, "role", "GRANT", "reader"), (0, 5, "role", "REVOKE", "reader"), (2, 1, "database", "ALTER", "shop"), (3, 0, "table", "CREATE", "shop.fresh"), (3, 1, "table", "ALTER", "shop.users"), (3, 3, "table", "RENAME", "shop.visits"), (3, 6, "table", "DROP", "shop.gone")], "kind_rank, op_rank, kind, op, name")),
    "nested_flatten": (nested_flatten, _values([(0, "id", "UInt64"), (1, "email", "LowCardinality(String)"), (2, "seen", "DateTime64(3, 'UTC')"), (3, "tags.k", "Array(String)"), (4, "tags.v", "Array(UInt8)")], "pos, name, type")),
    "nested_groups": (nested_groups, f"WITH c AS ({_values([('shop.users', 'tags.k'), ('shop.users', 'tags.v'), ('shop.fresh', 'tags.k'), ('shop.fresh', 'tags.v')], 't, name')}) SELECT t AS \"table\", split_part(name, '.', 1) AS prefix, count(*) AS n FROM c GROUP BY ALL HAVING count(*) > 1"),
    "as_resolution": (as_resolution, _values([("id", "UInt64"), ("email", "LowCardinality(String)"), ("seen", "DateTime64(3, 'UTC')"), ("tags.k", "Array(String)"), ("tags.v", "Array(UInt8)")], "name, type")),
    "engine_clause_rules": (engine_clause_rules, _values([("a.k", "Kafka", "order_by"), ("a.l", "Memory", "partition_by"), ("a.l", "Memory", "sample_by")], "name, engine, clause")),
    "catalog_scan": (catalog_scan, _values([("database", "shop"), ("table", "shop.users"), ("table", "shop.visits"), ("table", "shop.gone"), ("role", "reader")], "kind, name")),
    "rev_status": (rev_status, f"{_STATUS} SELECT version, status, partial FROM s"),
    "rev_pending": (rev_pending, f"{_STATUS} SELECT version FROM s WHERE status <> 'completed'"),
    "rev_counts": (rev_counts, f"{_STATUS} SELECT count(*) AS total, count_if(status = 'completed')::BIGINT AS completed, count_if(status <> 'completed')::BIGINT AS pending, count_if(status = 'failed')::BIGINT AS failed FROM s"),
    "rev_after_snapshot": (rev_after_snapshot, f"WITH {_REV} SELECT version FROM m WHERE version > (SELECT max(version) FROM r WHERE kind = 'snapshot')"),
    "stmt_hash": (stmt_hash, "SELECT n_nationkey, sha256(n_name) AS hex, length('h1:' || base64(unhex(sha256(n_name))) || '=')::BIGINT AS n FROM nation"),
    "hash_chain": (hash_chain, "WITH RECURSIVE c(ordinal, hash) AS (SELECT 0, sha256(r_name) FROM region WHERE r_regionkey = 0 UNION ALL SELECT ordinal + 1, sha256(unhex(hash) || encode(r_name)) FROM c JOIN region ON r_regionkey = ordinal + 1) SELECT ordinal, hash FROM c"),
    "stmt_hash_value": (stmt_hash_value, "SELECT n_nationkey, 'h1:' || base64(unhex(sha256(n_name))) || '=' AS h FROM nation"),
}
