"""Queries that run through statements: each builds a warehouse over a data set's tables, declares, inserts, alters and reads.

An entry has the script that declares, inserts as (table, query), the script that follows, the query
for the result, and DuckDB text for the same rows. ``{dir}`` stands for a fresh folder.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tarn.apply import Warehouse
from tarn.shared import fresh
from tarn.sqlfront.parser import parse_select

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """A new warehouse that also sees the data set's tables."""
    w = Warehouse(spark, fresh(spark, "warehouse"))
    own = w._lookup

    def lookup(parts: tuple[str, ...]) -> DataFrame:
        if len(parts) == 1 and parts[0] in TABLES:
            return spark.read.parquet(f"{sf_dir}/{parts[0]}.parquet")
        return own(parts)

    w._lookup = lookup
    return w


@dataclass(frozen=True)
class Case:
    """One query by statements."""

    before: str
    feeds: tuple[tuple[str, str], ...]
    after: str
    select: str
    oracle: str | None
    final: str = ""

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        w, folder = warehouse(spark, sf_dir), fresh(spark, "files")
        w.run_script(self.before.replace("{dir}", folder))
        for table, text in self.feeds:
            w.insert(table, w.session().run(parse_select(text)))
        w.run_script(self.after.replace("{dir}", folder))
        if self.final:
            return w.session().run(parse_select(self.select)) if self.final not in w.views else w.materialized(self.final)
        return w.session().run(parse_select(self.select))


#: Orders with a partition for each status.
O = "CREATE TABLE o (k Int64, c Int64, s String, p Float64, day Date, pri String) ENGINE = MergeTree() ORDER BY k PARTITION BY s;"
FEED = ("o", "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p, toDate(o_orderdate) AS day, o_orderpriority AS pri FROM orders")
D = "(SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p, o_orderdate::DATE AS day, o_orderpriority AS pri FROM orders)"
ALL = "SELECT k, c, s, p, day, pri FROM o"


def _alter(after: str, oracle: str, select: str = ALL, before: str = "") -> Case:
    return Case(O + before, (FEED,), after, select, oracle.replace("{o}", f"{D} o"))


EV = "CREATE TABLE ev (id Int64, u Int64, kind String, v Float64) ENGINE = MergeTree() ORDER BY id;"
BATCHES = tuple(("ev", f"SELECT event_id AS id, user_id AS u, event_type AS kind, value AS v FROM events WHERE {w}") for w in ("event_type = 'error'", "event_type = 'purchase'", "event_type NOT IN ('error', 'purchase')"))

CASES: dict[str, Case] = {
    # rows and columns
    "alter_update_delete": Case(
        "CREATE TABLE t (o_orderkey Int64, o_orderpriority String, o_totalprice Float64, o_orderstatus String) ENGINE = MergeTree() ORDER BY o_orderkey;", (("t", "SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders"),),
        "ALTER TABLE t UPDATE o_orderpriority = '0-TOP' WHERE o_totalprice > 300000, DELETE WHERE o_orderstatus = 'P'", "SELECT o_orderkey, o_orderpriority FROM t",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN '0-TOP' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE NOT coalesce(o_orderstatus = 'P', false)",
    ),
    "alter_add_column": _alter("ALTER TABLE o ADD COLUMN z Int64 DEFAULT k * 2 AFTER k, ADD COLUMN IF NOT EXISTS z Int64, ADD COLUMN n Nullable(String) FIRST, ADD COLUMN e String", "SELECT NULL::VARCHAR AS n, k, k * 2 AS z, '' AS e FROM {o}", "SELECT n, k, z, e FROM o"),
    "alter_drop_column": _alter("ALTER TABLE o DROP COLUMN pri, DROP COLUMN IF EXISTS none", "SELECT k, c, s, p, day FROM {o}", "SELECT * FROM o"),
    "alter_modify_column": _alter("ALTER TABLE o MODIFY COLUMN c String, MODIFY COLUMN pri String DEFAULT 'x', MODIFY COLUMN p COMMENT 'price'", "SELECT k, c::VARCHAR AS c, pri FROM {o}", "SELECT k, c, pri FROM o"),
    "alter_rename_column": _alter("ALTER TABLE o RENAME COLUMN pri TO priority, COMMENT COLUMN priority 'renamed'", "SELECT k, pri AS priority FROM {o}", "SELECT k, priority FROM o"),
    "alter_clear_column": _alter("ALTER TABLE o CLEAR COLUMN pri IN PARTITION 'F'", "SELECT k, CASE WHEN s = 'F' THEN '' ELSE pri END AS pri FROM {o}", "SELECT k, pri FROM o"),
    "alter_update_all": _alter("ALTER TABLE o UPDATE pri = concat(s, '-', pri) WHERE 1 = 1", "SELECT k, concat(s, '-', pri) AS pri FROM {o}", "SELECT k, pri FROM o"),
    "alter_constraint": _alter("ALTER TABLE o ADD CONSTRAINT pos CHECK p > 0, ADD CONSTRAINT odd CHECK k > 0, DROP CONSTRAINT odd", "SELECT k FROM {o}", "SELECT k FROM o"),
    "alter_ttl": _alter("ALTER TABLE o MODIFY TTL day + INTERVAL 1 DAY DELETE WHERE s = 'F'", "SELECT k, s FROM {o} WHERE s <> 'F'", "SELECT k, s FROM o"),
    "alter_delete_ttl": _alter("ALTER TABLE o MODIFY TTL day + INTERVAL 1 DAY; ALTER TABLE o REMOVE TTL", "SELECT k FROM {o}", "SELECT k FROM o"),
    "alter_metadata": _alter("ALTER TABLE o ADD INDEX i (c) TYPE minmax GRANULARITY 4, DROP INDEX i, MODIFY ORDER BY (k, c), MODIFY SETTING index_granularity = 1024, RESET SETTING index_granularity", "SELECT k FROM {o}", "SELECT k FROM o"),
    # partitions
    "drop_partition": _alter("ALTER TABLE o DROP PARTITION 'F'", "SELECT k, s FROM {o} WHERE s <> 'F'", "SELECT k, s FROM o"),
    "detach_attach_partition": _alter("ALTER TABLE o DETACH PARTITION 'F', DETACH PARTITION 'O', ATTACH PARTITION 'F'", "SELECT k, s FROM {o} WHERE s <> 'O'", "SELECT k, s FROM o"),
    "attach_partition_from": _alter("ALTER TABLE o2 ATTACH PARTITION 'P' FROM o", "SELECT k, s FROM {o} WHERE s = 'P'", "SELECT k, s FROM o2", "CREATE TABLE o2 AS o;"),
    "replace_partition": _alter("ALTER TABLE o2 ATTACH PARTITION 'P' FROM o, ATTACH PARTITION 'P' FROM o, REPLACE PARTITION 'P' FROM o", "SELECT k, s FROM {o} WHERE s = 'P'", "SELECT k, s FROM o2", "CREATE TABLE o2 AS o;"),
    "move_partition": _alter("ALTER TABLE o MOVE PARTITION 'P' TO TABLE o2, MOVE PARTITION 'F' TO DISK 'cold'", "SELECT 'o' AS t, k FROM {o} WHERE s <> 'P' UNION ALL SELECT 'o2' AS t, k FROM {o} WHERE s = 'P'", "SELECT t, k FROM both", "CREATE TABLE o2 AS o; CREATE TABLE both (t String, k Int64) ENGINE = Memory;"),
    "partition_by_expression": Case(
        "CREATE TABLE o (k Int64, s String, day Date) ENGINE = MergeTree() ORDER BY k PARTITION BY (toYYYYMM(day), s);", (("o", "SELECT o_orderkey AS k, o_orderstatus AS s, toDate(o_orderdate) AS day FROM orders"),),
        "ALTER TABLE o DROP PARTITION (199501, 'F'), DROP PARTITION ID '199502-O'", "SELECT k, s, day FROM o", f"SELECT k, s, day FROM {D} WHERE NOT (strftime(day, '%Y%m') = '199501' AND s = 'F') AND NOT (strftime(day, '%Y%m') = '199502' AND s = 'O')",
    ),
    # declarations
    "table_defaults": Case(
        "CREATE TABLE t (k Int64, d Int64 DEFAULT k + 1, m Int64 MATERIALIZED k * 2, a Int64 ALIAS k * 3, e String EPHEMERAL, n Nullable(Int32), z Int32, w String) ENGINE = MergeTree() ORDER BY k;", (("t", "SELECT o_orderkey AS k FROM orders"),),
        "", "SELECT k, d, m, a, n, z, w FROM t", "SELECT o_orderkey AS k, o_orderkey + 1 AS d, o_orderkey * 2 AS m, o_orderkey * 3 AS a, NULL::INT AS n, 0::INT AS z, '' AS w FROM orders",
    ),
    "table_as_table": Case(O + "CREATE TABLE o2 AS o; CREATE TABLE IF NOT EXISTS o2 (x Int8) ENGINE = Memory;", (("o2", FEED[1]),), "", "SELECT * FROM o2", f"SELECT * FROM {D}"),
    "table_as_select": Case("CREATE TABLE t ENGINE = MergeTree() ORDER BY s AS SELECT o_orderstatus AS s, count() AS n FROM orders GROUP BY s;", (), "", "SELECT s, n FROM t", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1"),
    "table_as_function": Case("CREATE TABLE t AS numbers(100);", (), "", "SELECT number FROM t", "SELECT range AS number FROM range(100)"),
    "table_or_replace": Case(O, (FEED,), "CREATE OR REPLACE TABLE o (x Int64) ENGINE = Memory; DROP TABLE IF EXISTS none; CREATE TABLE r (k Int64) ENGINE = Memory; RENAME TABLE r TO q", "SELECT count() AS n FROM (SELECT x FROM o)", "SELECT 0::BIGINT AS n"),
    "rename_table": _alter("RENAME TABLE o TO renamed", "SELECT k FROM {o}", "SELECT k FROM renamed"),
    "rename_database": Case("CREATE DATABASE a COMMENT 'x'; CREATE TABLE a.t (k Int64) ENGINE = Memory;", (("a.t", "SELECT o_orderkey AS k FROM orders"),), "RENAME DATABASE a TO b; ALTER DATABASE b MODIFY COMMENT 'y'", "SELECT k FROM b.t", "SELECT o_orderkey AS k FROM orders"),
    "detach_attach_table": _alter("DETACH TABLE o; ATTACH TABLE o; DETACH TABLE o; ATTACH TABLE o", "SELECT k FROM {o}", "SELECT k FROM o"),
    "view_plain": _alter("CREATE VIEW v AS SELECT k, s FROM o WHERE p > 100000; DETACH VIEW v; ATTACH VIEW v; CREATE OR REPLACE VIEW v AS SELECT k, s FROM o WHERE p > 200000", "SELECT k, s FROM {o} WHERE p > 200000", "SELECT k, s FROM v"),
    "function_statements": _alter("CREATE FUNCTION twice AS (x) -> x * 2; CREATE FUNCTION more AS (x, y) -> twice(x) + y; CREATE FUNCTION gone AS (x) -> x; DROP FUNCTION gone", "SELECT k, k * 2 + c AS m FROM {o}", "SELECT k, more(k, c) AS m FROM o"),
    "dictionary_statements": Case(
        "CREATE TABLE f (n_nationkey Int32, n_name String) ENGINE = File('CSVWithNames', '{dir}');", (("f", "SELECT n_nationkey, n_name FROM nation"),),
        "CREATE DICTIONARY a (n_nationkey Int32, n_name String, region String DEFAULT '?') PRIMARY KEY n_nationkey SOURCE(FILE(path '{dir}' format 'CSVWithNames')) LAYOUT(HASHED()) LIFETIME(60); CREATE DICTIONARY old (k Int32, v String) PRIMARY KEY k SOURCE(LOCAL(TABLE 'nation')) LAYOUT(FLAT()) LIFETIME(1); DROP DICTIONARY old; RENAME DICTIONARY a TO b; DETACH DICTIONARY b; ATTACH DICTIONARY b",
        "SELECT n_nationkey, n_name FROM b", "SELECT n_nationkey, n_name FROM nation",
    ),
    # engines
    "engine_file": Case("CREATE TABLE f (k Int64, s String) ENGINE = File('JSONEachRow', '{dir}'); CREATE TABLE g (k Int64, s String) ENGINE = S3('{dir}', 'JSONEachRow');", (("f", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders"),), "", "SELECT k, s FROM g", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders"),
    "engine_merge": Case(
        "CREATE DATABASE d; CREATE TABLE d.y1 (k Int64) ENGINE = MergeTree() ORDER BY k; CREATE TABLE d.y2 (k Int64) ENGINE = MergeTree() ORDER BY k; CREATE TABLE d.zz (k Int64) ENGINE = Memory; CREATE TABLE d.ys (k Int64) ENGINE = Merge('d', '^y');",
        (("d.y1", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'"), ("d.y2", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus != 'F'"), ("d.zz", "SELECT o_orderkey AS k FROM orders")), "", "SELECT k FROM d.ys", "SELECT o_orderkey AS k FROM orders",
    ),
    "engine_distributed": Case("CREATE DATABASE d; CREATE TABLE d.t (k Int64) ENGINE = MergeTree() ORDER BY k; CREATE TABLE d.dist (k Int64) ENGINE = Distributed('c', 'd', 't', rand());", (("d.dist", "SELECT o_orderkey AS k FROM orders"),), "", "SELECT a.k AS k FROM d.t AS a INNER JOIN d.dist AS b ON a.k = b.k", "SELECT o_orderkey AS k FROM orders"),
    "engine_buffer": Case("CREATE DATABASE d; CREATE TABLE d.t (k Int64) ENGINE = MergeTree() ORDER BY k; CREATE TABLE d.b (k Int64) ENGINE = Buffer('d', 't', 16, 10, 100, 10000, 1000000, 10000000, 100000000);", (("d.b", "SELECT o_orderkey AS k FROM orders"),), "", "SELECT k FROM d.t", "SELECT o_orderkey AS k FROM orders"),
    "engine_memory": Case("CREATE TABLE t (k Int64) ENGINE = Memory;", (("t", "SELECT o_orderkey AS k FROM orders"),), "", "SELECT k FROM t", "SELECT o_orderkey AS k FROM orders"),
    "engine_null": Case("CREATE TABLE t (k Int64, s String) ENGINE = Null; CREATE MATERIALIZED VIEW m ENGINE = MergeTree() ORDER BY s AS SELECT s, count() AS n FROM t GROUP BY s;", (("t", "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders"),), "", "SELECT s, n FROM m", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1"),
    "engine_dictionary": Case("CREATE DICTIONARY dd (n_nationkey Int32, n_name String) PRIMARY KEY n_nationkey SOURCE(LOCAL(TABLE 'nation')) LAYOUT(FLAT()) LIFETIME(1); CREATE TABLE t (n_nationkey Int32, n_name String) ENGINE = Dictionary('dd');", (), "", "SELECT n_nationkey, n_name FROM t", "SELECT n_nationkey, n_name FROM nation"),
    "engine_replicated": Case("CREATE TABLE t (k Int64, c Int64) ENGINE = ReplicatedReplacingMergeTree('/tables/t', '{replica}', c) ORDER BY k;", (("t", "SELECT o_custkey AS k, o_orderkey AS c FROM orders"),), "", "SELECT k, c FROM t FINAL", "SELECT o_custkey AS k, max(o_orderkey) AS c FROM orders GROUP BY 1"),
    # merging reads
    "merge_aggregating": Case(
        EV + "CREATE MATERIALIZED VIEW m ENGINE = AggregatingMergeTree() ORDER BY u AS SELECT u, sumState(id) AS s, countState() AS n, avgState(id) AS a, maxState(v) AS x FROM ev GROUP BY u;", BATCHES, "",
        "SELECT u, sumMerge(s) AS s, countMerge(n) AS n, round(avgMerge(a), 6) AS a, maxMerge(x) AS x FROM m GROUP BY u", "SELECT user_id AS u, sum(event_id)::BIGINT AS s, count(*) AS n, round(avg(event_id), 6) AS a, max(value) AS x FROM events GROUP BY 1",
    ),
    "merge_collapsing": Case(
        "CREATE TABLE t (k Int64, v Int64, sign Int8) ENGINE = CollapsingMergeTree(sign) ORDER BY k;", (("t", "SELECT o_orderkey AS k, o_custkey AS v, 1 AS sign FROM orders"), ("t", "SELECT o_orderkey AS k, o_custkey AS v, -1 AS sign FROM orders WHERE o_orderstatus = 'F'")), "",
        "SELECT k, v FROM t FINAL", "SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderstatus <> 'F'",
    ),
    "merge_versioned": Case(
        "CREATE TABLE t (k Int64, v Int64, sign Int8, ver Int32) ENGINE = VersionedCollapsingMergeTree(sign, ver) ORDER BY k;",
        (("t", "SELECT o_orderkey AS k, 1 AS v, 1 AS sign, 1 AS ver FROM orders"), ("t", "SELECT o_orderkey AS k, 2 AS v, 1 AS sign, 2 AS ver FROM orders WHERE o_orderstatus = 'F'"), ("t", "SELECT o_orderkey AS k, 1 AS v, -1 AS sign, 1 AS ver FROM orders WHERE o_orderstatus = 'F'")),
        "", "SELECT k, v, ver FROM t FINAL", "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END::BIGINT AS v, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS ver FROM orders",
    ),
    "merge_replicated": Case(EV + "CREATE MATERIALIZED VIEW m ENGINE = ReplicatedMergeTree('/p', 'r') ORDER BY u AS SELECT u, id FROM ev;", BATCHES, "", "", "SELECT user_id AS u, event_id AS id FROM events", "m"),
    "merge_summing": Case(EV + "CREATE MATERIALIZED VIEW m ENGINE = SummingMergeTree() ORDER BY kind AS SELECT kind, sum(id) AS s, count() AS n FROM ev GROUP BY kind;", BATCHES, "", "", "SELECT event_type AS kind, sum(event_id)::BIGINT AS s, count(*) AS n FROM events GROUP BY 1", "m"),
    # materialized views
    "mv_partials": Case(
        "CREATE TABLE ev (id Int64, ts Timestamp_NTZ, event_type String) ENGINE = MergeTree() ORDER BY id; CREATE MATERIALIZED VIEW m ENGINE = SummingMergeTree() ORDER BY (hour, event_type) AS SELECT toStartOfHour(ts) AS hour, event_type, count() AS n FROM ev GROUP BY hour, event_type;",
        tuple(("ev", f"SELECT event_id AS id, ts, event_type FROM events WHERE {w}") for w in ("event_type = 'error'", "value > 50 AND event_type != 'error'", "value <= 50 AND event_type != 'error'")), "",
        "", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL", "m",
    ),
    "mv_to_table": Case(EV + "CREATE TABLE t (u Int64, n Int64) ENGINE = SummingMergeTree() ORDER BY u; CREATE MATERIALIZED VIEW m TO t AS SELECT u, count() AS n FROM ev GROUP BY u;", BATCHES, "", "SELECT u, n FROM t FINAL", "SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1"),
    "mv_to_function": Case(EV + "CREATE MATERIALIZED VIEW m TO file('{dir}', 'Parquet', 'id Int64, v Float64') AS SELECT id, v FROM ev;", BATCHES, "", "SELECT id, v FROM m", "SELECT event_id AS id, value AS v FROM events"),
    "mv_populate": Case(EV, BATCHES, "CREATE MATERIALIZED VIEW m ENGINE = MergeTree() ORDER BY u POPULATE AS SELECT u, count() AS n FROM ev GROUP BY u", "SELECT u, n FROM m", "SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1"),
}


def move_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both tables after a partition has moved from one to the other."""
    w = warehouse(spark, sf_dir)
    w.run_script(O + "CREATE TABLE o2 AS o;")
    w.insert("o", w.session().run(parse_select(FEED[1])))
    w.run_script("ALTER TABLE o MOVE PARTITION 'P' TO TABLE o2, MOVE PARTITION 'F' TO DISK 'cold'")
    return w.read("o").selectExpr("'o' AS t", "k").unionByName(w.read("o2").selectExpr("'o2' AS t", "k"))


def pruned_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition's rows: only its folders are in the scan."""
    w = warehouse(spark, sf_dir)
    w.run_script(O)
    w.insert("o", w.session().run(parse_select(FEED[1])))
    return w.read_partition("o", "P").select("k", "s")


def freeze_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a frozen partition holds after the table has lost it."""
    w = warehouse(spark, sf_dir)
    w.run_script(O)
    w.insert("o", w.session().run(parse_select(FEED[1])))
    w.run_script("ALTER TABLE o FREEZE PARTITION 'F' WITH NAME 'b', DROP PARTITION 'F', FREEZE")
    return w.raw("o", [tuple(p) for p in w.frozen["b"]]).select("k", "s")


def fetch_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition that comes from another warehouse's folder."""
    w, other = warehouse(spark, sf_dir), warehouse(spark, sf_dir)
    for x in (w, other):
        x.run_script(O)
    other.insert("o", other.session().run(parse_select(FEED[1])))
    folders = [p for k, p in other.tables["o"].parts if k == "F"]
    for p in folders:
        w.run_script(f"ALTER TABLE o FETCH PARTITION 'F' FROM '{p}'")
    w.run_script("ALTER TABLE o ATTACH PARTITION 'F'")
    return w.read("o").select("k", "s")


def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same root opened again: tables, views and functions are found."""
    w = warehouse(spark, sf_dir)
    w.run_script(O + "CREATE VIEW v AS SELECT inc(k) AS k, s FROM o; CREATE FUNCTION inc AS (x) -> x + 1;")
    w.insert("o", w.session().run(parse_select(FEED[1])))
    return Warehouse(spark, w.root).run_script("SELECT k, s FROM v")[0]


def grants_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles and grants that a script leaves."""
    w = Warehouse(spark)
    w.run_script(
        "CREATE ROLE a; CREATE ROLE b SETTINGS max_threads = 2; CREATE ROLE gone; ALTER ROLE a RENAME TO c; DROP ROLE gone; GRANT SELECT, INSERT ON d.* TO c, b; GRANT ALTER ON d.t TO b WITH GRANT OPTION; REVOKE INSERT ON d.* FROM c; REVOKE GRANT OPTION FOR ALTER ON d.t FROM b; SET DEFAULT ROLE c TO u; SET ROLE ALL"
    )
    rows = [("role", r, "") for r in w.roles] + [("grant", g, p + (" with option" if option else "")) for g, p, _, _, option in w.grants] + [("default", u, ",".join(r)) for u, (_, r) in w.session_roles.items() if u == "u"]
    return spark.createDataFrame(rows, "kind string, name string, what string")


def collections_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named collections that a script leaves."""
    w = Warehouse(spark)
    w.run_script("CREATE NAMED COLLECTION a AS x = 'one' OVERRIDABLE, y = 'two'; CREATE NAMED COLLECTION b AS z = 'q'; ALTER NAMED COLLECTION a SET x = 'three' DELETE y; DROP NAMED COLLECTION b")
    return spark.createDataFrame([(n, k, str(v)) for n in w.collections for k, v in w.named(n).items()], "name string, k string, v string")


CODE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "move_partition": (move_partition, CASES.pop("move_partition").oracle),
    "pruned_partition": (pruned_partition, "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'P'"),
    "freeze_partition": (freeze_partition, "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F'"),
    "fetch_partition": (fetch_partition, "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'F'"),
    "warehouse_reopened": (reopened, "SELECT o_orderkey + 1 AS k, o_orderstatus AS s FROM orders"),
    "grants_left": (grants_left, "SELECT * FROM (VALUES ('role', 'c', ''), ('role', 'b', ''), ('grant', 'c', 'SELECT'), ('grant', 'b', 'SELECT'), ('grant', 'b', 'INSERT'), ('grant', 'b', 'ALTER'), ('default', 'u', 'c')) t(kind, name, what)"),
    "collections_left": (collections_left, "SELECT 'a' AS name, 'x' AS k, 'three' AS v"),
}

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {n: (c, c.oracle) for n, c in CASES.items()} | CODE
