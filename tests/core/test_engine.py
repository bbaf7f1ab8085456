"""Semantics of the compiler, the differ, migrations and statements at work."""
import re

import pytest
from pyspark.sql import functions as F

from tarn import migrate as M
from tarn.apply import Warehouse
from tarn.catalog import SchemaError, catalog, clause_conflicts, with_cluster
from tarn.compile import Session
from tarn.diff import NoDifference, migration
from tarn.operators.asof import asof_join
from tarn.replay import replayed
from tarn.sqlfront.ddl import parse, write_script
from tarn.sqlfront.parser import parse_type
from tarn.sqlfront.tokens import SqlError
from tarn.types import TypeError_, same, spark_type


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def s(spark):
    t = spark.createDataFrame([(1, "a", 10), (1, "b", 20), (2, "a", None), (3, None, 5)], "k int, name string, v int")
    u = spark.createDataFrame([(1, "x"), (1, "y"), (9, "z"), (None, "n")], "k int, tag string")
    n = spark.createDataFrame([(1, [("p", 1), ("q", 2)], [7, 8]), (2, [], None)], "id int, pages array<struct<url:string,n:int>>, xs array<int>")
    return Session(spark, {"t": t, "u": u, "db.n": n})


def test_nulls_and_order(s):
    assert [r[0] for r in s.sql("SELECT v FROM t ORDER BY v").collect()] == [5, 10, 20, None]
    assert [r[0] for r in s.sql("SELECT v FROM t ORDER BY v DESC NULLS FIRST").collect()] == [None, 20, 10, 5]
    assert rows(s.sql("SELECT k FROM t WHERE k NOT IN (SELECT k FROM u)")) == []
    assert rows(s.sql("SELECT v / 0 AS q FROM t WHERE k = 3")) == [(None,)]


def test_joins(s):
    assert len(rows(s.sql("SELECT t.k AS k, tag FROM t LEFT JOIN u ON t.k = u.k"))) == 6
    with pytest.raises(SqlError):
        s.sql("SELECT 1 FROM t LEFT JOIN u")
    assert rows(s.sql("SELECT id, pages.url AS url FROM db.n ARRAY JOIN pages")) == [(1, "p"), (1, "q")]
    assert rows(s.sql("SELECT id, x FROM db.n LEFT ARRAY JOIN xs AS x")) == [(1, 7), (1, 8), (2, None)]
    assert rows(s.sql("SELECT count(*) AS n FROM t GLOBAL INNER JOIN u USING (k)")) == [(4,)]


def test_asof_by_brute_force(spark):
    left = [(i, i % 3 if i % 7 else None, (i * 37) % 50 if i % 11 else None) for i in range(80)]
    right = [(100 + i, i % 3 if i % 5 else None, (i * 23) % 50 if i % 9 else None) for i in range(60)]
    a, b = spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "id int, k int, t int")
    for op, ok, best in ((">=", lambda x, y: x >= y, max), (">", lambda x, y: x > y, max), ("<=", lambda x, y: x <= y, min), ("<", lambda x, y: x < y, min)):
        want = []
        for i, k, t in left:
            hits = [(rt, rid, rk) for rid, rk, rt in right if k is not None and t is not None and rk == k and rt is not None and ok(t, rt)]
            near = best(h[0] for h in hits) if hits else None
            want.append((i, min((h[1] for h in hits if h[0] == near), default=None)))
        got = asof_join(a, b, [("k", "k")], ("t", op, "t"), inner=False, held="r").select("id", "r.id")
        assert rows(got) == sorted(want, key=repr), op
        assert asof_join(a, b, [("k", "k")], ("t", op, "t")).count() == sum(w[1] is not None for w in want)
        split = asof_join(a, b, [("k", "k")], ("t", op, "t"), inner=False, held="r", ranges=5).select("id", "r.id")
        assert rows(split) == sorted(want, key=repr), op
        alone = []
        for i, _, t in left:
            hits = [(rt, rid) for rid, _, rt in right if t is not None and rt is not None and ok(t, rt)]
            near = best(h[0] for h in hits) if hits else None
            alone.append((i, min((h[1] for h in hits if h[0] == near), default=None)))
        assert rows(asof_join(a, b, [], ("t", op, "t"), inner=False, held="r").select("id", "r.id")) == sorted(alone, key=repr), op
    mapped = b.withColumn("m", F.create_map(F.lit("x"), "id"))
    assert asof_join(a, mapped, [("k", "k")], ("t", ">=", "t")).count() > 0


def test_totals_limit_by_alias(s):
    assert [tuple(r) for r in s.sql("SELECT k, count() AS n FROM t GROUP BY k WITH TOTALS ORDER BY n DESC, k LIMIT 1").collect()] == [(1, 2), (None, 4)]
    assert [tuple(r) for r in s.sql("SELECT k, name FROM t ORDER BY name DESC LIMIT 1 BY k LIMIT 2").collect()] == [(1, "b"), (2, "a")]
    assert rows(s.sql("SELECT k + 1 AS more FROM t WHERE more > 3")) == [(4,)]


def test_fill(s):
    out = s.sql("SELECT k * 3 AS k, count() AS n FROM t GROUP BY k ORDER BY k WITH FILL FROM 2 TO 12 STEP 2 INTERPOLATE (n AS n + 1)")
    assert [tuple(r) for r in out.collect()] == [(2, None), (3, 2), (4, 3), (6, 1), (8, 2), (9, 1), (10, 2)]
    down = s.sql("SELECT k, count() AS n FROM t GROUP BY k HAVING k != 2 ORDER BY k DESC WITH FILL")
    assert [tuple(r) for r in down.collect()] == [(3, 1), (2, None), (1, 2)]


def test_wide_gaps(s):
    assert rows(s.sql("SELECT count(*) AS n, sum(k) AS t FROM (SELECT k FROM t ORDER BY k WITH FILL FROM 0 TO 100000 STEP 7)"))[0] == (14290, sum(range(0, 100000, 7)) + 1 + 1 + 2 + 3)
    months = s.sql("SELECT toDate('2024-01-31') AS d FROM t WHERE k = 2 ORDER BY d WITH FILL FROM toDate('2024-01-31') TO toDate('2224-01-31') STEP INTERVAL 1 MONTH")
    assert months.count() == 2400 and str(months.collect()[-1].d) == "2223-12-31"
    down = s.sql("SELECT k FROM t WHERE k = 1 ORDER BY k DESC WITH FILL FROM 5000 TO 0 STEP -1")
    assert down.count() == 5001  # both rows of 1


def test_aggregates(s):
    assert rows(s.sql("SELECT countIf(v > 5) AS c, sumIf(v, k = 1) AS s, argMax(name, v) AS m, quantile(0.5)(v) AS q, uniqMerge(x) AS u FROM (SELECT any(k) AS k, v, name, uniqState(k) AS x FROM t GROUP BY v, name)")) == [(2, 30, "b", 10.0, 3)]
    approx, exact = s.sql("SELECT uniq(number % 5000) AS a, uniqExact(number % 5000) AS e FROM numbers(50000)").first()
    assert exact == 5000 and abs(approx - exact) < 0.05 * exact


def test_sketches_beside_distinct_aggregates(spark):
    """No group of a key and a distinct value holds a sketch's buffer, which has a fixed width of kilobytes."""
    t = spark.sql("SELECT id % 3 AS k, id % 900 AS a, CASE WHEN id % 5 > 0 THEN concat('n', id % 700) END AS b, id % 2 AS c, make_interval(0, 0, 0, id % 4) AS i FROM range(6000)").cache()
    s = Session(spark, {"t": t}, {"spread": parse("CREATE FUNCTION spread AS (v) -> uniq(v) - uniqExact(v)")[0].get("body")})
    wide = r"Aggregate\(keys=\[[^\]]*\b[ab]#[^\]]*\], functions=\[[^\]]*approx_count_distinct"
    one, two = t.selectExpr("approx_count_distinct(a, 0.02)").first()[0], t.selectExpr("approx_count_distinct(b, 0.02)").first()[0]
    for text, want in (
        ("SELECT uniq(a), uniqExact(a) FROM t", (one, 900)),
        ("SELECT uniq(a) AS u, uniqExact(b) AS e, count() AS n FROM t", (one, 560, 6000)),
        ("SELECT uniq(b) AS u, count(DISTINCT a) AS e, uniqCombined(a) > 0 AS x FROM t", (two, 900, True)),
        ("SELECT uniqIf(a, c = 0) AS u, uniqExactIf(a, c = 1) AS e, sum(c) AS n FROM t", (t.where("c = 0").selectExpr("approx_count_distinct(a, 0.02)").first()[0], 450, 3000)),
        ("SELECT uniq(a) AS u FROM t HAVING uniqExact(b) = 560", (one,)),
        ("SELECT spread(a) AS d FROM t", (one - 900,)),
        ("SELECT (SELECT uniq(a) + uniqExact(b) FROM t) AS d", (one + 560,)),
    ):
        df = s.sql(text)
        assert rows(df) == [want], text
        assert not re.search(wide, df._jdf.queryExecution().executedPlan().toString()), text
    assert s.sql("SELECT uniq(a), uniqExact(a) FROM t").columns == ["uniq(a)", "uniqExact(a)"]
    by_key = s.sql("SELECT k, uniq(a) AS u, uniqExact(b) AS e FROM t GROUP BY k WITH TOTALS")
    assert rows(by_key) == rows(t.rollup("k").agg(F.expr("approx_count_distinct(a, 0.02)"), F.expr("count(DISTINCT b)")))
    # a calendar interval is no sound key beside NULLs that Spark puts in
    assert rows(s.sql("SELECT uniq(i) AS u, uniqExact(a) AS e, count() AS n, max(b) AS m FROM t")) == [(4, 900, 6000, "n99")]
    assert rows(s.sql("SELECT uniq(a) AS u, uniqExact(i) AS e, count() AS n FROM t")) == [(one, 4, 6000)]


def test_types():
    assert spark_type(parse_type("Map(String, Array(Nullable(UInt8)))")).simpleString() == "map<string,array<smallint>>"
    assert spark_type(parse_type("Decimal64(2)")).simpleString() == "decimal(18,2)"
    assert same(parse_type("DateTime64(3)"), parse_type("DateTime64(3, 'UTC')")) and not same(parse_type("DateTime64(3)"), parse_type("DateTime64(6)"))
    for bad in ("Decimal256(3)", "Int256", "Whatever"):
        with pytest.raises(TypeError_):
            spark_type(parse_type(bad))


BASE = "CREATE TABLE d.t (a UInt8, b String) ENGINE = MergeTree() ORDER BY a;"
DIFFS = [
    ("", "CREATE DATABASE d", ["CREATE DATABASE `d`"]),
    ("CREATE DATABASE d COMMENT 'a'", "CREATE DATABASE d COMMENT 'b'", ["ALTER DATABASE `d` MODIFY COMMENT 'b'"]),
    ("CREATE DATABASE d COMMENT 'a'", "CREATE DATABASE e COMMENT 'a'", ["RENAME DATABASE `d` TO `e`"]),
    (BASE, "CREATE TABLE d.t (a UInt8, b String, c UInt8 DEFAULT 1) ENGINE = MergeTree() ORDER BY a", ["ALTER TABLE `d`.`t` ADD COLUMN `c` UInt8 DEFAULT 1 AFTER `b`"]),
    (BASE, "CREATE TABLE d.t (a UInt16) ENGINE = MergeTree() ORDER BY a", ["ALTER TABLE `d`.`t` MODIFY COLUMN `a` UInt16, DROP COLUMN `b`"]),
    (BASE, BASE.replace("ORDER BY a", "ORDER BY (a, b)"), ["ALTER TABLE `d`.`t` MODIFY ORDER BY (a, b)"]),
    (BASE, BASE.replace("d.t", "d.u"), ["RENAME TABLE `d`.`t` TO `d`.`u`"]),
    ("CREATE TABLE d.k (a UInt8) ENGINE = Kafka('x')", "CREATE TABLE d.k (a UInt8) ENGINE = Kafka('y')", ["DROP TABLE IF EXISTS `d`.`k`", "CREATE TABLE `d`.`k`"]),
    ("CREATE TABLE d.r (a UInt8) ENGINE = ReplicatedMergeTree('/p', 'r') ORDER BY a", "CREATE TABLE d.r (a UInt8) ENGINE = ReplicatedMergeTree() ORDER BY a", None),
    ("CREATE TABLE d.n (a Nested(x String, y UInt8)) ENGINE = Memory", "CREATE TABLE d.n (`a.x` Array(String), `a.y` Array(UInt8)) ENGINE = Memory", None),
    ("CREATE TABLE d.n (a DateTime64(3)) ENGINE = Memory", "CREATE TABLE d.n (a DateTime64(3, 'UTC')) ENGINE = Memory", None),
    ("CREATE VIEW d.v AS SELECT a FROM d.t WHERE a > 1", "CREATE VIEW d.v AS SELECT a FROM d.t WHERE a > 2", ["CREATE OR REPLACE VIEW `d`.`v` AS SELECT a FROM d.t WHERE a > 2"]),
    ("CREATE VIEW d.v AS SELECT A FROM d.t", "CREATE VIEW d.v AS SELECT a FROM d.t", None),
    ("CREATE VIEW d.v AS SELECT a FROM d.t", "CREATE VIEW d.w AS SELECT a FROM d.t", ["RENAME TABLE `d`.`v` TO `d`.`w`"]),
    ("CREATE MATERIALIZED VIEW d.m ENGINE = Memory AS SELECT 1 AS a", "CREATE MATERIALIZED VIEW d.m ENGINE = Memory AS SELECT 2 AS a", ["DROP TABLE IF EXISTS `d`.`m`", "CREATE MATERIALIZED VIEW `d`.`m`"]),
    ("CREATE FUNCTION f AS (x) -> x", "CREATE FUNCTION f AS (x) -> x + 1", ["CREATE OR REPLACE FUNCTION `f`"]),
    ("CREATE FUNCTION f AS (x) -> x", "CREATE FUNCTION g AS (x) -> x", ["DROP FUNCTION IF EXISTS `f`", "CREATE FUNCTION `g`"]),
    ("CREATE ROLE r", "CREATE ROLE r SETTINGS a = 1", ["ALTER ROLE `r` SETTINGS a = 1"]),
    ("CREATE ROLE r", "CREATE ROLE q", ["ALTER ROLE `r` RENAME TO `q`"]),
    ("GRANT SELECT ON d.* TO r", "GRANT SELECT ON d.* TO r WITH GRANT OPTION", ["GRANT SELECT ON d.* TO `r` WITH GRANT OPTION", "REVOKE SELECT ON d.* FROM `r`"]),
    ("CREATE DICTIONARY d.x (a UInt8) PRIMARY KEY a SOURCE(HTTP(url 'u')) LAYOUT(HASHED()) LIFETIME(9)", "CREATE DICTIONARY d.x (a UInt8) PRIMARY KEY a SOURCE(HTTP(URL 'u')) LAYOUT(COMPLEX_KEY_HASHED()) LIFETIME(MIN 0 MAX 9)", None),
    ("CREATE DICTIONARY d.x (a UInt8) PRIMARY KEY a SOURCE(HTTP(url 'u')) LAYOUT(FLAT()) LIFETIME(9)", "CREATE DICTIONARY d.x (a UInt8) PRIMARY KEY a SOURCE(HTTP(url 'u')) LAYOUT(FLAT()) LIFETIME(8)", ["CREATE OR REPLACE DICTIONARY `d`.`x`"]),
]


@pytest.mark.parametrize(("before", "after", "want"), DIFFS)
def test_differences(spark, before, after, want):
    if want is None:
        with pytest.raises(NoDifference):
            migration(spark, before, after)
        return
    text = migration(spark, before, after)
    got = [p.strip() for p in text.split(";") if p.strip()]
    assert len(got) == len(want) and all(g.startswith(w) for g, w in zip(got, want, strict=True)), text
    assert parse(text) and parse(migration(spark, before, after, undo=True))


def test_migration_leads_to_target(spark):
    from tarn.plans.schema_queries import AFTER, BEFORE

    script = migration(spark, BEFORE, AFTER)
    after = write_script(replayed(parse(BEFORE) + parse(script)))
    with pytest.raises(NoDifference):
        migration(spark, after, AFTER)


@pytest.mark.parametrize(("before", "after"), [("CREATE DATABASE d ON CLUSTER a", "CREATE DATABASE d ON CLUSTER b"), (BASE, BASE.replace("MergeTree()", "SummingMergeTree()")), ("CREATE DATABASE d ENGINE = A", "CREATE DATABASE d ENGINE = B"), ("", "CREATE TABLE d.k (a UInt8) ENGINE = Kafka() ORDER BY a"), ("", "CREATE TABLE d.a AS d.b; CREATE TABLE d.b AS d.a"), ("", "CREATE TABLE d.a AS d.none")])
def test_impossible_changes(spark, before, after):
    with pytest.raises(SchemaError):
        migration(spark, before, after)


def test_views_after_what_they_read(spark):
    text = migration(spark, "", "CREATE VIEW d.a AS SELECT x FROM d.b; CREATE VIEW d.b AS SELECT x FROM d.c; CREATE VIEW d.c AS SELECT 1 AS x")
    assert [line.split("`")[3] for line in text.split("\n") if line] == ["c", "b", "a"]


def test_catalog_helpers(spark):
    assert clause_conflicts(catalog(spark, "CREATE TABLE d.k (a UInt8) ENGINE = Kafka() ORDER BY a")).count() == 1
    out = with_cluster(parse("CREATE DATABASE a; CREATE TABLE own.t (x UInt8) ENGINE = Memory; SELECT 1"), "c", own="own")
    assert [x.get("cluster") for x in out] == ["c", None, None]


def test_sums_and_hashes(tmp_path, spark):
    for name, text in (("001_a.sql", "SELECT 1;"), ("002_b.sql", "SELECT 2;"), ("note.txt", "x")):
        (tmp_path / name).write_text(text)
    one = M.SumFile.of_directory(str(tmp_path))
    assert [n for n, _ in one.entries] == ["001_a.sql", "002_b.sql"] and one.matches(one.text())
    (tmp_path / "001_a.sql").write_text("SELECT 3;")
    two = M.SumFile.of_directory(str(tmp_path))
    assert not two.matches(one.text()) and two.entries[1][1] != one.entries[1][1]
    df = spark.createDataFrame([(0, "SELECT 3;"), (1, "SELECT 2;")], "ordinal int, content string")
    assert M.chain(df).first()[0] == [h.hex() for _, h in two.entries]
    assert spark.range(1).select(M.statement_hash_column(F.lit("x"))).first()[0] == M.statement_hash("x")


def test_execute_resumes(tmp_path, spark):
    log = M.Log(spark, str(tmp_path / "log"))
    seen, broken = [], {"on": True}

    def run(s):
        if broken["on"] and s.get("comment") == "bad":
            raise RuntimeError("no")
        seen.append(s.name[0])

    scripts = [M.read_migration("001", "CREATE DATABASE a; CREATE DATABASE b COMMENT 'bad'; CREATE DATABASE c;"), M.read_migration("002", "CREATE DATABASE d;")]
    with pytest.raises(M.MigrationError):
        M.execute(scripts, log, run)
    assert seen == ["a"] and rows(M.statuses(M.migration_rows(spark, scripts), log.rows()).select("version", "status", "partial")) == [("001", "failed", True), ("002", "pending", False)]
    assert M.execute(scripts, log, run, dry=True) == [("001", "would run 2 statements"), ("002", "would run 1 statements")]
    changed = [M.read_migration("001", "CREATE DATABASE z; CREATE DATABASE b; CREATE DATABASE c;"), scripts[1]]
    with pytest.raises(M.MigrationError):
        M.execute(changed, log, run)
    broken["on"] = False
    assert M.execute(scripts, log, run) == [("001", "applied"), ("002", "applied")] and seen == ["a", "b", "c", "d"]
    assert M.execute(scripts, log, run) == [("001", "skipped"), ("002", "skipped")]
    snapshot = M.make_snapshot("003", scripts, "all")
    assert snapshot.included == ("001", "002") and M.execute([*scripts, snapshot], log, run)[-1] == ("003", "recorded")
    assert rows(M.after_snapshot(M.migration_rows(spark, [*scripts, snapshot, M.read_migration("004", "SELECT 1;")]), log.rows()).select("version")) == [("004",)]
    assert rows(M.status_counts(M.migration_rows(spark, [*scripts, snapshot]), log.rows())) == [(3, 3, 0, 0)]


def test_imports(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "main.sql").write_text("-- tarn:import sub/a.sql\nSELECT 2;")
    (tmp_path / "sub" / "a.sql").write_text("-- tarn:import b.sql\nSELECT 1;")
    (tmp_path / "sub" / "b.sql").write_text("SELECT 0;")
    assert len([x for x in parse(M.compiled(str(tmp_path / "main.sql"))) if x.kind == "SELECT"]) == 3
    (tmp_path / "sub" / "b.sql").write_text("-- tarn:import ../main.sql")
    with pytest.raises(ValueError):
        M.compiled(str(tmp_path / "main.sql"))


def test_warehouse(tmp_path, spark):
    w = Warehouse(spark, str(tmp_path))
    w.run_script(
        """CREATE DATABASE d; CREATE TABLE d.t (id UInt64, name String DEFAULT 'none', v Int32, twice Int32 MATERIALIZED v * 2, thrice Int32 ALIAS v * 3, day Date, CONSTRAINT pos CHECK v >= 0) ENGINE = MergeTree() ORDER BY id PARTITION BY day;
        CREATE MATERIALIZED VIEW d.m ENGINE = SummingMergeTree() ORDER BY name AS SELECT name, sum(v) AS total FROM d.t GROUP BY name;
        CREATE VIEW d.big AS SELECT id FROM d.t WHERE v > 1; CREATE FUNCTION inc AS (x) -> x + 1;
        CREATE TABLE d.l (k UInt64, v UInt64) ENGINE = ReplacingMergeTree(v) ORDER BY k"""
    )
    data = spark.createDataFrame([(1, 1, "2024-01-01"), (2, 2, "2024-01-02")], "id long, v int, day string").withColumn("day", F.to_date("day"))
    w.insert("d.t", data)
    w.insert("d.t", data.withColumn("name", F.lit("x")))
    assert rows(w.run_script("SELECT id, twice, thrice, inc(v) AS i FROM d.t WHERE name = 'x'")[0]) == [(1, 2, 3, 2), (2, 4, 6, 3)]
    assert rows(w.materialized("d.m")) == [("none", 3), ("x", 3)] and rows(w.run_script("SELECT id FROM d.big")[0]) == [(2,), (2,)]
    with pytest.raises(SchemaError):
        w.insert("d.t", data.withColumn("v", F.lit(-1)))
    w.run_script("ALTER TABLE d.t UPDATE v = v + 10 WHERE id = 2, DELETE WHERE name = 'x', ADD COLUMN z Nullable(UInt8) FIRST, RENAME COLUMN name TO title, MODIFY COLUMN v Int64, DROP CONSTRAINT pos")
    assert rows(w.run_script("SELECT z, id, title, v FROM d.t")[0]) == [(None, 1, "none", 1), (None, 2, "none", 12)]
    w.run_script("ALTER TABLE d.t DETACH PARTITION '2024-01-02'")
    assert w.read("d.t").count() == 1
    w.run_script("ALTER TABLE d.t ATTACH PARTITION '2024-01-02', DROP PARTITION '2024-01-01', FREEZE WITH NAME 'b'; RENAME TABLE d.t TO d.s; DETACH TABLE d.s")
    with pytest.raises(SchemaError):
        w.read("d.s")
    w.run_script("ATTACH TABLE d.s")
    assert w.read("d.s").count() == 1 and "b" in w.frozen
    w.insert("d.l", spark.createDataFrame([(1, 1), (1, 5), (2, 3)], "k long, v long"))
    assert rows(w.run_script("SELECT k, v FROM d.l FINAL")[0]) == [(1, 5), (2, 3)]
    w.run_script("GRANT SELECT ON d.* TO r; REVOKE SELECT ON d.* FROM r; CREATE ROLE r; DROP ROLE r; DROP TABLE d.s; DROP DATABASE d")
    assert not w.grants and not w.tables and not w.roles


def test_streamed_view(tmp_path, spark):
    from tarn.streaming.views import feed, windowed

    w = Warehouse(spark, str(tmp_path / "w"))
    w.run_script("CREATE TABLE t (k String, v Int64) ENGINE = MergeTree() ORDER BY k; CREATE MATERIALIZED VIEW m ENGINE = SummingMergeTree() ORDER BY k AS SELECT k, sum(v) AS s, count() AS n FROM t GROUP BY k")
    for i in range(3):
        spark.createDataFrame([("a", i), ("b", 1)], "k string, v long").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, v long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    feed(w, "t", stream, str(tmp_path / "c")).awaitTermination()
    assert rows(w.materialized("m")) == [("a", 3, 3), ("b", 3, 3)]
    at = spark.readStream.schema("ts timestamp, k string").parquet(str(tmp_path / "in"))
    assert windowed(at, "ts", "1 hour", "1 day", ["k"]).columns == ["start", "k", "n"]


def test_command_line(tmp_path, spark, capsys):
    from tarn.cli import main

    project = str(tmp_path)
    assert main(["--project", project, "init"]) == 0
    (tmp_path / "db" / "main.sql").write_text("CREATE DATABASE d; CREATE TABLE d.t (a UInt8) ENGINE = MergeTree() ORDER BY a;")
    assert main(["--project", project, "diff", "--name", "first"]) == 0
    assert main(["--project", project, "diff"]) == 1
    assert main(["--project", project, "migrate"]) == 0
    assert main(["--project", project, "status", "--verbose"]) == 0
    assert "completed 1, pending 0" in capsys.readouterr().out
    assert main(["--project", project, "schema", "dump"]) == 0
    assert main(["--project", project, "snapshot"]) == 0
    assert main(["--project", project, "fmt", "-w", str(tmp_path / "db" / "main.sql")]) == 0


def test_project_image(tmp_path):
    from tarn.project import cleaned, image, write_image

    text = "CREATE DATABASE d; CREATE TABLE d.t (a UInt8) ENGINE = Memory; CREATE VIEW d.b AS SELECT a FROM d.c; CREATE VIEW d.c AS SELECT a FROM d.t; CREATE ROLE r; GRANT SELECT ON d.* TO r; CREATE FUNCTION f AS (x) -> x"
    statements = parse(text)
    files = image(statements)
    assert {"main.sql", "global/roles.sql", "schemas/d/schema.sql", "schemas/d/tables/t.sql"} <= set(files)
    assert len(write_image(str(tmp_path), statements)) == len(files)
    assert write_image(str(tmp_path), statements) == ["main.sql"]
    again = parse(M.compiled(str(tmp_path / "main.sql")))
    assert sorted(map(repr, [s for s in again if s.kind != "COMMENT"])) == sorted(map(repr, statements))
    assert [s.name[-1] for s in again if s.kind == "CREATE VIEW"] == ["c", "b"]
    assert cleaned("x Float32 DEFAULT 1., LIFETIME(MIN 0 MAX 9)") == "x Float32 DEFAULT 1.0, LIFETIME(9)"


def test_changes_of_a_table_reach_those_declared_as_it(spark):
    chain = "CREATE TABLE d.p (a UInt8{}) ENGINE = MergeTree() ORDER BY a; CREATE TABLE d.c AS d.p ENGINE = MergeTree() ORDER BY a; CREATE TABLE d.g AS d.c ENGINE = MergeTree() ORDER BY a"
    script = migration(spark, chain.format(""), chain.format(", b String"))
    assert [x.name for x in parse(script)] == [("d", "c"), ("d", "g"), ("d", "p")] and all(x.kind == "ALTER TABLE" for x in parse(script))
    with pytest.raises(NoDifference):
        migration(spark, write_script(replayed(parse(chain.format("")) + parse(script))), chain.format(", b String"))


def test_functions_that_become_operators_keep_their_arguments_together(s):
    assert rows(s.sql("SELECT multiply(k + 1, 2) AS a, negate(k - 5) AS b, not(k = 1 OR k = 2) AS c, intDiv(k + 7, 2) AS d, isNull(k + v) AS e FROM t WHERE k = 2")) == [(6, 3, False, 4, True)]


def test_query_steps_compose(s):
    assert [tuple(r) for r in s.sql("SELECT k, name FROM t ORDER BY k WITH FILL FROM 0 TO 5 LIMIT 1 BY k").collect()] == [(0, None), (1, "a"), (2, "a"), (3, None), (4, None)]
    assert rows(s.sql("SELECT DISTINCT k FROM t ORDER BY v LIMIT 1 BY name")) == [(1,), (3,)]
    assert [tuple(r) for r in s.sql("SELECT k, count() AS n FROM t GROUP BY k WITH TOTALS ORDER BY k WITH FILL FROM 1 TO 6").collect()] == [(1, 2), (2, 1), (3, 1), (4, None), (5, None), (None, 4)]
    assert [tuple(r) for r in s.sql("SELECT k, name, count() AS n FROM t GROUP BY k, name WITH TOTALS ORDER BY k, name LIMIT 1 BY k").collect()] == [(1, "a", 1), (2, "a", 1), (3, None, 1), (None, None, 4)]
    assert [tuple(r) for r in s.sql("SELECT k FROM t ORDER BY k LIMIT 3 SETTINGS limit = 2, offset = 1").collect()] == [(1,), (2,)]


def test_warehouse_outlives_its_process(tmp_path, spark):
    script = """CREATE DATABASE d COMMENT 'x'; CREATE TABLE d.t (id UInt64, name LowCardinality(String) DEFAULT 'n', n Nested(a UInt8, b String), v Int32, CONSTRAINT pos CHECK v >= 0) ENGINE = MergeTree() ORDER BY id PARTITION BY v % 2;
        CREATE MATERIALIZED VIEW d.m ENGINE = SummingMergeTree() ORDER BY name AS SELECT name, sum(v) AS total FROM d.t GROUP BY name; CREATE VIEW d.v AS SELECT id FROM d.t;
        CREATE FUNCTION inc AS (x) -> x + 1; CREATE ROLE r SETTINGS max_threads = 4; GRANT SELECT(id, v) ON d.t TO r WITH GRANT OPTION; CREATE NAMED COLLECTION c AS a = 'b' OVERRIDABLE; SET DEFAULT ROLE r TO u;
        CREATE DICTIONARY d.x (id UInt64, v Int32) PRIMARY KEY id SOURCE(LOCAL(TABLE 't' DB 'd')) LAYOUT(FLAT()) LIFETIME(9)"""
    w = Warehouse(spark, str(tmp_path))
    w.run_script(script)
    w.insert("d.t", spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id long, v int"))
    w.run_script("ALTER TABLE d.t DETACH PARTITION 0, FREEZE WITH NAME 'f'; DETACH VIEW d.v")
    again = Warehouse(spark, str(tmp_path))
    for part in ("databases", "tables", "views", "dictionaries", "functions", "collections", "roles", "grants", "session_roles", "aside"):
        assert getattr(again, part) == getattr(w, part), part
    assert rows(again.run_script("SELECT id, inc(v) AS i FROM d.t")[0]) == [(1, 2), (3, 4)]
    again.run_script("ALTER TABLE d.t ATTACH PARTITION 0; ATTACH VIEW d.v")
    assert rows(Warehouse(spark, str(tmp_path)).run_script("SELECT id FROM d.v")[0]) == [(1,), (2,), (3,)]
    assert again.named("c") == {"a": "b"}


def test_partitions_are_folders(tmp_path, spark):
    w = Warehouse(spark, str(tmp_path))
    w.run_script("CREATE TABLE t (day Date, k String, v Int32) ENGINE = MergeTree() ORDER BY v PARTITION BY (toYYYYMM(day), k); CREATE TABLE u AS t ENGINE = MergeTree() ORDER BY v")
    data = spark.createDataFrame([(f"2024-0{m}-01", k, m) for m in (1, 2, 3) for k in ("a", "b/=c", "")], "day string, k string, v int").withColumn("day", F.to_date("day"))
    w.insert("t", data)
    assert {r.partition for r in w.partitions('t').collect()} >= {"202401-''", "202401-a", "202401-b/=c"}
    files = set(w.read("t").inputFiles())
    plan = w.read("t").where("v = 2")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(v,2)" in plan
    assert len(set(w.read_partition("t", "202401-a").inputFiles())) == 1 and w.read_partition("t", "202401-a").count() == 1
    w.run_script("ALTER TABLE t DROP PARTITION (202401, 'b/=c'), DETACH PARTITION (202402, ''); ALTER TABLE u ATTACH PARTITION (202403, 'a') FROM t; ALTER TABLE t MOVE PARTITION (202403, 'b/=c') TO TABLE u")
    assert w.read("t").count() == 6 and w.read("u").count() == 2 and set(w.read("t").inputFiles()) < files and set(w.read("u").inputFiles()) < files
    w.run_script("ALTER TABLE u REPLACE PARTITION (202403, 'a') FROM t; ALTER TABLE t CLEAR COLUMN v IN PARTITION (202401, 'a'), ADD COLUMN w Int32 DEFAULT v + 1")
    assert rows(w.read("u").select("k", "v")) == [("a", 3), ("b/=c", 3)] and rows(w.read("t").select("v", "w")) == [(0, 1), (1, 2), (2, 3), (2, 3), (3, 4), (3, 4)]
    w.run_script("ALTER TABLE t DROP COLUMN w, ADD COLUMN w String DEFAULT 'new', UPDATE w = 'old' WHERE v = 1, DROP COLUMN w, ADD COLUMN w String DEFAULT 'new'")
    assert {r.w for r in w.read("t").collect()} == {"new"}
    with pytest.raises(SchemaError):
        w.run_script("ALTER TABLE t DROP COLUMN k")
    frozen = str(tmp_path / "other")
    w.read("u").write.parquet(frozen)
    w.run_script(f"ALTER TABLE u FETCH PARTITION (202403, 'z') FROM '{frozen}', ATTACH PARTITION (202403, 'z')")
    assert w.read("u").count() == 4


def test_merging_engines(tmp_path, spark):
    w = Warehouse(spark, str(tmp_path))
    w.run_script(
        """CREATE TABLE a (k String, s AggregateFunction(sum, Int64), m SimpleAggregateFunction(max, Int64), v AggregateFunction(avg, Int64)) ENGINE = AggregatingMergeTree() ORDER BY k;
        CREATE TABLE c (k Int32, v String, sign Int8) ENGINE = CollapsingMergeTree(sign) ORDER BY k;
        CREATE TABLE vc (k Int32, v String, sign Int8, ver Int32) ENGINE = VersionedCollapsingMergeTree(sign, ver) ORDER BY k;
        CREATE TABLE r (k Int32, v Int32) ENGINE = ReplicatedMergeTree('/p/{shard}', '{replica}') ORDER BY k;
        CREATE TABLE rr (k Int32, v Int32, gone UInt8) ENGINE = ReplicatedReplacingMergeTree('/p', 'r', v, gone) ORDER BY k;
        CREATE TABLE sm (k Int32, x Int32, y Int32) ENGINE = SummingMergeTree((x)) ORDER BY k; CREATE TABLE src (k String, x Int64) ENGINE = Memory;
        CREATE MATERIALIZED VIEW mv TO a AS SELECT k, sumState(x) AS s, max(x) AS m, avgState(x) AS v FROM src GROUP BY k; CREATE MATERIALIZED VIEW plain ENGINE = ReplicatedMergeTree('/q', 'r') ORDER BY k AS SELECT k, x FROM src"""
    )
    for batch in ([("a", 3), ("b", 1)], [("a", 10)]):
        w.insert("src", spark.createDataFrame(batch, "k string, x long"))
    assert rows(w.materialized("mv").select("k", "s", "m", "v.sum", "v.count")) == [("a", 13, 10, 13.0, 2), ("b", 1, 1, 1.0, 1)]
    assert rows(w.run_script("SELECT k, sumMerge(s) AS s, avgMerge(v) AS v FROM mv GROUP BY k")[0]) == [("a", 13, 6.5), ("b", 1, 1.0)]
    assert rows(w.materialized("plain")) == [("a", 10), ("a", 3), ("b", 1)]
    w.insert("c", spark.createDataFrame([(1, "x", 1), (1, "x", -1), (1, "y", 1), (2, "z", 1), (2, "z", -1)], "k int, v string, sign int"))
    assert rows(w.read("c", final=True)) == [(1, "y", 1)]
    w.insert("vc", spark.createDataFrame([(1, "x", 1, 1), (1, "y", 1, 2), (1, "x", -1, 1)], "k int, v string, sign int, ver int"))
    assert rows(w.run_script("SELECT k, v FROM vc FINAL")[0]) == [(1, "y")]
    w.insert("r", spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "k int, v int"))
    assert w.read("r", final=True).count() == 3
    w.insert("rr", spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 1, 0)], "k int, v int, gone int"))
    assert rows(w.read("rr", final=True)) == [(2, 1, 0)]
    w.insert("sm", spark.createDataFrame([(1, 1, 5), (1, 2, 5)], "k int, x int, y int"))
    assert rows(w.read("sm", final=True)) == [(1, 3, 5)]


def test_engines_of_other_stores(tmp_path, spark):
    w = Warehouse(spark, str(tmp_path / "w"))
    for kind in ("Parquet", "CSVWithNames", "JSONEachRow", "TSV", "ORC"):
        path = str(tmp_path / kind)
        w.run_script(f"CREATE TABLE f_{kind} (k Int32, v String) ENGINE = File('{kind}', '{path}'); CREATE TABLE s_{kind} (k Int32, v String) ENGINE = S3('{path}', '{kind}')")
        assert w.read(f"f_{kind}").count() == 0
        w.insert(f"f_{kind}", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
        assert rows(w.read(f"s_{kind}")) == [(1, "a"), (2, "b")], kind
    w.run_script(
        f"""CREATE DATABASE d; CREATE TABLE d.x1 (k Int32) ENGINE = MergeTree() ORDER BY k; CREATE TABLE d.x2 (k Int32, z Int32) ENGINE = Memory; CREATE TABLE d.all (k Int32, z Int32) ENGINE = Merge('d', '^x');
        CREATE TABLE d.far (k Int32) ENGINE = Distributed('c', 'd', 'x1', rand()); CREATE TABLE d.buf (k Int32) ENGINE = Buffer('d', 'x1', 16, 10, 100, 10000, 1000000, 10000000, 100000000);
        CREATE TABLE d.nil (k Int32) ENGINE = Null; CREATE MATERIALIZED VIEW d.seen ENGINE = MergeTree() ORDER BY k AS SELECT k FROM d.nil;
        CREATE TABLE d.q (k Int32, v String) ENGINE = Kafka('host:9092', 'topic', 'group', 'JSONEachRow') SETTINGS kafka_max_block_size = 10; CREATE TABLE d.nums AS numbers(5);
        CREATE MATERIALIZED VIEW d.out TO file('{tmp_path}/out', 'JSONEachRow', 'k Int32') AS SELECT k FROM d.x1"""
    )
    one = spark.createDataFrame([(1,), (2,)], "k int")
    for name in ("d.far", "d.buf", "d.nil"):
        w.insert(name, one)
    w.insert("d.x2", one.withColumn("z", F.lit(7)))
    assert w.read("d.x1").count() == w.read("d.far").count() == 4 and w.read("d.nil").count() == 0 and w.materialized("d.seen").count() == 2
    assert rows(w.read("d.all")) == sorted([(1, None), (1, None), (1, 7), (2, None), (2, None), (2, 7)], key=repr) and w.read("d.nums").count() == 5
    assert w.materialized("d.out").count() == 4
    with pytest.raises(SchemaError):
        w.insert("d.all", one)
    from tarn.sources.engines import messages, queue_options

    assert queue_options(w, "d.q") == ({"kafka.bootstrap.servers": "host:9092", "subscribe": "topic", "groupIdPrefix": "group", "maxOffsetsPerTrigger": "10"}, "JSONEachRow")
    sent = spark.createDataFrame([(bytearray(b'{"k": 3, "v": "x"}'),)], "value binary")
    assert rows(messages(w, "d.q", sent)) == [(3, "x")]


def test_two_processes_migrate(tmp_path, spark):
    """A second migration starts from what the first process left on the shelf."""
    from tarn.cli import main

    project, schema = str(tmp_path), "CREATE DATABASE d; CREATE TABLE d.t (a UInt8{}) ENGINE = MergeTree() ORDER BY a;"
    assert main(["--project", project, "init"]) == 0
    for more in ("", ", b String"):
        (tmp_path / "db" / "main.sql").write_text(schema.format(more))
        assert main(["--project", project, "diff", "--name", f"v{len(more)}"]) == 0
        assert main(["--project", project, "migrate"]) == 0
    assert Warehouse(spark, str(tmp_path / "db/data")).read("d.t").columns == ["a", "b"]


def test_snapshot_markers_and_versions():
    for marker in ("-- snapshot", "-- SNAPSHOT", "-- tool:snapshot"):
        m = M.read_migration("9", f"{marker}\n-- version: 9\n-- included: 1,2\n\nSELECT 1;")
        assert m.included == ("1", "2") and len(m.statements) == 1
    assert M.read_migration("9", "-- a snapshot\nSELECT 1;").snapshot is None
    assert M.version_at_least("v24.10.3", 24, 10) and not M.version_at_least("24.9", 24, 10) and M.version_at_least("4.1.2", 4, 0)
    with pytest.raises(ValueError):
        M.version_at_least("latest", 1, 0)


def test_command_line_checks(tmp_path, spark, capsys):
    from tarn.cli import main

    project = str(tmp_path)
    main(["--project", project, "init"])
    (tmp_path / "db" / "main.sql").write_text("CREATE DATABASE d; CREATE TABLE d.t (a UInt8) ENGINE = MergeTree() ORDER BY a;")
    assert main(["--project", project, "diff", "--name", "one", "--cluster", "c"]) == 0
    assert "ON CLUSTER" in next((tmp_path / "db" / "migrations").glob("*_one.sql")).read_text()
    with pytest.raises(SystemExit):
        main(["--project", project, "snapshot"])  # nothing of it has run
    assert main(["--project", project, "schema", "compile", "--cluster", "c"]) == 0 and "ON CLUSTER" in capsys.readouterr().out
    assert main(["--project", project, "dev", "SELECT count() AS n FROM d.t"]) == 0 and "d.t" in capsys.readouterr().out
    dump = tmp_path / "dump.sql"
    dump.write_text("CREATE DATABASE e; CREATE DICTIONARY e.x (a UInt8) PRIMARY KEY a SOURCE(HTTP(url 'u')) LAYOUT(FLAT()) LIFETIME(MIN 0 MAX 9)")
    assert main(["--project", str(tmp_path / "db2"), "image", "--dump", str(dump)]) == 0 and "schemas/e/dictionaries/x.sql" in capsys.readouterr().out
    assert main(["--project", project, "snapshot", "--bootstrap"]) == 0
