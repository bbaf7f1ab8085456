"""Command line: init, fmt, diff, schema compile and dump, migrate, status, snapshot, rehash, bootstrap, image, dev.

A project is a folder with db/main.sql (which may import other files), db/migrations and a log of
revisions; data lies in a warehouse folder.
"""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace
from datetime import UTC, datetime

from tarn import migrate as M
from tarn.sqlfront.ddl import parse, write_script
from tarn.sqlfront.format import Options, format_script, options_from

MAIN, MIGRATIONS, REVISIONS, SUM = "db/main.sql", "db/migrations", "db/revisions", "tarn.sum"


def _spark():
    import pyspark
    from pyspark.sql import SparkSession

    if not M.version_at_least(pyspark.__version__, 4, 0):
        raise SystemExit(f"Spark 4.0 or later is needed, this is {pyspark.__version__}")
    return SparkSession.builder.appName("tarn").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _path(args, *parts: str) -> str:
    return os.path.join(args.project, *parts)


def init(args) -> int:
    """Lays down a project; files that exist are left as they are."""
    os.makedirs(_path(args, MIGRATIONS), exist_ok=True)
    if not os.path.exists(_path(args, MAIN)):
        with open(_path(args, MAIN), "w", encoding="utf-8") as f:
            f.write("-- The schema of this project; other files come in with  -- tarn:import path\n")
    rehash(args)
    return 0


def fmt(args) -> int:
    """Prints files in canonical form, or writes them back."""
    config = _path(args, "tarn.toml")
    base = options_from(config) if os.path.exists(config) else Options()
    given = {"indent": args.indent, "blank_lines": args.blank_lines, "max_line": args.max_line, "align": False if args.no_align else None, "uppercase": False if args.lowercase else None}
    given |= {"multiline_queries": False if args.one_line_queries else None, "multiline_functions": False if args.one_line_functions else None}
    options = replace(base, **{k: v for k, v in given.items() if v is not None})
    for path in args.files:
        with open(path, encoding="utf-8") as f:
            text = format_script(f.read(), options)
        if args.write:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            sys.stdout.write(text)
    return 0


def rehash(args) -> int:
    """Writes the sum file anew."""
    with open(_path(args, MIGRATIONS, SUM), "w", encoding="utf-8") as f:
        f.write(M.SumFile.of_directory(_path(args, MIGRATIONS)).text())
    return 0


def _verified(args) -> list[M.Migration]:
    """The project's scripts, their sum file checked."""
    stored = _path(args, MIGRATIONS, SUM)
    if os.path.exists(stored):
        with open(stored, encoding="utf-8") as f:
            if not M.SumFile.of_directory(_path(args, MIGRATIONS)).matches(f.read()):
                raise SystemExit("the sum file does not fit the migrations; run rehash if they were meant to change")
    return M.load_directory(_path(args, MIGRATIONS))


def _current(migrations: list[M.Migration]):
    """The statements that the scripts amount to, as a schema: what a replay leaves declared."""
    from tarn.replay import replayed

    return replayed([s for m in migrations for s in m.statements])


def diff(args) -> int:
    """Writes a migration from what the scripts declare to the schema file; 1 if there is none."""
    from tarn.diff import NoDifference, migration

    target = M.compiled(_path(args, MAIN))
    current = _current(_verified(args))
    if args.cluster:
        from tarn.catalog import with_cluster

        target = write_script(with_cluster(parse(target), args.cluster, args.own))
        current = with_cluster(current, args.cluster, args.own)
    try:
        text = migration(_spark(), write_script(current), target)
    except NoDifference:
        print("no difference")
        return 1
    name = datetime.now(UTC).strftime("%Y%m%d%H%M%S") + (f"_{args.name}" if args.name else "") + ".sql"
    with open(_path(args, MIGRATIONS, name), "w", encoding="utf-8") as f:
        f.write(text)
    rehash(args)
    print(name)
    return 0


def schema(args) -> int:
    """Prints the compiled schema file, or what the migrations amount to."""
    statements = parse(M.compiled(_path(args, MAIN))) if args.what == "compile" else _current(_verified(args))
    if args.cluster:
        from tarn.catalog import with_cluster

        statements = with_cluster(statements, args.cluster, args.own)
    sys.stdout.write(write_script(statements))
    return 0


def bootstrap(args) -> int:
    """Creates the revision log."""
    M.Log(_spark(), _path(args, REVISIONS)).bootstrap()
    return 0


def migrate(args) -> int:
    """Runs what is pending on the project's warehouse."""
    from tarn.apply import Warehouse

    spark = _spark()
    warehouse = Warehouse(spark, _path(args, "db/data"))
    log = M.Log(spark, _path(args, REVISIONS))
    for version, outcome in M.execute(_verified(args), log, warehouse.run, dry=args.dry_run):
        print(version, outcome)
    return 0


def status(args) -> int:
    """Prints counts, and with --verbose each migration's status."""
    spark = _spark()
    log = M.Log(spark, _path(args, REVISIONS))
    log.bootstrap()
    rows = M.migration_rows(spark, _verified(args))
    for r in M.status_counts(rows, log.rows()).collect():
        print(f"total {r.total}, completed {r.completed}, pending {r.pending}, failed {r.failed}")
    if args.verbose:
        for r in M.statuses(rows, log.rows()).orderBy("version").collect():
            print(r.version, r.status, r.error or "")
    return 0


def snapshot(args) -> int:
    """Puts one script in place of all so far."""
    migrations = _verified(args)
    name = datetime.now(UTC).strftime("%Y%m%d%H%M%S") + "_snapshot"
    if args.bootstrap:  # the schema as it stands, for a project whose data is older than its scripts
        made = M.make_snapshot(name, [M.read_migration("0", M.compiled(_path(args, MAIN)))], args.description)
    else:
        made = M.make_snapshot(name, migrations, args.description)
        spark = _spark()
        log = M.Log(spark, _path(args, REVISIONS))
        log.bootstrap()
        if missing := M.missing_of(spark, made, {r["version"] for r in M.executed_versions(log.rows()).collect()} | {r["version"] for r in M.latest_revisions(log.rows()).where("kind = 'snapshot'").collect()}):
            raise SystemExit(f"not completed yet: {', '.join(missing)}")
    with open(_path(args, MIGRATIONS, f"{name}.sql"), "w", encoding="utf-8") as f:
        f.write(made.text)
    for m in migrations:
        os.remove(_path(args, MIGRATIONS, f"{m.version}.sql"))
    rehash(args)
    return 0


def image(args) -> int:
    """Writes the schema that the migrations amount to, or that a server's dump declares, as files, one per object."""
    from tarn.project import cleaned, write_image

    if args.dump:
        with open(args.dump, encoding="utf-8") as f:
            statements = parse(cleaned(f.read()))
    else:
        statements = _current(_verified(args))
    for path in write_image(_path(args, "db"), statements):
        print(path)
    return 0


def dev(args) -> int:
    """Runs the compiled schema file in a new warehouse that goes with the process, and the query given."""
    import tempfile

    from tarn.apply import Warehouse

    warehouse = Warehouse(_spark(), tempfile.mkdtemp(prefix="tarn-dev-"))
    warehouse.run_script(M.compiled(_path(args, MAIN)))
    for name in [*warehouse.tables, *warehouse.views]:
        print(name)
    for query in args.query:
        for frame in warehouse.run_script(query):
            frame.show(truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tarn", description=__doc__)
    p.add_argument("--project", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    for f in (init, rehash, bootstrap):
        sub.add_parser(f.__name__, help=f.__doc__).set_defaults(run=f)
    q = sub.add_parser("image", help=image.__doc__)
    q.add_argument("--dump", default="")
    q.set_defaults(run=image)
    q = sub.add_parser("dev", help=dev.__doc__)
    q.add_argument("query", nargs="*")
    q.set_defaults(run=dev)

    def clustered(q) -> None:
        q.add_argument("--cluster", default="", help="declare every object ON CLUSTER of this name")
        q.add_argument("--own", default="", help="the tool's own database, which is left as it is")

    q = sub.add_parser("fmt", help=fmt.__doc__)
    q.add_argument("files", nargs="+")
    q.add_argument("-w", "--write", action="store_true")
    q.add_argument("--indent", type=int)
    q.add_argument("--no-align", action="store_true")
    q.add_argument("--lowercase", action="store_true")
    q.add_argument("--one-line-queries", action="store_true")
    q.add_argument("--blank-lines", type=int)
    q.add_argument("--max-line", type=int)
    q.add_argument("--one-line-functions", action="store_true")
    q.set_defaults(run=fmt)
    q = sub.add_parser("diff", help=diff.__doc__)
    q.add_argument("--name", default="")
    clustered(q)
    q.set_defaults(run=diff)
    for name in ("migrate", "apply"):
        q = sub.add_parser(name, help=migrate.__doc__)
        q.add_argument("--dry-run", action="store_true")
        q.set_defaults(run=migrate)
    q = sub.add_parser("status", help=status.__doc__)
    q.add_argument("--verbose", action="store_true")
    q.set_defaults(run=status)
    q = sub.add_parser("snapshot", help=snapshot.__doc__)
    q.add_argument("--description", default="")
    q.add_argument("--bootstrap", action="store_true")
    q.set_defaults(run=snapshot)
    q = sub.add_parser("schema", help=schema.__doc__)
    q.add_argument("what", choices=["compile", "dump"])
    clustered(q)
    q.set_defaults(run=schema)
    args = p.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    raise SystemExit(main())
