"""Migration state: scripts, hashes, the revision log, snapshots, status and resumed execution.

Scripts and hash chains are small and sequential, so they are handled on the driver. Revisions are a
relation in Parquet; what is completed, failed, pending or partial is asked of it by joins.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sqlfront.ast import Stmt
from tarn.sqlfront.ddl import parse, write, write_script

REVISIONS = "version string, executed_at timestamp, execution_time_ms bigint, kind string, error string, applied int, total int, hash string, partial_hashes array<string>, tool_version string"
TOOL_VERSION = "0.1"
MARKER = "-- snapshot"
#: A snapshot's first line, with or without the name of the tool that wrote it.
MARKED = re.compile(r"^--\s*(?:\w+:)?snapshot\s*$", re.IGNORECASE)
IMPORT = re.compile(r"^--\s*\w+:import\s+(\S+)\s*$")


def _digest(*parts: bytes) -> bytes:
    h = hashlib.sha256()
    for p in parts:
        h.update(p)
    return h.digest()


def _h1(digest: bytes) -> str:
    return "h1:" + base64.b64encode(digest).decode()


def statement_hash(text: str) -> str:
    """A statement's hash; the text form ends with one more equals sign."""
    return _h1(_digest(text.encode())) + "="


def statement_hash_column(c: Column) -> Column:
    """The same over a column of texts."""
    return F.concat(F.lit("h1:"), F.base64(F.unhex(F.sha2(c, 256))), F.lit("="))


def migration_hash(statements: list[Stmt]) -> str:
    """The hash over all statements as they are written, each with a line end."""
    return _h1(_digest(*[(write(s) + "\n").encode() for s in statements if s.kind != "COMMENT"])) + "="


@dataclass
class Migration:
    """One versioned script."""

    version: str
    text: str
    statements: list[Stmt] = field(default_factory=list)
    snapshot: dict[str, str] | None = None

    @property
    def included(self) -> tuple[str, ...]:
        return tuple(x for x in (self.snapshot or {}).get("included", "").split(",") if x)


def read_migration(version: str, text: str) -> Migration:
    """A script; one that begins with the snapshot's marker also has a header of ``-- key: value`` lines."""
    lines, header = text.split("\n"), None
    if lines and MARKED.match(lines[0].strip()):
        header = {}
        for line in lines[1:]:
            m = re.match(r"^--\s*([\w-]+):\s*(.*)$", re.sub(r"^--\s*\w+:(?=[\w-]+:)", "-- ", line))
            if not m:
                break
            header[m[1].lower()] = m[2].strip()
    return Migration(version, text, [s for s in parse(text) if s.kind != "COMMENT"], header)


def load_directory(path: str) -> list[Migration]:
    """All .sql files of a folder in order of name; a version is the name up to its first dot."""
    names = sorted(n for n in os.listdir(path) if n.endswith(".sql"))
    out = []
    for n in names:
        with open(os.path.join(path, n), encoding="utf-8") as f:
            out.append(read_migration(n.split(".")[0], f.read()))
    return out


def compiled(path: str, seen: tuple[str, ...] = ()) -> str:
    """A schema file with the files that its import lines name in their place, relative to each file."""
    path = os.path.normpath(path)
    if path in seen:
        raise ValueError(f"schema files that import each other: {' -> '.join((*seen, path))}")
    out = []
    with open(path, encoding="utf-8") as f:
        for line in f.read().split("\n"):
            m = IMPORT.match(line.strip())
            out.append(compiled(os.path.join(os.path.dirname(path), m[1]), (*seen, path)) if m else line)
    return "\n".join(out)


# Sums of files


@dataclass
class SumFile:
    """Chained hashes of files: each one covers the one before and its own content."""

    entries: list[tuple[str, bytes]] = field(default_factory=list)

    def add(self, name: str, content: bytes) -> None:
        before = self.entries[-1][1] if self.entries else b""
        self.entries.append((name, _digest(before, content)))

    @property
    def total(self) -> str:
        return _h1(_digest(*[h for _, h in self.entries]))

    def text(self) -> str:
        return "\n".join([self.total, *[f"{n} {_h1(h)}" for n, h in self.entries]]) + "\n"

    @classmethod
    def of_directory(cls, path: str) -> SumFile:
        out = cls()
        for n in sorted(os.listdir(path)):
            if n.endswith(".sql"):
                with open(os.path.join(path, n), "rb") as f:
                    out.add(n, f.read())
        return out

    def matches(self, text: str) -> bool:
        """Whether a stored sum file says the same; compared in constant time."""
        return hmac.compare_digest(self.text().encode(), text.encode())


def chain(contents: DataFrame) -> DataFrame:
    """One row, the array of chained hashes (hex) over (ordinal, content): an ordered fold on the cluster."""
    ordered = contents.agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("c"))
    return ordered.select(
        F.aggregate(
            "c", F.array().cast("array<string>"),
            lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.unhex(F.try_element_at(acc, F.lit(-1))), F.lit(b"")), F.encode(x["content"], "utf-8")), 256))),
        ).alias("hashes")
    )


# Snapshots


def make_snapshot(version: str, migrations: list[Migration], description: str = "") -> Migration:
    """One script in place of all before it, with a header that names them and holds their hash."""
    statements = [s for m in migrations for s in m.statements]
    body = write_script(statements)
    header = {"version": version, "description": description, "created_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "included": ",".join(m.version for m in migrations), "cumulative_hash": _h1(_digest(body.encode()))}
    text = MARKER + "\n" + "\n".join(f"-- {k}: {v}" for k, v in header.items()) + "\n\n" + body
    return read_migration(version, text)


def snapshot_gaps(snapshot: DataFrame, done: DataFrame) -> DataFrame:
    """Included versions (column version) that are not completed; none if the snapshot may stand."""
    return snapshot.join(done.select("version"), "version", "left_anti")


# The revision log


@dataclass
class Log:
    """The log of revisions, in a folder of Parquet files that only grows."""

    spark: SparkSession
    path: str

    def bootstrap(self) -> None:
        if not self.exists():
            self.spark.createDataFrame([], REVISIONS).write.parquet(self.path)

    def exists(self) -> bool:
        try:
            self.spark.read.schema(REVISIONS).parquet(self.path).schema  # noqa: B018
            return True
        except AnalysisException:
            return False

    def append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], REVISIONS).coalesce(1).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(REVISIONS).parquet(self.path)


def latest_revisions(revisions: DataFrame) -> DataFrame:
    """The newest revision of each version."""
    columns = [c for c in revisions.columns if c != "version"]
    best = revisions.groupBy("version").agg(F.max_by(F.struct(*columns), F.struct("executed_at", "applied")).alias("r"))
    return best.select("version", "r.*").select(*revisions.columns)


def migration_rows(spark: SparkSession, migrations: list[Migration]) -> DataFrame:
    """(version, is_snapshot, statements) of scripts."""
    return spark.createDataFrame([(m.version, m.snapshot is not None, len(m.statements)) for m in migrations], "version string, is_snapshot boolean, statements int")


def statuses(migrations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Every migration with its newest revision and ``status``: completed, failed, partial or pending.

    Completed: no error, kind as the script's, all of its statements applied. Failed: a migration
    with an error. Partial: some, not all applied; a failed one may be partial too (column partial).
    """
    r = latest_revisions(revisions)
    out = migrations.join(r, "version", "left")
    clean = F.col("error").isNull() & F.col("kind").isNotNull()
    completed = F.when(F.col("is_snapshot"), clean & (F.col("kind") == "snapshot")).otherwise(clean & (F.col("kind") == "migration") & (F.col("applied") == F.col("total")) & (F.col("total") == F.col("statements")))
    partial = F.coalesce((F.col("applied") > 0) & (F.col("applied") < F.col("total")), F.lit(False))
    failed = F.coalesce((F.col("kind") == "migration") & F.col("error").isNotNull(), F.lit(False))
    status = F.when(completed, "completed").when(failed, "failed").when(partial, "partial").otherwise("pending")
    return out.withColumn("status", status).withColumn("partial", partial)


def pending(migrations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Migrations that are not completed, failed and partial ones included."""
    done = statuses(migrations, revisions).where("status = 'completed'").select("version")
    return migrations.join(done, "version", "left_anti")


def status_counts(migrations: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row: total, completed, pending (all that are not completed) and failed."""
    s = statuses(migrations, revisions)
    return s.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") != "completed").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))


def executed_versions(revisions: DataFrame) -> DataFrame:
    return latest_revisions(revisions).where("kind = 'migration' and error is null").select("version").orderBy("version")


def after_snapshot(migrations: DataFrame, revisions: DataFrame) -> DataFrame:
    """Migrations of versions after the last recorded snapshot; all if there is none."""
    last = latest_revisions(revisions).where("kind = 'snapshot'").agg(F.max("version").alias("last"))
    return migrations.join(F.broadcast(last), F.col("last").isNull() | (F.col("version") > F.col("last"))).drop("last")


def changed_prefix(revisions: DataFrame, statements: DataFrame) -> DataFrame:
    """(version, ordinal) of applied statements of partial revisions whose text has changed since.

    ``statements`` has (version, ordinal from 0, text).
    """
    part = latest_revisions(revisions).where("applied > 0 and applied < total")
    held = part.select("version", F.posexplode("partial_hashes").alias("ordinal", "stored"))
    now = statements.select("version", "ordinal", statement_hash_column(F.col("text")).alias("now"))
    return held.join(now, ["version", "ordinal"], "left").where("now is null or now <> stored").select("version", "ordinal")


def missing_of(spark: SparkSession, snapshot: Migration, done: set[str]) -> list[str]:
    """Versions that a snapshot includes and that are not completed."""
    one = spark.createDataFrame([(v,) for v in snapshot.included], "version string")
    return sorted(r["version"] for r in snapshot_gaps(one, spark.createDataFrame([(v,) for v in done], "version string")).collect())


class MigrationError(RuntimeError):
    """A run that stopped."""


def execute(migrations: list[Migration], log: Log, run: Callable[[Stmt], None], dry: bool = False) -> list[tuple[str, str]]:
    """Runs what is pending, in order; (version, outcome) of each.

    Completed scripts are skipped; a snapshot is recorded, not run, if all it includes is completed
    or nothing at all has run; a partial one goes on where it stopped if its applied statements are
    unchanged. The first failure is recorded and ends the run.
    """
    log.bootstrap()
    known = {r["version"]: r for r in latest_revisions(log.rows()).collect()}
    if newer := sorted(v for v, r in known.items() if not version_at_least(TOOL_VERSION, *_version(r["tool_version"]))):
        raise MigrationError(f"{newer[0]}: recorded by a later version of the tool, {known[newer[0]]['tool_version']}")
    texts = [(m.version, i, write(s)) for m in migrations if m.version in known for i, s in enumerate(m.statements)]
    changed = {r["version"] for r in changed_prefix(log.rows(), log.spark.createDataFrame(texts, "version string, ordinal int, text string")).collect()} if texts else set()
    done_before = {r["version"] for r in executed_versions(log.rows()).collect()}
    out = []
    for m in migrations:
        r = known.get(m.version)
        total = len(m.statements)
        done = r is not None and r["error"] is None and (r["kind"] == "snapshot" if m.snapshot is not None else r["kind"] == "migration" and r["applied"] == r["total"] == total)
        if done:
            out.append((m.version, "skipped"))
            continue
        hashes = [statement_hash(write(s)) for s in m.statements]
        start = 0
        if m.snapshot is not None and (not m.included or not missing_of(log.spark, m, done_before)):
            if not dry:
                log.append((m.version, datetime.now(UTC), 0, "snapshot", None, total, total, migration_hash(m.statements), hashes, TOOL_VERSION))
            out.append((m.version, "recorded"))
            continue
        if r is not None and 0 < r["applied"] < r["total"]:
            if r["total"] != total or m.version in changed:
                raise MigrationError(f"{m.version}: statements that were applied have changed")
            start = r["applied"]
        if dry:
            out.append((m.version, f"would run {total - start} statements"))
            continue
        began, applied, error = time.time(), start, None
        for s in m.statements[start:]:
            try:
                run(s)
            except Exception as x:  # noqa: BLE001  whatever a statement raises is recorded
                error = f"{type(x).__name__}: {x}"[:2000]
                break
            applied += 1
        kind = "snapshot" if m.snapshot is not None else "migration"
        log.append((m.version, datetime.now(UTC), int(1000 * (time.time() - began)), kind, error, applied, total, migration_hash(m.statements), hashes[:applied], TOOL_VERSION))
        out.append((m.version, "failed" if error else "applied"))
        if error:
            raise MigrationError(f"{m.version}, statement {applied + 1}: {error}")
    return out


def _version(text: str) -> tuple[int, int, int]:
    m = re.match(r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?", text or "")
    if not m:
        raise ValueError(f"not a version: {text}")
    return int(m[1]), int(m[2] or 0), int(m[3] or 0)


def version_at_least(version: str, major: int, minor: int, patch: int = 0) -> bool:
    """Whether ``major.minor[.patch]`` is that or later."""
    if not re.match(r"^v?\d+\.\d+", version):
        raise ValueError(f"not a version: {version}")
    return _version(version) >= (major, minor, patch)
