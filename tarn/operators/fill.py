"""Gap filling: WITH FILL with its bounds, steps, staleness, and INTERPOLATE."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Fill:
    """One filled sort key: bounds from start (included) to end (excluded), step and staleness as SQL texts or None."""

    key: str
    desc: bool = False
    start: str | None = None
    end: str | None = None
    step: str | None = None
    staleness: str | None = None


def _step(df: DataFrame, f: Fill) -> Column:
    kind = dict(df.dtypes)[f.key]
    if f.step:
        return F.expr(f.step)
    sign = -1 if f.desc else 1
    return F.expr(f"INTERVAL {sign} DAY") if kind in ("date", "timestamp", "timestamp_ntz") else F.lit(sign).cast(kind)


#: Values of a gap that are made up in one array; a longer gap takes several. A multiple of 12, so that months stay in step.
CHUNK = 1200


def _values(spans: DataFrame, prefix: list[str], desc: bool, kind: str, step: Column) -> DataFrame:
    """(prefix, _k, _b): the values from _a to _b by steps, in chunks, so that a wide gap is no long array."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        spans, step, kind = spans.withColumns({"_a": F.col("_a").cast("bigint"), "_b": F.col("_b").cast("bigint")}), step.cast("bigint"), "bigint"
    starts = spans.select(*prefix, "_b", F.explode(F.sequence("_a", "_b", step * F.lit(CHUNK))).alias("_c"))
    last = (F.col("_c") + step * F.lit(CHUNK - 1)).cast(kind)
    return starts.select(*prefix, F.explode(F.sequence("_c", (F.greatest if desc else F.least)(F.col("_b"), last), step)).alias("_k"), "_b")


def missing(df: DataFrame, prefix: list[str], f: Fill) -> DataFrame:
    """The (prefix, key) rows that a fill adds, for each prefix from its own bounds where none are given."""
    kind = dict(df.dtypes)[f.key]
    key, step = F.col(f"`{f.key}`"), _step(df, f)
    known = df.where(key.isNotNull()).select(*prefix, f.key).distinct()
    if f.staleness:
        w = W.partitionBy(*prefix).orderBy(key.desc() if f.desc else key.asc())
        edge = key + F.expr(f.staleness)
        following = F.lead(key).over(w)
        end = F.expr(f.end).cast(kind) if f.end else F.lit(None).cast(kind)
        nearest = (F.greatest if f.desc else F.least)(edge, F.coalesce(following, end, edge), F.coalesce(end, edge))
        spans = known.select(*prefix, (key + step).cast(kind).alias("_a"), nearest.cast(kind).alias("_b"))
        inside = F.col("_a") > F.col("_b") if f.desc else F.col("_a") < F.col("_b")
        grid = _values(spans.where(inside), prefix, f.desc, kind, step).where("_k <> _b").select(*prefix, F.col("_k").cast(kind).alias(f.key))
    else:
        bounds = known.groupBy(*prefix).agg(F.min(key).alias("_min"), F.max(key).alias("_max"))
        first, last = ("_max", "_min") if f.desc else ("_min", "_max")
        start = F.expr(f.start).cast(kind) if f.start else F.col(first)
        end = F.expr(f.end).cast(kind) if f.end else F.col(last)
        spans = bounds.select(*prefix, start.alias("_a"), end.alias("_b"))
        inside = F.col("_a") >= F.col("_b") if f.desc else F.col("_a") <= F.col("_b")
        grid = _values(spans.where(inside), prefix, f.desc, kind, step)
        if f.end:
            grid = grid.where("_k <> _b")
        grid = grid.select(*prefix, F.col("_k").cast(kind).alias(f.key))
    return _anti(grid, known, [*prefix, f.key])


def _anti(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    other = right.select(*[F.col(f"`{k}`").alias(f"_r_{k}") for k in keys])
    on = None
    for k in keys:
        one = F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`"))
        on = one if on is None else on & one
    return left.join(other, on, "left_anti")


def with_fill(df: DataFrame, order: list[tuple[str, bool]], fills: list[Fill], carried: dict[str, str | None] | None = None) -> DataFrame:
    """The rows of ``df`` with gaps filled, unsorted.

    ``order`` has the sort keys in turn; a key is filled within each combination of the keys before
    it. Added rows are null in all other columns, but for those of ``carried``: they take the last
    real row's value, or a SQL expression of ``acc``, that value, applied once more for each added row.
    """
    out = df.withColumn("_real", F.lit(True))
    keys = [k for k, _ in order]
    for f in fills:
        prefix = keys[: keys.index(f.key)]
        out = out.unionByName(missing(out, prefix, f), allowMissingColumns=True)
    if carried:
        ordering = [F.col(f"`{k}`").desc_nulls_last() if d else F.col(f"`{k}`").asc_nulls_last() for k, d in order]
        prefix = keys[: keys.index(fills[0].key)]
        w = W.partitionBy(*prefix).orderBy(*ordering[len(prefix) :])
        out = out.withColumn("_run", F.sum(F.when(F.col("_real"), 1).otherwise(0)).over(w))
        within = W.partitionBy(*prefix, "_run").orderBy(*ordering[len(prefix) :])
        out = out.withColumn("_nth", F.row_number().over(within) - 1)
        for c, text in carried.items():
            out = out.withColumn("_last", F.first(F.col(f"`{c}`")).over(within))
            value = F.col("_last")
            if text is not None:
                value = F.expr(f"aggregate(CASE WHEN _nth > 0 THEN sequence(1, _nth) ELSE array() END, _last, (acc, i) -> CAST({text} AS {dict(df.dtypes)[c]}))")
            out = out.withColumn(c, F.when(F.col("_real"), F.col(f"`{c}`")).otherwise(F.when(F.col("_run") > 0, value))).drop("_last")
        out = out.drop("_run", "_nth")
    return out.drop("_real")
