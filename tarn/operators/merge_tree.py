"""What merging storage engines do to rows, as explicit read operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """One row per key: the one of the highest version (ties: the largest row).

    An aggregation with map-side combination, so that a key with many versions is no hot spot.
    """
    others = [c for c in df.columns if c not in keys]
    rank = [version, *[c for c in others if c != version]] if version and version not in keys else others
    if not others:
        return df.select(*keys).distinct()
    best = df.groupBy(*keys).agg(F.max(F.struct(*rank)).alias("_best"))
    return best.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_best.`{c}`").alias(c) for c in df.columns])


def summed(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per key with the numeric columns (or those named) summed; of others any value stays."""
    numeric = {c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")}
    adds = set(columns) if columns else numeric - set(keys)
    kinds = dict(df.dtypes)
    aggs = [(F.sum(f"`{c}`").cast(kinds[c]) if c in adds else F.any_value(f"`{c}`", True)).alias(c) for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*aggs).select(*df.columns) if aggs else df.select(*keys).distinct()


def collapsed(df: DataFrame, keys: list[str], sign: str, version: str | None = None) -> DataFrame:
    """Rows of sign 1 that no row of sign -1 cancels: for each key, and version where there is one, the last state, where signs add up to more than zero."""
    keys = [*keys, version] if version and version not in keys else keys
    others = [c for c in df.columns if c not in (*keys, sign)] or keys[:1]
    best = df.groupBy(*keys).agg(F.sum(sign).alias("_left"), F.max(F.when(F.col(sign) > 0, F.struct(*others))).alias("_best")).where("_left > 0")
    found = {c: F.lit(1).cast(dict(df.dtypes)[sign]) if c == sign else F.col(c) if c in keys else F.col(f"_best.`{c}`") for c in df.columns}
    return best.select(*[x.alias(c) for c, x in found.items()])


def merged_state(c: str, how: str) -> Column:
    """Partial states of one function as one: sum, count, min, max, any, avg (struct of sum and count) or uniq (sketch)."""
    x = F.col(f"`{c}`")
    if how == "avg":
        return F.struct(F.sum(x["sum"]).alias("sum"), F.sum(x["count"]).alias("count"))
    merges = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "uniq": F.hll_union_agg, "any": lambda v: F.any_value(v, True), "anylast": lambda v: F.any_value(v, True), "grouparrayarray": lambda v: F.flatten(F.collect_list(v))}
    if how.lower() not in merges:
        raise ValueError(f"no merging of {how} states")
    return merges[how.lower()](x)


def aggregated(df: DataFrame, keys: list[str], merges: dict[str, str]) -> DataFrame:
    """One row per key with partial states merged (column -> function); of other columns any value stays."""
    kinds = dict(df.dtypes)
    aggs = [(merged_state(c, merges[c]) if c in merges else F.any_value(f"`{c}`", True)).cast(kinds[c]).alias(c) for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*aggs).select(*df.columns) if aggs else df.select(*keys).distinct()


@dataclass(frozen=True)
class Merging:
    """How rows of one sort key become one: the engine's name without its prefix for replicas, and its columns."""

    engine: str
    keys: list[str]
    columns: list[str] = field(default_factory=list)
    states: dict[str, str] = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        """The rows after all merges; engines that do not merge leave them as they are."""
        if not self.keys:
            return df
        first = self.columns[0] if self.columns else None
        if self.engine == "ReplacingMergeTree":
            out = latest(df, self.keys, first)
            return out.where(F.col(f"`{self.columns[1]}`") == 0) if len(self.columns) > 1 else out
        if self.engine == "SummingMergeTree":
            return aggregated(df, self.keys, {**{c: "sum" for c in self._adds(df)}, **self.states})
        if self.engine == "AggregatingMergeTree":
            return aggregated(df, self.keys, self.states)
        if self.engine == "CollapsingMergeTree":
            return collapsed(df, self.keys, first)
        if self.engine == "VersionedCollapsingMergeTree":
            return collapsed(df, self.keys, first, self.columns[1])
        return df

    def _adds(self, df: DataFrame) -> list[str]:
        numeric = [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
        return [c for c in (self.columns or numeric) if c not in self.keys]
