"""As-of join: every left row with the nearest right row of its key.

Both sides go through one shuffle on the key and one sort; a running last value then carries the
nearest right row along. There is no join, so keys with many rows on both sides do not multiply.
Without a key, or where told so for keys with a large share of the rows, rows are also dealt by
ranges of the compared value, and the last right row of each range is carried to the ranges after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType | T.VariantType)


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], near: tuple[str, str, str], inner: bool = True, held: str = "right", ranges: int | None = None
) -> DataFrame:
    """The left columns and ``held``, a struct of the right row.

    ``keys`` pairs equal columns; ``near`` is (left column, comparison, right column) such as
    ("ts", ">=", "ts"): the right row with the closest value that satisfies it. Of equally close right
    rows, the smallest in the order of its columns is taken (those that have an order). Null keys and
    null values match nothing. ``ranges`` is the number of ranges that each key's rows are dealt into:
    0 for none, which is what stands with keys; without any, it is the number of shuffle partitions.
    """
    at, op, other = near
    back = op in (">", ">=")
    names = [f"_k{i}" for i in range(len(keys))]
    if ranges is None:
        ranges = 0 if keys else int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    usable_l = F.col(f"`{at}`").isNotNull()
    for a, _ in keys:
        usable_l = usable_l & F.col(f"`{a}`").isNotNull()
    one = left.select(*[F.col(f"`{a}`").alias(n) for (a, _), n in zip(keys, names, strict=True)], F.col(f"`{at}`").alias("_t"), F.struct(*[f"`{c}`" for c in left.columns]).alias("_l"), usable_l.alias("_ok"))
    two = right.select(*[F.col(f"`{b}`").alias(n) for (_, b), n in zip(keys, names, strict=True)], F.col(f"`{other}`").alias("_t"), F.struct(*[f"`{c}`" for c in right.columns]).alias("_r"))
    two = two.where(F.col("_t").isNotNull())
    for n in names:
        two = two.where(F.col(n).isNotNull())
    ties = [F.col(f"_r.`{f.name}`") for f in right.schema.fields if _orderable(f.dataType)]
    # Equal values count for >= and <=: right rows then come first in the walk; for > and < they come last.
    first = 0 if op in (">=", "<=") else 2

    def walk(forth: bool) -> list[Column]:
        t = F.col("_t").asc() if back == forth else F.col("_t").desc()
        return [t, *([F.col("_side").asc() if forth else F.col("_side").desc()]), *(c.desc() if forth else c.asc() for c in ties)]

    both = one.withColumn("_side", F.lit(1)).unionByName(two.withColumn("_side", F.lit(first)), allowMissingColumns=True)
    dealt = list(names)
    if ranges > 1:
        cuts = one.select("_t").unionByName(two.select("_t")).agg(F.percentile_approx("_t", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), F.lit(max(1000, 10 * ranges))).alias("_cuts"))
        both = both.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c <= F.col("_t")))).drop("_cuts")  # one row
        dealt.append("_b")
    w = W.partitionBy(*dealt).orderBy(*walk(True)).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumn("_found", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    if ranges > 1:
        out = _carried(out, both, names, back, walk(False))
    out = out.withColumn("_found", F.when(F.col("_ok"), F.col("_found")))
    if inner:
        out = out.where(F.col("_found").isNotNull())
    return out.select("_l.*", F.col("_found").alias(held))


def _carried(out: DataFrame, both: DataFrame, names: list[str], back: bool, last_first: list[Column]) -> DataFrame:
    """``out`` with the last right row of the ranges before where its own range has none."""
    last = both.where("_r is not null").withColumn("_n", F.row_number().over(W.partitionBy(*names, "_b").orderBy(*last_first))).where("_n = 1").select(*names, "_b", F.col("_r").alias("_last"))
    here = both.select(*names, "_b").distinct()
    order = F.col("_b").asc() if back else F.col("_b").desc()
    before = W.partitionBy(*names).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    carry = here.join(last, [*names, "_b"], "left").withColumn("_carry", F.last("_last", ignorenulls=True).over(before))
    named = carry.select(*[F.col(n).alias(f"_c{n}") for n in [*names, "_b"]], "_carry")
    on = F.col("_b") == F.col("_c_b")
    for n in names:
        on = on & (F.col(n) == F.col(f"_c{n}"))
    return out.join(named, on, "left").withColumn("_found", F.coalesce("_found", "_carry"))
