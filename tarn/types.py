"""Declared types of the dialect as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from tarn.sqlfront import ast as A

# Simple types by name.
SIMPLE = {
    "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(),
    "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(), "UInt64": T.LongType(),
    "Float32": T.FloatType(), "Float64": T.DoubleType(), "Bool": T.BooleanType(), "Boolean": T.BooleanType(),
    "String": T.StringType(), "FixedString": T.StringType(), "UUID": T.StringType(), "IPv4": T.StringType(), "IPv6": T.StringType(),
    "Enum": T.StringType(), "Enum8": T.StringType(), "Enum16": T.StringType(), "JSON": T.StringType(), "Dynamic": T.StringType(), "Variant": T.StringType(),
    "Date": T.DateType(), "Date32": T.DateType(), "DateTime": T.TimestampType(), "DateTime64": T.TimestampType(),
    "Int128": T.DecimalType(38, 0), "UInt128": T.DecimalType(38, 0),
}
# Widths of decimals named by their bits.
DECIMAL_BITS = {"Decimal32": 9, "Decimal64": 18, "Decimal128": 38, "Decimal256": 76}
_LOWER = {k.lower(): v for k, v in SIMPLE.items()} | {
    k.lower(): v
    for k, v in {"Int": T.IntegerType(), "Integer": T.IntegerType(), "BigInt": T.LongType(), "Double": T.DoubleType(), "Float": T.FloatType(), "Timestamp": T.TimestampType(), "Timestamp_NTZ": T.TimestampNTZType(), "Varchar": T.StringType(), "Text": T.StringType()}.items()
}


class TypeError_(ValueError):
    """A declared type that Spark cannot hold."""


def _number(x) -> int:
    return int(x.value)


def normal(t: A.Type) -> A.Type:
    """The type with decimals of named width written by precision and scale, in all its parts."""

    def change(n):
        if isinstance(n, A.Type) and n.name in DECIMAL_BITS:
            return A.Type("Decimal", (A.Lit("number", str(DECIMAL_BITS[n.name])), *(n.args or (A.Lit("number", "0"),))))
        return None

    return A.rebuilt(t, change)


def nullable(t: A.Type) -> bool:
    """Types are not nullable unless they say so."""
    return t.name == "Nullable" or (t.name == "LowCardinality" and isinstance(t.args[0], A.Type) and nullable(t.args[0]))


def spark_type(t: A.Type, strict_uint64: bool = False) -> T.DataType:
    """The Spark type; UInt64 is a long, or decimal(20, 0) where ``strict_uint64``.

    Types of more than 38 digits, and unknown ones, raise an error.
    """

    def of(x) -> T.DataType:
        return spark_type(x, strict_uint64)

    name = t.name
    if name in ("Nullable", "LowCardinality"):
        return of(t.args[0])
    if name == "Array":
        return T.ArrayType(of(t.args[0]), nullable(t.args[0]))
    if name == "Map":
        return T.MapType(of(t.args[0]), of(t.args[1]), nullable(t.args[1]))
    if name in ("Tuple", "Nested"):
        named = [x if isinstance(x, tuple) else (f"_{i}", x) for i, x in enumerate(t.args, 1)]
        struct = T.StructType([T.StructField(n, of(x), nullable(x)) for n, x in named])
        return T.ArrayType(struct, False) if name == "Nested" else struct
    if name == "SimpleAggregateFunction":
        return of(t.args[1])
    if name == "AggregateFunction":
        return _state(t)
    if name in ("Decimal", "Numeric", *DECIMAL_BITS):
        t = normal(t)
        precision, scale = (_number(t.args[0]) if t.args else 10), (_number(t.args[1]) if len(t.args) > 1 else 0)
        if precision > 38:
            raise TypeError_(f"decimals of {precision} digits: Spark holds 38 at most")
        return T.DecimalType(precision, scale)
    if name == "UInt64" and strict_uint64:
        return T.DecimalType(20, 0)
    if name.lower() in _LOWER:
        return _LOWER[name.lower()]
    if name in ("Int256", "UInt256"):
        raise TypeError_(f"{name} has more digits than the 38 that Spark holds")
    raise TypeError_(f"unknown type {name}")


def _state(t: A.Type) -> T.DataType:
    function = t.args[0].name if isinstance(t.args[0], A.Type) else ""
    if function == "uniq":
        return T.BinaryType()
    if function == "avg":
        return T.StructType([T.StructField("sum", T.DoubleType()), T.StructField("count", T.LongType())])
    if function == "count":
        return T.LongType()
    return spark_type(t.args[1]) if len(t.args) > 1 else T.BinaryType()


def same(current: A.Type, target: A.Type) -> bool:
    """Equality of declared types: DateTime64(p) equals DateTime64(p, zone), and Decimal64(s) equals Decimal(18, s)."""

    def plain(t):
        def change(n):
            if isinstance(n, A.Type) and n.name == "DateTime64":
                return A.Type("DateTime64", n.args[:1])
            return None

        return A.rebuilt(normal(t), change)

    if current.name == target.name == "DateTime64" and len(current.args) == len(target.args) == 2:
        return current == target
    return plain(current) == plain(target)


def struct_of(columns) -> T.StructType:
    """The schema of declared columns, with comments and allowed enum labels as metadata."""
    out = []
    for c in columns:
        meta = {}
        if c.comment:
            meta["comment"] = c.comment
        inner = c.type.args[0] if c.type.name in ("Nullable", "LowCardinality") else c.type
        if inner.name.startswith("Enum"):
            meta["labels"] = [x[0].value if isinstance(x, tuple) else x.value for x in inner.args]
        out.append(T.StructField(c.name, spark_type(c.type), True if c.kind else nullable(c.type), meta))
    return T.StructType(out)
