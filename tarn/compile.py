"""Queries of the dialect as DataFrames.

A tree becomes Spark SQL text over temporary views; what Spark's SQL lacks is rewritten: aliases in
WHERE, totals, limits per group, as-of and array joins, gap filling, conditional and mergeable
aggregates. Catalyst plans the rest. Names of tables are looked up in a dictionary of DataFrames,
then in Spark's catalog.
"""

from __future__ import annotations

import itertools
import re
import warnings
from collections.abc import Callable, Mapping
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tarn.functions import registry as R
from tarn.operators.fill import Fill, with_fill
from tarn.sqlfront import ast as A
from tarn.sqlfront.parser import parse_select
from tarn.sqlfront.render import Renderer, quote, render
from tarn.sqlfront.tokens import SqlError
from tarn.types import spark_type

_NUMBER = itertools.count()
#: A right side declared GLOBAL is broadcast up to this estimated size; beyond it Spark chooses.
BROADCAST_BYTES = 256 << 20
# Collation names of other systems.
COLLATIONS = {"utf8_bin": "UTF8_BINARY", "binary": "UTF8_BINARY", "utf8_general_ci": "UTF8_LCASE", "utf8_unicode_ci": "UNICODE_CI", "unicode": "UNICODE"}
#: Types, by their text, that have no order in Spark: calendar intervals (those of days or months have a unit after the word) and variants.
UNORDERED = re.compile(r"\binterval\b(?! )|\bvariant\b")
TIME_UNITS = {"QUARTER": ("MONTH", 3), "WEEK": ("DAY", 7)}


class SparkText(Renderer):
    """Trees as Spark SQL."""

    def __init__(self, functions: Mapping[str, A.Lambda] = (), spark: SparkSession | None = None):
        self.functions = {k.lower(): v for k, v in dict(functions).items()}
        self.spark = spark

    def on_select(self, e: A.Select) -> str:
        def kinds(args: tuple[A.Node, ...]) -> list[str]:
            bare = A.Select(tuple((x, f"_{i}") for i, x in enumerate(args)), with_=e.with_, from_=e.from_, joins=e.joins)
            return self.kinds(Renderer.on_select(self, bare))

        return super().on_select(self.sparing(e, kinds))

    def kinds(self, text: str) -> list[str]:
        """The types of a query's columns."""
        return [kind for _, kind in self.spark.sql(text).dtypes]

    def sparing(self, s: A.Select, kinds: Callable[[tuple[A.Node, ...]], list[str]]) -> A.Select:
        """The query with its sketches over distinct values, where they stand beside distinct aggregates.

        Spark groups such a query by keys and distinct values first, and each of these groups would hold the buffer of
        every sketch, some kilobytes. A sketch of the distinct values is the same sketch, with one buffer for each key.
        With distinct values of several arguments, or conditions, Spark spreads the rows and puts NULL for the other
        arguments; a calendar interval then makes no sound key, and the query stays as it is. ``kinds`` has the types of
        arguments.
        """
        inner = (A.Query, A.Select)

        def opened(n):
            return A.rebuilt(inlined(n, self.functions[n.name.lower()]), opened, inner) if isinstance(n, A.Call) and n.name.lower() in self.functions else None

        old = (tuple(x for x, _ in s.items), s.having, s.order)
        new = A.rebuilt(old, opened, inner)
        calls = [n for n in A.walk(new, inner) if isinstance(n, A.Call) and n.over is None]
        exact = {n for n in calls if n.distinct or R.without_if(n.name) == "uniqexact"}
        sketches = {n for n in calls if R.without_if(n.name) in R.SKETCHES} - exact
        if not exact or not sketches:
            return s
        some = {n for n in exact | sketches if R.without_if(n.name) != n.name.lower()}
        values = {n.args[:-1] if n in some else n.args[:1] if n in sketches else n.args for n in exact | sketches}
        if some or len(values) > 1:
            try:
                if self.spark is None or any(UNORDERED.search(k) for k in kinds(tuple({x for v in values for x in v}))):
                    return s
            except AnalysisException:
                return s
        items, having, order = A.rebuilt(new, lambda n: replace(n, distinct=True) if isinstance(n, A.Call) and n in sketches else None, inner)
        named = tuple(a or ("" if x == was else render(was)) for x, was, (_, a) in zip(items, old[0], s.items, strict=True))
        return replace(s, items=tuple(zip(items, named, strict=True)), having=having, order=order)

    def on_lit(self, e: A.Lit) -> str:
        if e.kind == "number" and "." in e.value:
            return e.value + ("0" if e.value.endswith(".") else "")
        return super().on_lit(e)

    def on_name(self, e: A.Name) -> str:
        return ".".join("`" + p.replace("`", "``") + "`" for p in e.parts)

    def on_binary(self, e: A.Binary) -> str:
        if e.op == "/":
            return f"try_divide({self(e.left)}, {self(e.right)})"
        for date, days, op in ((e.left, e.right, e.op), (e.right, e.left, e.op)):
            if op in ("+", "-") and isinstance(date, A.Call) and date.name.lower() in ("today", "todate", "yesterday") and isinstance(days, A.Lit) and days.kind == "number" and (date is e.left or op == "+"):
                return f"{'date_add' if op == '+' else 'date_sub'}({self(date)}, {self(days)})"
        return super().on_binary(e)

    def on_in(self, e: A.In) -> str:
        if isinstance(e.among, A.Array):
            return super().on_in(replace(e, among=A.Tuple(e.among.items)))
        if isinstance(e.among, A.Tuple | A.Query):
            return super().on_in(e)
        return f"{'NOT ' * e.negated}array_contains({self(e.among)}, {self(e.arg)})"

    def on_interval(self, e: A.Interval) -> str:
        unit, times = TIME_UNITS.get(e.unit, (e.unit, 1))
        if isinstance(e.value, A.Lit):
            return f"INTERVAL {int(e.value.value) * times} {unit}"
        at = ("YEAR", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND").index(unit)
        return f"make_interval({', '.join(['0'] * at + [f'{self(e.value, 8)} * {times}'])})"

    def on_extract(self, e: A.Extract) -> str:
        return f"CAST(EXTRACT({e.part} FROM {self(e.arg)}) AS INT)"

    def on_cast(self, e: A.Cast) -> str:
        return f"CAST({self(e.arg)} AS {spark_type(e.to).simpleString()})"

    def on_tuple(self, e: A.Tuple) -> str:
        return f"({self.many(e.items)})" if len(e.items) > 1 else f"struct({self.many(e.items)})"

    def on_array(self, e: A.Array) -> str:
        return f"array({self.many(e.items)})"

    def on_index(self, e: A.Index) -> str:
        return f"try_element_at({self(e.arg)}, {self(e.at)})"

    def on_lambda(self, e: A.Lambda) -> str:
        params = ", ".join(f"`{p}`" for p in e.params)
        return f"{params if len(e.params) == 1 else f'({params})'} -> {self(e.body)}"

    def on_call(self, e: A.Call) -> str:
        low = e.name.lower()
        if low in self.functions:
            return f"({self(inlined(e, self.functions[low]))})"
        args = [self(x) for x in e.args]
        if low in R.SCALAR:  # some become operators, which may bind tighter than what is in their arguments
            args = [f"({t})" if isinstance(x, A.Unary | A.Binary | A.Between | A.In | A.IsNull) else t for x, t in zip(e.args, args, strict=True)]
        params = tuple(self(x) for x in e.params) if e.params is not None else None
        if e.over is None:
            return R.call(e.name, params, args, e.distinct)
        over = e.over
        if low == "cumsum":
            return f"sum({args[0]}) OVER ({self(replace(over, frame=('ROWS', (None, 'PRECEDING'), (None, 'CURRENT ROW'))))})"
        text = f"{R.WINDOWED[low]}({', '.join(args)})" if low in R.WINDOWED else R.call(e.name, params, args, e.distinct)
        frameless = low in ("row_number", "rank", "dense_rank", "ntile", "percent_rank", "cume_dist", "lag", "lead")
        return f"{text} OVER ({self(replace(over, frame=None) if frameless else over)})"

    def on_order(self, e: A.Order) -> str:
        text = self(e.expr)
        if e.collate:
            text = f"collate({text}, {quote(COLLATIONS.get(e.collate.lower(), e.collate))})"
        return f"{text} {'DESC' if e.desc else 'ASC'} NULLS {e.nulls or 'LAST'}"

    def on_group(self, e: A.Group) -> str:
        if e.all:
            return "ALL"
        keys = self.many(e.exprs)
        return {"CUBE": f"CUBE({keys})", "ROLLUP": f"ROLLUP({keys})", "TOTALS": f"GROUPING SETS (({keys}), ())"}.get(e.mode, keys)


def inlined(call: A.Call, function: A.Lambda) -> A.Node:
    """The body of a declared function with the call's arguments in place of its parameters."""
    if len(call.args) != len(function.params):
        raise SqlError(f"{call.name} takes {len(function.params)} arguments, {len(call.args)} given")
    given = dict(zip(function.params, call.args, strict=True))
    return A.rebuilt(function.body, lambda n: given.get(n.parts[0]) if isinstance(n, A.Name) and len(n.parts) == 1 else None)


class Session:
    """Where queries run: tables by name, declared functions, table functions and warnings.

    ``tables`` maps names (``t`` or ``db.t``) to DataFrames; others are looked up in Spark's catalog.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | None = None, functions: Mapping[str, A.Lambda] | None = None):
        self.spark = spark
        self.tables = dict(tables or {})
        self.functions = dict(functions or {})
        #: How FINAL merges a table's rows, by its name.
        self.merging: Callable[[tuple[str, ...]], Callable[[DataFrame], DataFrame]] = lambda parts: lambda df: df
        self.names: Callable[[], list[str]] = lambda: list(self.tables)
        self.table_functions: dict[str, Callable[..., DataFrame]] = dict(TABLE_FUNCTIONS)
        self.views: list[str] = []

    def sql(self, text: str) -> DataFrame:
        """The DataFrame of one query."""
        return self.run(parse_select(text))

    def run(self, select: A.Select) -> DataFrame:
        """The DataFrame of a parsed query. Its plan is analysed at once, so the views it was made from go again."""
        before = len(self.views)
        try:
            return _Query(self, {}).frame(select)
        finally:
            while len(self.views) > before:
                self.spark.catalog.dropTempView(self.views.pop())

    def table(self, parts: tuple[str, ...]) -> DataFrame:
        for name in (".".join(parts), parts[-1]):
            if name in self.tables:
                return self.tables[name]
        return self.spark.table(".".join(f"`{p}`" for p in parts))


class _Query:
    """Compiles one query; ``named`` has the CTEs in sight."""

    def __init__(self, session: Session, named: Mapping[str, DataFrame]):
        self.session, self.named = session, dict(named)
        self.text = SparkText(session.functions, session.spark)

    def view(self, df: DataFrame) -> str:
        name = f"_tarn_{next(_NUMBER)}"
        df.createOrReplaceTempView(name)
        self.session.views.append(name)
        return name

    def columns(self, relation: str) -> list[str]:
        return self.session.spark.sql(f"SELECT * FROM {relation}").columns

    def source(self, t: A.Node) -> tuple[str, str, DataFrame]:
        """The relation's text with its alias, the alias, and the frame."""
        if isinstance(t, A.Table):
            df = self.named[t.parts[0]] if len(t.parts) == 1 and t.parts[0] in self.named else self.session.table(t.parts)
            if t.final:
                df = self.session.merging(t.parts)(df)
            alias = t.alias or t.parts[-1]
        elif isinstance(t, A.SubSelect):
            df, alias = _Query(self.session, self.named).frame(t.select), t.alias or f"_sub_{next(_NUMBER)}"
        else:
            make = self.session.table_functions.get(t.name.lower())
            if make is None:
                raise SqlError(f"unknown table function {t.name}")
            df, alias = make(self.session, *[_constant(x) for x in t.args]), t.alias or t.name
        return f"{self.view(df)} AS `{alias}`", alias, df

    # Rewrites of what Spark's SQL does not have

    def subqueries(self, node):
        """Tables inside queries of expressions by their views; such queries are compiled as text."""

        def change(n):
            if isinstance(n, A.Query):
                return A.Query(self.plain(n.select), n.exists)
            return None

        return A.rebuilt(node, change)

    def plain(self, s: A.Select) -> A.Select:
        def relation(n):
            if isinstance(n, A.Table) and not n.parts[0].startswith("_tarn_"):
                _, alias, df = self.source(n)
                return A.Table((self.view(df),), alias)
            return None

        local = {n for n, _ in s.with_}
        return A.rebuilt(s, lambda n: None if isinstance(n, A.Table) and n.parts[0] in local else relation(n))

    def frame(self, s: A.Select) -> DataFrame:
        for name, query in s.with_:
            self.named[name] = _Query(self.session, self.named).frame(query)
        s = self.settled(s)
        s = replace(s, with_=(), settings=())
        s, relation, known = self.relation(s)
        s = self.where_aliases(s, known)
        s = self.subqueries(s)
        if s.limit_by or any(o.fill is not None for o in s.order) or (s.group is not None and s.group.mode == "TOTALS"):
            return self.staged(s, relation)
        return self.session.spark.sql(self.body(s, relation))

    def settled(self, s: A.Select) -> A.Select:
        """SETTINGS of a query that bear on its rows: limit and offset; others have no counterpart here."""
        for k, v in s.settings:
            value = int(v.value) if isinstance(v, A.Lit) and v.kind == "number" and v.value.isdigit() else int(v) if isinstance(v, int | str) and str(v).isdigit() else None
            if k == "limit" and value:
                s = replace(s, limit=value if s.limit is None else min(value, s.limit))
            elif k == "offset" and value is not None:
                s = replace(s, offset=value + (s.offset or 0))
            else:
                warnings.warn(f"setting {k} has no counterpart here and is ignored", stacklevel=4)
        return s

    def body(self, s: A.Select, relation: str) -> str:
        """The query's text without rewrites that need more than one step."""
        s = self.text.sparing(s, lambda args: self.text.kinds(f"SELECT {self.text.many(args)}" + (f" FROM {relation}" if relation else "")))
        parts = [f"SELECT {'DISTINCT ' * s.distinct}{', '.join(self.item(x, a) for x, a in s.items)}"]
        if relation:
            parts.append(f"FROM {relation}")
        if s.where is not None:
            parts.append(f"WHERE {self.text(s.where)}")
        totals = s.group is not None and s.group.mode == "TOTALS"
        if s.group is not None:
            group = s.group
            if totals:
                named = {a: x for x, a in s.items if a}
                group = replace(group, exprs=tuple(named.get(x.parts[0], x) if isinstance(x, A.Name) and len(x.parts) == 1 else x for x in group.exprs))
            parts.append(f"GROUP BY {self.text(group)}")
        if s.having is not None:
            having = self.text(s.having)
            parts.append(f"HAVING {f'(grouping_id() <> 0 OR ({having}))' if totals else having}")
        if s.order:
            parts.append(f"ORDER BY {self.text.many(s.order)}")
        if s.limit is not None:
            parts.append(f"LIMIT {s.limit}")
        if s.offset is not None:
            parts.append(f"OFFSET {s.offset}")
        return " ".join(parts)

    def item(self, x: A.Node, alias: str) -> str:
        text = self.text(x)
        if alias:
            return f"{text} AS `{alias}`"
        if isinstance(x, A.Name | A.Star):
            return text
        return f"{text} AS `{render(x)}`".replace("``", "`") if "`" not in render(x) else text

    def relation(self, s: A.Select) -> tuple[A.Select, str, set[str]]:
        """The FROM clause's text, joins included; the query with names that the joins have moved; the columns in sight."""
        if s.from_ is None:
            return s, "", set()
        text, alias, df = self.source(s.from_)
        known = set(df.columns)
        for k, j in enumerate(s.joins):
            if j.strictness == "ARRAY":
                s, view = self.array_join(s, j, k)
                text += view
            elif j.strictness == "ASOF":
                if k:
                    raise SqlError("an as-of join has to be the first join; put what is before it into a subquery")
                s, text, df = self.asof(s, j, alias, df)
                known |= set(df.columns)
            else:
                more, other, right = self.source(j.table)
                on = f" ON {self.text(self.subqueries(s.joins[k].on))}" if j.on is not None else f" USING ({', '.join(f'`{c}`' for c in j.using)})" if j.using else ""
                if not on and j.kind != "CROSS":
                    raise SqlError(f"{j.kind} JOIN without ON or USING")
                if j.strictness == "GLOBAL" and _estimated(right) <= BROADCAST_BYTES:
                    more = f"{self.view(right.hint('broadcast'))} AS `{other}`"
                text += f" {j.kind} JOIN {more}{on}"
                known |= set(right.columns)
        return s, text, known

    def array_join(self, s: A.Select, j: A.Join, k: int) -> tuple[A.Select, str]:
        """ARRAY JOIN as a lateral view; the array's name, or its alias, then stands for one element."""
        t = j.table
        if not isinstance(t, A.Table | A.TableFunction):
            raise SqlError("ARRAY JOIN takes the name of an array")
        array = self.text(A.Name(t.parts)) if isinstance(t, A.Table) else self.text(A.Call(t.name, t.args))
        name, side = t.alias or (t.parts[-1] if isinstance(t, A.Table) else "element"), f"_each_{k}"

        def change(n):
            if isinstance(n, A.Name) and n.parts[0] == name:
                return A.Name((side, *n.parts))
            return None

        moved = A.rebuilt(replace(s, from_=None, joins=()), change)
        items = tuple((x, a or (n[0].parts[-1] if isinstance(n[0], A.Name) else a)) for (x, a), n in zip(moved.items, s.items, strict=True))
        joins = (*s.joins[: k + 1], *A.rebuilt(s.joins[k + 1 :], change))
        return replace(moved, items=items, from_=s.from_, joins=joins), f" LATERAL VIEW {'OUTER ' * (j.kind == 'LEFT')}explode({array}) `{side}` AS `{name}`"

    def asof(self, s: A.Select, j: A.Join, alias: str, left: DataFrame) -> tuple[A.Select, str, DataFrame]:
        """The left rows with the nearest right row; names of the right side become fields of one column."""
        from tarn.operators.asof import asof_join

        _, other, right = self.source(j.table)

        def side(n: A.Node) -> str:
            if not isinstance(n, A.Name):
                raise SqlError("an as-of join compares columns")
            if len(n.parts) > 1:
                return "right" if n.parts[-2] == other else "left"
            return "left" if n.parts[-1] in left.columns else "right"

        keys, near = [(c, c) for c in j.using[:-1]], (j.using[-1], ">=", j.using[-1]) if j.using else None
        for part in _conjuncts(j.on):
            if not isinstance(part, A.Binary) or part.op not in ("=", "<", "<=", ">", ">="):
                raise SqlError("an as-of join takes equalities and one inequality of columns")
            a, b, op = part.left, part.right, part.op
            if side(a) == "right":
                a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
            if op == "=":
                keys.append((a.parts[-1], b.parts[-1]))
            else:
                near = (a.parts[-1], op, b.parts[-1])
        if near is None:
            raise SqlError("an as-of join needs an inequality")
        held = f"_right_{next(_NUMBER)}"
        joined = asof_join(left, right, keys, near, inner=j.kind != "LEFT", held=held)

        def change(n):
            if isinstance(n, A.Name):
                if len(n.parts) > 1 and n.parts[0] == other:
                    return A.Name((held, *n.parts[1:]))
                if len(n.parts) == 1 and n.parts[0] not in left.columns and n.parts[0] in right.columns:
                    return A.Name((held, n.parts[0]))
            return None

        moved = A.rebuilt(replace(s, from_=None, joins=()), change)
        items = []
        for (x, a), (before, _) in zip(moved.items, s.items, strict=True):
            if isinstance(before, A.Star) and before.of in ("", other):
                if not before.of:
                    items += [(A.Name((alias, c)), "") for c in left.columns]
                items += [(A.Name((held, c)), c) for c in right.columns if c not in left.columns or before.of]
            else:
                items.append((x, a or (before.parts[-1] if isinstance(before, A.Name) else a)))
        later = A.rebuilt(s.joins[1:], change)
        out = replace(moved, items=tuple(items), from_=s.from_, joins=(j, *later))
        return out, f"{self.view(joined)} AS `{alias}`", right

    def where_aliases(self, s: A.Select, known: set[str]) -> A.Select:
        """Aliases in WHERE by their expressions; a column of the same name wins."""
        if s.where is None:
            return s
        named = {a: x for x, a in s.items if a and a not in known}
        for _ in range(len(named)):
            named = {a: A.rebuilt(x, lambda n: named.get(n.parts[0]) if isinstance(n, A.Name) and len(n.parts) == 1 and n.parts[0] != a else None) for a, x in named.items()}  # noqa: B023
        return replace(s, where=A.rebuilt(s.where, lambda n: named.get(n.parts[0]) if isinstance(n, A.Name) and len(n.parts) == 1 else None))

    def staged(self, s: A.Select, relation: str) -> DataFrame:
        """What one text cannot say, step by step: rows, DISTINCT, LIMIT BY, WITH FILL, order and limits, the totals row.

        Sort and group keys that are not in the result stand in hidden columns until they are used. Of equal
        rows, DISTINCT keeps the first in the query's order. The totals row is in none of the steps.
        """
        spark, totals = self.session.spark, s.group is not None and s.group.mode == "TOTALS"
        aliases = {a: x for x, a in s.items if a}
        n, skip, by = s.limit_by or (0, 0, ())
        hidden = [(A.Call("grouping_id"), "_total")] if totals else []
        hidden += [(self.named_expr(x, aliases), f"_by_{i}") for i, x in enumerate(by)]
        hidden += [(self.named_expr(o.expr, aliases), f"_o_{i}") for i, o in enumerate(s.order)]
        plain = replace(s, items=(*s.items, *hidden), distinct=False, order=(), limit=None, offset=None, limit_by=None, interpolate=None)
        base = spark.sql(self.body(plain, relation))
        extra = [a for _, a in hidden]
        seen = [c for c in base.columns if c not in extra]
        order = ", ".join(self.text(replace(o, expr=A.Name((f"_o_{i}",)), fill=None)) for i, o in enumerate(s.order))
        rows = base.where("_total = 0") if totals else base
        if s.distinct:
            rows = self.first_of(rows, seen, order, 0, 1) if extra else rows.distinct()
        if by:
            rows = self.first_of(rows, [f"_by_{i}" for i in range(len(by))], order, skip, n)
        if any(o.fill is not None for o in s.order):
            rows, order = self.filled(s, rows.select(*[f"`{c}`" for c in seen]))
        limits = (f" LIMIT {s.limit}" if s.limit is not None else "") + (f" OFFSET {s.offset}" if s.offset is not None else "")
        text = f"SELECT * FROM {self.view(rows)}" + (f" ORDER BY {order}" if order else "") + limits
        if totals:
            last = base.where("_total > 0").select(*[c for c in base.columns if c in rows.columns])
            both = spark.sql(text).drop("_total").selectExpr("*", "0 AS _total").unionByName(last.drop("_total").selectExpr("*", "1 AS _total"))
            text = f"SELECT * FROM {self.view(both)} ORDER BY {', '.join(x for x in ('_total', order) if x)}"
        return spark.sql(text).drop(*extra)

    def first_of(self, rows: DataFrame, keys: list[str], order: str, skip: int, n: int) -> DataFrame:
        """Rows ``skip`` + 1 to ``skip`` + ``n`` of each group, in an order."""
        among = ", ".join(f"`{k}`" for k in keys)
        ranked = f"SELECT *, row_number() OVER (PARTITION BY {among} ORDER BY {order or '1'}) AS _n FROM {self.view(rows)}"
        return self.session.spark.sql(f"SELECT * FROM ({ranked}) WHERE _n > {skip} AND _n <= {skip + n}").drop("_n")

    def named_expr(self, x: A.Node, aliases: dict[str, A.Node]) -> A.Node:
        return aliases.get(x.parts[0], x) if isinstance(x, A.Name) and len(x.parts) == 1 else x

    def filled(self, s: A.Select, base: DataFrame) -> tuple[DataFrame, str]:
        """ORDER BY ... WITH FILL: the rows filled, and their order by columns of the result."""
        by_text = {x: a or (x.parts[-1] if isinstance(x, A.Name) else "") for x, a in s.items}
        order, fills = [], []
        for o in s.order:
            key = by_text.get(o.expr) or (o.expr.parts[-1] if isinstance(o.expr, A.Name) else "")
            if key not in base.columns:
                raise SqlError("WITH FILL sorts by columns of the result")
            order.append((key, o.desc))
            if o.fill is not None:
                fills.append(Fill(key, o.desc, *[None if x is None else self.text(x) for x in o.fill]))
        carried = None
        if s.interpolate is not None:
            free = [c for c in base.columns if c not in {k for k, _ in order}]
            chosen = s.interpolate or tuple((c, None) for c in free)
            carried = {c: None if x is None else self.text(A.rebuilt(x, lambda n, c=c: A.Name(("acc",)) if isinstance(n, A.Name) and n.parts[-1] == c else None)) for c, x in chosen}
        out = with_fill(base, order, fills, carried).select(*[f"`{c}`" for c in base.columns])
        return out, ", ".join(self.text(replace(o, expr=A.Name((k,)), fill=None)) for o, (k, _) in zip(s.order, order, strict=True))


def _conjuncts(e: A.Node | None) -> list[A.Node]:
    if e is None:
        return []
    if isinstance(e, A.Binary) and e.op == "AND":
        return _conjuncts(e.left) + _conjuncts(e.right)
    return [e]


def _constant(e: A.Node):
    if isinstance(e, A.Lit):
        return {"number": lambda: float(e.value) if "." in e.value else int(e.value), "bool": lambda: e.value == "true", "null": lambda: None}.get(e.kind, lambda: e.value)()
    if isinstance(e, A.Name):
        return ".".join(e.parts)
    if isinstance(e, A.Unary) and e.op == "-":
        return -_constant(e.arg)
    raise SqlError("a table function takes constants and names")


def _estimated(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


from tarn.sources.table_functions import TABLE_FUNCTIONS  # noqa: E402
