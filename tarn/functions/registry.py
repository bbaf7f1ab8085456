"""The dialect's functions as Spark SQL expressions. Names are matched without case."""

from __future__ import annotations

from collections.abc import Callable

from tarn.sqlfront.tokens import SqlError

# Format letters of the dialect's date formatter and the pattern letters of Spark's.
DATE_LETTERS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%e": "d", "%H": "HH", "%I": "hh", "%M": "mm", "%i": "mm", "%S": "ss", "%s": "ss", "%p": "a", "%j": "DDD", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%D": "MM/dd/yy", "%a": "EEE", "%b": "MMM", "%%": "'%'"}
# Suffixes of readable sizes.
SIZES = ("B", "KiB", "MiB", "GiB", "TiB", "PiB")


def _plain(name: str) -> Callable:
    return lambda *a: f"{name}({', '.join(a)})"


def _binary(op: str) -> Callable:
    return lambda *a: "(" + f" {op} ".join(a) + ")"


def _multi_if(*a: str) -> str:
    whens = " ".join(f"WHEN {a[i]} THEN {a[i + 1]}" for i in range(0, len(a) - 1, 2))
    return f"CASE {whens} ELSE {a[-1]} END"


def _ntz(x: str) -> str:
    return f"CAST({x} AS TIMESTAMP_NTZ)"


def _trunc(unit: str, date: bool = False) -> Callable:
    return lambda x, *_: f"CAST(date_trunc('{unit}', {x}) AS DATE)" if date else _ntz(f"date_trunc('{unit}', {x})")


def _week(x: str, mode: str = "0") -> str:
    shift = 1 if mode in ("0", "2", "4", "6") else 0  # weeks start on Sunday, or on Monday
    moved = f"date_add(CAST({x} AS DATE), {shift})"
    return f"date_add(CAST(date_trunc('WEEK', {moved}) AS DATE), -{shift})"


def _format(x: str, pattern: str) -> str:
    text, out, i = pattern.strip("'"), "", 0
    while i < len(text):
        if text[i : i + 2] in DATE_LETTERS:
            out, i = out + DATE_LETTERS[text[i : i + 2]], i + 2
        else:
            out, i = out + (f"\\'{text[i]}\\'" if text[i].isalpha() else text[i]), i + 1
    return f"date_format({x}, '{out}')"


def _readable(x: str) -> str:
    whens = " ".join(f"WHEN abs({x}) >= {1024**i} THEN format_string('%.2f {SIZES[i]}', {x} / {1024.0**i}D)" for i in range(len(SIZES) - 1, 0, -1))
    return f"CASE {whens} ELSE format_string('%.2f B', CAST({x} AS DOUBLE)) END"


def _json(as_type: str | None) -> Callable:
    def made(doc: str, *path: str) -> str:
        steps = "".join(f".{p.strip(chr(39))}" if p.startswith("'") else f"[{p}]" for p in path)
        found = f"get_json_object({doc}, '${steps}')"
        return found if as_type is None else f"CAST({found} AS {as_type})"

    return made


def _day_math(op: str) -> Callable:
    """Adding a number to a date counts days; all else is plain arithmetic. The compiler decides which."""
    return _binary(op)


#: Scalar functions: the Spark SQL text for the arguments' texts.
SCALAR: dict[str, Callable] = {k.lower(): v for k, v in {
    "plus": _binary("+"), "minus": _binary("-"), "multiply": _binary("*"), "modulo": _binary("%"), "divide": lambda a, b: f"try_divide({a}, {b})",
    "intDiv": lambda a, b: f"({a} div {b})", "negate": lambda a: f"(-{a})", "round": _plain("round"), "floor": _plain("floor"), "ceil": _plain("ceil"), "ceiling": _plain("ceil"),
    "abs": _plain("abs"), "sqrt": _plain("sqrt"), "pow": _plain("power"), "power": _plain("power"), "exp": _plain("exp"), "log": _plain("ln"), "log2": _plain("log2"), "log10": _plain("log10"),
    "sin": _plain("sin"), "cos": _plain("cos"), "sign": _plain("sign"), "least": _plain("least"), "greatest": _plain("greatest"), "rand": lambda *a: "CAST(rand() * 4294967296D AS BIGINT)",
    "equals": _binary("="), "notEquals": _binary("<>"), "greater": _binary(">"), "less": _binary("<"), "greaterOrEquals": _binary(">="), "lessOrEquals": _binary("<="),
    "and": _binary("AND"), "or": _binary("OR"), "not": lambda a: f"(NOT {a})", "isNull": lambda a: f"({a} IS NULL)", "isNotNull": lambda a: f"({a} IS NOT NULL)",
    "if": lambda c, a, b: f"CASE WHEN {c} THEN {a} ELSE {b} END", "multiIf": _multi_if, "coalesce": _plain("coalesce"), "ifNull": _plain("coalesce"), "nullIf": _plain("nullif"), "assumeNotNull": lambda a: a, "toNullable": lambda a: a,
    "lower": _plain("lower"), "upper": _plain("upper"), "lowerUTF8": _plain("lower"), "upperUTF8": _plain("upper"), "startsWith": _plain("startswith"), "endsWith": _plain("endswith"),
    "concat": _plain("concat"), "substring": _plain("substring"), "substr": _plain("substring"), "length": _plain("length"), "lengthUTF8": _plain("length"), "octetLength": _plain("octet_length"), "trim": _plain("trim"), "trimBoth": _plain("trim"),
    "trimLeft": _plain("ltrim"), "trimRight": _plain("rtrim"), "reverse": _plain("reverse"), "replaceAll": _plain("replace"), "replace": _plain("replace"), "replaceRegexpAll": _plain("regexp_replace"), "position": lambda a, b: f"instr({a}, {b})",
    "match": lambda a, b: f"({a} RLIKE {b})", "splitByChar": lambda sep, s: f"split({s}, concat('\\\\Q', {sep}, '\\\\E'))", "splitByString": lambda sep, s: f"split({s}, concat('\\\\Q', {sep}, '\\\\E'))",
    "domain": lambda u: f"parse_url({u}, 'HOST')", "path": lambda u: f"parse_url({u}, 'PATH')", "protocol": lambda u: f"parse_url({u}, 'PROTOCOL')", "empty": lambda a: f"(length({a}) = 0)", "notEmpty": lambda a: f"(length({a}) > 0)", "format": _plain("format_string"),
    "toString": lambda a: f"CAST({a} AS STRING)", "toInt8": lambda a: f"CAST({a} AS TINYINT)", "toInt16": lambda a: f"CAST({a} AS SMALLINT)", "toInt32": lambda a: f"CAST({a} AS INT)", "toInt64": lambda a: f"CAST({a} AS BIGINT)",
    "toUInt8": lambda a: f"CAST({a} AS SMALLINT)", "toUInt16": lambda a: f"CAST({a} AS INT)", "toUInt32": lambda a: f"CAST({a} AS BIGINT)", "toUInt64": lambda a: f"CAST({a} AS BIGINT)",
    "toFloat32": lambda a: f"CAST({a} AS FLOAT)", "toFloat64": lambda a: f"CAST({a} AS DOUBLE)", "toDecimal64": lambda a, s="0": f"CAST({a} AS DECIMAL(18, {s}))", "toDate": lambda a: f"CAST({a} AS DATE)", "toDateTime": lambda a, *_: _ntz(a),
    "now": lambda *_: "localtimestamp()", "today": lambda: "current_date()", "yesterday": lambda: "date_sub(current_date(), 1)",
    "toYYYYMM": lambda a: f"(year({a}) * 100 + month({a}))", "toYYYYMMDD": lambda a: f"(year({a}) * 10000 + month({a}) * 100 + day({a}))",
    "toYear": _plain("year"), "toQuarter": _plain("quarter"), "toMonth": _plain("month"), "toDayOfMonth": _plain("day"), "toDayOfYear": _plain("dayofyear"), "toHour": _plain("hour"), "toMinute": _plain("minute"), "toSecond": lambda a: f"CAST(second({a}) AS INT)",
    "toDayOfWeek": lambda a: f"(weekday({a}) + 1)", "toStartOfYear": _trunc("YEAR", True), "toStartOfQuarter": _trunc("QUARTER", True), "toStartOfMonth": _trunc("MONTH", True), "toStartOfDay": _trunc("DAY"), "toStartOfHour": _trunc("HOUR"), "toStartOfMinute": _trunc("MINUTE"),
    "toMonday": _trunc("WEEK", True), "toStartOfWeek": _week, "toUnixTimestamp": lambda a: f"unix_timestamp({a})", "toUnixTimestamp64Milli": lambda a: f"unix_millis(CAST({a} AS TIMESTAMP))", "fromUnixTimestamp": lambda a: _ntz(f"timestamp_seconds({a})"),
    "dateDiff": lambda u, a, b: f"timestampdiff({u.strip(chr(39)).upper()}, {a}, {b})", "date_diff": lambda u, a, b: f"timestampdiff({u.strip(chr(39)).upper()}, {a}, {b})", "dateAdd": lambda u, n, a: f"timestampadd({u.strip(chr(39)).upper()}, {n}, {a})",
    "addDays": lambda a, n: f"date_add({a}, {n})", "subtractDays": lambda a, n: f"date_sub({a}, {n})", "addMonths": lambda a, n: f"add_months({a}, {n})", "formatDateTime": _format,
    "days": lambda n: f"make_interval(0, 0, 0, {n})", "years": lambda n: f"make_interval({n})", "months": lambda n: f"make_interval(0, {n})", "hours": lambda n: f"make_interval(0, 0, 0, 0, {n})",
    "toIntervalDay": lambda n: f"make_interval(0, 0, 0, {n})", "toIntervalHour": lambda n: f"make_interval(0, 0, 0, 0, {n})", "toIntervalMonth": lambda n: f"make_interval(0, {n})",
    "xxHash64": _plain("xxhash64"), "cityHash64": _plain("xxhash64"), "sipHash64": _plain("xxhash64"), "MD5": lambda a: f"md5({a})", "SHA256": lambda a: f"sha2({a}, 256)", "hex": _plain("hex"), "base64Encode": lambda a: f"base64({a})",
    "array": _plain("array"), "map": _plain("map"), "tuple": _plain("struct"), "tupleElement": lambda t, n: f"{t}.{n.strip(chr(39)) if n.startswith(chr(39)) else 'col' + n}", "has": _plain("array_contains"), "arrayElement": _plain("element_at"), "arrayJoin": _plain("explode"),
    "arrayConcat": _plain("concat"), "arrayDistinct": _plain("array_distinct"), "arraySort": _plain("sort_array"), "arrayReverse": _plain("reverse"), "arraySum": lambda a: f"aggregate({a}, CAST(0 AS DOUBLE), (x, y) -> x + y)", "arrayStringConcat": lambda a, s="''": f"array_join({a}, {s})",
    "arrayMap": lambda f, a, *b: f"transform({a}, {f})" if not b else f"zip_with({a}, {b[0]}, {f})", "arrayFilter": lambda f, a: f"filter({a}, {f})", "arrayExists": lambda f, a: f"exists({a}, {f})", "arrayAll": lambda f, a: f"forall({a}, {f})", "range": lambda a, b=None: f"sequence(0, {a} - 1)" if b is None else f"sequence({a}, {b} - 1)",
    "mapKeys": _plain("map_keys"), "mapValues": _plain("map_values"), "mapContains": _plain("map_contains_key"),
    "JSONExtractString": _json(None), "JSONExtractInt": _json("BIGINT"), "JSONExtractUInt": _json("BIGINT"), "JSONExtractFloat": _json("DOUBLE"), "JSONExtractBool": _json("BOOLEAN"), "JSONExtractRaw": _json(None), "JSONHas": lambda d, *p: f"({_json(None)(d, *p)} IS NOT NULL)",
    "currentDatabase": lambda: "current_database()", "generateUUIDv4": lambda: "uuid()", "toIPv4": lambda a: a, "toIPv6": lambda a: a, "formatReadableSize": _readable, "bar": lambda x, *_: f"repeat('#', CAST({x} AS INT))", "ignore": lambda *_: "0", "identity": lambda a: a,
}.items()}


def _count(*a: str) -> str:
    return f"count({a[0]})" if a and a[0] != "*" else "count(1)"


#: Accuracy of approximate quantiles: ranks are right to one part in this many.
RANKS = 10_000


def _quantile(params: tuple[str, ...], x: str) -> str:
    return f"percentile({x}, {params[0] if params else '0.5'})"


def _quantiles(params: tuple[str, ...], x: str) -> str:
    return f"percentile({x}, array({', '.join(params)}))"


def _sketched(params: tuple[str, ...], x: str) -> str:
    """A quantile of bounded memory; the exact ones keep every distinct value of a group."""
    return f"percentile_approx({x}, {params[0] if params else '0.5'}, {RANKS})"


def _sketched_all(params: tuple[str, ...], x: str) -> str:
    return f"percentile_approx({x}, array({', '.join(params)}), {RANKS})"


#: Aggregates: the text for parameters and arguments.
AGGREGATE: dict[str, Callable] = {k.lower(): v for k, v in {
    "count": lambda p, *a: _count(*a), "sum": lambda p, x: f"sum({x})", "avg": lambda p, x: f"avg({x})", "min": lambda p, x: f"min({x})", "max": lambda p, x: f"max({x})", "any": lambda p, x: f"any_value({x}, true)", "anyLast": lambda p, x: f"last_value({x}, true)",
    "uniq": lambda p, x: f"approx_count_distinct({x}, 0.02)", "uniqCombined": lambda p, x: f"approx_count_distinct({x})", "uniqHLL12": lambda p, x: f"approx_count_distinct({x})", "uniqExact": lambda p, *x: f"count(DISTINCT {', '.join(x)})",
    "argMax": lambda p, x, v: f"max_by({x}, {v})", "argMin": lambda p, x, v: f"min_by({x}, {v})", "quantile": _sketched, "quantiles": _sketched_all, "median": _sketched,
    "quantileExact": _quantile, "quantileExactInclusive": _quantile, "quantilesExact": _quantiles, "quantilesExactInclusive": _quantiles, "medianExact": _quantile, "medianExactInclusive": _quantile,
    "quantileApprox": lambda p, x: f"percentile_approx({x}, {p[0] if p else '0.5'})", "groupArray": lambda p, x: f"collect_list({x})" if not p else f"slice(collect_list({x}), 1, {p[0]})", "groupUniqArray": lambda p, x: f"collect_set({x})",
    "topK": lambda p, x: f"transform(approx_top_k({x}, {p[0] if p else '10'}), t -> t.item)", "varPop": lambda p, x: f"var_pop({x})", "varSamp": lambda p, x: f"var_samp({x})", "stddevPop": lambda p, x: f"stddev_pop({x})", "stddevSamp": lambda p, x: f"stddev_samp({x})", "corr": lambda p, x, y: f"corr({x}, {y})",
    "countState": lambda p, *a: _count(*a), "sumState": lambda p, x: f"sum({x})", "minState": lambda p, x: f"min({x})", "maxState": lambda p, x: f"max({x})", "uniqState": lambda p, x: f"hll_sketch_agg({x})",
    "avgState": lambda p, x: f"named_struct('sum', sum(CAST({x} AS DOUBLE)), 'count', count({x}))",
    "countMerge": lambda p, x: f"sum({x})", "sumMerge": lambda p, x: f"sum({x})", "minMerge": lambda p, x: f"min({x})", "maxMerge": lambda p, x: f"max({x})", "uniqMerge": lambda p, x: f"hll_sketch_estimate(hll_union_agg({x}))",
    "avgMerge": lambda p, x: f"try_divide(sum({x}.sum), sum({x}.count))",
    "grouping": lambda p, x: f"grouping({x})", "bool_and": lambda p, x: f"bool_and({x})", "bool_or": lambda p, x: f"bool_or({x})",
}.items()}
#: Functions that only stand over a window.
WINDOWED = {
    "row_number": "row_number", "rank": "rank", "dense_rank": "dense_rank", "ntile": "ntile", "percent_rank": "percent_rank", "cume_dist": "cume_dist", "lag": "lag", "lead": "lead",
    "laginframe": "lag", "leadinframe": "lead", "first_value": "first_value", "last_value": "last_value", "nth_value": "nth_value",
}


#: Approximate counts: each has a buffer of fixed width, some kilobytes, and does not mind equal values.
SKETCHES = ("uniq", "uniqcombined", "uniqhll12", "approx_count_distinct")


def without_if(name: str) -> str:
    """The name of an aggregate in small letters, without the ending of its conditional form."""
    low = name.lower()
    return low[:-2] if low not in AGGREGATE and low.endswith("if") and low[:-2] in AGGREGATE else low


def is_aggregate(name: str) -> bool:
    low = name.lower()
    return low in AGGREGATE or (low.endswith("if") and low[:-2] in AGGREGATE)


def call(name: str, params: tuple[str, ...] | None, args: list[str], distinct: bool = False) -> str:
    """The Spark SQL text of a call that is not over a window. A name that is not listed is taken as Spark's."""
    low = name.lower()
    if low in SCALAR and not distinct:
        return SCALAR[low](*args)
    if low in AGGREGATE:
        if distinct:
            return AGGREGATE[low](params or (), "DISTINCT " + ", ".join(args))
        return AGGREGATE[low](params or (), *args)
    if low.endswith("if") and low[:-2] in AGGREGATE and args:
        inner = AGGREGATE[low[:-2]](params or (), *(["DISTINCT " + ", ".join(args[:-1])] if distinct else args[:-1]))
        if not inner.endswith(")") or inner.startswith(("named_struct", "try_divide", "transform", "slice", "hll_sketch_estimate")):
            raise SqlError(f"{name}: no conditional form")
        return f"{inner} FILTER (WHERE {args[-1]})"
    if params is not None:
        raise SqlError(f"unknown function with parameters: {name}")
    return f"{name}({'DISTINCT ' * distinct}{', '.join(args)})"
