"""Scripts in canonical form, with a few options of layout."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields

from tarn.sqlfront.ddl import column_text, parse, write
from tarn.sqlfront.parser import STOPS
from tarn.sqlfront.render import ident, render
from tarn.sqlfront.tokens import tokens

# Words that are the dialect's own wherever they stand in a statement.
_KEYWORDS = STOPS | frozenset(
    "CREATE ALTER ATTACH DETACH DROP RENAME SET OR REPLACE TABLE DATABASE VIEW MATERIALIZED DICTIONARY FUNCTION ROLE NAMED COLLECTION IF EXISTS CLUSTER ENGINE PRIMARY KEY PARTITION SAMPLE TTL DEFAULT ALIAS EPHEMERAL "
    "CODEC COMMENT INDEX TYPE GRANULARITY CONSTRAINT CHECK PROJECTION ADD COLUMN MODIFY REMOVE CLEAR UPDATE DELETE FREEZE POPULATE LIFETIME SOURCE LAYOUT DISTINCT OVER ROWS RANGE PRECEDING FOLLOWING UNBOUNDED CURRENT ROW "
    "TOTALS CUBE ROLLUP FIRST LAST AFTER SYNC PERMANENTLY CAST EXTRACT INTERVAL NULL TRUE FALSE".split()
)


@dataclass(frozen=True)
class Options:
    """Indent in spaces; key words in upper case; types of columns in one line; clauses of queries on lines of their own; blank lines between statements.

    Clauses longer than ``max_line`` characters break at their commas (0: never). With ``multiline_functions``,
    a call of at least ``function_args`` arguments, and any of a function in ``always_multiline``, has its
    arguments on lines of their own, indented by ``function_indent``; with ``pair_functions``, those of a
    function in ``paired`` go ``pair_size`` to a line.
    """

    indent: int = 4
    uppercase: bool = True
    align: bool = True
    multiline_queries: bool = True
    blank_lines: int = 1
    max_line: int = 120
    multiline_functions: bool = True
    function_args: int = 4
    always_multiline: tuple[str, ...] = ("multiIf", "case", "transform", "multiSearchAllPositions")
    function_indent: int = 4
    pair_functions: bool = True
    paired: tuple[str, ...] = ("multiIf", "if", "case", "transform")
    pair_size: int = 2


def options_from(path: str) -> Options:
    """Options from the [format] table of a TOML file; what it does not name keeps its default."""
    with open(path, "rb") as f:
        given = tomllib.load(f).get("format", {})
    if unknown := set(given) - {f.name for f in fields(Options)}:
        raise ValueError(f"unknown format options: {', '.join(sorted(unknown))}")
    return Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def _split(every: list, text: str, first: int, last: int) -> list[str]:
    """The text between two tokens, cut at the commas outside parentheses."""
    out, level, start = [], 0, every[first].at + 1
    for t in every[first + 1 : last]:
        if t.kind == "op" and t.text in "([":
            level += 1
        elif t.kind == "op" and t.text in ")]":
            level -= 1
        elif t.kind == "op" and t.text == "," and not level:
            out.append(text[start : t.at].strip())
            start = t.at + 1
    rest = text[start : every[last].at].strip()
    return [*out, rest] if rest or out else []


def laid_out(text: str, o: Options, depth: int = 0) -> str:
    """An expression's or clause's text with long calls over several lines; only white space changes."""
    if not o.multiline_functions:
        return text
    every = list(tokens(text))
    out, done, k = [], 0, 0
    while k < len(every) - 1:
        t = every[k]
        call = t.kind == "name" and every[k + 1].text == "(" and every[k + 1].at == t.at + len(t.text) and t.text.upper() not in _KEYWORDS
        if not call:
            k += 1
            continue
        level, end = 0, k + 1
        while end < len(every):
            level += every[end].text in ("(", "[") and every[end].kind == "op"
            level -= every[end].text in (")", "]") and every[end].kind == "op"
            if not level:
                break
            end += 1
        if end >= len(every):
            break
        args, name = _split(every, text, k + 1, end), t.text.lower()
        out.append(text[done : t.at])
        if len(args) > 1 and (len(args) >= o.function_args or name in {n.lower() for n in o.always_multiline}):
            inner = [laid_out(a, o, depth + 1) for a in args]
            size = o.pair_size if o.pair_functions and name in {n.lower() for n in o.paired} else 1
            pad = " " * (o.function_indent * (depth + 1))
            lines = [pad + ", ".join(inner[i : i + size]) for i in range(0, len(inner), size)]
            out.append(f"{t.text}(\n" + ",\n".join(lines) + f"\n{' ' * (o.function_indent * depth)})")
        else:
            out.append(f"{t.text}({', '.join(laid_out(a, o, depth) for a in args)})")
        done = every[end].at + 1
        k = end + 1
    return "".join(out) + text[done:]


def _broken(clause: str, o: Options) -> str:
    """A clause that is too long for a line, at its commas."""
    if not o.max_line or len(clause) <= o.max_line or "\n" in clause:
        return clause
    every, cuts, level = list(tokens(clause)), [], 0
    for t in every:
        if t.kind == "op" and t.text in "([":
            level += 1
        elif t.kind == "op" and t.text in ")]":
            level -= 1
        elif t.kind == "op" and t.text == "," and not level:
            cuts.append(t.at + 1)
    if not cuts:
        return clause
    parts = [clause[a:b].strip() for a, b in zip([0, *cuts], [*cuts, len(clause)], strict=True)]
    return ("\n" + " " * o.indent).join(parts)


def _columns(s, o: Options) -> list[str]:
    columns = s.get("columns", ())
    names = [ident(c.name, True) for c in columns]
    width = max(map(len, names), default=0) if o.align else 0
    out = []
    for c, n in zip(columns, names, strict=True):
        rest = column_text(c)[len(n) :].lstrip()
        out.append(f"{n.ljust(width)} {rest}".rstrip())
    return out


def _query(s, o: Options, depth: int = 0) -> str:
    text = render(s)
    if not o.multiline_queries:
        return text
    pad, out, level, last = " " * (o.indent * depth), [], 0, 0
    breaks = ("FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "SETTINGS", "INTERPOLATE", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "GLOBAL")
    every = tokens(text)
    for k, t in enumerate(every):
        if t.kind == "op" and t.text in "([":
            level += 1
        elif t.kind == "op" and t.text in ")]":
            level -= 1
        elif level == 0 and t.kind == "name" and t.text in breaks and k and not (every[k - 1].text in ("GLOBAL", "WITH")) and not (k + 1 < len(every) and every[k + 1].text == "("):
            out.append(text[last : t.at].rstrip())
            last = t.at
    out.append(text[last:])
    return ("\n" + pad).join(_broken(laid_out(x, o), o) for x in out)


def format_statement(s, o: Options) -> str:
    text = write(s)
    if s.kind == "CREATE TABLE" and s.get("columns"):
        before, inner, after = text.partition("(\n    ")
        if inner:
            elements = text[len(before) + len(inner) :].split("\n)")[0].split(",\n    ")
            own = _columns(s, o)
            elements = [*own, *elements[len(own) :]]
            rest = text.split("\n)", 1)[1]
            pad = " " * o.indent
            text = before + "(\n" + ",\n".join(pad + e for e in elements) + "\n)" + rest
    elif s.kind == "SELECT":
        text = _query(s.get("select"), o)
    elif s.kind == "CREATE VIEW":
        head = text[: len(text) - len(render(s.get("select")))] if text.endswith(render(s.get("select"))) else None
        if head is not None:
            text = head.rstrip() + "\n" + _query(s.get("select"), o)
    if not o.uppercase and s.kind not in ("GRANT", "REVOKE"):  # privileges are names
        text = _lower(text)
    return text


def _lower(text: str) -> str:
    out, last = [], 0
    for t in tokens(text):
        out.append(text[last : t.at])
        out.append(t.text.lower() if t.kind == "name" and t.text in _KEYWORDS else t.text)
        last = t.at + len(t.text)
    return "".join(out)


def format_script(text: str, options: Options = Options()) -> str:
    """A script in canonical form; what it parses to does not change."""
    parts = [format_statement(s, options) + ("" if s.kind == "COMMENT" else ";") for s in parse(text)]
    return ("\n" * (options.blank_lines + 1)).join(parts) + ("\n" if parts else "")
