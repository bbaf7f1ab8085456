"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SqlError(ValueError):
    """A text that the dialect's grammar does not take."""


@dataclass(frozen=True)
class Token:
    """kind: name, quoted, number, string, op, comment or end."""

    kind: str
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


_SCAN = re.compile(
    r"""(?P<space>\s+)
      | (?P<comment>--[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^'\\]|\\.|'')*')
      | (?P<quoted>`(?:[^`\\]|\\.)*`|"(?:[^"\\]|\\.)*")
      | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)
      | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<op><=|>=|!=|<>|->|\|\||::|[-+*/%=<>(),.;\[\]{}])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f"}


def unquoted(text: str) -> str:
    """What a quoted string or identifier stands for."""
    mark, body = text[0], text[1:-1]
    if mark == "'":
        body = body.replace("''", "\\'")
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.DOTALL)


def tokens(sql: str) -> list[Token]:
    """All tokens but white space, comments included, an end token last."""
    out, at = [], 0
    while at < len(sql):
        m = _SCAN.match(sql, at)
        if not m:
            line = sql.count("\n", 0, at) + 1
            raise SqlError(f"line {line}: cannot read {sql[at : at + 20]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    out.append(Token("end", "", len(sql)))
    return out
