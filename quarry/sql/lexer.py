"""Tokens with their line and column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quarry.errors import EngineError, ErrorCode

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*")
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<sign><>|!=|<=|>=|\|\||//|[-+*/%(),.;=<>?\[\]:])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, quoted, word, sign or end
    text: str
    line: int
    column: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokens(sql: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise EngineError(ErrorCode.SYNTAX_ERROR, f"Unexpected character {sql[at]!r}.", line=line, column=at - start + 1)
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], line, at - start + 1))
        if "\n" in m[0]:
            line += m[0].count("\n")
            start = at + m[0].rindex("\n") + 1
        at = m.end()
    return [*out, Token("end", "", line, at - start + 1)]
