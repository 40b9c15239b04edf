"""Text to tokens.  Words keep their spelling; keywords are told by the parser, in any case."""

from __future__ import annotations

import re

from ..errors import SyntaxFailure
from .ast import Token

_PATTERN = re.compile(
    r"""
    (?P<space>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<float>\d+\.\d*|\.\d+)
  | (?P<int>\d+)
  | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
  | (?P<str>'[^']*')
  | (?P<param>\$\d+)
  | (?P<op><>|!=|<=|>=|\+=|-=|[=<>+\-*/(),;.])
    """,
    re.X | re.S,
)
_PATH = re.compile(r"(?:\.{0,2}/)[^\s;]*")


def tokens(text: str) -> list[Token]:
    """All tokens of a statement and an end token.

    After LOAD, something that begins with /, ./ or ../ is one path.
    """
    out: list[Token] = []
    at = 0
    while at < len(text):
        if out and out[-1].kind == "word" and out[-1].text.upper() == "LOAD" and (m := _PATH.match(text, at)):
            out.append(Token("path", m[0], at))
            at = m.end()
            continue
        m = _PATTERN.match(text, at)
        if not m:
            raise SyntaxFailure(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup == "str":
            out.append(Token("str", m[0][1:-1], at))
        elif m.lastgroup == "op":
            out.append(Token("op", "<>" if m[0] == "!=" else m[0], at))
        elif m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    out.append(Token("end", "", at))
    return out
