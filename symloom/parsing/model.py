"""What a parser returns, and text helpers. Offsets are UTF-8 bytes: sources are handled as Latin-1 text of their bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cache


@dataclass
class Symbol:
    name: str
    kind: str
    visibility: str
    signature: str
    start: int
    end: int
    docstring: str | None = None
    parent: int | None = None


@dataclass
class Import:
    raw_text: str
    module: str | None
    names: list[str] = field(default_factory=list)


@dataclass
class Parsed:
    """symbols in pre-order (parent: a place in the list), imports in order, references (name, start, end)."""

    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    references: list[tuple[str, int, int]] = field(default_factory=list)


#: A compiled pattern; re.compile() looks its own cache up by flags, which takes longer than most matches.
compiled = cache(re.compile)


def real(s: str) -> str:
    """Latin-1 text of bytes as the text it is."""
    return s if s.isascii() else s.encode("latin-1").decode("utf-8", "replace")


def head(s: str) -> str:
    """A signature: all before the body, without its brace."""
    return real(s).rstrip().rstrip("{").rstrip()


def first_line(s: str) -> str:
    return real(s).split("\n", 1)[0].rstrip("\r")
