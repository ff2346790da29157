"""Column builders for text: sizes, terms, LIKE in its ASCII form, path and module names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One capital with what follows it up to the next, or a capital alone.
TERM = r"\p{Lu}?[\p{L}\p{N}&&[^\p{Lu}]]+|\p{Lu}"
# Fixed values, in this order: the first that a path ends with is cut.
SOURCE_SUFFIXES = ["py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "rs", "go", "java", "c", "cpp", "cc", "cxx", "h", "hpp", "hh", "hxx", "rb"]


def token_estimate(x: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(x) / F.lit(4)).cast("long")


def terms(x: Column) -> Column:
    """Lower-case terms of two bytes and more; a capital starts a term."""
    found = F.regexp_extract_all(x, F.lit(TERM), 0)
    return F.filter(F.transform(found, F.lower), lambda t: F.octet_length(t) >= 2)


def query_terms(query: str) -> list[str]:
    """terms() of a literal, on the driver."""
    out, run = [], ""
    for c in query:
        if not c.isalnum() or c.isupper():
            out.append(run)
            run = ""
        if c.isalnum():
            run += c
    return [t.lower() for t in [*out, run] if len(t.encode()) >= 2]


def ascii_lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def _fold(s: str) -> str:
    return s.translate(str.maketrans(_UPPER, _LOWER))


def like_pattern(word: str) -> str:
    """A regular expression for a LIKE pattern in which % and _ are live."""
    return "(?s)^" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in _fold(word)) + "$"


def like(x: Column, pattern: str) -> Column:
    """LIKE that folds ASCII case only; without wildcards inside it is a plain test that pushes no regular expression."""
    inner = pattern.strip("%")
    low = ascii_lower(x)
    if not set("%_") & set(inner):
        if pattern == f"%{inner}%":
            return F.contains(low, F.lit(_fold(inner)))
        if pattern == f"{inner}%":
            return low.startswith(_fold(inner))
        if pattern == f"%{inner}":
            return low.endswith(_fold(inner))
        if pattern == inner:
            return low == _fold(inner)
    return low.rlike(like_pattern(pattern))


def module_path(x: Column) -> Column:
    """A module name as a path: dots and :: are separators."""
    inner = F.regexp_replace(F.trim(x), r"^\.+|\.+$", "")
    return F.regexp_replace(F.replace(F.replace(inner, F.lit("::"), F.lit("/")), F.lit("."), F.lit("/")), "^/+|/+$", "")


def file_stem(x: Column) -> Column:
    """A file path without its source suffix and package file."""
    path = F.replace(x, F.lit("\\"), F.lit("/"))
    cut = path
    for s in reversed(SOURCE_SUFFIXES):
        cut = F.when(path.endswith("." + s), path.substr(F.lit(1), F.length(path) - len(s) - 1)).otherwise(cut)
    return F.regexp_replace(cut, "(/__init__)+$", "")


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _inner(raw: Column, at: Column) -> Column:
    """Whether byte ``at`` (from 0) of UTF-8 continues a character; false beyond the ends."""
    byte = F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int")
    return (at >= 0) & F.coalesce((byte >= 128) & (byte < 192), F.lit(False))


def _before(raw: Column, at: Column) -> Column:
    """``at``, or the start of the character that it cuts: at most three bytes before it."""
    a, b, c = (_inner(raw, at - k) for k in range(3))
    return F.when(a & b & c, at - 3).when(a & b, at - 2).when(a, at - 1).otherwise(at)


def _after(raw: Column, at: Column) -> Column:
    """``at``, or the end of the character that it cuts."""
    a, b, c = (_inner(raw, at + k) for k in range(3))
    return F.when(a & b & c, at + 3).when(a & b, at + 2).when(a, at + 1).otherwise(at)


def byte_slice(source: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a text, clamped to it; characters that a border cuts are left out."""
    raw = F.encode(source, "UTF-8")
    first = _after(raw, start)
    return F.decode(F.substring(raw, first + 1, F.greatest(_before(raw, end) - first, F.lit(0))), "UTF-8")


def head_tail(source: Column, size: int, note: str = "\n... (truncated)\n") -> Column:
    """A text of more than ``size`` bytes as its first three quarters and its end; characters that a border cuts go with the dropped middle."""
    raw, n = F.encode(source, "UTF-8"), F.octet_length(source)
    head = size * 3 // 4
    first = F.decode(F.substring(raw, F.lit(1), _before(raw, F.lit(head))), "UTF-8")
    last = F.decode(F.substring(raw, _after(raw, n - (size - head)) + 1, n), "UTF-8")
    return F.when(n <= size, source).otherwise(F.concat(first, F.lit(note), last))


def line_number(source: Column, offset: Column) -> Column:
    """The line, from 1, of a byte offset."""
    return F.size(F.split(byte_slice(source, F.lit(0), offset), "\n"))
