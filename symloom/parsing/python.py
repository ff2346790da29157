"""Python by the standard ast module; files it refuses are scanned by indentation."""

from __future__ import annotations

import ast
import re

from symloom.parsing.model import Import, Parsed, Symbol, compiled, first_line, head, real

_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)
_RECEIVERS = {"self", "super", "this", "crate"}


def _visible(name: str) -> str:
    return "private" if name.startswith("_") else "public"


def parse(source: bytes) -> Parsed:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _scan(source)
    src = source.decode("latin-1")
    starts = [0]
    for line in (src if "\r" not in src else re.sub("\r\n?", lambda m: "\n" * len(m[0]) if len(m[0]) == 1 else " \n", src)).split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    bom = 3 if src.startswith("\xef\xbb\xbf") else 0

    def begin(n: ast.AST) -> int:
        return starts[n.lineno - 1] + n.col_offset + (bom if n.lineno == 1 else 0)

    def end(n: ast.AST) -> int:
        return starts[n.end_lineno - 1] + n.end_col_offset + (bom if n.end_lineno == 1 else 0)

    out = Parsed()

    def define(n: ast.AST, kind: str, parent: int | None) -> None:
        body = min(begin(b) if not getattr(b, "decorator_list", None) else begin(b.decorator_list[0]) - 1 for b in n.body)
        doc = n.body[0]
        text = None
        if isinstance(doc, ast.Expr) and isinstance(doc.value, ast.Constant) and isinstance(doc.value.value, str):
            text = (real(src[begin(doc) : end(doc)]).strip("\"'").strip().split("\n") or [""])[0].rstrip("\r")
        out.symbols.append(Symbol(n.name, kind, _visible(n.name), head(src[begin(n) : body]), begin(n), end(n), text, parent))

    for n in tree.body:
        if isinstance(n, _FUNCTION):
            define(n, "function", None)
        elif isinstance(n, ast.ClassDef):
            me = len(out.symbols)
            define(n, "class", None)
            for m in n.body:
                if isinstance(m, _FUNCTION):
                    define(m, "method", me)
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            target = n.targets[0] if isinstance(n, ast.Assign) else n.target
            if isinstance(target, ast.Name) and compiled("[A-Z_]+").fullmatch(target.id):
                out.symbols.append(Symbol(target.id, "const", _visible(target.id), first_line(src[begin(n) : end(n)]), begin(n), end(n)))
        elif isinstance(n, ast.Import):
            names = [a.name for a in n.names]
            out.imports.append(Import(real(src[begin(n) : end(n)]), names[0], names))
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            names = ([module] if not n.level else []) + [a.name for a in n.names if a.name != "*"]
            out.imports.append(Import(real(src[begin(n) : end(n)]), module, names))
    calls = set()
    left = [tree]
    while left:
        n = left.pop()
        if isinstance(n, ast.Call):
            f = n.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            if name and name not in _RECEIVERS:
                calls.add((begin(f), end(f), name))
        for x in vars(n).values():
            if type(x) is list:
                left += [y for y in x if isinstance(y, ast.AST)]
            elif isinstance(x, ast.AST) and not isinstance(x, ast.expr_context):
                left.append(x)
    out.references = [(name, a, b) for a, b, name in sorted(calls)]
    return out


_DEF = re.compile(r"(?m)^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)[^\n]*")


def _scan(source: bytes) -> Parsed:
    """Definitions by indentation, calls and imports by pattern."""
    src, out = source.decode("latin-1"), Parsed()
    found = list(_DEF.finditer(src))
    owner: tuple[int, int] | None = None
    for m in found:
        depth = len(m[1].expandtabs())
        stop = re.compile(rf"(?m)^[ \t]{{0,{len(m[1])}}}(?=[^ \t\r\n#)\]}}])").search(src, m.end())
        end = len(src[: stop.start() if stop else len(src)].rstrip())
        sig = head(m[0].strip().rstrip(":")) + (":" if m[0].rstrip().endswith(":") else "")
        if depth == 0:
            owner = (len(out.symbols), end) if m[2] == "class" else None
            out.symbols.append(Symbol(m[3], "class" if m[2] == "class" else "function", _visible(m[3]), sig, m.start(), end))
        elif m[2] == "def" and owner and m.start() < owner[1]:
            out.symbols.append(Symbol(m[3], "method", _visible(m[3]), sig, m.start() + len(m[1]), end, None, owner[0]))
    for m in re.finditer(r"(?m)^(?:from[ \t]+([\w.]+)[ \t]+)?import[ \t]+([^\n#]+)", src):
        names = [x.split(" as ")[0].strip(" ()") for x in m[2].split(",")]
        out.imports.append(Import(real(m[0].rstrip()), m[1] or names[0], ([m[1]] if m[1] and m[1][0] != "." else []) + names))
    named = {m.start(3) for m in found}
    for m in re.finditer(r"\b(\w+)[ \t]*\(", src):
        if m.start() not in named and m[1] not in _RECEIVERS and m[1] not in {"if", "elif", "while", "for", "return", "and", "or", "not", "in", "lambda"}:
            out.references.append((m[1], m.start(), m.end(1)))
    return out
