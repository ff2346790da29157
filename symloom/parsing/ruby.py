"""Ruby by its line structure: what opens a block and the ``end`` that closes it."""

from __future__ import annotations

import re

from symloom.parsing.model import Import, Parsed, Symbol, compiled, real

_MASK = re.compile(r"(?ms)^=begin\b.*?^=end\b[^\n]*|#(?!\{)[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'")
_OPEN = re.compile(r"^\s*(?:(?:private|public|protected|module_function)\s+)?(def|class|module|if|unless|case|while|until|for|begin)\b|(?:=|\breturn)\s*(if|unless|case|begin)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$")
_NO_CALL = {"if", "unless", "while", "until", "and", "or", "not", "return", "yield", "super", "self", "elsif", "when", "defined?"}


def parse(source: bytes) -> Parsed:
    src = source.decode("latin-1")
    masked = _MASK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), src)
    out, stack, at = Parsed(), [], 0
    for line, text in zip(masked.split("\n"), src.split("\n")):
        start, at = at, at + len(line) + 1
        if m := compiled(r"\s*require(?:_relative)?\b\s*\(?\s*[\"']([^\"']*)").match(text):
            if not stack:
                out.imports.append(Import(real(text.strip()), real(m[1]), [real(m[1])]))
        code = line.strip()
        if compiled(r"end\b").match(code) and stack:
            k = stack.pop()
            if k is not None:
                out.symbols[k].end = start + len(line[: line.index("end")]) + 3
            continue
        opened = _OPEN.search(line)
        if not opened:
            continue
        k = None
        body = start + len(line) - len(line.lstrip())
        d = compiled(r"(?:(?:private|public|protected|module_function)\s+)?(def|class|module)\s+([\w:.?!=<>+\-*/%\[\]~^&|]+)").match(code)
        inside = [s for s in stack if s is not None]
        if d and len(stack) <= 1 and len(inside) == len(stack):
            owner = out.symbols[inside[0]] if inside else None
            kind = {"class": "class", "module": "module"}.get(d[1])
            sig = real(src[body : start + len(line)].strip())
            if d[1] == "def" and (owner is None or owner.kind == "class"):
                k = len(out.symbols)
                out.symbols.append(Symbol(real(d[2]), "method" if owner or d[2].startswith("self.") else "function", "public", sig, body, len(src), None, inside[0] if owner else None))
            elif kind and owner is None:
                k = len(out.symbols)
                out.symbols.append(Symbol(real(d[2]), kind, "public", sig, body, len(src)))
        if d and d[1] == "def" and compiled(r"\)\s*=\s*\S|def\s+[\w.?!]+\s*=\s").search(code):  # endless
            if k is not None:
                out.symbols[k].end = start + len(line.rstrip())
            continue
        if not compiled(r"\bend\s*$").search(code):
            stack.append(k)
        elif k is not None:
            out.symbols[k].end = start + len(line.rstrip())
    defined = {m.start(1) for m in re.finditer(r"\bdef\s+(?:self\.)?(\w+[?!=]?)", masked)}
    found = set()
    for m in re.finditer(r"(?:(?:[\w@]+[?!]?|\))\s*&?\.\s*)?\b([A-Za-z_]\w*[?!]?)\s*\(|[\w@)\]]+[?!]?\s*&?\.\s*([a-z_]\w*[?!]?)(?![\w(])", masked):
        name = m[1] or m[2]
        if name not in _NO_CALL and m.start(1 if m[1] else 2) not in defined:
            found.add((*m.span(1 if m[1] else 2), real(name)))
    out.references = [(n, a, b) for a, b, n in sorted(found)]
    return out
