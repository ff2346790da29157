"""TypeScript, JavaScript, Rust, Go, Java, C and C++: one masker, one splitter into items, a few patterns each.

Comments and strings are blanked, so brackets match; a body is cut into items at
semicolons, closing braces and, where the language ends statements so, lines.
Broken code never fails: what doesn't match is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from symloom.parsing.model import Import, Parsed, Symbol, compiled, first_line, head, real

_ID = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*"
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?'
_SINGLE = r"'(?:\\.|[^'\\\n])*'?"
_MASK = {
    "js": rf"{_COMMENT}|{_QUOTED}|{_SINGLE}|`(?:\\.|[^`\\])*`?",
    "rust": rf"{_COMMENT}|r(#*)\".*?\"\1|{_QUOTED}|'(?:\\[^\n]{{1,10}}?|[^'\\\n]|[\x80-\xff]{{2,4}})'",
    "go": rf"{_COMMENT}|{_QUOTED}|{_SINGLE}|`[^`]*`?",
    "java": rf"{_COMMENT}|\"\"\".*?\"\"\"|{_QUOTED}|{_SINGLE}",
    "c": rf"{_COMMENT}|R\"(\w*)\(.*?\)\1\"|{_QUOTED}|{_SINGLE}",
}
_FAMILY = {"typescript": "js", "tsx": "js", "javascript": "js", "rust": "rust", "go": "go", "java": "java", "c": "c", "cpp": "c"}
_RECEIVERS = {"self", "super", "this", "crate"}
_NO_CALL = set("if for while switch catch return function func fn match sizeof typeof new in of do else case throw await yield delete void import alignof decltype defined loop unsafe move where synchronized try with assert using template".split())

_GO = {"go", "defer", "select", "range"}
#: A call with its receivers. A name is tried at its beginning alone and never given back in part, which finds the same.
_WHOLE = r"[A-Za-z_$\x80-\xff][\w$\x80-\xff]*+"
_CALL = re.compile(rf"(?<![A-Za-z_$\x80-\xff])(?:{_WHOLE}\s*(?:\.|\?\.|::|->)\s*)*({_WHOLE})!?\s*(?:::)?(?:<[\w\s,.:&*\[\]<>]*>)?\s*\(")


def mask(src: str, family: str) -> str:
    """src with comments and strings as blanks; what stands in ${} of a JavaScript template is left."""

    def blank(m: re.Match) -> str:
        s = m[0]
        out = compiled(r"[^\n]").sub(" ", s) if "\n" in s else " " * len(s)
        if family == "js" and s[0] == "`":
            for x in re.finditer(r"\$\{([^{}`]*)\}", s):
                out = out[: x.start(1)] + x[1] + out[x.end(1) :]
        return out

    return compiled(_MASK[family], re.S).sub(blank, src)


def pairs(masked: str) -> dict[int, int]:
    """Closing places of brackets; those without one end with the text."""
    out, stack = {}, []
    close = {")": "(", "]": "[", "}": "{"}
    for m in compiled(r"[()\[\]{}]").finditer(masked):
        c = m[0]
        if c in "([{":
            stack.append((c, m.start()))
        else:
            for k in range(len(stack) - 1, max(-1, len(stack) - 40), -1):
                if stack[k][0] == close[c]:
                    for _, at in stack[k + 1 :]:
                        out[at] = m.start()
                    out[stack[k][1]] = m.start()
                    del stack[k:]
                    break
    for _, at in stack:
        out[at] = len(masked)
    return out


def _next(masked: str, lo: int, hi: int) -> str:
    """The first character that is no space; empty without one."""
    m = compiled(r"\s*").match(masked, lo, hi)
    return masked[m.end() : min(m.end() + 1, hi)]


def items(masked: str, closing: dict[int, int], lo: int, hi: int, family: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, brace): pieces of a body; brace is the place of the last block's opening, or -1."""
    lines = family in ("js", "go")
    at = lo
    while at < hi:
        while at < hi and masked[at] in " \t\r\n;,}":
            at += 1
        if at >= hi:
            return
        if masked[at] == "#" and family == "c":
            end = at
            while end < hi and masked[end] != "\n":
                end += 2 if masked[end] == "\\" else 1
            yield at, min(end, hi), -1
            at = end
            continue
        if masked[at] == "#" and family == "rust":
            end = closing.get(masked.find("[", at), at) + 1
            at = max(end, at + 1)
            continue
        start, i, brace, assigned = at, at, -1, False
        while i < hi:
            c = masked[i]
            if c in "([":
                i = closing.get(i, hi)
            elif c == "=" and masked[i + 1 : i + 2] != "=" and masked[i - 1 : i] not in "=!<>":
                assigned = True
            elif c == ";":
                break
            elif c == "{":
                brace = i
                i = min(closing.get(i, hi), hi)
                tail = family == "c" and compiled(r"(?:typedef|struct|enum|union|class)\b").match(masked, start, brace) and "(" not in masked[start:brace]
                if family == "js" and compiled(r"(?:export\s+)?(?:declare\s+)?type\b|(?:export\s+)?(?:import|export)\b\s*(?:type\s*)?\{").match(masked, start, brace + 1):
                    tail = True
                if not assigned and not tail:
                    if family == "go" and compiled(r"func\b").match(masked, start, brace) and _next(masked, i + 1, hi) == "{":
                        i += 1
                        continue
                    i += 1
                    break
            elif c == "\n" and lines:
                before = masked[start:i].rstrip()
                open_end = before[-1:] in tuple("=,+-*/&|<?:.(") or before.endswith("=>")
                goes_on = _next(masked, i, hi) in tuple(".?:=&|+*){") if family == "js" else False
                if before[:1] == "@" and re.fullmatch(rf"(?:@{_ID}(?:\.{_ID})*\s*(?:\([^)]*\))?\s*)+", before, re.S):
                    goes_on = True
                if not open_end and not goes_on:
                    break
            i += 1
        end = min(i, hi)
        if end < hi and masked[end] == ";" and family != "js":
            end += 1
        if end < hi and masked[end : end + 1] == ";":
            end += 1
        yield start, max(end, start + 1), brace
        at = max(end, start + 1)


class _Reader:
    def __init__(self, source: bytes, language: str):
        self.src, self.language, self.family = source.decode("latin-1"), language, _FAMILY[language]
        self.m = mask(self.src, self.family)
        self.closing = pairs(self.m)
        self.out = Parsed()
        self.names: set[int] = set()

    def items(self, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        return items(self.m, self.closing, lo, hi, self.family)

    def inside(self, brace: int) -> tuple[int, int]:
        return brace + 1, self.closing.get(brace, len(self.m))

    def add(self, name: str, kind: str, visibility: str, start: int, end: int, brace: int = -1, parent: int | None = None, line: bool = False) -> int:
        """A symbol; its signature ends at the body, or with the first line."""
        end = start + len(self.src[start:end].rstrip())
        sig = head(self.src[start:brace]) if brace >= 0 and not line else first_line(self.src[start:end])
        self.out.symbols.append(Symbol(real(name), kind, visibility, sig, start, end, None, parent))
        return len(self.out.symbols) - 1

    def match(self, pattern: str, start: int, end: int) -> re.Match | None:
        m = compiled(pattern, re.S).match(self.m, start, end)
        if m and "name" in m.groupdict() and m["name"]:
            self.names.add(m.start("name"))
        return m

    def references(self) -> None:
        found = set()
        for m in _CALL.finditer(self.m):
            name, at = m[1], m.start(1)
            if at in self.names or name in _NO_CALL or self.family == "go" and name in _GO or name in _RECEIVERS or self.m.startswith("!", m.end(1)):
                continue
            before = self.m[max(0, m.start() - 12) : m.start()].rstrip()
            if self.family == "js" and compiled(r"\bnew$").search(before):
                continue
            if compiled(r"\b(?:function|func|fn|class|struct|enum)\*?$").search(before):
                continue
            # The range is that of what is called: with its receivers, in Java the name alone; type arguments belong to it in Rust.
            end = m.start() + len(m[0][:-1].rstrip()) if self.family == "rust" else m.end(1)
            found.add((at if self.family == "java" else m.start(), end, real(name)))
        self.out.references = [(n, a, b) for a, b, n in sorted(found)]


def _script(r: _Reader, lo: int, hi: int) -> None:
    typed = r.language != "javascript"
    for start, end, brace in r.items(lo, hi):
        visibility = "internal"
        whole = start
        m = r.match(r"(?:@[\w$.]+\s*(?:\([^)]*\))?\s*)*(?:export\s+(?:default\s+)?)(?=\S)", start, end)
        if m:
            visibility, start = "public", m.end()
        if r.match(r"import\b(?!\s*\()", whole, end):
            text = r.src[whole:end]
            got = re.search(r"""["']([^"'\n]+)["']""", text)
            if got:
                names = re.findall(rf"(?:type\s+)?({_ID})(?:\s+as\s+{_ID})?\s*(?=[,}}]|\s+from)", text[: got.start()].replace("import", "", 1))
                r.out.imports.append(Import(real(text.rstrip(";").rstrip()), real(got[1]), [real(n) for n in names if n not in ("from", "type")]))
            continue
        if m2 := r.match(rf"(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})", start, end):
            r.add(m2["name"], "function", visibility, start, end, brace)
        elif m2 := r.match(rf"(?:@[\w$.]+\s*(?:\([^)]*\))?\s*)*(?:declare\s+)?(?:abstract\s+)?class\s+(?P<name>{_ID})", start, end):
            me = r.add(m2["name"], "class", visibility, start, end, brace)
            for a, b, inner in r.items(*r.inside(brace)) if brace >= 0 else ():
                word = r"(?:(?:public|private|protected|static|async|readonly|get|set|override|abstract|declare|accessor)\s+)*\*?\s*"
                if (x := r.match(rf"(?:@[\w$.]+\s*(?:\([^)]*\))?\s*)*{word}(?P<name>#?{_ID}|\[[^\]]*\])\s*[?!]?\s*(?:<[^(]*>)?\s*\(", a, b)) and inner >= 0:
                    r.add(x["name"], "method", "public", a, b, inner, me)
                elif typed and (x := r.match(rf"{word}(?P<name>#?{_ID})\s*[?!]?\s*(?=[:=;]|$)", a, b)):
                    k = r.add(x["name"], "const", "public", a, b, -1, me)
                    r.out.symbols[k].signature = real(r.src[a:b]).strip().rstrip(";")
        elif typed and (m2 := r.match(rf"(?:declare\s+)?interface\s+(?P<name>{_ID})", start, end)):
            r.add(m2["name"], "interface", visibility, start, end, brace)
            for a, b, _ in r.items(*r.inside(brace)) if brace >= 0 else ():
                r.match(rf"(?:(?:readonly|get|set)\s+)*(?P<name>{_ID})\s*\??\s*(?:<[^(]*>)?\s*\(", a, b)  # a member's name is no call
        elif typed and (m2 := r.match(rf"(?:declare\s+)?type\s+(?P<name>{_ID})", start, end)):
            r.add(m2["name"], "type", visibility, start, end, line=True)
        elif m2 := r.match(r"(?:declare\s+)?(const|let|var)\s+", start, end):
            at = m2.end()
            while at < end:
                x = r.match(rf"\s*(?P<name>{_ID})", at, end)
                if not x:
                    break
                r.add(x["name"], "const" if m2[1] == "const" else "function", visibility, start, end, line=True)
                at = x.end()
                while at < end and r.m[at] != ",":
                    at = r.closing.get(at, end) + 1 if r.m[at] in "([{" else at + 1
                at += 1


def _rust(r: _Reader, lo: int, hi: int, owner: str | None = None) -> None:
    lead = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
    for start, end, brace in r.items(lo, hi):
        visibility = "public" if "pub " in r.src[start:end] else "private"
        fn = rf"{lead}(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+)?fn\s+(?P<name>{_ID})"
        if m := r.match(fn, start, end):
            if owner:
                r.add(f"{owner}::{m['name']}", "method", visibility, start, end, brace)
            else:
                r.add(m["name"], "function", visibility, start, end, brace)
        elif owner:
            continue
        elif m := r.match(rf"{lead}(?:struct|enum)\s+(?P<name>{_ID})", start, end):
            r.add(m["name"], "type", visibility, start, end, brace)
        elif m := r.match(rf"{lead}(?:unsafe\s+)?trait\s+(?P<name>{_ID})", start, end):
            me = r.add(m["name"], "interface", visibility, start, end, brace)
            for a, b, inner in r.items(*r.inside(brace)) if brace >= 0 else ():
                if inner >= 0 and (x := r.match(fn, a, b)):
                    r.add(x["name"], "method", "public", a, b, inner, me)
        elif r.match(r"(?:unsafe\s+)?impl\b", start, end) and brace >= 0:
            title = re.sub(r"\s+where\b.*", "", r.m[start:brace], flags=re.S)
            title = re.sub(r"^(?:unsafe\s+)?impl\s*(?:<[^{]*?>(?=\s))?", "", title, flags=re.S)
            name = re.search(rf"({_ID})\s*(?:<.*)?$", title.split(" for ")[-1].strip(), re.S)
            _rust(r, *r.inside(brace), owner=(re.match(rf"(?:&\s*)?(?:mut\s+)?(?:{_ID}::)*({_ID})", title.split(" for ")[-1].strip()) or name or [None, "impl"])[1])
        elif m := r.match(rf"{lead}(?:const|static)\s+(?:mut\s+)?(?P<name>{_ID})\s*:", start, end):
            r.add(m["name"], "const", visibility, start, end, line=True)
        elif m := r.match(rf"{lead}type\s+(?P<name>{_ID})", start, end):
            r.add(m["name"], "type", visibility, start, end, line=True)
        elif m := r.match(rf"{lead}use\s+", start, end):
            path = real(r.src[m.end() : end]).strip().rstrip(";").strip()
            r.out.imports.append(Import(real(r.src[start:end]).strip(), path, [path]))


def _go(r: _Reader, lo: int, hi: int) -> None:
    seen = lambda name: "public" if name[:1].isupper() else "private"
    for start, end, brace in r.items(lo, hi):
        if m := r.match(rf"func\s*\(\s*(?:{_ID}\s+)?\*?\s*({_ID})[^)]*\)\s*(?P<name>{_ID})", start, end):
            r.add(f"{m[1]}.{m['name']}", "method", seen(m["name"]), start, end, brace)
        elif m := r.match(rf"func\s+(?P<name>{_ID})", start, end):
            r.add(m["name"], "function", seen(m["name"]), start, end, brace)
        elif m := r.match(r"type\b\s*(\()?", start, end):
            a = m.end()
            stop = r.closing.get(m.start(1), end) if m[1] else end
            for x, y, inner in r.items(a, stop):
                if got := r.match(rf"(?P<name>{_ID})\s*", x, y):
                    kind = "interface" if "interface" in r.m[x:y] else "type"
                    r.add(got["name"], kind, seen(got["name"]), x, y, inner)
        elif m := r.match(r"import\b", start, end):
            got = re.search(r'"([^"]*)"', r.src[start:end])
            grouped = "(" in r.m[start:end]
            r.out.imports.append(Import(real(r.src[start:end].rstrip()), real(got[1]) if got and not grouped else None, [real(got[1])] if got and not grouped else []))


def _java(r: _Reader, lo: int, hi: int) -> None:
    lead = r"(?:@[\w.]+\s*(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|abstract|sealed|strictfp|synchronized|native|default|transient|volatile)\s+)*"

    def visible(a: int, b: int) -> str:
        text = r.src[a:b]
        return "public" if "public" in text else "private" if "private" in text else "internal"

    for start, end, brace in r.items(lo, hi):
        if m := r.match(r"import\s+(?:static\s+)?([\w.*\s]+)", start, end):
            path = m[1].strip()
            r.out.imports.append(Import(real(r.src[start:end]).strip(), path, [path.rsplit(".", 1)[-1]]))
        elif m := r.match(rf"{lead}class\s+(?P<name>{_ID})", start, end):
            me = r.add(m["name"], "class", visible(start, end), start, end, brace)
            for a, b, inner in r.items(*r.inside(brace)) if brace >= 0 else ():
                if r.match(rf"{lead}(?:class|interface|enum|record|@interface)\b", a, b):
                    continue
                if x := r.match(rf"{lead}(?:<[^(]*?>\s*)?(?:[\w.$]+(?:\s*<[^(;=]*>)?(?:\s*\[\s*\])*\s+)?(?P<name>{_ID})\s*\(", a, b):
                    if "=" not in r.m[a : x.end()]:
                        r.add(x["name"], "method", visible(a, b), a, b, inner, me)
                elif re.search(r"\bstatic\b", r.m[a:b]) and re.search(r"\bfinal\b", r.m[a:b]) and (x := r.match(rf".*?(?P<name>{_ID})\s*=", a, b)):
                    r.add(x["name"], "const", visible(a, b), a, b, -1, me, line=True)
        elif m := r.match(rf"{lead}interface\s+(?P<name>{_ID})", start, end):
            r.add(m["name"], "interface", visible(start, end), start, end, brace)


def _c(r: _Reader, lo: int, hi: int) -> None:
    cpp = r.language == "cpp"
    for start, end, brace in r.items(lo, hi):
        if m := r.match(r"#\s*include\b", start, end):
            path = real(r.src[m.end() : end]).strip().strip('<>"')
            r.out.imports.append(Import(real(r.src[start:end]).strip(), path, [path]))
        elif r.m[start] == "#":
            continue
        elif cpp and (m := r.match(rf"(?:inline\s+)?namespace\s+(?P<name>{_ID}(?:::{_ID})*)", start, end)) and brace >= 0:
            r.add(m["name"], "module", "public", start, end, brace)
            _c(r, *r.inside(brace))
        elif r.match(r'extern\s+(?=\{)', start, end) and brace >= 0:
            _c(r, *r.inside(brace))
        elif m := r.match(r"typedef\b", start, end):
            words = re.findall(_ID, r.m[r.closing.get(brace, start) if brace >= 0 else start : end])
            if words:
                r.add(words[-1], "type", "public", start, end, line=True)
        elif cpp and (m := r.match(rf"(?:template\s*<[^;{{]*?>\s*)?class\s+(?:{_ID}\s*\([^)]*\)\s*)?(?P<name>{_ID})", start, end)) and brace >= 0:
            lo2, hi2 = r.inside(brace)
            me = r.add(m["name"], "class", "public", r.m.index("class", start), min(hi2 + 1, end), brace)
            r.out.symbols[me].signature = f"class {real(m['name'])}"
            clean = re.sub(r"\b(?:public|private|protected)\s*:", lambda x: " " * len(x[0]), r.m[lo2:hi2])
            r.m = r.m[:lo2] + clean + r.m[hi2:]
            for a, b, inner in r.items(lo2, hi2):
                if x := r.match(rf"[^=;{{]*?(?P<name>~?{_ID}|operator\s*[^\s(]+)\s*\(", a, b):
                    r.add(x["name"], "method", "public", a, b, inner, me)
        elif (m := r.match(rf"(?:struct|enum(?:\s+class)?|union)\s+(?P<name>{_ID})\s*(?::[^{{;]*)?(?=\{{)", start, end)) and brace >= 0:
            r.add(m["name"], "type", "public", start, min(r.inside(brace)[1] + 1, end), line=True)
        elif brace >= 0 and (m := r.match(rf"(?:template\s*<[^;{{]*?>\s*)?[^=;{{(]*?(?P<name>(?:{_ID}::)*~?{_ID})\s*\(", start, end)) and m["name"] not in _NO_CALL:
            r.names.add(m.end("name") - len(m["name"].rsplit("::", 1)[-1]))
            r.add(m["name"], "function", "public", start, end, brace)
        elif re.search(r"\bconst(?:expr)?\b", r.m[start:end]) and "(" not in r.m[start:end].split("=")[0]:
            x = re.search(rf"({_ID})\s*(?:\[[^\]]*\]\s*)*(?:=|;|$)", r.m[start:end])
            if x:
                r.add(x[1], "const", "public", start, end, line=True)


def parse(source: bytes, language: str) -> Parsed:
    r = _Reader(source, language)
    {"js": _script, "rust": _rust, "go": _go, "java": _java, "c": _c}[r.family](r, 0, len(r.m))
    r.references()
    return r.out
