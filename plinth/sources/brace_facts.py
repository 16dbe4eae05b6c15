"""Facts of one TypeScript/JavaScript, Go or Rust file, by a small tokenizer and brace matching.

Scope: declarations, parameters, calls, imports, loops. Not read: type-level code, macros' insides, regular
expression literals beyond the common places, generated code that hides names. An unbalanced bracket is the
syntax error that is reported.
"""

from __future__ import annotations

import re
from typing import Any

from . import lint_rules as L
from .python_facts import _symbol

Row = dict[str, Any]

_TOKEN = {
    "go": r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "rust": r"//[^\n]*|/\*.*?\*/|r(?P<hash>#*)\".*?\"(?P=hash)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\\n])'",
    "typescript": r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:;!&|?{\n])\s*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*",
}
_LEX = {k: re.compile(rf"(?P<skip>{v})|(?P<name>'?[A-Za-z_$][\w$]*!?(?![\w$]))|(?P<num>\d[\w.]*)|(?P<op>=>|->|::|\.\.\.|\?\.|[^\s\w])", re.S) for k, v in _TOKEN.items()}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Words that are followed by a parenthesis and are no calls.
_NO_CALL = frozenset("if for while switch match catch return function func fn await typeof in of case go defer else select new throw yield super import require async let const var type struct interface impl pub use where loop unsafe".split())


class Tok(tuple):
    """``(kind, text, line, column, position)``"""

    kind = property(lambda s: s[0])
    text = property(lambda s: s[1])
    line = property(lambda s: s[2])
    col = property(lambda s: s[3])
    at = property(lambda s: s[4])


def tokens(source: str, language: str) -> list[Tok]:
    out, line, begin, last = [], 1, 0, 0
    for m in _LEX[language].finditer(source):
        line += source.count("\n", last, m.start())
        begin = source.rfind("\n", 0, m.start()) + 1
        last = m.start()
        kind, text = m.lastgroup or "skip", m.group()
        if m.group("skip") is not None:
            if text.lstrip()[:2] in ("//", "/*"):
                continue
            kind = "str"
        if language == "rust" and kind == "name" and text.startswith("'"):
            continue  # a lifetime
        if kind == "name" and text.endswith("!") and language != "rust":
            out.append(Tok(("name", text[:-1], line, m.start() - begin, m.start())))
            out.append(Tok(("op", "!", line, m.end() - begin, m.end() - 1)))
            continue
        if kind == "name" and text.startswith("'"):
            text = text[1:]
        out.append(Tok((kind, text, line, m.start() - begin, m.start())))
    return out


def matching(ts: list[Tok]) -> tuple[dict[int, int], str | None]:
    """The closing token of every opening one, and a message where they do not match."""
    pairs, open_ = {}, []
    for i, t in enumerate(ts):
        if t.kind == "op" and t.text in _PAIRS:
            open_.append(i)
        elif t.kind == "op" and t.text in _PAIRS.values():
            if not open_ or _PAIRS[ts[open_[-1]].text] != t.text:
                return pairs, f"SyntaxError at line {t.line}:{t.col}: unexpected '{t.text}'"
            pairs[open_.pop()] = i
    return pairs, f"SyntaxError at line {ts[open_[-1]].line}:{ts[open_[-1]].col}: '{ts[open_[-1]].text}' is never closed" if open_ else None


def split(ts: list[Tok], a: int, b: int, pairs: dict[int, int], angle: bool = True) -> list[tuple[int, int]]:
    """Ranges between top-level commas of tokens ``a`` to ``b`` (not included)."""
    out, begin, i, depth = [], a, a, 0
    while i < b:
        text = ts[i].text if ts[i].kind == "op" else ""
        if i in pairs:
            i = pairs[i]
        elif angle and text == "<":
            depth += 1
        elif angle and text == ">" and depth:
            depth -= 1
        elif text == "," and not depth:
            out.append((begin, i))
            begin = i + 1
        i += 1
    return [*out, (begin, b)] if begin < b else out


class File:
    def __init__(self, source: str, language: str):
        self.source, self.language = source, language
        self.ts = tokens(source, language)
        self.pairs, self.error = matching(self.ts)
        self.symbols: list[Row] = []
        self.spans: list[tuple[int, int, str]] = []  # body tokens and owner
        self.imports: list[Row] = []
        self.asyncs: dict[str, bool] = {}
        self.heads: set[int] = set()  # parentheses of declarations
        self.quiet: list[tuple[int, int]] = []  # bodies that declare and never call

    def text(self, a: int, b: int) -> str:
        return self.source[self.ts[a].at : self.ts[b].at + len(self.ts[b].text)] if a <= b < len(self.ts) else ""

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.ts) and self.ts[i].text in texts and self.ts[i].kind != "str"

    def find(self, i: int, text: str, stop: tuple[str, ...] = ()) -> int:
        """The next top-level token with this text, -1 where there is none before a stop."""
        while i < len(self.ts):
            if self.is_(i, text):
                return i
            if self.is_(i, *stop) or self.is_(i, ")", "]", "}"):
                return -1
            i = self.pairs.get(i, i) + 1
        return -1

    def doc(self, i: int) -> str | None:
        lines = self.source[: self.ts[i].at].split("\n")[:-1]
        held = []
        while lines and (s := lines[-1].strip()) and (s.startswith(("//", "*", "/*", "#[", "@")) or s.endswith("*/")):
            if not s.startswith(("#[", "@")):
                held.insert(0, re.sub(r"^(///?!?|/\*\*?|\*/?)\s?|\*/$", "", s).strip())
            lines.pop()
        return "\n".join(x for x in held if x) or None

    def decorators(self, i: int) -> list[str]:
        lines = self.source[: self.ts[i].at].split("\n")[:-1]
        held = []
        while lines and (s := lines[-1].strip()).startswith(("#[", "@", "//", "*", "/*")):
            held += [s] if s.startswith(("#[", "@")) else []
            lines.pop()
        return held[::-1]

    def add(self, name: str, kind: str, first: int, last: int, body: tuple[int, int] | None = None, prefix: str = "", **more: Any) -> str:
        qualname = f"{prefix}.{name}" if prefix else name
        row = _symbol(name=name, qualname=qualname, kind=kind, lineno=self.ts[first].line, end_lineno=self.ts[min(last, len(self.ts) - 1)].line, docstring=self.doc(first), decorators=self.decorators(first))
        row |= {"signature": " ".join(self.text(first, (body[0] - 1) if body and body[0] > first else min(last, first + 12)).split())} | more
        self.symbols.append(row)
        if body:
            self.spans.append((body[0], body[1], qualname))
        return qualname

    def arity(self, params: list[Row], method: bool) -> Row:
        plain = [p for p in params if not p["is_vararg"]]
        return {"params": params, "min_args": sum(not p["has_default"] for p in plain), "max_args": None if len(plain) < len(params) else len(plain), "accepted_kwargs": None if self.language == "typescript" else [], "is_method": method}

    def finish(self) -> Row:
        calls, lint = self._calls()
        owned = {id(c) for c in calls if c["caller"] != "<module>"}
        if any(id(c) not in owned for c in calls):
            self.symbols.append(_symbol(name="<module>", qualname="<module>", kind="module", lineno=1, end_lineno=len(self.source.splitlines()) or 1, signature="# module"))
        names = sorted(set(re.findall(r"(?:const|let|var|static)\s+(?:mut\s+)?([A-Za-z_$][\w$]*)", self.source)))
        return {"symbols": self.symbols, "calls": calls, "imports": self.imports, "assigned": names, "syntax_error": None, "lint": lint}

    def _calls(self) -> tuple[list[Row], list[Row]]:
        loops = self._loops()
        calls, lint = [], []
        functions = {s["qualname"] for s in self.symbols if s["kind"] in ("function", "async_function", "method")}
        for a, _, chain in loops:
            event = {"kind": "loop", "callee": None, "depth": len(chain), "loop_lines": chain, "in_async": False, "awaited": False, "scoped": False, "lineno": self.ts[a].line, "col": self.ts[a].col}
            lint += L.judge(event, self.language)
        for i, t in enumerate(self.ts):
            if t.kind != "name" or t.text in _NO_CALL or self.is_(i - 1, "function", "func", "fn"):
                continue
            bang = self.language == "rust" and t.text.endswith("!")
            if not (self.is_(i + 1, "(") or bang and self.is_(i + 1, "[")) or i + 1 not in self.pairs or i + 1 in self.heads or any(a < i < b for a, b in self.quiet):
                continue
            begin = i
            while begin >= 2 and self.is_(begin - 1, ".", "::", "?.") and (self.ts[begin - 2].kind == "name" or self.is_(begin - 2, ")", "]", ">")):
                if self.ts[begin - 2].kind != "name":
                    begin -= 1
                    break
                begin -= 2
            callee = "".join(x.text for x in self.ts[begin : i + 1]).replace("?.", ".").lstrip(".:")
            parts = split(self.ts, i + 2, self.pairs[i + 1], self.pairs, angle=False)
            spread = any(self.is_(a, "...") or self.is_(b - 1, "...") for a, b in parts)
            row = {"callee": callee.rstrip("!"), "args_count": len(parts), "kwargs": [], "lineno": t.line, "has_vararg": spread, "has_kwarg": False}
            owners = [q for a, b, q in self.spans if a < i < b]
            calls += [row | {"caller": q} for q in owners] or [row | {"caller": "<module>"}]
            inner = [(a, b, q) for a, b, q in self.spans if a < i < b and q in functions]
            nearest = max(inner, default=(-1, 0, ""))
            around = [(a, chain) for a, b, chain in loops if a < i < b and a > nearest[0]]
            chain = max(around, default=(0, []), key=lambda x: len(x[1]))[1]
            event = {
                "kind": "call", "callee": row["callee"], "depth": len(chain), "loop_lines": chain, "in_async": self.asyncs.get(nearest[2], False), "lineno": t.line, "col": self.ts[begin].col,
                "awaited": self.is_(begin - 1, "await") or self.is_(self.pairs[i + 1] + 1, ".") and self.is_(self.pairs[i + 1] + 2, "await"), "scoped": self._scoped(begin, i, nearest),
            }
            lint += L.judge(event, self.language)
        return calls, lint

    def _loops(self) -> list[tuple[int, int, list[int]]]:
        words = {"go": ("for",), "rust": ("for", "while", "loop"), "typescript": ("for", "while", "do")}[self.language]
        found = []
        for i, t in enumerate(self.ts):
            if t.kind != "name" or t.text not in words or self.is_(i - 1, ".", "impl", ">") or self.is_(i + 1, "<"):
                continue
            j = i + 1
            if self.language == "typescript":
                j += self.is_(j, "await")
                j = self.pairs.get(j, j - 1) + 1 if self.is_(j, "(") else j
            body = j if self.is_(j, "{") else self.find(j, "{", (";",) if self.language == "typescript" else ())
            if body in self.pairs:
                found.append((i, self.pairs[body]))
        if self.language == "typescript":
            for i, t in enumerate(self.ts):
                if t.text in ("forEach", "map", "flatMap", "filter") and self.is_(i - 1, ".") and self.is_(i + 1, "(") and i + 1 in self.pairs and any(self.is_(j, "=>", "function") for j in range(i + 2, min(i + 10, self.pairs[i + 1]))):
                    found.append((i, self.pairs[i + 1]))
        functions = [(a, b) for a, b, q in self.spans]
        out = []
        for a, b in found:
            home = max(((x, y) for x, y in functions if x < a < y), default=(-1, 0))
            chain = sorted(x for x, y in found if home[0] < x <= a and y >= b)
            out.append((a, b, [self.ts[x].line for x in chain]))
        return out

    def _scoped(self, begin: int, i: int, home: tuple[int, int, str]) -> bool:
        """Whether what a call opens is handed on, piped, or closed by defer or finally in the same function."""
        if self.is_(begin - 1, "return") or self.is_(begin - 2, "return"):
            return True
        after = self.pairs[i + 1] + 1
        if self.is_(after, ".") and self.is_(after + 1, "pipe", "pipeTo"):
            return True
        line = self.source.split("\n")[self.ts[begin].line - 1]
        names = [n for n in re.findall(r"([A-Za-z_$][\w$]*)", line.split("=")[0]) if n not in ("const", "let", "var", "err", "_")] if "=" in line else []
        end = min(home[1], len(self.ts) - 1) if home[0] >= 0 else len(self.ts) - 1
        body = self.text(i, end)
        if self.language == "go":
            return any(re.search(rf"\bdefer\s+(func\(\)\s*\{{[^}}]*)?{n}(\.Body)?\.Close\(|\breturn\b[^\n]*\b{n}\b", body) for n in names)
        return any(re.search(rf"finally\s*\{{[^}}]*\b{re.escape(n)}\.(close|destroy|end)\(|\b{re.escape(n)}\.pipe\(|\breturn\s+{re.escape(n)}\b", body) for n in names) if self.language == "typescript" else False


def _param(name: str, **flags: Any) -> Row:
    return {"name": name, "annotation": None, "default": None, "has_default": False, "is_vararg": False, "is_kwarg": False, "is_kwonly": False, "is_posonly": False} | flags


def _imported(module: str | None, name: str, line: int, asname: str | None = None, level: int = 0) -> Row:
    return {"module": module, "name": name, "asname": asname, "lineno": line, "level": level}


# --- Go ---------------------------------------------------------------------------------------------


def _go_params(f: File, a: int, b: int) -> list[Row]:
    groups = split(f.ts, a, b, f.pairs, angle=False)
    named = any(y - x > 1 and f.ts[x].kind == "name" and not f.is_(x + 1, ".") for x, y in groups)
    out = []
    for n, (x, y) in enumerate(groups):
        vararg = any(f.is_(j, "...") for j in range(x, y))
        kind = f.text(x + 1, y - 1) if named and y - x > 1 else f.text(x, y - 1)
        out.append(_param(f.ts[x].text if named else f"_{n}", is_vararg=vararg, annotation=kind))
    return out


def _go(f: File) -> None:
    i, ts = 0, f.ts
    while i < len(ts):
        t = ts[i]
        if t.text == "import" and t.kind == "name":
            last = f.pairs.get(i + 1, i + 2) if f.is_(i + 1, "(") else i + 2
            for j in range(i + 1, min(last + 1, len(ts))):
                if ts[j].kind == "str":
                    path = ts[j].text.strip('"`')
                    alias = ts[j - 1].text if ts[j - 1].kind == "name" and ts[j - 1].text != "import" else "." if f.is_(j - 1, ".") else None
                    f.imports.append(_imported(None, path, ts[j].line, alias))
                    if not f.is_(i + 1, "("):
                        break
            i = last + 1 if f.is_(i + 1, "(") else i + 2
            continue
        if t.text == "func" and t.kind == "name":
            j, receiver = i + 1, None
            if f.is_(j, "("):
                names = [x for x in ts[j + 1 : f.pairs[j]] if x.kind == "name"]
                receiver, j = (names[0].text, names[1].text) if len(names) > 1 else ("_", names[0].text), f.pairs[j] + 1
            name = ts[j].text
            j += 1
            if f.is_(j, "["):
                j = f.pairs[j] + 1
            if not f.is_(j, "("):
                i += 1
                continue
            f.heads.add(j)
            params = _go_params(f, j + 1, f.pairs[j])
            body = f.find(f.pairs[j] + 1, "{")
            while body > 0 and f.is_(body - 1, "interface", "struct"):
                body = f.find(f.pairs[body] + 1, "{")
            end = f.pairs.get(body, f.pairs[j])
            exported = name[:1].isupper()
            if receiver:
                params = [_param(receiver[0]), *params]
            f.add(name, "method" if receiver else "function", i, end, (body, end) if body > 0 else None, receiver[1] if receiver else "", is_exported=exported, visibility="public" if exported else "internal", **f.arity(params, bool(receiver)))
            i = end + 1
            continue
        if t.text in ("type", "const", "var") and t.kind == "name":
            ranges = []
            if f.is_(i + 1, "("):
                end, line = f.pairs[i + 1], -1
                j = i + 2
                while j < end:
                    if ts[j].line != line and ts[j].kind == "name":
                        ranges.append(j)
                    line = ts[j].line
                    j = f.pairs.get(j, j) + 1
                    line = ts[j - 1].line
            else:
                ranges, end = [i + 1], i + 1
            for j in ranges:
                name = ts[j].text
                k = j + 1
                if f.is_(k, "[") and t.text == "type":
                    k = f.pairs[k] + 1
                kind = {"const": "constant", "var": "variable"}.get(t.text) or ("struct" if f.is_(k, "struct") else "interface" if f.is_(k, "interface") else "type_alias")
                last = f.pairs.get(k + 1, k) if kind in ("struct", "interface") else k
                f.quiet.append((k, last))
                bases = []
                if kind == "struct" and last > k + 1:
                    rows: dict[int, list[Tok]] = {}
                    for x in ts[k + 2 : last]:
                        rows.setdefault(x.line, []).append(x)
                    bases = [x[-1].text for x in rows.values() if all(y.kind == "name" or y.text in "*." for y in x) and len([y for y in x if y.kind == "name"]) == (2 if any(y.text == "." for y in x) else 1)]
                exported = name[:1].isupper()
                f.add(name, kind, j if len(ranges) > 1 else i, last, None, "", bases=bases, is_exported=exported, visibility="public" if exported else "internal")
                end = max(end, last)
            i = end + 1
            continue
        i = f.pairs.get(i, i) + 1


# --- Rust -------------------------------------------------------------------------------------------


def _use(f: File, i: int, prefix: list[str], line: int) -> int:
    """Read one use tree from token ``i``; gives the token after it."""
    path = list(prefix)
    while True:
        if f.is_(i, "{"):
            end, j = f.pairs[i], i + 1
            while j < end:
                j = _use(f, j, path, line)
                j += f.is_(j, ",")
            return end + 1
        path.append(f.ts[i].text)
        if f.is_(i + 1, "::"):
            i += 2
            continue
        alias = f.ts[i + 2].text if f.is_(i + 1, "as") else None
        name = path[-1] if path[-1] != "self" or len(path) == 1 else path[-2]
        module = "::".join(path[:-1] if path[-1] != "self" else path[:-2])
        f.imports.append(_imported(module or None, name, line, alias))
        return i + (3 if alias else 1)


def _rust(f: File, a: int, b: int, prefix: str = "", bases: tuple[str, ...] = (), inside: str = "") -> None:
    i, ts = a, f.ts
    while i < b:
        t = ts[i]
        if f.is_(i, "#"):
            i = f.pairs.get(i + 1 + f.is_(i + 1, "!"), i) + 1
            continue
        first, shown = i, "private"
        if t.text == "pub":
            shown = "internal" if f.is_(i + 1, "(") else "public"
            i = f.pairs[i + 1] + 1 if f.is_(i + 1, "(") else i + 1
        asynchronous = False
        while f.is_(i, "async", "unsafe", "extern", "const", "default") and not (f.is_(i, "const") and not f.is_(i + 1, "fn", "unsafe", "async", "extern")):
            asynchronous |= f.is_(i, "async")
            i += 1 + (i + 1 < len(ts) and ts[i + 1].kind == "str")
        if i >= b:
            return
        word = ts[i].text if ts[i].kind == "name" else ""
        public = {"is_exported": shown == "public" or inside == "trait", "visibility": "public" if inside == "trait" else shown}
        if word == "fn":
            name, j = ts[i + 1].text, f.find(i + 2, "(")
            params, method = [], False
            f.heads.add(j)
            for x, y in split(ts, j + 1, f.pairs[j], f.pairs):
                names = [k for k in range(x, y) if ts[k].kind == "name" and ts[k].text not in ("mut", "ref")]
                if names and ts[names[0]].text == "self" and not f.is_(names[0] + 1, "::"):
                    method = True
                    params.append(_param("self"))
                elif names:
                    params.append(_param(ts[names[0]].text))
            body = f.find(f.pairs[j] + 1, "{", (";",))
            end = f.pairs[body] if body > 0 else max(f.find(f.pairs[j] + 1, ";"), f.pairs[j])
            made = f.add(name, "method" if prefix and inside != "mod" else "function", first, end, (body, end) if body > 0 else None, prefix, bases=list(bases), is_static=bool(prefix) and not method, **public, **f.arity(params, method))
            f.asyncs[made] = asynchronous
            i = end + 1
        elif word in ("struct", "enum", "trait", "union"):
            name = ts[i + 1].text
            body = f.find(i + 2, "{", (";",))
            end = f.pairs[body] if body > 0 else max(f.find(i + 2, ";"), i + 1)
            f.add(name, {"trait": "interface", "union": "struct"}.get(word, word), first, end, None, prefix if inside == "mod" else "", **public)
            if word == "trait" and body > 0:
                _rust(f, body + 1, end, name, (), "trait")
            i = end + 1
        elif word == "impl":
            body = f.find(i + 1, "{")
            if body < 0:
                return
            depth, names = 0, [[]]
            for k in range(i + 1, body):
                depth += f.is_(k, "<") - f.is_(k, ">")
                if not depth and f.is_(k, "for"):
                    names.append([])
                elif not depth and f.is_(k, "where"):
                    break
                elif not depth and ts[k].kind == "name":
                    names[-1].append(ts[k].text)
            target = names[-1][-1] if names[-1] else ""
            _rust(f, body + 1, f.pairs[body], f"{prefix}.{target}" if inside == "mod" and prefix else target, tuple(names[0][-1:]) if len(names) > 1 else (), "impl")
            i = f.pairs[body] + 1
        elif word == "mod":
            name = ts[i + 1].text
            if f.is_(i + 2, "{"):
                end = f.pairs[i + 2]
                f.add(name, "module", first, end, None, prefix, **public)
                _rust(f, i + 3, end, f"{prefix}.{name}" if prefix else name, (), "mod")
                i = end + 1
            else:
                f.imports.append(_imported(None, name, ts[i].line))
                i += 3
        elif word == "use":
            i = _use(f, i + 1, [], ts[i].line) + 1
        elif word in ("const", "static", "type"):
            j = i + 1 + f.is_(i + 1, "mut")
            end = max(f.find(j, ";"), j)
            f.add(ts[j].text, {"const": "constant", "static": "variable", "type": "type_alias"}[word], first, end, None, prefix, **public)
            i = end + 1
        else:
            i = f.pairs.get(i, i) + 1


# --- TypeScript and JavaScript ----------------------------------------------------------------------


def _ts_params(f: File, a: int, b: int) -> list[Row]:
    out = []
    for n, (x, y) in enumerate(split(f.ts, a, b, f.pairs)):
        while f.is_(x, "public", "private", "protected", "readonly", "@"):
            x += 1
        rest = f.is_(x, "...")
        x += rest
        name = f.ts[x].text if f.ts[x].kind == "name" else f"_{n}"
        if name == "this":
            continue
        k, default = x, f.is_(x + 1, "?")
        while k < y:
            default |= f.is_(k, "=")
            k = f.pairs.get(k, k) + 1
        out.append(_param(name, has_default=bool(default), is_vararg=rest))
    return out


def _ts_function(f: File, name: str, first: int, paren: int, prefix: str, kind: str, asynchronous: bool, static: bool = False, **more: Any) -> int:
    """Add a function whose parameters open at ``paren``; gives the token after it."""
    params = _ts_params(f, paren + 1, f.pairs[paren])
    f.heads.add(paren)
    method = kind == "method" and not static
    if method:
        params = [_param("this"), *params]
    i = f.pairs[paren] + 1
    arrow = -1
    while i < len(f.ts) and not f.is_(i, ";", ")", "]", "}", ","):
        if f.is_(i, "=>"):
            arrow = i
            i += 1
            break
        if f.is_(i, "{") and not f.is_(i - 1, ":", "|", "&", "<"):
            break
        i = f.pairs.get(i, i) + 1
    if f.is_(i, "{") and i in f.pairs:
        body, end = i, f.pairs[i]
    elif arrow > 0:
        body, end = arrow, arrow + 1
        while end + 1 < len(f.ts) and not f.is_(end, ";") and not (f.ts[end + 1].line > f.ts[f.pairs.get(end, end)].line and not f.is_(end + 1, ".", "?")) and not f.is_(end + 1, ")", "]", "}"):
            end = f.pairs.get(end, end) + 1
        end = f.pairs.get(end, end)
    else:
        body, end = -1, f.pairs[paren]
    made = f.add(name, "async_function" if asynchronous and kind == "function" else kind, first, end, (body, end + (arrow > 0 and body == arrow)) if body > 0 else None, prefix, is_static=static, **more, **f.arity(params, method))
    f.asyncs[made] = asynchronous
    if body > 0 and f.is_(body, "{"):
        _typescript(f, body + 1, end, made, "function")
    return end + 1


def _ts_class(f: File, name: str, first: int, i: int, prefix: str, **more: Any) -> int:
    body = f.find(i, "{")
    if body < 0:
        return i + 1
    bases, taking, depth = [], False, 0
    for k in range(i, body):
        depth += f.is_(k, "<") - f.is_(k, ">")
        if f.is_(k, "extends", "implements"):
            taking = True
        elif taking and not depth and f.ts[k].kind == "name":
            if f.is_(k - 1, "."):
                bases[-1] += "." + f.ts[k].text
            else:
                bases.append(f.ts[k].text)
    end = f.pairs[body]
    made = f.add(name, "class", first, end, (body, end), prefix, bases=bases, **more)
    k = body + 1
    while k < end:
        start, flags = k, set()
        while f.is_(k, "public", "private", "protected", "static", "async", "readonly", "abstract", "override", "get", "set", "*", "declare") and not f.is_(k + 1, "(", "=", ":", ";", "?"):
            flags.add(f.ts[k].text)
            k += 1
        if f.is_(k, "@"):
            k += 2
            while f.is_(k, "."):
                k += 2
            k = f.pairs[k] + 1 if f.is_(k, "(") else k
            continue
        shown = {"is_exported": not flags & {"private", "protected"} and not f.ts[k].text.startswith(("#", "_")), "visibility": "private" if "private" in flags or f.is_(k, "#") else "internal" if "protected" in flags else "public"}
        k += f.is_(k, "#")
        name_at = k
        k += 1
        if f.is_(k, "<"):
            while k < end and not f.is_(k, "("):
                k += 1
        if f.ts[name_at].kind == "name" and f.is_(k, "(") and k in f.pairs:
            k = _ts_function(f, f.ts[name_at].text, start, k, made, "method", "async" in flags, "static" in flags, **shown)
            continue
        eq = k
        while eq < end and not f.is_(eq, "=", ";") and f.ts[eq].line == f.ts[name_at].line:
            eq = f.pairs.get(eq, eq) + 1
        at = eq + 1 + f.is_(eq + 1, "async")
        if f.ts[name_at].kind == "name" and f.is_(eq, "=") and f.is_(at, "(") and at in f.pairs and f.find(f.pairs[at] + 1, "=>", (";", ",")) > 0:
            k = _ts_function(f, f.ts[name_at].text, start, at, made, "method", f.is_(eq + 1, "async"), "static" in flags, **shown)
            continue
        while k < end and not f.is_(k, ";") and f.ts[k].line == f.ts[name_at].line:
            k = f.pairs.get(k, k) + 1
        k += f.is_(k, ";")
    return end + 1


def _ts_import(f: File, i: int, exported: bool = False) -> int:
    line, names, j = f.ts[i].line, [], i + 1
    j += f.is_(j, "type")
    while j < len(f.ts) and f.ts[j].kind != "str" and not f.is_(j, ";", "="):
        if f.is_(j, "{"):
            for a, b in split(f.ts, j + 1, f.pairs[j], f.pairs, angle=False):
                a += f.is_(a, "type") and b - a > 1
                names.append((f.ts[a].text, f.ts[b - 1].text if b - a > 2 else None))
            j = f.pairs[j]
        elif f.is_(j, "*"):
            names.append(("*", f.ts[j + 2].text if f.is_(j + 1, "as") else None))
            j += 2 * f.is_(j + 1, "as")
        elif f.ts[j].kind == "name" and not f.is_(j, "from", "as"):
            names.append(("default", f.ts[j].text))
        j += 1
    if j >= len(f.ts) or f.ts[j].kind != "str":
        return -1 if exported else i + 1
    module = f.ts[j].text.strip("\"'`")
    f.imports += [_imported(module, n, line, a) for n, a in names] or [_imported(module, "*", line)]
    return j + 1


def _typescript(f: File, a: int, b: int, prefix: str = "", scope: str = "module") -> None:
    i, ts = a, f.ts
    while i < b:
        first, exported, default = i, False, False
        if f.is_(i, "import") and scope == "module" and not f.is_(i + 1, "(", "."):
            i = _ts_import(f, i)
            continue
        if f.is_(i, "export"):
            if f.is_(i + 1, "{", "*") and (after := _ts_import(f, i, True)) > 0:
                i = after
                continue
            if f.is_(i + 1, "{"):
                listed = [ts[x].text for x, _ in split(ts, i + 2, f.pairs[i + 1], f.pairs, angle=False)]
                for s in f.symbols:
                    if s["qualname"] in listed:
                        s["is_exported"], s["visibility"] = True, "public"
                i = f.pairs[i + 1] + 1
                continue
            exported, i = True, i + 1
            if f.is_(i, "default"):
                default, i = True, i + 1
        while f.is_(i, "declare", "abstract"):
            i += 1
        shown = {"is_exported": exported, "visibility": "public" if exported else "internal"}
        asynchronous = f.is_(i, "async") and f.is_(i + 1, "function")
        i += asynchronous
        if i >= b:
            return
        word = ts[i].text if ts[i].kind == "name" else ""
        if word == "function":
            j = i + 1 + f.is_(i + 1, "*")
            named = ts[j].kind == "name"
            paren = f.find(j, "(")
            if named or default:
                i = _ts_function(f, ts[j].text if named else "default", first, paren, prefix, "function", asynchronous, **shown)
            else:
                i = paren
        elif word == "class" and (ts[i + 1].kind == "name" or default):
            named = ts[i + 1].kind == "name" and not f.is_(i + 1, "extends", "implements")
            i = _ts_class(f, ts[i + 1].text if named else "default", first, i + 1 + named, prefix, **shown)
        elif word in ("interface", "enum") and ts[i + 1].kind == "name":
            body = f.find(i + 2, "{")
            f.add(ts[i + 1].text, word, first, f.pairs[body], None, prefix, **shown)
            if word == "interface":
                f.quiet.append((body, f.pairs[body]))
            i = f.pairs[body] + 1
        elif word == "type" and ts[i + 1].kind == "name" and f.find(i + 2, "=", (";",)) > 0:
            j = f.find(i + 2, "=")
            f.add(ts[i + 1].text, "type_alias", first, j, None, prefix, **shown)
            i = j + 1
        elif word in ("namespace", "module") and ts[i + 1].kind == "name" and f.find(i + 2, "{") > 0:
            body = f.find(i + 2, "{")
            _typescript(f, body + 1, f.pairs[body], f"{prefix}.{ts[i + 1].text}" if prefix else ts[i + 1].text, "namespace")
            i = f.pairs[body] + 1
        elif word in ("const", "let", "var") and ts[i + 1].kind == "name" and not f.is_(i + 1, "enum"):
            name, eq = ts[i + 1].text, i + 2
            while eq < b and not f.is_(eq, "=", ";") and (ts[eq].line == ts[i].line or f.is_(eq - 1, ":")):
                eq = f.pairs.get(eq, eq) + 1
            at = eq + 1
            lazy = f.is_(at, "async")
            at += lazy
            if f.is_(eq, "=") and f.is_(at, "(") and at in f.pairs and 0 < f.find(f.pairs[at] + 1, "=>", (";", ",")) <= f.pairs[at] + 12:
                i = _ts_function(f, name, first, at, prefix, "function", lazy, **shown)
            elif f.is_(eq, "=") and f.is_(at, "function"):
                i = _ts_function(f, name, first, f.find(at, "("), prefix, "function", lazy, **shown)
            elif f.is_(eq, "=") and f.is_(at, "require") and at + 2 < len(ts) and ts[at + 2].kind == "str":
                f.imports.append(_imported(ts[at + 2].text.strip("\"'`"), "*", ts[i].line, name))
                i = at + 4
            else:
                if scope != "function":
                    end = eq
                    while end + 1 < b and not f.is_(end, ";") and ts[f.pairs.get(end, end)].line == ts[min(f.pairs.get(end, end) + 1, len(ts) - 1)].line:
                        end = f.pairs.get(end, end) + 1
                    f.add(name, "constant" if word == "const" else "variable", first, min(f.pairs.get(end, end), b - 1), None, prefix, **shown)
                i = eq + 1
        elif word in ("module", "exports") and f.is_(i + 1, "."):
            if f.is_(i + 2, "exports") and f.is_(i + 3, "=") and f.is_(i + 4, "{"):
                listed = [ts[x].text for x, _ in split(ts, i + 5, f.pairs[i + 4], f.pairs, angle=False)]
            else:
                listed = [ts[i + 2 + 2 * f.is_(i + 2, "exports")].text]
            for s in f.symbols:
                if s["qualname"] in listed:
                    s["is_exported"], s["visibility"] = True, "public"
            i += 4
        else:
            i = f.pairs.get(i, i) + 1 if scope != "function" or not f.is_(i, "{", "(") else i + 1


def facts(source: str, language: str) -> Row:
    out: Row = {"symbols": [], "calls": [], "imports": [], "assigned": [], "syntax_error": None, "lint": []}
    f = File(source, language)
    if f.error:
        return out | {"syntax_error": f.error}
    if language == "go":
        _go(f)
    elif language == "rust":
        _rust(f, 0, len(f.ts))
    else:
        _typescript(f, 0, len(f.ts))
    return f.finish()
