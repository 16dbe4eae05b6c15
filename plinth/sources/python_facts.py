"""Facts of one Python file, from its syntax tree: symbols, calls, imports, assigned names, lint events."""

from __future__ import annotations

import ast
from typing import Any

from . import lint_rules as L

Row = dict[str, Any]


def _names_in_all(tree: ast.Module) -> set[str] | None:
    """Names of ``__all__`` over plain, annotated and augmented assignments, None where there is none."""
    found: set[str] | None = None
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign | ast.AugAssign) else []
        if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and node.value is not None:
            items = node.value.elts if isinstance(node.value, ast.List | ast.Tuple | ast.Set) else []
            found = (found or set()) | {e.value for e in items if isinstance(e, ast.Constant) and isinstance(e.value, str)}
    return found


def _visibility(name: str, scope: str, listed: set[str] | None) -> str:
    """``scope`` is module, class or function; ``listed`` are the names of ``__all__`` where they decide."""
    if scope == "function":
        return "private"
    mangled = name.startswith("__") and not name.endswith("__")
    if scope == "module" and listed is not None:
        return "public" if name in listed else "private" if name.startswith("__") else "internal"
    return "private" if mangled else "internal" if name.startswith("_") else "public"


def _params(args: ast.arguments) -> list[Row]:
    def one(a: ast.arg, default: ast.expr | None = None, **flags: bool) -> Row:
        row = dict.fromkeys(("is_vararg", "is_kwarg", "is_kwonly", "is_posonly"), False)
        return {"name": a.arg, "annotation": ast.unparse(a.annotation) if a.annotation and not flags.get("is_vararg") and not flags.get("is_kwarg") else None, "default": ast.unparse(default) if default is not None else None, "has_default": default is not None, **row, **flags}

    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    out = [one(a, d, is_posonly=i < len(args.posonlyargs)) for i, (a, d) in enumerate(zip(plain, defaults, strict=True))]
    out += [one(a, d, is_kwonly=True) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    out += [one(args.vararg, is_vararg=True)] if args.vararg else []
    return out + ([one(args.kwarg, is_kwarg=True)] if args.kwarg else [])


def _signature(node: ast.FunctionDef | ast.AsyncFunctionDef, params: list[Row]) -> str:
    shown = [("*" if p["is_vararg"] else "**" if p["is_kwarg"] else "") + p["name"] + (f": {p['annotation']}" if p["annotation"] else "") + (f" = {p['default']}" if p["has_default"] else "") for p in params]
    head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    return f"{head} {node.name}({', '.join(shown)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def _calls(node: ast.AST, owner: str) -> list[Row]:
    """Every call under the node, nested functions' too, so an outer function owns inner calls as well."""
    return [
        {
            "caller": owner, "callee": ast.unparse(c.func), "args_count": len(c.args), "kwargs": [k.arg for k in c.keywords if k.arg is not None], "lineno": c.lineno,
            "has_vararg": any(isinstance(a, ast.Starred) for a in c.args), "has_kwarg": any(k.arg is None for k in c.keywords),
        }
        for c in ast.walk(node) if isinstance(c, ast.Call)
    ]


def _symbol(**given: Any) -> Row:
    base: Row = {"params": [], "min_args": 0, "max_args": None, "accepted_kwargs": [], "required_kwargs": [], "return_type": None, "is_method": False, "is_static": False, "bases": [], "docstring": None, "is_exported": True, "visibility": "public", "decorators": []}
    return base | given


def facts(source: str) -> Row:
    """Symbols, calls, imports, assigned names and the syntax error of a file; an invalid file has only the error."""
    out: Row = {"symbols": [], "calls": [], "imports": [], "assigned": [], "syntax_error": None, "lint": []}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as error:
        line, column = getattr(error, "lineno", None) or 1, getattr(error, "offset", None) or 0
        out["syntax_error"] = f"SyntaxError at line {line}:{column}: {getattr(error, 'msg', None) or error}"
        return out
    listed = _names_in_all(tree)

    def visit(body: list[ast.stmt], prefix: str, scope: str) -> None:
        for node in body:
            if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            qualname = f"{prefix}.{node.name}" if prefix else node.name
            decorators = ["@" + ast.unparse(d) for d in node.decorator_list]
            common = {"name": node.name, "qualname": qualname, "lineno": node.lineno, "end_lineno": node.end_lineno or node.lineno, "docstring": ast.get_docstring(node), "decorators": decorators}
            if isinstance(node, ast.ClassDef):
                bases = [ast.unparse(b) for b in node.bases]
                visible = _visibility(node.name, "module", listed)
                out["symbols"].append(_symbol(**common, kind="class", signature=f"class {node.name}" + (f"({', '.join(bases)})" if bases else ""), bases=bases, visibility=visible, is_exported=visible == "public"))
                out["calls"] += _calls(node, qualname)
                visit(node.body, qualname, "class")
                continue
            params = _params(node.args)
            static = any(isinstance(d, ast.Name) and d.id == "staticmethod" or isinstance(d, ast.Attribute) and d.attr == "staticmethod" for d in node.decorator_list)
            visible = _visibility(node.name, scope, listed)
            ordered = [p for p in params if not (p["is_vararg"] or p["is_kwarg"] or p["is_kwonly"])]
            out["symbols"].append(
                _symbol(
                    **common, kind="method" if scope == "class" else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function", signature=_signature(node, params), params=params,
                    min_args=sum(not p["has_default"] for p in ordered), max_args=None if node.args.vararg else len(ordered),
                    accepted_kwargs=None if node.args.kwarg else sorted(p["name"] for p in params if not (p["is_vararg"] or p["is_kwarg"] or p["is_posonly"])),
                    required_kwargs=sorted(p["name"] for p in params if p["is_kwonly"] and not p["has_default"]), return_type=ast.unparse(node.returns) if node.returns else None,
                    is_method=scope == "class" and not static, is_static=static, visibility=visible, is_exported=visible == "public",
                )
            )
            out["calls"] += _calls(node, qualname)
            visit(node.body, qualname, "function")

    visit(tree.body, "", "module")
    spans = [(s["lineno"], s["end_lineno"]) for s in out["symbols"]]
    loose = [c for c in _calls(tree, "<module>") if not any(a <= c["lineno"] <= b for a, b in spans)]
    if loose:
        out["symbols"].append(_symbol(name="<module>", qualname="<module>", kind="module", lineno=1, end_lineno=len(source.splitlines()) or 1, signature="# module", docstring=ast.get_docstring(tree)))
        out["calls"] += loose
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom):
            plain = isinstance(node, ast.Import)
            out["imports"] += [{"module": None if plain else node.module, "name": a.name, "asname": a.asname, "lineno": node.lineno, "level": 0 if plain else node.level} for a in node.names]
        elif isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            out["assigned"].append(node.id)
        elif type(node).__name__ == "TypeAlias":
            out["assigned"].append(node.name.id)
    out["assigned"] = sorted(set(out["assigned"]))
    out["lint"] = _lint(tree)
    return out


def _lint(tree: ast.Module) -> list[Row]:
    """Loop and call events with what the rules need of their surroundings."""
    found: list[Row] = []
    scoped: set[int] = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.With | ast.AsyncWith):
            for item in node.items:
                scoped.update(id(c) for c in ast.walk(item.context_expr) if isinstance(c, ast.Call))
        if isinstance(node, ast.Return | ast.Yield) and node.value is not None:
            scoped.update(id(c) for c in [node.value] if isinstance(c, ast.Call))
    handed: dict[int, bool] = {}
    for scope in [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.Module)]:
        closed, returned, opened = set(), set(), {}
        for node in ast.walk(scope):
            if isinstance(node, ast.Try):
                for c in (c for s in node.finalbody for c in ast.walk(s)):
                    if isinstance(c, ast.Call) and isinstance(c.func, ast.Attribute) and c.func.attr == "close":
                        closed.add(ast.unparse(c.func.value))
            elif isinstance(node, ast.Return) and node.value is not None:
                returned |= {n.id for n in ast.walk(node.value) if isinstance(n, ast.Name)}
            elif isinstance(node, ast.With | ast.AsyncWith):
                closed |= {ast.unparse(i.context_expr) for i in node.items}
            elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Call):
                opened[id(node.value)] = [ast.unparse(t) for t in node.targets]
        for call, names in opened.items():
            handed[call] = handed.get(call, False) or any(n in closed or n in returned for n in names)

    def event(node: ast.AST, **more: Any) -> None:
        found.append({"lineno": node.lineno, "col": node.col_offset, **more})

    def walk(node: ast.AST, loops: tuple[int, ...], asynchronous: bool, awaited: bool) -> None:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            for d in getattr(node, "decorator_list", []):
                walk(d, loops, asynchronous, False)
            inner = isinstance(node, ast.AsyncFunctionDef)
            for child in node.body if isinstance(node.body, list) else [node.body]:
                walk(child, (), inner, False)
            return
        if isinstance(node, ast.For | ast.AsyncFor | ast.While):
            deeper = (*loops, node.lineno)
            event(node, kind="loop", callee=None, depth=len(deeper), loop_lines=list(deeper), in_async=asynchronous, awaited=False, scoped=False)
            walk(node.test if isinstance(node, ast.While) else node.iter, deeper if isinstance(node, ast.While) else loops, asynchronous, False)
            for child in node.body:
                walk(child, deeper, asynchronous, False)
            for child in node.orelse:
                walk(child, loops, asynchronous, False)
            return
        if isinstance(node, ast.ListComp | ast.SetComp | ast.GeneratorExp | ast.DictComp):
            deeper = loops
            for g in node.generators:
                walk(g.iter, deeper, asynchronous, False)
                deeper = (*deeper, node.lineno)
                event(node, kind="loop", callee=None, depth=len(deeper), loop_lines=list(deeper), in_async=asynchronous, awaited=False, scoped=False)
                for c in g.ifs:
                    walk(c, deeper, asynchronous, False)
            for part in [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]:
                walk(part, deeper, asynchronous, False)
            return
        if isinstance(node, ast.Await):
            walk(node.value, loops, asynchronous, True)
            return
        if isinstance(node, ast.Call):
            event(node, kind="call", callee=ast.unparse(node.func), depth=len(loops), loop_lines=list(loops), in_async=asynchronous, awaited=awaited, scoped=id(node) in scoped or handed.get(id(node), False))
        for child in ast.iter_child_nodes(node):
            walk(child, loops, asynchronous, False)

    walk(tree, (), False, False)
    return [d for e in found for d in L.judge(e, "python")]
