"""Places in Python files: definitions, imports, calls, assignments, URL lists and returned dicts, each where it stands."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A position is line * 2**20 + column; a module's own scope ends after all of them.
COLUMNS, LAST = 1 << 20, 1 << 62
#: Operations on a manager that read or write rows, calls that declare a URL.
QUERIES = ("all", "filter", "get", "create", "update", "delete", "aggregate")
ROUTES = ("path", "re_path", "url")
#: A frame goes to Spark as soon as it has so many rows.
FRAME = 10_000
COOKIE = re.compile(r"coding[:=]")

PLACES = "path string, kind string, name string, value string, inside string, at long, start long, end long, line int, end_line int, rank int, place array<int>, detail map<string,string>"
_NAMES = [c.split()[0] for c in PLACES.replace("map<string,string>", "map").split(", ")]


def parsed(text: str) -> ast.Module | None:
    """The module, if need be without a coding cookie that contradicts the text; None if it is no Python."""
    for source in (text, None):
        if source is None:
            lines = text.splitlines(keepends=True)
            source = "".join([COOKIE.sub("coding removed ", line) for line in lines[:2]] + lines[2:])
        try:
            return ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
    return None


def dotted(node: ast.AST | None) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def literal(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _first(node: ast.AST) -> int:
    above = [d.lineno for d in getattr(node, "decorator_list", [])]
    return min([node.lineno, *above]) * COLUMNS + node.col_offset


def _end(node: ast.AST) -> int:
    return node.end_lineno * COLUMNS + node.end_col_offset


def _bound(node: ast.AST) -> list[str]:
    """Names that a statement or expression binds itself, without those of statements inside."""
    names = lambda x: [n.id for n in ast.walk(x) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store | ast.Del)]
    match node:
        case ast.Assign(targets=targets) | ast.Delete(targets=targets):
            return [n for t in targets for n in names(t)]
        case ast.AnnAssign(target=t) | ast.AugAssign(target=t) | ast.NamedExpr(target=t) | ast.For(target=t) | ast.AsyncFor(target=t):
            return [] if isinstance(node, ast.AnnAssign) and node.value is None else names(t)
        case ast.With(items=items) | ast.AsyncWith(items=items):
            return [n for i in items if i.optional_vars for n in names(i.optional_vars)]
        case ast.Import(names=found) | ast.ImportFrom(names=found):
            return [a.asname or a.name.split(".")[0] for a in found]
        case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
            return [name]
        case ast.ExceptHandler(name=name) | ast.MatchAs(name=name) | ast.MatchStar(name=name):
            return [name] if name else []
    return []


def _model(call: ast.Call) -> str | None:
    """X of X.objects.filter().get() and the like."""
    value = call.func.value
    while isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and value.func.attr in QUERIES:
        value = value.func.value
    return dotted(value.value) if isinstance(value, ast.Attribute) and value.attr == "objects" else None


def _listed(node: ast.AST | None, place: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], ast.Call | str]]:
    """(place, a call or another list's name) of a list value: literals, lists in lists, sums and starred names."""
    match node:
        case ast.List(elts=elts) | ast.Tuple(elts=elts):
            for k, item in enumerate(elts):
                if isinstance(item, ast.Call):
                    yield (*place, k), item
                else:
                    yield from _listed(item.value if isinstance(item, ast.Starred) else item, (*place, k))
        case ast.BinOp(left=left, op=ast.Add(), right=right):
            yield from _listed(left, (*place, 0))
            yield from _listed(right, (*place, 1))
        case ast.Attribute(attr="urls", value=ast.Name()):
            yield place, node
        case ast.Name() | ast.Attribute():
            yield place, dotted(node)


def _included(view: ast.AST | None) -> dict[str, str | None]:
    """What include() names: a module as text, a name, or a router."""
    if not isinstance(view, ast.Call) or dotted(view.func) != "include" or not view.args:
        return {}
    to = view.args[0].elts[0] if isinstance(view.args[0], ast.Tuple | ast.List) and view.args[0].elts else view.args[0]
    if isinstance(to, ast.Attribute) and to.attr == "urls" and isinstance(to.value, ast.Name):
        return {"router": to.value.id, "include": f"{to.value.id}.urls"}
    return {"module": literal(to)} if literal(to) else {"include": dotted(to)} if dotted(to) else {"unknown": "1"}


def places(path: str, text: str) -> Iterator[tuple]:
    tree = parsed(text)
    if tree is None:
        yield path, "unsupported_syntax", *[None] * 11
        return
    ranks = {id(n): k for k, n in enumerate(ast.walk(tree))}

    def row(kind: str, node: ast.AST, name: str | None, value: str | None = None, inside: str = "", start: int | None = None, end: int | None = None, at: int | None = None, place=None, **detail) -> tuple:
        return path, kind, name, value, inside, _first(node) if at is None else at, start, end, node.lineno, node.end_lineno, ranks.get(id(node), 0), place, {k: v for k, v in detail.items() if v is not None} or None

    said: dict[str, int] = {}  # entries of each list so far

    def url_rows(statement: ast.stmt, nth: int) -> Iterator[tuple]:
        value, names = getattr(statement, "value", None), _bound(statement)
        sums = isinstance(statement, ast.AugAssign) and isinstance(statement.op, ast.Add)
        if not names or not (sums or isinstance(statement, ast.Assign | ast.AnnAssign)):
            return
        for name in names:
            for place, item in _listed(value, ()):
                order, index = [nth, *place], [said.get(name, 0), *place] if sums else place
                said[name] = said.get(name, 0) + 1
                at = {"place": order, "index": ".".join(map(str, index))}
                if isinstance(item, ast.Call):
                    if dotted(item.func) in ROUTES:
                        view = item.args[1] if len(item.args) > 1 else next((x.value for x in item.keywords if x.arg == "view"), None)
                        shown = view.func.value if isinstance(view, ast.Call) and isinstance(view.func, ast.Attribute) and view.func.attr == "as_view" else view
                        yield row("url", item, name, literal(item.args[0]) if item.args else None, **at, view=dotted(shown), **_included(view))
                elif isinstance(item, ast.Attribute):
                    yield row("url", item, name, "", **at, router=item.value.id, include=dotted(item))
                elif item != name:
                    yield row("extend", statement, name, item, **at)

    todo: list[tuple[ast.AST, str, tuple[int, int], frozenset[str]]] = []
    own = -1, LAST
    for nth, statement in enumerate(tree.body):
        yield from url_rows(statement, nth)
    todo.extend((n, "", own, frozenset()) for n in reversed(tree.body))
    while todo:
        node, inside, block, outer = todo.pop()
        scope = inside
        for name in _bound(node):
            value = literal(node.value) if isinstance(node, ast.Assign | ast.AnnAssign) and not any(isinstance(t, ast.Tuple | ast.List) for t in getattr(node, "targets", [])) else None
            imported = isinstance(node, ast.Import | ast.ImportFrom)
            # a loop's target and a definition count from their start on, an assignment after its value
            late = _end(node) if isinstance(node, ast.Assign | ast.AnnAssign | ast.AugAssign | ast.NamedExpr) else _first(node) if hasattr(node, "lineno") else block[0]
            if hasattr(node, "lineno") and not imported:
                yield row("assign", node, name, value, inside, *block, after=str(late), outer="1" if name in outer else None)
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                scope = f"{inside}.{node.name}".lstrip(".")
                bases = ",".join(filter(None, map(dotted, node.bases))) if isinstance(node, ast.ClassDef) else None
                yield row("class" if isinstance(node, ast.ClassDef) else "function", node, scope, bases, inside, _first(node), _end(node))
                outer = frozenset(n for s in node.body if isinstance(s, ast.Global) for n in s.names)
                block = _first(node), _end(node)
                if not isinstance(node, ast.ClassDef):
                    a = node.args
                    for arg in filter(None, [*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg]):
                        yield row("assign", node, arg.arg, None, scope, *block, at=_first(node), after=str(_first(node)))
            case ast.Import():
                for a in node.names:
                    yield row("import", node, a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], inside, *block)
            case ast.ImportFrom():
                for a in node.names:
                    yield row("import", node, a.asname or a.name, ".".join(filter(None, [node.module, a.name])), inside, *block, level=str(node.level))
            case ast.Call():
                op = node.func.attr if isinstance(node.func, ast.Attribute) and node.func.attr in QUERIES else None
                yield row("call", node, dotted(node.func), _model(node) if op else None, inside, operation=op)
            case ast.Return(value=ast.Dict() as held):
                fields = {literal(k): v for k, v in zip(held.keys, held.values, strict=True) if literal(k) is not None}
                if "url" in fields:
                    known = isinstance(fields["url"], ast.Name) or literal(fields["url"]) is not None
                    name = fields["url"].id if isinstance(fields["url"], ast.Name) else None
                    yield row("boundary", node, name, literal(fields["url"]), inside, known=str(int(known)), method=literal(fields.get("method")) or "GET")
            case ast.For() | ast.AsyncFor() | ast.While():
                # what a later turn may have set is not known at the loop's start
                for name in {n for x in ast.walk(node) for n in _bound(x)}:
                    yield row("assign", node, name, None, inside, *block, after=str(_first(node)))
        if isinstance(node, ast.ClassDef):
            for s in node.body:
                value = getattr(s, "value", None)
                if isinstance(s, ast.Assign | ast.AnnAssign) and "queryset" in _bound(s) and isinstance(value, ast.Call) and isinstance(value.func, ast.Attribute) and _model(value):
                    yield row("queryset", s, scope, _model(value), scope)
        suites = [(_first(s[0]), _end(s[-1]), s) for f in ("body", "orelse", "finalbody") if isinstance(s := getattr(node, f, None), list) and s and isinstance(s[0], ast.stmt)]
        inner = {id(child): ((start, end) if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else block) for start, end, s in suites for child in s}
        todo.extend((child, scope, inner.get(id(child), block), outer) for child in reversed(list(ast.iter_child_nodes(node))))


def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The places of batches of (path, text), many files in a frame: one for each file costs far more than to parse it."""
    for batch in batches:
        out: list[tuple] = []
        for path, text in zip(batch["path"], batch["text"], strict=True):
            if text is not None:
                out.extend(places(path, text))
            if len(out) >= FRAME:
                yield pd.DataFrame(out, columns=_NAMES, dtype=object)
                out = []
        yield pd.DataFrame(out, columns=_NAMES, dtype=object)


def python_places(files: DataFrame) -> DataFrame:
    """(path, text) to ``PLACES``; a file that cannot be parsed gives one ``unsupported_syntax`` row, a null text none.

    ``at`` is where something stands, ``start`` and ``end`` are a definition's extent or the
    block of statements around an import or assignment. ``inside`` is the definition around it.
    Kinds: function, class (value: bases), import (value: full name; detail: level), call (value:
    the model of a query; detail: operation), assign (value: literal text; detail: after, where it
    takes effect), url and extend (entries of a module's lists; value: route or other list; place:
    order), boundary (a returned dict with a url) and queryset.
    """
    return files.select("path", "text").mapInPandas(frames, PLACES)
