"""Function records of Python sources."""

from __future__ import annotations

import ast
from collections.abc import Iterator

Row = tuple[str, str, int, str, str, str, str, int]


def _param(arg: ast.arg, default: ast.expr | None, stars: str = "") -> str:
    hint = f": {ast.unparse(arg.annotation)}" if arg.annotation else ""
    value = "" if default is None else f" = {ast.unparse(default)}" if hint else f"={ast.unparse(default)}"
    return stars + arg.arg + hint + value


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """The parameters as written, with markers, and the return annotation."""
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    out = [_param(x, d) for x, d in zip(plain, defaults, strict=True)]
    if a.posonlyargs:
        out.insert(len(a.posonlyargs), "/")
    if a.vararg:
        out.append(_param(a.vararg, None, "*"))
    elif a.kwonlyargs:
        out.append("*")
    out += [_param(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    if a.kwarg:
        out.append(_param(a.kwarg, None, "**"))
    return f"({', '.join(out)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def summary(node: ast.AST) -> str:
    """The first line of the docstring that isn't blank."""
    return next((line.strip() for line in (ast.get_docstring(node) or "").splitlines() if line.strip()), "")


def _walk(node: ast.AST, path: tuple[str, ...]) -> Iterator[tuple[ast.AST, tuple[str, ...]]]:
    for child in ast.iter_child_nodes(node):
        named = isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)
        inner = (*path, child.name) if named else path
        if named and not isinstance(child, ast.ClassDef):
            yield child, inner
        yield from _walk(child, inner)


def parse(source: str, path: str) -> list[Row]:
    """Every function of a file, methods and nested ones too, in order; none where it doesn't parse or nests too deep."""
    try:
        return [(n.name, path, n.lineno, signature(n), summary(n), "python", ".".join(q), k) for k, (n, q) in enumerate(_walk(ast.parse(source), ()))]
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
