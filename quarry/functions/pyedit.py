"""Changes to Python sources by their tree: imports, functions, classes, methods, docstrings.

Plain functions over one source, for use through ``pyast.per_row``.  Text that does not
parse gives null.
"""

from __future__ import annotations

import ast
import re
import textwrap

from quarry.functions.pyast import _find, _plain_body, safe_parse

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parent_lines(script: str, first: int) -> list[int]:
    """0-based lines less deep than line ``first``, from the end of the script up to the first line at the left edge."""
    rows = script.split("\n")
    depth = lambda r: len(r) - len(r.lstrip())
    own, out = depth(rows[first]), []
    for i in range(len(rows) - 1, -1, -1):
        if rows[i].strip():
            if depth(rows[i]) < own:
                out.append(i)
            if depth(rows[i]) == 0:
                break
    return out


def body_lines(code: str | None, name: str) -> tuple[int, int] | None:
    """0-based first and last line of a function's body without its docstring; null if absent or nothing else."""
    tree = safe_parse(textwrap.dedent(code)) if code is not None else None
    fn = next((f for f in tree.body if isinstance(f, _FUNCTIONS) and f.name == name), None) if tree else None
    body = _plain_body(fn) if fn else []
    return (body[0].lineno - 1, fn.end_lineno - 1) if body else None


def without_docstring(code: str | None, name: str) -> str | None:
    """The source, written anew from its tree, with the docstring of a function left out."""
    tree = safe_parse(textwrap.dedent(code)) if code is not None else None
    if tree is None:
        return None
    for _, fn in _find(tree, name):
        fn.body = _plain_body(fn) or [ast.Pass()]
    return ast.unparse(tree)


class _Renamed(ast.NodeTransformer):
    def __init__(self, names: dict[str, str]):
        self.names = names

    def visit_Name(self, node: ast.Name) -> ast.Name:
        return ast.copy_location(ast.Name(self.names.get(node.id, node.id), node.ctx), node)


def without_aliases(code: str | None, names: list[str]) -> str | None:
    """Aliases of imports of the given names are replaced by the names where they are used; the import lines stay."""
    tree = safe_parse(code)
    if tree is None:
        return None
    imports = [a for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names]
    return ast.unparse(_Renamed({a.asname: a.name for a in imports if a.asname and a.name in names and a.asname not in names}).visit(tree))


def _without(code: str | None, drop) -> str | None:
    tree = safe_parse(code)
    if tree is None:
        return None
    tree.body = [n for n in tree.body if not drop(n)]
    return ast.unparse(tree)


def without_function(code: str | None, name: str) -> str | None:
    """Without the top-level function."""
    return _without(code, lambda n: isinstance(n, _FUNCTIONS) and n.name == name)


def without_class(code: str | None, name: str) -> str | None:
    """Without the top-level class."""
    return _without(code, lambda n: isinstance(n, ast.ClassDef) and n.name == name)


def without_last(code: str | None) -> str | None:
    """Without the last top-level statement; an empty source stays empty."""
    tree = safe_parse(code)
    if tree is None:
        return None
    tree.body = tree.body[:-1]
    return ast.unparse(tree)


def without_methods(code: str | None, owner: str, names: list[str]) -> str | None:
    """Without the named methods of a class; a class that is left empty gets ``pass``."""
    tree = safe_parse(code)
    if tree is None:
        return None
    for c in tree.body:
        if isinstance(c, ast.ClassDef) and c.name == owner:
            c.body = [n for n in c.body if not (isinstance(n, _FUNCTIONS) and n.name in names)] or [ast.Pass()]
    return ast.unparse(tree)


def method_last(code: str | None, owner: str, name: str) -> str | None:
    """The method moved to the end of its class."""
    tree = safe_parse(code)
    if tree is None:
        return None
    for c in tree.body:
        if isinstance(c, ast.ClassDef) and c.name == owner:
            c.body.sort(key=lambda n: isinstance(n, _FUNCTIONS) and n.name == name)
    return ast.unparse(tree)


def definition(code: str | None, name: str) -> str | None:
    """The source of a function or class, ``Class.method`` for methods; null if absent."""
    tree = safe_parse(code)
    if tree is None:
        return None
    here: list[ast.stmt] = tree.body
    node = None
    for part in name.split("."):
        node = next((n for n in here if isinstance(n, (*_FUNCTIONS, ast.ClassDef)) and n.name == part), None)
        if node is None:
            return None
        here = node.body
    return ast.get_source_segment(code, node)


def inner_imports(code: str | None, name: str) -> list[str]:
    """Import statements inside a function's body."""
    tree = safe_parse(code)
    found = _find(tree, name) if tree is not None else []
    return [ast.unparse(n) for _, fn in found for n in ast.walk(fn) if isinstance(n, (ast.Import, ast.ImportFrom))]


def public_names(code: str | None) -> list[str]:
    """What ``from module import *`` gives: the names of ``__all__``, else all bound at the top that do not start with an underscore."""
    tree = safe_parse(code)
    if tree is None:
        return []
    bound: dict[str, None] = {}
    for n in tree.body:
        if isinstance(n, (*_FUNCTIONS, ast.ClassDef)):
            bound[n.name] = None
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            bound |= {(a.asname or a.name).split(".")[0]: None for a in n.names if a.name != "*"}
        else:
            names = [x.id for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)]
            bound |= dict.fromkeys(names)
            if "__all__" in names and isinstance(n, ast.Assign) and isinstance(n.value, (ast.List, ast.Tuple)):
                return [e.value for e in n.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return [b for b in bound if not b.startswith("_")]


def absolute_imports(code: str | None, module: str, is_package: bool = False, files: dict[str, str] | None = None) -> str | None:
    """Relative imports written out from the module's own name, stars as the names they stand for.

    A level climbs one package.  ``files`` maps module names to sources; a star import of a
    module that is not among them stays.
    """
    tree = safe_parse(code)
    if tree is None:
        return None
    package = module.split(".") if is_package else module.split(".")[:-1]
    out = []
    for n in tree.body:
        if isinstance(n, ast.ImportFrom):
            lead = package[: len(package) - n.level + 1] if n.level else []
            target = ".".join([*lead, *([n.module] if n.module else [])])
            names = n.names
            if files is not None and target in files and any(a.name == "*" for a in names):
                given = [ast.alias(x) for x in public_names(files[target])]
                names = [*[a for a in names if a.name != "*"], *given]
            if target and names:
                n = ast.ImportFrom(target, names, 0)
        out.append(n)
    tree.body = out
    return ast.unparse(tree)


def import_file(name: str, importer: str, files: set[str]) -> str | None:
    """The file of an imported module: from the root, then beside the importer, then from each folder above it."""
    here = importer.split("/")[:-1]
    rest = name.replace(".", "/")
    for folder in [[], *(here[:i] for i in range(len(here), 0, -1))]:
        for end in (".py", "/__init__.py"):
            path = "/".join([*folder, rest]) + end
            if path in files:
                return path
    return None


def missing_guard(script: str | None) -> bool:
    return not re.search(r"^if __name__ == [\"']__main__[\"']:", script or "", re.M)
