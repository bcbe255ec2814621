"""Python source functions: each source string is parsed once, in Arrow batches."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def safe_parse(code: str | None) -> ast.Module | None:
    """The tree; tries again without BOM, with a final line end and without trailing blanks; null if all fail."""
    if code is None:
        return None
    for text in (code, code.lstrip("﻿"), code + "\n", "\n".join(x.rstrip() for x in code.splitlines())):
        try:
            return ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
    return None


def _plain_body(fn: ast.AST) -> list[ast.stmt]:
    body = list(fn.body)
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        body = body[1:]
    return body


def token_count(code: str) -> int:
    """Python tokens; 0 when the text cannot be tokenised."""
    try:
        return sum(1 for _ in tokenize.generate_tokens(io.StringIO(code).readline))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        return 0


def branches(code: str) -> int:
    tree = safe_parse(code)
    return 0 if tree is None else sum(isinstance(n, (ast.If, ast.For, ast.While, ast.Try)) for n in ast.walk(tree))


def definitions(tree: ast.Module) -> Iterator[tuple[str | None, ast.AST]]:
    """Top-level functions and methods of top-level classes, with the class name."""
    for node in tree.body:
        if isinstance(node, _DEFS):
            yield None, node
        elif isinstance(node, ast.ClassDef):
            for sub in node.body:
                if isinstance(sub, _DEFS):
                    yield node.name, sub


def function_rows(code: str | None) -> list[dict]:
    """Feature rows of all functions and methods of a source; none if it does not parse."""
    tree = safe_parse(code)
    if tree is None:
        return []
    lines = code.splitlines()
    out = []
    for owner, fn in definitions(tree):
        doc = ast.get_docstring(fn)
        returns = [s for s in fn.body if isinstance(s, ast.Return)]
        literal = [r for r in returns if r.value is None or isinstance(r.value, ast.Constant)]
        args = fn.args
        # the docstring counts as a statement here, as it does for n_statements
        texts = [ast.unparse(s) for s in fn.body[:3]]
        wrapper = len(fn.body) == 1 or (len(fn.body) == 2 and "self." in texts[1]) or (len(fn.body) == 3 and "self." in texts[1] and "return" in texts[2])
        names = {n.id.lower() for n in ast.walk(fn) if isinstance(n, ast.Name)} | {str(n.value).lower() for n in ast.walk(fn) if isinstance(n, ast.Constant)}
        src = lines[fn.lineno - 1 : fn.end_lineno]
        skip = set()
        if doc is not None:
            d = fn.body[0]
            skip = set(range(d.lineno, d.end_lineno + 1))
        n_code = sum(1 for i, x in enumerate(src, fn.lineno) if i not in skip and x.strip() and not x.strip().startswith("#"))
        out.append({
            "kind": "method" if owner else "function", "class_name": owner, "name": fn.name, "docstring": doc,
            "doc_tokens": re.findall(r"\w+", doc.lower()) if doc else None, "body_tokens": sorted(names),
            "n_args": len(args.args) + len(args.posonlyargs) + len(args.kwonlyargs) + bool(args.vararg) + bool(args.kwarg), "n_statements": len(fn.body),
            "n_returns": len(returns), "n_literal_returns": len(literal), "decorators": [ast.unparse(d) for d in fn.decorator_list], "is_wrapper": wrapper,
            "n_code_lines": n_code, "first_line": min([fn.lineno, *(d.lineno for d in fn.decorator_list)]), "last_line": fn.end_lineno, "n_branches": sum(isinstance(n, (ast.If, ast.For, ast.While, ast.Try)) for n in ast.walk(fn)),
        })
    return out


FUNCTION_ROW = (
    "kind string, class_name string, name string, docstring string, doc_tokens array<string>, body_tokens array<string>, n_args int, n_statements int, n_returns int,"
    " n_literal_returns int, decorators array<string>, is_wrapper boolean, n_code_lines int, first_line int, last_line int, n_branches int"
)


def function_table(df: DataFrame, id_col: str, code: str) -> DataFrame:
    """One row of features for each function in ``code``; sources that do not parse give none."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split()[0] for c in re.split(r",(?![^<]*>)", FUNCTION_ROW)]
        for pdf in batches:
            rows = [{id_col: i, **r} for i, c in zip(pdf[id_col], pdf[code]) for r in function_rows(c)]
            yield pd.DataFrame(rows, columns=[id_col, *names])

    return df.select(id_col, code).mapInPandas(run, f"{id_col} {kind}, {FUNCTION_ROW}")


def _find(tree: ast.Module, name: str) -> list[tuple[ast.AST | None, ast.AST]]:
    owner, _, last = name.rpartition(".")
    return [(c, f) for c, f in definitions(tree) if f.name == last and (not owner or c == owner.rsplit(".", 1)[-1])]


def function_lines(code: str | None, name: str) -> tuple[int, int] | None:
    """0-based first and last line with decorators; null if absent, defined twice or unparsable."""
    tree = safe_parse(code)
    found = _find(tree, name) if tree is not None else []
    if len(found) != 1:
        return None
    fn = found[0][1]
    return min([fn.lineno, *(d.lineno for d in fn.decorator_list)]) - 1, fn.end_lineno - 1


def function_text(code: str | None, name: str) -> str | None:
    at = function_lines(code, name)
    return None if at is None else "\n".join(code.splitlines()[at[0] : at[1] + 1])


def mask_body(code: str | None, name: str) -> str | None:
    """The source with the function's body replaced by its docstring and ``pass``."""
    tree = safe_parse(code)
    found = _find(tree, name) if tree is not None else []
    if len(found) != 1:
        return None
    fn = found[0][1]
    lines = code.splitlines()
    body = _plain_body(fn)
    if not body:
        return code
    first = min([body[0].lineno, *(d.lineno for d in getattr(body[0], "decorator_list", []))])
    indent = re.match(r"\s*", lines[first - 1]).group() if body[0].lineno != fn.lineno else " " * (fn.col_offset + 4)
    head = lines[: first - 1] if body[0].lineno != fn.lineno else [*lines[: fn.lineno - 1], lines[fn.lineno - 1][: body[0].col_offset].rstrip()]
    return "\n".join([*head, indent + "pass", *lines[fn.end_lineno :]])


def replace_function(code: str | None, name: str, new: str) -> str | None:
    """The source with the function's lines replaced, re-indented; runs of blank lines are cut to two."""
    at = function_lines(code, name)
    if at is None:
        return None
    lines = code.splitlines()
    have = re.match(r"\s*", new.splitlines()[0]).group() if new else ""
    want = re.match(r"\s*", lines[at[0]]).group()
    fresh = [want + x[len(have) :] if x.startswith(have) and x.strip() else x for x in new.splitlines()]
    text = "\n".join([*lines[: at[0]], *fresh, *lines[at[1] + 1 :]])
    return re.sub(r"\n{4,}", "\n\n\n", text)


def remove_function(code: str | None, name: str) -> str | None:
    at = function_lines(code, name)
    if at is None:
        return code
    lines = code.splitlines()
    return re.sub(r"\n{4,}", "\n\n\n", "\n".join([*lines[: at[0]], *lines[at[1] + 1 :]]))


def same_behaviour_tree(a: str | None, b: str | None) -> bool:
    """Containment without blanks, or equal trees without docstrings; any failure is false."""
    if not a or not b:
        return False
    if re.sub(r"\s+", "", b) in re.sub(r"\s+", "", a):
        return True
    ta, tb = safe_parse(_dedent(a)), safe_parse(_dedent(b))
    if ta is None or tb is None:
        return False
    fa, fb = [f for _, f in definitions(ta)], [f for _, f in definitions(tb)]
    dump = lambda fs: [[ast.dump(s) for s in _plain_body(f)] for f in fs]
    return bool(fa) and dump(fa) == dump(fb)


def _dedent(code: str) -> str:
    import textwrap

    return textwrap.dedent(code)


def free_names(code: str | None) -> list[str]:
    """Names read in a statement that it does not bind, without builtins and dunders.

    Scopes are told apart: a name that is local to a function inside may still be read
    outside it.  Names in annotations count, also in those written as text, and so do
    names that are changed in place.
    """
    import builtins
    import symtable

    tree = safe_parse(code)
    if tree is None:
        return []
    top = None
    for make in (lambda: code, lambda: ast.unparse(tree)):
        try:
            top = symtable.symtable(make(), "<statement>", "exec")
            break
        except (SyntaxError, ValueError, RecursionError):
            continue
    if top is None:
        return []
    bound = {x.get_name() for x in top.get_symbols() if x.is_assigned() or x.is_imported() or x.is_namespace()}
    used = {n.target.id for n in tree.body if isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Name)}
    used |= {x.get_name() for x in top.get_symbols() if x.is_referenced()} - bound
    tables = list(top.get_children())
    while tables:
        t = tables.pop()
        used |= {x.get_name() for x in t.get_symbols() if x.is_global() and x.is_referenced()} - bound
        tables += t.get_children()
    for n in ast.walk(tree):
        for note in (getattr(n, "annotation", None), getattr(n, "returns", None)):
            if isinstance(note, ast.Constant) and isinstance(note.value, str):
                inner = safe_parse(note.value)
                used |= {x.id for x in ast.walk(inner) if isinstance(x, ast.Name)} - bound if inner is not None else set()
    return sorted(x for x in used if not hasattr(builtins, x) and not (x.startswith("__") and x.endswith("__")) and not x.startswith("."))


def _holds_function(name: str, script: str | None, before: str | None, original: str | None, margin: int, whole: bool) -> str | None:
    """Why a script does not hold the function whole any more; null if it does."""
    if safe_parse(script) is None:
        return "does not parse"
    fn = function_text(script, name)
    if fn is None:
        return "function missing or defined twice"
    for sign in ("...", "remains unchanged"):
        if sign in (script if whole else fn) and sign not in (before or ""):
            return f"new {sign!r}"
    if token_count(_dedent(fn)) + 20 < token_count(_dedent(original or "")):
        return "function got shorter"
    if token_count(script) + margin < token_count(before or ""):
        return "script got shorter"
    return None


def _tests_function(name: str, script: str, calls) -> str | None:
    last = name.rsplit(".", 1)[-1]
    test = function_text(script, f"test_{last}")
    if test is None:
        return "no test function"
    if test.lower().count("assert") < 3:
        return "fewer than three assertions"
    if not calls(test, last):
        return "does not call the function"
    if not re.search(r"if __name__ == [\"']__main__[\"']:", script):
        return "no main guard"
    return None


def sandbox_check(name: str, original: str | None, script: str | None, before: str | None = None) -> tuple[bool, str]:
    """Whether a sandboxed script still holds the whole function: ``(ok, reason)``.

    ``before`` is the code the script was made of, the function itself by default.
    """
    reason = _holds_function(name, script, original if before is None else before, original, 50, False)
    return reason is None, reason or ""


def test_check(name: str, script: str | None, before: str | None, original: str | None = None) -> tuple[bool, str]:
    """Whether a script with a new test is complete: ``(ok, reason)``."""
    last = name.rsplit(".", 1)[-1]
    reason = _holds_function(name, script, before, original, 0, True)
    if reason is None and function_text(script, f"{name}_new_implementation") is not None:
        reason = "holds the new version"
    reason = reason or _tests_function(name, script, lambda t, f: f"{f}(" in t and f"{last}_new_implementation(" in t)
    return reason is None, reason or ""


def debug_check(name: str, script: str | None, before: str | None, original: str | None = None) -> tuple[bool, str]:
    """Whether a repaired script is complete: as ``test_check``, with a margin of 20 tokens and any mention of the function in its test."""
    reason = _holds_function(name, script, before, original, 20, True)
    reason = reason or _tests_function(name, script, lambda t, f: f in t.replace(f"test_{f}", ""))
    return reason is None, reason or ""


def per_row(fn: Callable, returns: str, *cols: str | Column) -> Column:
    """A Python function over columns in Arrow batches; nulls reach the function as None."""
    @F.pandas_udf(returns)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([fn(*(None if x is pd.NA or x is None or (isinstance(x, float) and x != x) else x for x in row)) for row in zip(*series)], dtype=object)

    return run(*[F.col(c) if isinstance(c, str) else c for c in cols])
