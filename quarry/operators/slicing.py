"""Call graphs and dependency slices of source trees, one repository at a time.

A repository is the unit of work: its modules are parsed once into statements with the
names they bind and read; edges between statements follow names inside a file and
imports across files.  ``applyInPandas`` by repository spreads repositories over tasks.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import DataFrame

from quarry.functions.pyast import free_names, safe_parse


def _bound(node: ast.stmt) -> list[str]:
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return [node.name]
    if isinstance(node, (ast.Import, ast.ImportFrom)):
        return [(a.asname or a.name).split(".")[0] for a in node.names]
    return sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)})


def _is_main(node: ast.stmt) -> bool:
    return isinstance(node, ast.If) and "__name__" in ast.unparse(node.test) and "__main__" in ast.unparse(node.test)


def _leaves(body: list[ast.stmt], reads: tuple[str, ...] = (), binds: tuple[str, ...] = ()) -> list[tuple[ast.stmt, tuple[str, ...], tuple[str, ...]]]:
    """Top-level statements with the names that the headers above them read and bind.

    Compound statements are opened, except the main guard; an import of several names
    becomes one statement for each.
    """
    out = []
    for node in body:
        if isinstance(node, (ast.Import, ast.ImportFrom)) and len(node.names) > 1:
            for a in node.names:
                one = ast.Import([a]) if isinstance(node, ast.Import) else ast.ImportFrom(node.module, [a], node.level)
                out.append((one, reads, binds))
            continue
        parts: list[list[ast.stmt]] = []
        heads: list[ast.expr] = []
        named: list[ast.expr] = []
        if isinstance(node, (ast.If, ast.While)) and not _is_main(node):
            parts, heads = [node.body, node.orelse], [node.test]
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            parts, heads, named = [node.body, node.orelse], [node.iter], [node.target]
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            parts, heads, named = [node.body], [i.context_expr for i in node.items], [i.optional_vars for i in node.items if i.optional_vars]
        elif isinstance(node, (ast.Try, ast.TryStar)):
            parts, heads = [node.body, *(h.body for h in node.handlers), node.orelse, node.finalbody], [h.type for h in node.handlers if h.type]
        elif isinstance(node, ast.Match):
            parts, heads = [c.body for c in node.cases], [node.subject, *(c.guard for c in node.cases if c.guard)]
        if not parts:
            out.append((node, reads, binds))
            continue
        new = tuple(sorted({x for h in heads for x in free_names(ast.unparse(h))}))
        given = {n.id for t in named for n in ast.walk(t) if isinstance(n, ast.Name)} | {h.name for h in getattr(node, "handlers", []) if h.name}
        given |= {n.name for n in ast.walk(node) if isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name} if isinstance(node, ast.Match) else set()
        for part in parts:
            out += _leaves(part, (*reads, *new), (*binds, *sorted(given)))
    return out


class Module:
    """Statements of one file with their bindings and the names they read."""

    def __init__(self, name: str, code: str):
        self.name, self.code = name, code
        tree = safe_parse(code)
        leaves = _leaves(tree.body) if tree else []
        self.nodes = [n for n, _, _ in leaves]
        self.texts = [(ast.get_source_segment(code, n) if hasattr(n, "lineno") else None) or ast.unparse(n) for n in self.nodes]
        self.above = [(reads, set(binds)) for _, reads, binds in leaves]
        self.binds = [_bound(n) for n in self.nodes]
        self.late = [isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) for n in self.nodes]
        self.main = [_is_main(n) for n in self.nodes]
        self.places: dict[str, list[int]] = {}
        for i, names in enumerate(self.binds):
            for n in names:
                self.places.setdefault(n, []).append(i)

    def reads(self, i: int) -> list[str]:
        """Names that a statement and the headers above it read and do not bind."""
        above, given = self.above[i]
        return sorted({*free_names(self.texts[i]), *above} - given)

    def definition(self, name: str, before: int, late: bool) -> int | None:
        """The last binding of a name; for statements that run at once only earlier ones count."""
        at = [i for i in self.places.get(name, ()) if late or i < before]
        return at[-1] if at else None

    def import_target(self, node: ast.stmt, name: str) -> tuple[str, str | None] | None:
        """``(module, attribute)`` that an import binds under a name; relative levels climb packages."""
        if isinstance(node, ast.Import):
            for a in node.names:
                if (a.asname or a.name).split(".")[0] == name:
                    return a.name, None
        if isinstance(node, ast.ImportFrom):
            package = self.name.split(".")[: -node.level] if node.level else []
            base = ".".join([*package, *([node.module] if node.module else [])])
            for a in node.names:
                if a.name == "*":
                    return base, name
                if (a.asname or a.name) == name:
                    return base, a.name
        return None


class Repository:
    def __init__(self, files: dict[str, str]):
        self.modules = {n: Module(n, c) for n, c in files.items()}

    def needs(self, module: str, i: int) -> list[tuple[str, int]]:
        """Statements that statement ``i`` depends on directly."""
        m, out = self.modules[module], []
        for name in m.reads(i):
            j = m.definition(name, i, m.late[i])
            if j is None:
                j = next((k for k, n in enumerate(m.nodes) if isinstance(n, ast.ImportFrom) and any(a.name == "*" for a in n.names)), None)
            if j is None or j == i:
                continue
            out.append((module, j))
            target = m.import_target(m.nodes[j], name)
            if target:
                for mod, attr in ((f"{target[0]}.{target[1]}", None), target) if target[1] else (target,):
                    far = self.modules.get(mod)
                    if far is not None and attr is not None:
                        k = far.definition(attr, len(far.nodes), True)
                        if k is not None:
                            out.append((mod, k))
                            break
        return out

    def slice(self, module: str, name: str, depth: int | None = None) -> list[tuple[str, int]]:
        """All statements the named top-level definition needs, callees before callers, itself last."""
        m = self.modules.get(module)
        start = m.definition(name.split(".")[0], len(m.nodes), True) if m else None
        if start is None:
            return []
        order, seen, stack = [], {(module, start)}, [((module, start), iter(self.needs(module, start)), 0)]
        while stack:
            node, it, level = stack[-1]
            nxt = None if depth is not None and level >= depth else next((x for x in it if x not in seen), None)
            if nxt is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(nxt)
                stack.append((nxt, iter(self.needs(*nxt)), level + 1))
        return order

    def render(self, nodes: list[tuple[str, int]], last: str, cut: frozenset[str] = frozenset()) -> str:
        """One fenced block for each file in order of first need, the own file last.

        Statements stand in file order, but the target (the last node) behind all others of
        its file and a main guard behind that.  Blocks of files in ``cut`` end with a mark.
        """
        target = nodes[-1] if nodes else None
        files = [f for f in dict.fromkeys(m for m, _ in nodes) if f != last] + ([last] if any(m == last for m, _ in nodes) else [])
        blocks = []
        for f in files:
            order = sorted((i for m, i in nodes if m == f), key=lambda i: (self.modules[f].main[i], (f, i) == target, i))
            rows = [self.modules[f].texts[i] for i in order] + (["# ..."] if f in cut else [])
            blocks.append(f"```python\n## {f.replace('.', '/')}.py\n" + "\n".join(rows) + "\n```")
        return "\n".join(blocks)

    def shortened(self, nodes: list[tuple[str, int]], last: str, budget: int) -> list[tuple[str, int]]:
        """Statements that fit a budget of blank-separated tokens.

        The latest statements of the first foreign file go first, then those of the next;
        the own file is cut last.  Sizes are counted once, so this is linear.
        """
        cost = {n: len(self.modules[n[0]].texts[n[1]].split()) for n in nodes}
        total = sum(cost.values())
        files = [f for f in dict.fromkeys(m for m, _ in nodes) if f != last] + [last]
        gone = set()
        for f in files:
            for n in sorted((n for n in nodes if n[0] == f), key=lambda n: -n[1]):
                if total <= budget or n == nodes[-1]:
                    continue
                gone.add(n)
                total -= cost[n]
        return [n for n in nodes if n not in gone]

    def calls(self) -> list[tuple[str, str]]:
        """``(caller, callee)`` between definitions of the repository, by name resolution."""
        out = set()
        for name, m in self.modules.items():
            for i, node in enumerate(m.nodes):
                if m.late[i]:
                    for mod, j in self.needs(name, i):
                        if self.modules[mod].late[j]:
                            out.add((f"{name}.{m.binds[i][0]}", f"{mod}.{self.modules[mod].binds[j][0]}"))
        return sorted(out)


def call_graph(files: DataFrame) -> DataFrame:
    """``files(repo_id, module, code)`` to ``(repo_id, caller, callee)``; unparsable files add nothing."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        repo = Repository({m: c or "" for m, c in zip(pdf.module, pdf.code)})
        return pd.DataFrame([(pdf.repo_id.iloc[0], a, b) for a, b in repo.calls()], columns=["repo_id", "caller", "callee"])

    return files.groupBy("repo_id").applyInPandas(run, "repo_id string, caller string, callee string")


def contexts(files: DataFrame, targets: DataFrame, kind: str = "sliced", budget: int | None = None, depth: int | None = None) -> DataFrame:
    """Context of ``targets(repo_id, module, name)``: ``(repo_id, module, name, context)``.

    ``naive`` is the definition alone, ``full`` the whole files the slice touches, the own
    file last, ``sliced`` the needed statements.  A target that is not found has a null
    context.
    """
    if kind not in ("naive", "full", "sliced"):
        raise ValueError(kind)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        repo = Repository({m: c or "" for m, c in zip(left.module, left.code)})
        rows = []
        for module, name in zip(right.module, right.name):
            nodes = repo.slice(module, name, 0 if kind == "naive" else depth)
            if kind == "full":
                nodes = [(f, i) for f in dict.fromkeys(m for m, _ in nodes) for i in range(len(repo.modules[f].nodes))]
            cut: frozenset[str] = frozenset()
            if nodes and budget is not None:
                short = repo.shortened(nodes, module, budget)
                cut, nodes = frozenset(m for m, _ in set(nodes) - set(short)), short
            rows.append((key[0], module, name, repo.render(nodes, module, cut) if nodes else None))
        return pd.DataFrame(rows, columns=["repo_id", "module", "name", "context"])

    return files.groupBy("repo_id").cogroup(targets.groupBy("repo_id")).applyInPandas(run, "repo_id string, module string, name string, context string")
