"""Call graphs as edge tables: closure, merging, types, order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.sized import look_up
from quarry.workspace import Workspace


def edges(graphs: DataFrame) -> DataFrame:
    """``(repo_id, caller, callee)``, distinct, of graphs as maps; self calls are kept."""
    flat = graphs.select("repo_id", F.explode("graph").alias("caller", "callees"))
    return flat.select("repo_id", "caller", F.explode("callees").alias("callee")).distinct()


def nodes(graphs: DataFrame) -> DataFrame:
    """``(repo_id, id, type)`` of every caller and callee; ids without a type get OTHER."""
    typed = graphs.select("repo_id", F.explode("id2type").alias("id", "type"))
    flat = graphs.select("repo_id", F.explode("graph").alias("caller", "callees"))
    every = flat.select("repo_id", F.explode(F.concat(F.array("caller"), F.coalesce("callees", F.array().cast("array<string>")))).alias("id")).distinct()
    return every.join(typed.groupBy("repo_id", "id").agg(F.min("type").alias("type")), ["repo_id", "id"], "left").withColumn("type", F.coalesce("type", F.lit("OTHER")))


#: Edges of a repository up to which it is searched in one task.
SMALL_GRAPH = 200_000


def closure(edge: DataFrame, ws: Workspace, depth: int | None = None, small: int = SMALL_GRAPH) -> DataFrame:
    """All ``(repo_id, root, id, hops)`` reachable from every caller, with the fewest hops; no row has root = id.

    Graphs of up to ``small`` edges are searched breadth first, each in one task.  Larger
    ones are joined with themselves: a round takes the pairs found last one edge further
    and drops those known, and is written, so lineage stays short.
    """
    step = ws.save(edge.where("caller <> callee").select("repo_id", "caller", "callee").distinct(), "steps")
    sizes = ws.save(step.groupBy("repo_id").agg(F.count("*").alias("n")), "sizes")
    few, many = (look_up(step, sizes.where(c), ["repo_id"]).drop("n") for c in (F.col("n") <= small, F.col("n") > small))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[str]] = {}
        for a, b in zip(pdf.caller, pdf.callee):
            out.setdefault(a, []).append(b)
        rows = []
        for root in out:
            seen, front, hop = {root}, [root], 0
            while front and (depth is None or hop < depth):
                hop += 1
                front = list(dict.fromkeys(y for x in front for y in out.get(x, ()) if y not in seen))
                seen.update(front)
                rows += [(root, x, hop) for x in front]
        found = pd.DataFrame(rows, columns=["root", "id", "hops"])
        found.insert(0, "repo_id", pdf.repo_id.iloc[0])
        return found

    known = few.groupBy("repo_id").applyInPandas(search, "repo_id string, root string, id string, hops int")
    if sizes.where(F.col("n") > small).isEmpty():
        return known
    many = ws.save(many, "many")
    front = ws.save(many.select("repo_id", F.col("caller").alias("root"), F.col("callee").alias("id"), F.lit(1).alias("hops")), "front1")
    far_known, hop = front, 1
    while (depth is None or hop < depth) and not front.isEmpty():
        hop += 1
        far = front.join(many, (front.repo_id == many.repo_id) & (front.id == many.caller)).select(front.repo_id, "root", F.col("callee").alias("id")).distinct()
        fresh = far.where("root <> id").join(far_known.select("repo_id", "root", "id"), ["repo_id", "root", "id"], "left_anti").withColumn("hops", F.lit(hop))
        front = ws.save(fresh.select("repo_id", "root", "id", "hops"), f"front{hop}")
        far_known = far_known.unionByName(front)
    return known.unionByName(far_known)


def merged_callees(edge: DataFrame, groups: DataFrame) -> DataFrame:
    """Union of the callees of a group's members: ``groups(repo_id, group_id, caller)``."""
    return groups.join(edge, ["repo_id", "caller"]).groupBy("repo_id", "group_id").agg(F.array_sort(F.collect_set("callee")).alias("callees"))


def callee_counts(edge: DataFrame) -> DataFrame:
    return edge.groupBy("repo_id", F.col("caller").alias("function_id")).agg(F.count("*").alias("n_callees"))


def drop_unresolved(edge: DataFrame, known: DataFrame) -> DataFrame:
    """Edges whose caller is a known id."""
    return edge.join(known.select("repo_id", F.col("id").alias("caller")).distinct(), ["repo_id", "caller"], "left_semi")


def id_type(node: DataFrame, functions: DataFrame, methods: DataFrame, classes: DataFrame, modules: DataFrame) -> DataFrame:
    """Types of ids by look-up: BUILTIN by prefix, then FUNCTION, CLASS, METHOD, API (a known module), OTHER."""
    out = node
    for name, table in (("function", functions), ("class", classes), ("method", methods)):
        out = out.join(table.select("repo_id", "id").distinct().withColumn(f"_{name}", F.lit(True)), ["repo_id", "id"], "left")
    out = out.withColumn("_module", F.substring_index("id", ".", 1)).join(modules.select(F.col("module").alias("_module"), F.lit(True).alias("_api")).distinct(), "_module", "left")
    kind = F.when(F.col("id").startswith("<builtin>"), "BUILTIN").when(F.col("_function"), "FUNCTION").when(F.col("_class"), "CLASS").when(F.col("_method"), "METHOD").when(F.col("_api"), "API").otherwise("OTHER")
    return out.withColumn("type", kind).select(*[c for c in node.columns if c != "type"], "type")


def topological_order(edge: DataFrame) -> DataFrame:
    """``(repo_id, id, place)``: callees before callers, by depth-first post-order from the smallest ids.

    One repository is one group: a graph of one code base, bounded by its source.
    Cycles are cut at the edge that closes them.
    """
    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        out_edges: dict[str, list[str]] = {}
        for a, b in zip(pdf.caller, pdf.callee):
            out_edges.setdefault(a, []).append(b)
            out_edges.setdefault(b, [])
        seen, done = set(), []
        for root in sorted(out_edges):
            if root in seen:
                continue
            seen.add(root)
            stack = [(root, iter(sorted(out_edges[root])))]
            while stack:
                node, it = stack[-1]
                nxt = next((x for x in it if x not in seen), None)
                if nxt is None:
                    stack.pop()
                    done.append(node)
                else:
                    seen.add(nxt)
                    stack.append((nxt, iter(sorted(out_edges[nxt]))))
        return pd.DataFrame({"repo_id": pdf.repo_id.iloc[0], "id": done, "place": range(len(done))})

    return edge.groupBy("repo_id").applyInPandas(order, "repo_id string, id string, place int")


def render_slice(statements: DataFrame) -> DataFrame:
    """``(target, context)``: one fenced block for each file, files and statements in order.

    ``statements(target, file_pos, path, pos, code)``; the path leads each block.
    """
    per_file = statements.groupBy("target", "file_pos", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda s: s["code"]), "\n").alias("body"))
    block = F.concat(F.lit("```python\n## "), F.col("path"), F.lit("\n"), F.col("body"), F.lit("\n```"))
    return per_file.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_pos", "path", block.alias("block")))), lambda b: b["block"]), "\n").alias("context"))


def normalised_callees(edge: DataFrame, modules: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(edges, counts)``: callees that are no known id are resolved through an import of the caller's file.

    ``edge(repo_id, caller, callee)``; ``modules(repo_id, id)`` are the known ids,
    ``imports(repo_id, module, name, target)`` what a name means in a file.  A callee
    ``name.rest`` becomes ``target.rest`` if that is known.  ``edges`` has ``kind``:
    ``retained`` (known as it is), ``normalized``, or ``unnormalized`` (left as it is);
    ``counts`` has one row with retained, normalized, unnormalized and unresolved, which is
    normalized and unnormalized together.
    """
    known = modules.select("repo_id", "id").distinct()
    first, file = F.substring_index("callee", ".", 1), F.regexp_replace("caller", r"\.[^.]*$", "")
    e = edge.distinct().withColumns({"name": first, "module": file, "rest": F.expr("substr(callee, length(substring_index(callee, '.', 1)) + 1)")})
    e = e.join(known.select("repo_id", F.col("id").alias("callee"), F.lit(True).alias("own")), ["repo_id", "callee"], "left")
    one = imports.groupBy("repo_id", "module", "name").agg(F.min("target").alias("target"))
    e = e.join(one, ["repo_id", "module", "name"], "left").withColumn("other", F.concat("target", "rest"))
    e = e.join(known.select("repo_id", F.col("id").alias("other"), F.lit(True).alias("far")), ["repo_id", "other"], "left")
    kind = F.when(F.col("own"), "retained").when(F.col("far"), "normalized").otherwise("unnormalized")
    out = e.select("repo_id", "caller", F.when(kind == "normalized", F.col("other")).otherwise(F.col("callee")).alias("callee"), kind.alias("kind"))
    is_ = lambda k: F.count_if(F.col("kind") == k)
    return out, out.agg(is_("retained").alias("retained"), is_("normalized").alias("normalized"), is_("unnormalized").alias("unnormalized"), (is_("normalized") + is_("unnormalized")).alias("unresolved"))


def expanded_callees(edge: DataFrame, types: DataFrame) -> DataFrame:
    """Callees of each id, where a class stands for its methods: ``(repo_id, id, callees)``.

    ``types(repo_id, id, type)``; a method is named ``class.method``.
    """
    own = edge.select("repo_id", F.col("caller").alias("id"), "callee")
    classes = types.where("type = 'CLASS'").select("repo_id", "id")
    by_class = edge.select("repo_id", F.regexp_replace("caller", r"\.[^.]*$", "").alias("id"), "callee").join(classes, ["repo_id", "id"], "left_semi")
    return own.unionByName(by_class).groupBy("repo_id", "id").agg(F.array_sort(F.collect_set("callee")).alias("callees"))
