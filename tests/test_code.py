"""Code text, slicing, evaluation and external sources."""

import ast
import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import codetext as C
from quarry.functions.fences import block_rows, blocks
from quarry.functions.pyast import free_names
from quarry.operators import evaluation, slicing
from quarry.plans.queries import QUERIES
from quarry.sources.external import RepoSearch

FILES = {
    "p.a": "import os\nfrom p.b import g, K as L\nX = 3\ndef unused():\n    return 0\ndef f(v):\n    return g(v) + X + L()\n",
    "p.b": "Y = 1\nY = 2\ndef g(v):\n    return h(v) * Y\ndef h(v):\n    return g(v)\nclass K:\n    pass\n",
    "p.broken": "def (",
}


def test_slice_follows_imports_and_cycles():
    r = slicing.Repository(FILES)
    nodes = r.slice("p.a", "f")
    assert nodes[-1] == ("p.a", 5) and ("p.a", 4) not in nodes and ("p.b", 1) in nodes and ("p.b", 0) not in nodes
    assert r.calls() == [("p.a.f", "p.b.K"), ("p.a.f", "p.b.g"), ("p.b.g", "p.b.h"), ("p.b.h", "p.b.g")]
    assert r.slice("p.a", "missing") == [] and r.slice("p.broken", "f") == []
    assert r.slice("p.a", "f", 0) == [("p.a", 5)]
    assert r.shortened(nodes, "p.a", 0) == [("p.a", 5)] and r.shortened(nodes, "p.a", 10**6) == nodes


def test_headers_matches_and_marks():
    code = "import a, b as c\nfrom d import e, g\nN = 1\nfor x in e(N):\n    with g(x) as h:\n        V = h\nmatch c:\n    case 1 if a:\n        W = 2\nif __name__ == '__main__':\n    f()\ndef f():\n    return V, W\n"
    r = slicing.Repository({"m": code})
    m = r.modules["m"]
    assert [t for t in m.texts[:4]] == ["import a", "import b as c", "from d import e", "from d import g"] and m.main.count(True) == 1
    v, w = (next(i for i, b in enumerate(m.binds) if b == [n]) for n in "VW")
    assert m.reads(v) == ["N", "e", "g"] and m.reads(w) == ["a", "c"]
    nodes = r.slice("m", "f")
    text = r.render(nodes, "m", frozenset(["m"]))
    assert text.index("from d import e") < text.index("V = h") < text.index("def f") < text.index("# ...") and "import a" in text
    assert free_names("def f(y):\n    z = 1\n    return z + w\nq = z") == ["w", "z"] and free_names("x += 1") == ["x"]
    assert free_names("def f(a: 'T') -> U:\n    return [a for a in b]") == ["T", "U", "b"]


def test_contexts(spark):
    files = spark.createDataFrame([("r", m, c) for m, c in FILES.items()] + [("s", "x", None)], "repo_id string, module string, code string")
    targets = spark.createDataFrame([("r", "p.a", "f"), ("s", "x", "f")], "repo_id string, module string, name string")
    got = {r.repo_id: r.context for r in slicing.contexts(files, targets).collect()}
    assert got["s"] is None and got["r"].index("## p/b.py") < got["r"].index("## p/a.py") and "unused" not in got["r"]
    full = {r.repo_id: r.context for r in slicing.contexts(files, targets, "full").collect()}
    assert "unused" in full["r"]
    assert slicing.call_graph(files).count() == 4
    with pytest.raises(ValueError):
        slicing.contexts(files, targets, "other")


def test_code_text():
    script = "class A:\n    def f(self):\n        return 1\n\nx = 1\n"
    assert C.evaluation_script(script, "```python\ndef f(self):\n    return 2\n```", "A.f") == "class A:\n    def f(self):\n        return 2\n\nx = 1"
    assert "f_new_implementation" in C.evaluation_script(script, "def f(self):\n    return 2", "A.f", True)
    assert C.evaluation_script(script, "nothing", "A.f") is None and C.evaluation_script(None, "", "f") is None
    assert C.body_until_dedent("@d\ndef f(\n  a,\n):\n    x\n# c\n\n    y\nz", "f") == "    x\n# c\n\n    y"
    assert C.target_body('def f():\n    """d"""\n\n    return 1\n', "f") == "    return 1"
    assert C.target_body("def f():\n    # only\n", "f") is None
    assert C.first_lines_like("a\n#c\nb\nc", "x\ny") == "a\nb"
    assert C.with_pragmas("a\nb\n\nc", 1, 1) == "a  # pragma: no cover\nb\n\nc  # pragma: no cover"
    assert C.with_unevaluated("if x:\n    y", [2]) == "if x:\n    # UNEVALUATED BRANCH\n    y"
    assert C.failed_tests("short test summary info\nFAILED a.py::t\nERROR b.py\nFAILED a.py::u") == ["a.py", "b.py"] and C.failed_tests(None) == []
    assert C.completed("import re\ndef f(x):\n", "```python\nimport q\ndef f(x):\n    return 1\n```") == "import re\ndef f(x):\n    return 1"
    assert C.between_markers("x BEGIN y END z", "BEGIN", ["END"]) == "y"
    assert C.without_failing("def test_a():\n    pass\ndef test_b():\n    pass", ["test_a"]) == "def test_b():\n    pass"
    assert C.without_failing("def test_a():\n    pass", ["test_a"]) is None
    assert C.spec_text("a\n```\nx\n```\nb\n```\ny\n```") == "y" and C.spec_text(None) is None
    assert C.replaced_test("def test_f():\n    assert 0\n", "```\ndef test_f():\n    assert 1\n```", "f") == "def test_f():\n    assert 1"


def test_evaluation(spark):
    assert evaluation.matching(["human*", "m*"]) == ["humaneval", "mbpp"]
    task = evaluation.TASKS["humaneval"]()
    assert spark.range(1).select(task.postprocess(F.lit("```python\nx = 1\nprint(2)\n```"))).first()[0] == "x = 1"
    rows = spark.createDataFrame([("do it", ["assert f()", "assert g()"])], "text string, test_list array<string>")
    mbpp = evaluation.TASKS["mbpp"]()
    assert rows.select(mbpp.prompt(), mbpp.reference()).first()[:] == ('"""\ndo it\nassert f()\n"""\n', "assert f()\nassert g()")
    assert spark.range(1).select(evaluation.TASKS["ds1000"]().postprocess(F.lit("x BEGIN SOLUTION\n```python\ny = 1\n</code>\n```"))).first()[0] == "y = 1\n"
    lcb = spark.createDataFrame([("Q", None), ("Q", "class S: pass")], "question_content string, starter_code string").select(evaluation.TASKS["live_code_bench"]().prompt()).collect()
    assert "standard input" in lcb[0][0] and "class S" in lcb[1][0]
    res = spark.createDataFrame([("a", True), ("a", False), ("b", None), ("b", True)], "task_id string, passed boolean")
    assert {r["k"]: r["pass_at_k"] for r in task.score(res, [1, 2]).collect()} == {1: 0.5, 2: 1.0}
    runs = spark.createDataFrame([(1, True, 2, 0, 0, 80.0), (1, False, 0, 2, 0, None), (2, None, None, None, None, None)], "id int, valid boolean, passed int, failed int, errored int, branch_coverage double")
    r = evaluation.test_summary(runs).first()
    assert (r.functions, r.runnable, r.valid, r.valid_percent, r.all_failed) == (2, 1, 1, 50.0, 1) and r.pass_ratio == 0.5
    doc = F.array(F.struct(F.lit("t").alias("title"), F.lit("x\ny").alias("text")))
    out = spark.range(1).select(evaluation.with_context(F.lit("P"), doc, 1)).first()[0]
    assert out.endswith("\nP") and "# x\n# y" in out


def test_repo_search(spark, tmp_path):
    rows = [{"full_name": f"o/r{i}", "language": "Python", "license": "MIT" if i % 2 else None, "created": f"2024-0{1 + i % 9}-01", "size_kb": i * 100} for i in range(9)]
    (tmp_path / "f.jsonl").write_text("\n".join(map(json.dumps, rows)))
    spark.dataSource.register(RepoSearch)
    df = spark.read.format("repo_search").option("fixture", f"{tmp_path}/f.jsonl").option("license", "mit").option("max_kb", "600").option("block_bytes", "150").load()
    assert sorted(r.full_name for r in df.collect()) == ["o/r1", "o/r3", "o/r5"]


def test_blocks_of_every_fence(spark):
    opens = ["```python", "```py", "```Python", "```python3", "``` python", "```python   ", "```python\r", "```python\r  ", "~~~python", "```", "see ```python"]
    text = "\n".join(f"{o}\n## p/m{i}.py\ndef f{i}():\n    return {i}\n```{' ' * (i % 2)}" for i, o in enumerate(opens))
    text += '\n```yaml\n## a.yml\nx: 1\n```\n```python\n## p/open.py\ndef g():\n    """\n    ```\n    a\n    ```\n    """\n```py\n## p/last.py\r\ndef h():\r\n    return 1'
    got = blocks(text)
    assert [p for _, p, _ in got] == [*(f"p/m{i}.py" for i in range(len(opens))), "a.yml", "p/open.py", "p/last.py"]
    assert [lang for lang, *_ in got] == ["python"] * len(opens) + ["yaml", "python", "python"]
    assert all(ast.parse(b) for lang, _, b in got if lang == "python") and got[-1][2].endswith("return 1") and got[0][2] == "## p/m0.py\ndef f0():\n    return 0"
    assert blocks(None) == [] and blocks("a ```x``` b\nuse ``` for it") == [] and blocks("```")[0][2] == ""
    df = spark.createDataFrame([(1, text), (2, None)], "k bigint, t string")
    assert [r.pos for r in block_rows(df, "t", "k").where("lang = 'python'").orderBy("pos").collect()] == [*range(len(opens)), len(opens) + 1, len(opens) + 2]


def test_queries_read_every_fence(spark, tmp_path):
    text = "```py\n## p/a.py\ndef f():\n    return g()\n```\n~~~python\n## p/b.py\ndef k():\n    return 1\n```\n```\n## p/c.py\nfrom p.a import f\ndef h():\n    return f()"
    spark.createDataFrame([(1, text, "h")], "record_id bigint, orig_context string, func_name string").write.parquet(f"{tmp_path}/checked_test_set_final.parquet")
    assert sorted(r.name for r in QUERIES["function_features"](spark, str(tmp_path)).collect()) == ["f", "h", "k"]
    assert [(r.caller, r.callee) for r in QUERIES["built_call_graph"](spark, str(tmp_path)).collect()] == [("p.c.h", "p.a.f")]
    assert [(r.module, r.n_chars > 0) for r in QUERIES["sliced_contexts"](spark, str(tmp_path)).collect()] == [("p.c", True)]
