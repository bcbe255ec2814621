"""Fine-tuning records, prompts, source edits, capture, runners and sources."""

import json
import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import capture, codetext, prompts, pyast, pyedit
from quarry.operators import chat, graph, joins, retrieval
from quarry.operators.ranking import row_before
from quarry.plans import runners
from quarry.sources import external, readers, sinks
from quarry.workspace import Workspace


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def pairs(*turns):
    return F.array(*[F.struct(F.array(*map(F.lit, s)).cast("array<int>").alias("source"), F.array(*map(F.lit, t)).cast("array<int>").alias("target")) for s, t in turns])


def test_supervised_encoding(spark):
    two = pairs(([1, 2], [3]), ([4, 5], [6, 7]))
    r = one(spark, chat.encode_supervised(two, 100))
    assert r["input_ids"] == [1, 2, 3, 4, 5, 6, 7] and r["labels"] == [-100, -100, 3, -100, -100, 6, 7]
    assert one(spark, chat.encode_supervised(two, 100, train_on_prompt=True))["labels"] == [1, 2, 3, 4, 5, 6, 7]
    r = one(spark, chat.encode_supervised(two, 100, mask_history=True))
    assert r["input_ids"] == [1, 2, 3, 4, 5, 6, 7] and r["labels"] == [-100] * 5 + [6, 7]
    # the last turn has the budget first
    r = one(spark, chat.encode_supervised(two, 4, mask_history=True))
    assert r["input_ids"] == [4, 5, 6, 7] and r["labels"] == [-100, -100, 6, 7]
    assert one(spark, chat.encode_supervised(two, 3))["input_ids"] == [1, 2, 3]
    r = one(spark, chat.encode_supervised(two, 100, efficient_eos=9))
    assert r["input_ids"][-1] == 9 and r["labels"] == [9, -100, 3, 9, -100, 6, 7, 9]
    assert one(spark, chat.encode_supervised(pairs(([], [])), 5)) == ([], [])
    with pytest.raises(ValueError):
        chat.encode_supervised(two, 5, True, True)


def test_packs_and_blocks(spark):
    rows = [(0, i, list(range(n)), list(range(n))) for i, n in enumerate([3, 2, 4, 9, 0, 2])]
    df = spark.createDataFrame(rows, "b int, pos int, input_ids array<int>, labels array<int>")
    got = chat.packed_supervised(df, "b", "pos", 8, pad=77).orderBy("pack").collect()
    assert [r.attention_mask for r in got] == [[1, 1, 1, 1, 2, 2, 2, 0], [1, 1, 2, 2, 0, 0, 0, 0]] and got[0].input_ids[-1] == 77 and got[1].labels[4:] == [-100] * 4
    assert all(set(r.attention_mask) == {1} for r in chat.packed_supervised(df, "b", "pos", 8, neat=False).collect())
    texts = spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 2, []), (0, 3, [4, 5, 6, 7, 8]), (1, 1, [9])], "b int, pos int, ids array<int>")
    assert [(r.b, r.block, r.input_ids) for r in chat.pretrain_ids(texts, ["b"], ["pos"], "ids", 4).orderBy("block").collect()] == [(0, 0, [1, 2, 3, 4]), (0, 1, [5, 6, 7, 8])]
    sacks = chat.knapsacks([5, 5, 4, 3, 3, 2, 9, 1, 0, 11], 10)
    assert sorted(n for s in sacks for n in s) == [1, 2, 3, 3, 4, 5, 5, 9] and all(sum(s) <= 10 for s in sacks)


def test_stages(spark):
    df = spark.createDataFrame([("do", "x", "good", "bad", None), ("do", "", "a", "b", "s")], "instruction string, input string, chosen string, rejected string, sys string")
    t = chat.TEMPLATES["chatml"]
    rm = chat.encode_stage(chat.align(df, "alpaca", ranking=("chosen", "rejected")), "rm", t, 500).collect()
    assert len(rm) == 2 and all(len(r.chosen_input_ids) == len(r.chosen_labels) for r in rm)
    gen = chat.encode_stage(chat.align(df, response="chosen", system="sys"), "generate", t, 500).collect()
    assert "".join(map(chr, gen[1].labels)) == "a<|im_end|>\n" and "system\ns" in "".join(map(chr, gen[1].input_ids))
    assert chat.encode_stage(chat.align(df, response="chosen"), "pt", t, 3).first().input_ids == [100, 111, 10]
    assert chat.encode_stage(chat.align(df, response="chosen"), "sft", t, 50, mask_history=True).count() == 2
    with pytest.raises(ValueError):
        chat.align(df, "other")
    paths = F.array(F.lit("a.png"), F.lit("b.png"))
    assert one(spark, chat.resolved_media(paths, "m/", F.array(F.lit("m/b.png")))) == ["a.png", "m/b.png"]
    assert one(spark, chat.resolved_media(F.array().cast("array<string>"), "m", paths)) is None


@pytest.mark.parametrize("dialect", chat.DIALECTS)
def test_calls_are_read_back(dialect):
    calls = [("look_up", '{"q": "größe", "n": 2}')]
    if dialect not in ("glm4", "llama3"):
        calls.append(("other", "{}"))
    else:
        with pytest.raises(ValueError):
            chat.call_text(dialect, calls * 2)
    assert chat.read_calls(dialect, chat.call_text(dialect, calls)) == calls
    assert chat.read_calls(dialect, "no call at all") is None and chat.read_calls(dialect, None) is None
    with pytest.raises(ValueError):
        chat.read_calls("none", "x")
    tools = [{"name": "f", "description": "d", "parameters": {"properties": {"x": {"type": "array", "description": "p", "items": {"type": "int"}}}, "required": []}}]
    assert "f" in chat.describe_tools(tools, dialect)


def test_prompts(spark):
    assert len(prompts.PROMPTS) == 14
    text = one(spark, prompts.prompt("instruction", func_name=F.lit("f"), code=F.lit(None).cast("string")))
    assert "`f`" in text and "{{" not in text
    with pytest.raises(ValueError):
        prompts.prompt("debug", func_name=F.lit("f"))
    m = one(spark, prompts.few_shot_messages(F.lit("CODE"), F.lit("f"), F.lit("WRONG"), F.lit("ERR"), debug=True, reasoning=True))
    assert [x["role"] for x in m] == ["system", "system", "system", "user"] and all(x in m[-1]["content"] for x in ("CODE", "WRONG", "ERR"))
    assert "Reasoning:" in m[2]["content"] and "{{" not in "".join(x["content"] for x in m)


SOURCE = '''import numpy as np
from a.b import c as d

class K:
    def m(self):
        """Doc."""
        return np.x
    def n(self):
        return d

def f(x):
    """Doc."""
    if x:
        return 1
    return d
'''


def test_source_edits():
    assert "numpy.x" in pyedit.without_aliases(SOURCE, ["numpy"]) and "return c" in pyedit.without_aliases(SOURCE, ["c"])
    assert "def f" not in pyedit.without_function(SOURCE, "f") and "class K" not in pyedit.without_class(SOURCE, "K")
    assert "def f" not in pyedit.without_last(SOURCE) and pyedit.without_last("") == ""
    assert "pass" in pyedit.without_methods(SOURCE, "K", ["m", "n"])
    moved = pyedit.method_last(SOURCE, "K", "m")
    assert moved.index("def n") < moved.index("def m")
    assert "Doc." not in pyedit.without_docstring("def f():\n    'Doc.'\n    return 1", "f")
    assert pyedit.body_lines("    def f(x):\n        '''d'''\n        return 1\n", "f") == (2, 2) and pyedit.body_lines("def f():\n    'd'", "f") is None
    assert pyedit.parent_lines("class A:\n    def f(self):\n        pass\n", 1) == [0]
    assert pyedit.definition(SOURCE, "K.n").startswith("def n") and pyedit.definition(SOURCE, "K.z") is None
    assert pyedit.inner_imports("def f():\n    import os\n    return os", "f") == ["import os"]
    assert pyedit.public_names("__all__ = ['a']\nb = 1") == ["a"] and pyedit.public_names("import os\n_x = 1\ny = 2\ndef z(): pass") == ["os", "y", "z"]
    assert pyedit.absolute_imports("from . import x\nfrom ..q import y\nfrom .s import *", "p.r.m", files={"p.r.s": "u = 1"}) == "from p.r import x\nfrom p.q import y\nfrom p.r.s import u"
    assert pyedit.import_file("u.v", "a/b/c.py", {"a/u/v.py"}) == "a/u/v.py" and pyedit.import_file("u", "c.py", {"u/__init__.py"}) == "u/__init__.py"
    for fn in (pyedit.without_last, lambda c: pyedit.without_docstring(c, "f"), lambda c: pyedit.absolute_imports(c, "m")):
        assert fn("def (") is None and fn(None) is None


def test_checks_of_answers():
    before = "def f(x):\n    return x + 1\n"
    test = "def test_f():\n    assert f(1) == f_new_implementation(1)\n    assert f(2) == f_new_implementation(2)\n    assert f(3) == f_new_implementation(3)\n"
    main = "if __name__ == '__main__':\n    test_f()\n"
    assert pyast.test_check("f", before + test + main, before, before) == (True, "")
    assert pyast.test_check("f", before + test, before, before)[1] == "no main guard"
    assert pyast.test_check("f", before + "def f_new_implementation(x):\n    return 0\n" + test + main, before, before)[1] == "holds the new version"
    assert pyast.test_check("f", before + test.replace("assert f(3)", "f(3)") + main, before, before)[1] == "fewer than three assertions"
    assert pyast.test_check("f", before + "# ...\n" + test + main, before, before)[1] == "new '...'"
    weak = test.replace("f_new_implementation(", "g(").replace("f(", "h(f, ").replace("def test_h(f, )", "def test_f()")
    assert pyast.test_check("f", before + weak + main, before, before)[1] == "does not call the function"
    assert pyast.debug_check("f", before + weak + main, before, before) == (True, "")
    assert pyast.sandbox_check("f", before, before, before + "x = 1\n" * 30)[1] == "script got shorter"


def test_sft_example():
    own = "## p/a.py\nimport os\n\nclass A:\n    def f(self):\n        \"\"\"Doc.\"\"\"\n        return os\n\nx = 1"
    other = "## p/b.py\ny = 1"
    text, out = codetext.sft_example([own, other], "p/a.py", "A.f")
    assert text.startswith("# From the file\n# p/b.py\n# y = 1\n\n## p/a.py") and text.endswith('"""Doc."""\n') and "x = 1" not in text
    assert out == "        return os\n    \n"
    assert "Doc." not in codetext.sft_example([own], "p/a.py", "A.f", docstring="drop")[0]
    assert '"""\n        new\n        """' in codetext.sft_example([own], "p/a.py", "A.f", "new", "instruction")[0]
    assert not codetext.sft_example([own, other], "p/a.py", "A.f", infile=True)[0].startswith("# From")
    assert codetext.sft_example([own], "p/z.py", "A.f") is None and codetext.sft_example(None, "p/a.py", "f") is None and codetext.sft_example([own, "one"], "p/a.py", "A.f") is None
    assert codetext.renamed_in_script("f(1); g.f(2); ff(3); f (4)", "f", "h") == "h(1); g.f(2); ff(3); h (4)"
    assert codetext.section_after("x\nANSWER\n```\na\n```\n```py\nb\n```", "ANSWER") == "a\n\nb" and codetext.section_after("plain", "ANSWER") == "plain"
    assert "def f_new_implementation(x)" in codetext.with_copy("def f(x):\n    return x\n", "f") and codetext.with_copy("x", "f") is None


def test_capture():
    c = capture.Capture()

    class Odd:
        def __init__(self):
            self.me = {1, "a"}

    fn = c.wrap(lambda a, b=2, *rest: Odd() if a else (a, b, rest))
    fn(1)
    fn(0, b=None)
    assert c.records[0]["inputs"] == {"a": 1, "b": 2, "rest": []} and c.records[0]["output"] == {"me": [1, "a"]} and c.records[1]["output"] == [0, None, []]
    assert capture.merged_types(c.records)["b"] == "builtins.NoneType | builtins.int" and json.loads(c.dump())
    loop: list = []
    loop.append(loop)
    assert "list" in json.dumps(capture.plain(loop))


def test_branch_coverage_and_guard():
    script = "def f(x):\n    if x:\n        return 1\n    return 2\ndef test_f():\n    assert f(1) == 1\n"
    assert runners.branch_coverage(script, "f", "test_f") == (0.5, [4])
    assert runners.branch_coverage(script.replace("assert f(1) == 1", "assert f(1) == 1 and f(0) == 2"), "f", "test_f") == (1.0, [])
    assert runners.branch_coverage("def g():\n    return 1\n", "g", "test_g") == (1.0, [])
    assert runners.branch_coverage(script.replace("== 1", "== 7"), "f", "test_f")[0] is None and runners.branch_coverage("def (", "f", "t") == (None, [])
    assert runners.run_guarded("import os\nos.system('true')")[0] == "error" and runners.run_guarded("print(1)")[0] == "success"


def test_measured_scripts(spark):
    script = "def f(x):\n    if x:\n        return 1\n    return 2\ndef test_f():\n    assert f(0) == f_new_implementation(0)\n"
    df = spark.createDataFrame([(1, script, "f"), (2, "x = 1", "f"), (3, None, None)], "i int, s string, n string")
    got = {r.i: r.coverage for r in runners.measured(df, "s", "n").collect()}
    assert got[1]["rate"] == 0.5 and got[2]["rate"] is None and got[3]["rate"] is None


def test_patched_repository():
    files = {"r/a.py": "def f():\n    return 1  # x\n", "r/test_a.py": "from a import f\ndef test_f():\n    assert f() == 1\n"}
    assert runners.patch_outcome(files, "r/a.py", 1, "    return 1  # x", "    return 1  # x\n    # more") == ("success", "")
    assert runners.patch_outcome(files, "r/a.py", 1, "    return 1  # x", "    return 2", ["r/test_a.py"])[0] == "failed"
    assert runners.patch_outcome(files, "r/a.py", 1, "    return 1  # x", "    return 2 - 1")[0] == "success"
    assert runners.run_tests({"x.py": "y = 1"})[0] == "success"


def test_timed_map_and_cache(spark, tmp_path):
    import time

    def work(x):
        if x == "slow":
            time.sleep(5)
        return x.upper()

    df = spark.createDataFrame([("a",), ("slow",), (None,)], "x string")
    got = {r.x: (r.task["status"], r.task["result"]) for r in runners.timed_map(df, "x", work, 0.3).collect()}
    assert got["a"] == ("success", "A") and got["slow"] == ("timeout", None) and got[None][0] == "failed"
    none = spark.createDataFrame([], "key string, prompt string, answers array<string>, error string")
    asked = runners.cached_calls(spark.createDataFrame([("k", "p")], "key string, prompt string"), none)
    runners.append_cache(f"{tmp_path}/c", asked)
    assert spark.read.parquet(f"{tmp_path}/c").count() == 1


def test_typed_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"instruction": "i", "output": "o"}\n{"idx": "3_1"}\n')
    df = readers.typed_records(spark, f"{tmp_path}/a.jsonl", "sft")
    assert df.columns == ["instruction", "input", "output", "idx"] and [r.idx for r in df.collect()] == [None, "3_1"]
    with pytest.raises(ValueError):
        readers.typed_records(spark, "", "none")


def test_more_sources(spark, tmp_path):
    t = pa.table({"x": [1, 2], "s": ["a", None]})
    for i in range(2):
        with pa.OSFile(f"{tmp_path}/f{i}.arrow", "wb") as f, (pa.ipc.new_file if i else pa.ipc.new_stream)(f, t.schema) as w:
            w.write_table(t)
    assert readers.arrow_files(spark, f"{tmp_path}/*.arrow").count() == 4
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.csv").write_text("p\n1\n2\n3\n")
    info = readers.registry({"d": {"file_name": "d", "num_samples": 2}, "w": {"hf_hub_url": "o/x"}})
    assert [r.p for r in readers.load_registered(spark, info["d"], str(tmp_path)).collect()] == ["1", "2"]
    with pytest.raises(ValueError):
        readers.load_registered(spark, info["w"], str(tmp_path))
    assert readers.load_registered(spark, info["w"], "", lambda s, address, i: s.createDataFrame([(address,)], "a string")).first().a == "o/x"
    (tmp_path / "d/b.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.load_registered(spark, info["d"], str(tmp_path))
    sinks.export_json_array(spark.range(25), f"{tmp_path}/arr", 10)
    assert readers.json_array(spark, f"{tmp_path}/arr").count() == 25
    (tmp_path / "src").mkdir()
    (tmp_path / "src/x.txt").write_text("x")
    repos = spark.createDataFrame([(f"{tmp_path}/src",), (f"{tmp_path}/none",)], "repo_name string")
    got = {r.repo_name.rsplit("/", 1)[1]: r.status for r in external.copied(repos, f"{tmp_path}/out").collect()} if (tmp_path / "out").mkdir() is None else {}
    assert got["src"] == "copied" and got["none"].startswith("failed")
    assert external.copied(repos.where("repo_name like '%src'"), f"{tmp_path}/out").first().status == "present"
    assert external.file_listing(str(tmp_path / "src")) == "- src/\n    - x.txt"


def test_closure_of_large_graphs(spark):
    e = spark.createDataFrame([("r", "a", "b"), ("r", "b", "c"), ("r", "c", "a"), ("s", "x", "y"), ("s", "x", "x")], "repo_id string, caller string, callee string")
    both = [sorted((r.repo_id, r.root, r.id, r.hops) for r in graph.closure(e, Workspace(spark, "t"), small=n).collect()) for n in (100, 1, 0)]
    assert both[0] == both[1] == both[2] and ("r", "a", "c", 2) in both[0] and len(both[0]) == 7
    assert graph.closure(e, Workspace(spark, "t"), depth=1, small=0).count() == 4


def test_neighbours_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(900, [0.0, 0.0, 0.0]), (901, None)]
    e = spark.createDataFrame(rows, "i bigint, v array<float>")
    q = e.where("i % 5 = 0")
    whole = sorted(map(tuple, retrieval.nearest(q, e.repartition(3), 4, "i", "v", Workspace(spark, "t")).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 100)
    assert whole == sorted(map(tuple, retrieval.nearest(q, e, 4, "i", "v", Workspace(spark, "t")).collect()))
    assert len(whole) == 12 * 4 and all(a != b for a, b, *_ in whole)
    assert retrieval.nearest(q.limit(0), e, 4, "i", "v", Workspace(spark, "t")).count() == 0


def test_row_before_and_first_text(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 4, None), ("b", 5, "w")], "g string, i int, v string")
    got = {r.i: r.prev for r in row_before(df, ["g"], ["i"], "v", "prev", Workspace(spark, "t")).collect()}
    assert got == {1: None, 2: "x", 3: None, 4: "z", 5: None}
    t = spark.createDataFrame([("k", 2), ("k", 1), (None, 0)], "k string, n int")
    assert {r.v: r.n for r in joins.first_by_text(df, "v", t.withColumn("k", F.when(F.col("k") == "k", "x")), "k", "n", "n", "n").collect()} == {"x": 1, "y": None, "z": None, "w": None, None: None}


def test_whole_package_works_without_the_optional_part(tmp_path):
    import pathlib
    import shutil

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not any(n.startswith('p1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)


def test_clean_up(spark, tmp_path):
    from quarry import workspace

    ws = Workspace(spark, "t")
    assert ws.save(spark.range(3), "x").count() == 3
    old = workspace._MADE.pop(spark.sparkContext.applicationId)
    workspace._MADE[spark.sparkContext.applicationId] = old[-1:]
    assert workspace.clean_up(spark) == 1 and not workspace.finished_tables(spark, ws.path)
    workspace._MADE[spark.sparkContext.applicationId] = old[:-1]
