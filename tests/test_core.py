"""Golden cases, brute-force models and edge cases of the core operators."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import containing, pyast
from quarry.functions import text as T
from quarry.functions.names import base_idx, canonical_repo
from quarry.operators import chat, filters, graph, joins, metrics, sampling
from quarry.operators.ranking import rank_within
from quarry.plans.rounds import run_rounds
from quarry.plans.runners import cached_calls, executed, run_script
from quarry.sources import readers, sinks
from quarry.workspace import Workspace


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def one(spark, expr, **cols):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]) if cols else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, wanted",
    [("Own___Re_po", "own___re_po"), (" own / repo ", "own___repo"), ("https://h.example/Own/repo.git/", "own___repo"), ("git@h.example:own/re-po.git", "own___re-po"), ("own/repo", "own___repo"), ("own", None), ("  ", None), (None, None), ("___x", None)],
)
def test_canonical_repo(spark, given, wanted):
    assert one(spark, canonical_repo(F.lit(given).cast("string"))) == wanted


@pytest.mark.parametrize("given, wanted", [("0012_3", "12"), (" 7 ", "7"), ("000", "0"), ("", None), (" ", None), (None, None), ("311", "311")])
def test_base_idx(spark, given, wanted):
    assert one(spark, base_idx(F.lit(given).cast("string"))) == wanted


def test_rank_within_matches_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", "hot", "hot", "b"]), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {(r.g, r.i): r["rank"] for r in rank_within(df, ["g"], ["v", "i"], Workspace(spark, "t")).collect()}
    for g in {r[0] for r in rows}:
        for k, (_, v, i) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: x[1:])):
            assert got[(g, i)] == k
    assert rank_within(df.limit(0), ["g"], ["v", "i"], Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("source, target, cutoff, wanted", [(3000, 2000, 1000, (600, 400)), (2000, 3000, 1000, (400, 600)), (1000, 100, 1000, (900, 100)), (100, 1000, 1000, (100, 900)), (100, 500, 1000, (100, 500)), (500, 100, 1000, (500, 100)), (10, 10, 1000, (10, 10))])
def test_split_budget_golden(spark, source, target, cutoff, wanted):
    r = one(spark, chat.split_budget(F.lit(source), F.lit(target), cutoff))
    assert (r["source"], r["target"]) == wanted


def test_pass_at_k(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0)], "p string, ok int")
    counts = metrics.pass_counts(df, "p", F.col("ok") == 1)
    assert dict(values(metrics.pass_at_k(counts, [1, 2, 3]), "k", "pass_at_k")) == {1: 0.5, 2: 1.0}
    none = metrics.pass_counts(spark.createDataFrame([("a", None), ("a", 0)], "p string, ok int"), "p", F.col("ok") == 1)
    assert dict(values(metrics.pass_at_k(none, [1]), "k", "pass_at_k")) == {1: 0.0}
    assert metrics.pass_at_k(counts.limit(0), [1]).count() == 0


def test_similarity_and_bleu(spark):
    assert one(spark, metrics.edit_similarity(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, metrics.edit_similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    same = F.split(F.lit("a b c d e"), " ")
    words = lambda t: F.split(F.lit(t), " ")
    assert one(spark, metrics.smoothed_bleu(same, F.array(words("x"), same))) == pytest.approx(1.0)
    assert one(spark, metrics.smoothed_bleu(same, F.array(words("x y z")))) == 0.0
    # of two references the one with more of an n-gram counts, and the shorter length
    assert one(spark, metrics.smoothed_bleu(words("a a a b"), F.array(words("a a c"), words("b x y z")), 1)) == pytest.approx(3 / 4)
    assert one(spark, metrics.smoothed_bleu(F.lit(None).cast("array<string>"), F.array(same))) is None
    assert one(spark, metrics.normalise_for_bleu(F.lit("It&apos;s 5. A-1, x-\ny <skipped>3-4 &lt;b&gt; end 5."))) == ["it", "&", "apos", ";", "s", "5", ".", "a-1", ",", "xy", "3", "-", "4", "<", "b", ">", "end", "5", "."]
    assert one(spark, metrics.rouge_l(words("a b c d"), words("a x c d"))) == 0.75 and one(spark, metrics.rouge_l(F.array().cast("array<string>"), same)) == 0.0
    assert one(spark, metrics.rouge_n(words("a b a"), words("a b c"), 2)) == 0.5


def test_longest_common_subsequence_matches_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(0, 90))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert metrics.common_length(a, b) == row[-1]


@pytest.mark.parametrize("out, want, ok", [("1 2\n", "1 2", True), (" a \n b", "a\nb", True), ("1.0000000001", "1", True), ("b a", "a b", True), ("1", "2", False), ("a\n\nb", "a\nb", True)])
def test_answers_agree(spark, out, want, ok):
    assert one(spark, metrics.answers_agree(F.lit(out), F.lit(want))) is ok


def test_text_functions(spark):
    text = "x\n```python\nA = 1\n```\ny\n```\nB\n```"
    assert [(b["lang"], b["body"]) for b in one(spark, T.fenced_blocks(F.lit(text)))] == [("python", "A = 1"), ("", "B")]
    assert one(spark, T.first_code_piece(F.lit(text))) == "A = 1"
    assert one(spark, T.first_code_piece(F.lit("plain"))) == "plain"
    assert one(spark, T.between_fence_lines(F.lit(text))) == "A = 1"
    assert one(spark, T.cut_at_stops(F.lit("a STOP b END"), ["END", "STOP"])) == "a "
    assert one(spark, T.cut_at_stops(F.lit("abc"), ["Z"])) == "abc"
    assert one(spark, T.verdict(F.lit("REASONING: no. ANSWER: Yes, not"))) == "yes"
    assert one(spark, T.verdict(F.lit("ANSWER: yes"))) is None
    assert one(spark, T.missing_module(F.lit("No module named 'a.b'"))) == "a"
    assert one(spark, T.error_types(F.lit("t\nKeyError: x\nfoo ValueError: y"))) == ["KeyError"]
    assert one(spark, T.doc_title(F.lit("# name rest\nx"))) == "name"
    assert one(spark, T.doc_title(F.lit("one"))) is None
    assert one(spark, T.first_chunk_lines(F.lit("a b\nc d\ne"), 4)) == 2
    assert one(spark, T.first_chunk(F.lit("a b c d e"), 2)) == ""
    assert one(spark, T.truncate_tokens(F.lit("a b c"), 2)) == "b c"
    assert [(r["first"], r["last"]) for r in one(spark, T.missing_blocks(F.array(*map(F.lit, [0, 1, 3, 7, 8, 8]))))] == [(0, 1), (3, 3), (7, 8)]
    assert one(spark, T.missing_blocks(F.array().cast("array<int>"))) == []
    assert one(spark, T.without_docstrings(F.lit('a\n"""\nhid\n"""\nb'))) == 'a\n"""\nb'
    assert one(spark, T.fill_slots("{{a}}-{{b}}", a=F.lit("1"), b=F.lit(None).cast("string"))) == "1-"
    assert one(spark, T.fenced_blocks(F.lit(None).cast("string"))) is None


def test_chat_alignment(spark):
    rows = [(1, [("system", "s"), ("user", "q"), ("assistant", "a")]), (2, [("user", "q"), ("user", "r")]), (3, [("user", "q")]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "id int, messages array<struct<role:string,content:string>>")
    got = {r.id: (len(r.prompt), len(r.response), r.system) for r in chat.align_sharegpt(df).collect()}
    assert got == {1: (1, 1, "s"), 2: (0, 0, ""), 3: (0, 0, ""), 4: (0, 0, ""), 5: (0, 0, "")}
    a = chat.align_alpaca(spark.createDataFrame([("do", "", "done"), ("do", "in", None)], "instruction string, input string, output string"))
    assert [(r.prompt[0]["content"], len(r.response)) for r in a.collect()] == [("do", 1), ("do\nin", 0)]
    pairs = a.where(chat.valid_for("sft")).select(chat.render_pairs(chat.TEMPLATES["llama3"], F.concat("prompt", "response"), F.col("system")).alias("p")).first()["p"]
    assert pairs[0]["source"].endswith("do<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n") and pairs[0]["target"] == "done<|eot_id|>"


def test_packing_helpers(spark):
    assert chat.knapsacks([5, 4, 3, 2, 9], 7) == [[5, 2], [4, 3]]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([5, 4, 3, 2, 9])], "b int, pos int, n int")
    packs = values(chat.pack_batches(df, "b", "pos", "n", 7), "pos", "pack")
    assert sorted(packs) == [(0, 0), (1, 1), (2, 1), (3, 0)]
    mask = F.array(*map(F.lit, [1, 1, 2, 2, 2, 0]))
    assert one(spark, chat.segment_lengths(mask)) == [2, 3]
    assert one(spark, chat.cumulative_lengths(F.array(*map(F.lit, [2, 3, 1])))) == [0, 2, 5, 6]
    assert one(spark, chat.block_mask(F.array(*map(F.lit, [1, 1, 2, 0])))) == [[1, 0, 0, 0], [1, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 0]]
    assert one(spark, chat.padded(F.array(*map(F.lit, [1, 2, 3])), 4)) == [1, 2, 3, 0]
    kept = one(spark, chat.encoded_lengths(F.array(F.struct(F.lit(5).alias("source"), F.lit(5).alias("target")), F.struct(F.lit(5).alias("source"), F.lit(5).alias("target"))), 12))
    assert sum(k["source"] + k["target"] for k in kept) <= 12 and len(kept) == 2


def test_sampling_edges(spark):
    ws = Workspace(spark, "t")
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "id int, g string")
    assert sampling.stratified_sample(df, ["g"], 2, "id").groupBy("g").count().where("count = 2").count() == 2
    assert sampling.resample_exact(df, 23, "id", ws).count() == 23
    assert sampling.resample_exact(df.limit(0), 5, "id", ws).count() == 0
    parts = dict(values(sampling.split_exact(df, 3, "id", ws).groupBy("part").count(), "part", "count"))
    assert parts == {"validation": 3, "train": 7}
    assert sampling.interleave(df, "g", ["id"], ws, "first_exhausted").count() == 6
    assert values(sampling.interleave_by_weight(df, "g", ["id"], {"a": 2.0, "b": 1.0}, ws).orderBy("place", "g"), "g")[:3] == ["a", "b", "a"]
    dup = spark.createDataFrame([("k", 2, "x"), ("k", 1, "y"), (None, 5, "z")], "k string, o int, v string")
    assert sorted(values(sampling.first_by_priority(dup, ["k"], [F.col("o")]), "v")) == ["y", "z"]


def test_joins(spark):
    left = spark.createDataFrame([("u", 5, 1), ("u", 1, 2), (None, 9, 3), ("w", 5, 4)], "u string, t int, id int")
    right = spark.createDataFrame([("u", 1), ("u", 4), ("u", 5), (None, 1)], "u string, t int")
    got = dict(values(joins.last_before(left, right.withColumn("v", F.col("t")), ["u"], "t", "v"), "id", "last_value"))
    assert got == {1: 4, 2: None, 3: None, 4: None}
    known = spark.createDataFrame([("a.b",), ("a.b.c",)], "m string")
    df = spark.createDataFrame([("a.b.c.d",), ("a.b",), ("x.y",), (None,)], "n string")
    assert dict(values(joins.resolve_by_prefix(df, "n", known, "m"), "n", "resolved")) == {"a.b.c.d": "a.b.c", "a.b": "a.b", "x.y": None, None: None}
    old = spark.createDataFrame([(1, "a", None)], "i int, x string, y string")
    new = spark.createDataFrame([(1, None, "n", 4)], "i int, x string, y string, z int")
    assert joins.update_columns(old, new, ["i"]).first().asDict() == {"i": 1, "x": "a", "y": "n", "z": 4}


def test_graph(spark):
    g = spark.createDataFrame([("r", {"a": ["b", "b", "a"], "b": ["c"], "c": ["a"]}, {"a": "METHOD"})], "repo_id string, graph map<string,array<string>>, id2type map<string,string>")
    e = graph.edges(g)
    assert e.count() == 4
    far = graph.closure(e, Workspace(spark, "t"))
    assert sorted(values(far, "root", "id")) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]
    assert dict(values(graph.nodes(g), "id", "type")) == {"a": "METHOD", "b": "OTHER", "c": "OTHER"}
    assert [i for i, _ in sorted(values(graph.topological_order(e), "id", "place"), key=lambda x: x[1])] == ["c", "b", "a"]
    assert graph.closure(e.limit(0), Workspace(spark, "t")).count() == 0


CODE = '''import os

def kept(a, b):
    """Adds."""
    if a:
        a += 1
    c = a + b
    return c

class K:
    @staticmethod
    def m(x):
        return helper(x)
'''


def test_python_source(spark):
    rows = {r["name"]: r for r in pyast.function_rows(CODE)}
    assert rows["kept"]["n_args"] == 2 and rows["kept"]["n_branches"] == 1 and rows["m"]["decorators"] == ["staticmethod"] and rows["m"]["is_wrapper"]
    assert pyast.function_rows("def (") == [] and pyast.function_rows(None) == []
    assert pyast.function_lines(CODE, "K.m") == (10, 12)
    masked = pyast.mask_body(CODE, "kept")
    assert '"""Adds."""' in masked and "c = a + b" not in masked and pyast.safe_parse(masked) is not None
    assert "pass" in pyast.replace_function(CODE, "kept", "def kept():\n    pass") and "c = a + b" not in pyast.replace_function(CODE, "kept", "def kept():\n    pass")
    assert "class K" in pyast.remove_function(CODE, "kept")
    assert pyast.same_behaviour_tree("def f(x):\n    '''d'''\n    return x", "def f(x):\n    return  x") and not pyast.same_behaviour_tree("def f(): return 1", "def f(): return 2")
    assert pyast.free_names("y = f(x) + len(z)\n") == ["f", "x", "z"]
    assert pyast.sandbox_check("kept", "def kept(a, b): return 1", CODE) == (True, "")
    assert pyast.sandbox_check("gone", "", CODE)[0] is False
    df = spark.createDataFrame([(1, CODE), (2, None), (3, "def (")], "id int, code string")
    t = pyast.function_table(df, "id", "code").withColumn("keep", filters.function_keep(F.col("kind")))
    assert dict(values(t, "name", "keep")) == {"kept": True, "m": False}


def test_filters(spark):
    df = spark.createDataFrame([("success", 0.9), ("success", float("nan")), ("success", None), ("error", 1.0), (None, 1.0)], "s string, r double")
    assert df.where(filters.executed_well(F.col("s"), F.col("r"))).count() == 1
    docs = spark.createDataFrame([([("pkg-a.py x", "has REF in"), ("other", "REF")], "REF", ["pkg", "a.py"])], "docs array<struct<title:string,text:string>>, ref string, path array<string>")
    assert docs.select(F.size(filters.decontaminate_docs(F.col("docs"), F.col("ref"), F.col("path")))).first()[0] == 1
    texts = spark.createDataFrame([(1, "say the quick brown fox jumps over it"), (2, "quick fox"), (3, None), (4, "")], "id int, text string")
    items = spark.createDataFrame([("quick brown fox jumps",), ("",), (None,)], "item string")
    ws = Workspace(spark, "t")
    assert values(filters.contaminated(texts, items, ws), "id") == [1]
    texts = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, "xbeta gammas"), (3, "====="), (4, "beta, gamma"), (5, "alpha beta gamma delta epsilo")], "id int, text string")
    found = lambda *xs: sorted(values(filters.contaminated(texts, spark.createDataFrame([(x,) for x in xs], "item string"), ws), "id"))
    assert found("gamma") == [1, 2, 4, 5] and found("beta gamma") == [1, 2, 5] and found("==") == [3] and found("  ") == []
    assert found("alpha beta gamma delta epsilon") == [1] and found("pha beta gamma delta eps", "nothing at all here") == [1, 5]
    assert found("Gamma") == [] and filters.contaminated(texts.limit(0), texts.select(F.col("text").alias("item")), ws).count() == 0


def test_contaminated_writes_no_pairs(spark, monkeypatch):
    """Texts and items that share a word each, as names of functions do, must not be written pair by pair."""
    texts = spark.range(300).select("id", F.concat(F.lit("calls one.load_"), F.col("id"), F.lit(" in "), F.col("id")).alias("text"))
    items = spark.range(1000, 1300).select(F.concat(F.lit("a.load_"), F.col("id")).alias("item"))
    ws = Workspace(spark, "t")
    assert values(filters.contaminated(texts, items.unionByName(spark.createDataFrame([("one.load_7 in",)], "item string")), ws), "id") == [7]
    assert sum(spark.read.parquet(str(p)).count() for p in Path(ws.path.removeprefix("file://")).iterdir()) <= 301
    words = ["f", "é", "漢字", "x.y", "a_b", "läuft", "run_all", "Σας", "\n", "parse_é_tree", "    return  x", "find the longest", "日本語の長い文字列", "😀"]
    rows = [(n, f"{a}{b} {a[1:]}\t{b[:-1]}{a}") for n, (a, b) in enumerate((a, b) for a in words for b in words)] + [(None, "f"), (900, None), (901, ""), (902, " ")]
    monkeypatch.setattr(filters, "ITEM_BLOCK", 200)  # several passes
    for some in (words[1::2], [w + w for w in words] + [w[1:] for w in words[2::3]], ["b lä", "\té", " ", "zz"]):
        got = filters.contaminated(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([(w,) for w in some], "item string"), Workspace(spark, "t"))
        assert Counter(values(got, "id")) == Counter({n for n, t in rows if t is not None and any(w in t for w in some if w.strip(" "))})


def test_containing(monkeypatch):
    """Equal to a search for each item, over edges of texts and of steps, for repeated bytes and hot anchors."""
    rnd = random.Random(1)
    monkeypatch.setattr(containing, "_COUNT_BITS", 6)
    for step, pairs in ((1, 1), (7, 2), (containing.STEP, containing.PAIRS)):
        monkeypatch.setattr(containing, "STEP", step)
        monkeypatch.setattr(containing, "PAIRS", pairs)
        for letters in (b"a", b"ab", b"abcdefgh \n", bytes(range(256))):
            for _ in range(40):
                text = lambda n: bytes(rnd.choices(letters, k=rnd.randrange(n)))
                items, texts = list({text(20) for _ in range(10)} - {b""}), [text(50) for _ in range(10)]
                bounds = np.cumsum([0, *map(len, texts)])
                assert containing.Finder(containing.anchors(items))(b"".join(texts), bounds).tolist() == [any(i in t for i in items) for t in texts]


def test_function_words_and_wrappers():
    row = lambda code: pyast.function_rows(code)[0]
    method = 'class A:\n    def f(self):\n        """d"""\n        {}\n        {}\n'
    assert row(method.format("self.a()", "return x"))["is_wrapper"] and not row(method.format("y = 1", "return self.f(y)"))["is_wrapper"]
    assert row("def f():\n    x.attr = 'Two Words'\n    return plt")["body_tokens"] == ["plt", "two words", "x"]
    assert {"scheduler", "pebble"} <= set(filters.BODY_WORDS) and len(filters.BODY_WORDS) == 31


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    assert readers.json_lines(spark, f"{tmp_path}/a.json").count() == 2 and readers.json_lines(spark, f"{tmp_path}/b.jsonl").count() == 3
    (tmp_path / "src/.hid").mkdir(parents=True)
    (tmp_path / "src/ok.py").write_text("x = 1\n")
    (tmp_path / "src/bad.py").write_text("def (\n")
    (tmp_path / "src/.hid/no.py").write_text("x = 1\n")
    assert [p.rsplit("/", 1)[1] for p in values(readers.python_files(spark, f"{tmp_path}/src"), "path")] == ["ok.py"]
    (tmp_path / "reg.json").write_text('{"d": {"file_name": "b.jsonl", "columns": {"prompt": "x"}}}')
    info = readers.registry(f"{tmp_path}/reg.json", ["d"])["d"]
    assert readers.load_registered(spark, info, str(tmp_path)).columns == ["prompt"]
    with pytest.raises(ValueError):
        readers.registry(f"{tmp_path}/reg.json", ["nope"])
    with pytest.raises(ValueError):
        readers.check_data_options(mask_history=True, train_on_prompt=True)
    todo = spark.range(5).withColumnRenamed("id", "idx")
    out = f"{tmp_path}/done"
    assert sinks.resume(todo.limit(2), out, "idx", lambda d: d, 2).count() == 2
    assert sinks.resume(todo, out, "idx", lambda d: d).count() == 5
    assert sinks.cached_stage(spark, f"{tmp_path}/c", lambda: todo).count() == sinks.cached_stage(spark, f"{tmp_path}/c", lambda: 1 / 0).count()
    kinds = readers.tagged_functions(spark.createDataFrame([("f", None), (None, "m")], "function_id string, method_id string"))
    assert values(kinds, "kind") == ["function", "method"]


def test_runners_and_rounds(spark):
    assert run_script("print(1)")[:2] == ("success", "1\n")
    assert run_script("raise ValueError('x')")[0] == "error"
    assert run_script("while True: pass", seconds=1)[0] == "timeout"
    df = spark.createDataFrame([(1, "x = 1"), (2, "def ("), (3, None)], "i int, s string")
    assert [r.exec["status"] if r.exec else None for r in executed(df, "s").orderBy("i").collect()] == ["success", "error", None]
    prompts = spark.createDataFrame([("a", "p"), ("b", "q")], "key string, prompt string")
    cache = spark.createDataFrame([("a", "p", ["hit"], None)], "key string, prompt string, answers array<string>, error string")
    assert {r.key: r.answers == ["hit"] for r in cached_calls(prompts, cache).collect()} == {"a": True, "b": False}

    def broken(prompt, n):
        raise RuntimeError("down")

    assert cached_calls(prompts, cache.limit(0), broken).where("answers is null and error is not null").count() == 2
    work = spark.createDataFrame([(1, 0), (2, 1), (3, 9)], "idx int, need int")
    state = {"r": -1}

    def generate(d):
        state["r"] += 1
        return d.withColumn("level", F.lit(state["r"]))

    out = run_rounds(work, Workspace(spark, "t"), generate, lambda d: d.withColumn("good", F.col("need") <= F.col("level")), rounds=3, enough=0.6)
    assert sorted(values(out, "idx", "good", "round")) == [(1, True, 0), (2, True, 1), (3, False, 1)]


def test_streaming_stage(spark, tmp_path):
    from quarry.streaming.stages import parquet_stream, run_available

    spark.range(4).write.parquet(f"{tmp_path}/in")
    run_available(parquet_stream(spark, f"{tmp_path}/in", "id bigint"), lambda d: d.where("id > 1"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_partitioning_does_not_matter(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("g"))
        got = sorted(values(sampling.stratified_sample(df, ["g"], 4, "id"), "id"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    import hashlib

    want = sorted(i for g in range(3) for i in sorted(range(g, 200, 3), key=lambda i: hashlib.md5(f"0|{i}".encode()).hexdigest())[:4])
    assert got == want


def test_hot_keys_of_look_ups_are_split(spark):
    from quarry.plans.sized import look_up

    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        ws = Workspace(spark, "t")
        rows = ws.save(spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.md5(F.col("id").cast("string")).alias("v")).repartition(8), "rows")
        table = rows.groupBy("k").agg(F.min("v").alias("low"))
        split = look_up(rows, ws.save(table, "table"), ["k"], max_rows=10)
        assert split.count() == 200_000
        joined = split.groupBy().agg(F.max("low"), F.max("v"))
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        assert look_up(rows, ws.save(table.limit(5), "few"), ["k"]).count() >= 0
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
