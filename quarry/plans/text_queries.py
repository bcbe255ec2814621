"""Registered queries over text functions, scores and graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import codetext
from quarry.functions import text as T
from quarry.functions.names import base_idx, canonical_label, canonical_repo
from quarry.functions.prompts import PROMPTS, few_shot_messages, prompt
from quarry.functions.pyast import per_row
from quarry.operators import chat, evaluation, filters, graph, joins, metrics, retrieval, sampling, slicing
from quarry.operators.ranking import rank_within
from quarry.plans.queries import _EDGES, _SRC, BASE, REPO, RUNS, context_files, query, runs, table
from quarry.plans.sized import spread
from quarry.workspace import Workspace

RECORDS = "checked_test_set_final"
_STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_BLOCKS = r"""b AS (SELECT *, regexp_extract_all(orig_context, '(?s)```(\w*)\n(.*?)\n```', 2) AS bs FROM checked_test_set_final WHERE orig_context IS NOT NULL)"""


@query(rf"""WITH p AS (SELECT doc_id, text, list_transform(string_split(text, '```python')[2:], lambda x: {_STRIP.format(c="string_split(x, '```')[1]")}) AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(p)::INT AS pieces, md5(CASE WHEN len(p) > 0 THEN array_to_string(p, chr(10) || chr(10)) ELSE text END) AS code_md5 FROM p""")
def joined_code(s, d):
    t = table(s, d, "documents").where("text is not null")
    return t.select("doc_id", F.size(T.code_pieces("text")).alias("pieces"), F.md5(T.joined_code_pieces("text")).alias("code_md5"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: contains(l[i], '```')) AS m FROM l)
SELECT doc_id, md5(CASE WHEN len(m) >= 2 THEN array_to_string(l[m[1] + 1:m[2] - 1], chr(10)) END) AS body_md5 FROM m""")
def fence_lines(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(T.between_fence_lines("text")).alias("body_md5"))


@query("WITH " + _BLOCKS + """,
h AS (SELECT record_id, func_path, bs, list_transform(bs, lambda x: list_filter(string_split(x, chr(10)), lambda l: starts_with(trim(l, ' '), '#'))[1]) AS h FROM b),
f AS (SELECT *, list_position(list_transform(h, lambda x: x IS NULL OR contains(x, func_path)), true) AS p FROM h)
SELECT record_id, CASE WHEN h[p] IS NOT NULL THEN md5(bs[p]) END AS body_md5 FROM f""")
def block_of_path(s, d):
    t = table(s, d, RECORDS).where("orig_context is not null")
    return t.select("record_id", F.md5(T.block_by_path(T.fenced_blocks("orig_context"), F.col("func_path"))).alias("body_md5"))


@query("WITH " + _BLOCKS + """ SELECT record_id, i::INT AS pos, string_split(string_split(bs[i + 1], chr(10))[1], ' ')[2] AS title FROM b, unnest(range(len(bs))) AS u(i)""")
def block_titles(s, d):
    t = table(s, d, RECORDS).where("orig_context is not null").select("record_id", F.posexplode(T.fenced_blocks("orig_context")).alias("pos", "b"))
    return t.select("record_id", "pos", T.doc_title("b.body").alias("title"))


@query("WITH " + _BLOCKS + """,
x AS (SELECT record_id, list_transform(bs[:2], lambda x: 'From the file' || chr(10) || split_part(string_split(x, chr(10))[1], ' ', 2) || chr(10) || repeat('-', 50) || chr(10) || x || chr(10) || repeat('-', 50)) AS l FROM b WHERE len(bs) > 0)
SELECT record_id, md5('# ' || replace('Code of the same repository that may help:' || chr(10) || repeat('-', 50) || chr(10) || array_to_string(l, chr(10)), chr(10), chr(10) || '# ')) AS context_md5 FROM x""")
def wrapped_context(s, d):
    """The first two blocks of each context as commented text."""
    docs = F.transform(T.fenced_blocks("orig_context"), lambda b: F.struct(F.coalesce(T.doc_title(b["body"]), F.lit("")).alias("title"), b["body"].alias("text")))
    t = table(s, d, RECORDS).where("orig_context is not null").select("record_id", docs.alias("docs")).where("size(docs) > 0")
    return t.select("record_id", F.md5(T.wrap_context(retrieval.top_docs(F.col("docs"), 2))).alias("context_md5"))


@query(rf"""SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: '    ' || {_STRIP.format(c='x')}), chr(10))) AS text_md5 FROM documents WHERE text IS NOT NULL""")
def reindented_docs(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(T.reindent_docstring("text", "    ")).alias("text_md5"))


_CODE = r"list_filter(string_split({c}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '' AND NOT starts_with(regexp_replace(x, '^\s+|\s+$', '', 'g'), '#'))"


@query(f"""WITH l AS (SELECT record_id, {_CODE.format(c='eval_script')} AS p, {_CODE.format(c='orig_func')} AS t FROM checked_test_set_final WHERE eval_script IS NOT NULL AND orig_func IS NOT NULL)
SELECT record_id, len(t)::INT AS target_lines, md5(array_to_string(p[:len(t)], chr(10))) AS cut_md5 FROM l""")
def lines_like_target(s, d):
    t = table(s, d, RECORDS).where("eval_script is not null and orig_func is not null")
    n = F.size(T.code_lines("orig_func"))
    return t.select("record_id", n.alias("target_lines"), F.md5(T.first_code_lines("eval_script", n)).alias("cut_md5"))


@query(r"""SELECT record_id, md5(regexp_replace(eval_script, '(?s)\n[^\s].*$', '')) AS head_md5, md5(regexp_replace(eval_script, '#[^\n]*', '', 'g')) AS bare_md5,
 md5(regexp_replace(eval_script, '(?ms)^if __name__ *== *["'']__main__["''].*', '')) AS body_md5, regexp_extract(orig_func, '^([ \t]*)', 1) AS indent, md5(replace(eval_script, '"', '''')) AS quotes_md5
FROM checked_test_set_final WHERE eval_script IS NOT NULL""")
def script_parts(s, d):
    """Scripts cut after their first block, without comments, without main guard, with one kind of quotes; the function's indent."""
    t = table(s, d, RECORDS).where("eval_script is not null")
    return t.select("record_id", F.md5(T.cut_after_return("eval_script")).alias("head_md5"), F.md5(T.remove_hash_comments("eval_script")).alias("bare_md5"), F.md5(T.without_main("eval_script")).alias("body_md5"), T.leading_blank("orig_func").alias("indent"), F.md5(T.quotes_normalised("eval_script")).alias("quotes_md5"))


@query("""WITH l AS (SELECT record_id, i, x, sum(CASE WHEN contains(x, '\"\"\"') OR contains(x, '''''''') THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY i) AS t
FROM (SELECT record_id, unnest(string_split(eval_script, chr(10))) AS x, unnest(range(len(string_split(eval_script, chr(10))))) AS i FROM checked_test_set_final WHERE eval_script IS NOT NULL))
SELECT record_id, md5(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (t % 2 = 0), '')) AS text_md5 FROM l GROUP BY record_id""")
def without_docstrings(s, d):
    return table(s, d, RECORDS).where("eval_script is not null").select("record_id", F.md5(T.without_docstrings("eval_script")).alias("text_md5"))


@query("""SELECT record_id, array_to_string(string_split(m, '.')[greatest(len(string_split(m, '.')) - 1, 1):], '.') AS last_two, string_split(m, '.')[-1] AS last_one, replace(m, '.', '/') || '.py' AS path
FROM (SELECT record_id, regexp_replace(regexp_replace(replace(func_path, '/', '.'), '\\.py$', ''), '^\\.+', '') AS m FROM checked_test_set_final WHERE func_path IS NOT NULL)""")
def module_names(s, d):
    t = table(s, d, RECORDS).where("func_path is not null").select("record_id", T.path_module("func_path").alias("m"))
    return t.select("record_id", T.last_parts("m", 2).alias("last_two"), T.last_parts("m", 1).alias("last_one"), T.module_path("m").alias("path"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: starts_with(regexp_replace(x, '^\s+|\s+$', '', 'g'), '>>>')), true) AS p FROM l),
q AS (SELECT doc_id, CASE WHEN len(l) > 5 AND p > 1 THEN l[:p - 1] ELSE l END AS l FROM p),
r AS (SELECT doc_id, l, list_filter(range(3, len(l) + 1), lambda i: starts_with(regexp_replace(l[i], '^\s+|\s+$', '', 'g'), '.. '))[1] AS k FROM q),
t AS (SELECT doc_id, CASE WHEN k IS NOT NULL THEN l[:k - 1] ELSE l END AS l FROM r)
SELECT doc_id, md5(array_to_string(CASE WHEN len(l) > 10 THEN l[:3] ELSE l END, chr(10))) AS short_md5 FROM t""")
def short_docs(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(T.truncate_doc("text")).alias("short_md5"))


@query(rf"""SELECT idx, script_key, run_at, nullif(regexp_extract(stderr, 'No module named ''([^''.]+)', 1), '') AS missing_module FROM {RUNS}""")
def missing_modules(s, d):
    return runs(s, d).select("idx", "script_key", "run_at", T.missing_module("stderr").alias("missing_module"))


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN contains(text, 'short test summary info') THEN string_split(text, 'short test summary info')[-1] ELSE '' END AS tail FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_sort(list_distinct(regexp_extract_all(tail, '(?m)^(?:FAILED|ERROR)\s+([^\s:]+)', 1))) AS files FROM t""")
def failed_test_files(s, d):
    t = table(s, d, "documents").where("text is not null")
    tail = F.when(F.contains("text", F.lit("short test summary info")), F.substring_index("text", "short test summary info", -1)).otherwise("")
    return t.select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all(tail, F.lit(r"(?m)^(?:FAILED|ERROR)\s+([^\s:]+)"), F.lit(1)))).alias("files"))


@query(f"""WITH m AS (SELECT base, list_sort(list_distinct(flatten(list(coverage_missing_lines)))) AS m FROM {RUNS} WHERE base IS NOT NULL AND coverage_missing_lines IS NOT NULL GROUP BY base),
r AS (SELECT record_id, eval_script, {BASE} AS base FROM checked_test_set_final WHERE eval_script IS NOT NULL),
l AS (SELECT record_id, m, unnest(string_split(eval_script, chr(10))) AS x, unnest(range(1, len(string_split(eval_script, chr(10))) + 1)) AS i FROM r JOIN m ON r.base = m.base)
SELECT record_id, md5(string_agg(CASE WHEN list_contains(m, i) THEN regexp_extract(x, '^[ \\t\\r\\f\\v]*') || '# UNEVALUATED BRANCH' || chr(10) || x ELSE x END, chr(10) ORDER BY i)) AS text_md5,
 md5(string_agg(CASE WHEN (i >= 3 AND i <= 6) OR regexp_replace(x, '\\s+', '', 'g') = '' THEN x ELSE x || '  # pragma: no cover' END, chr(10) ORDER BY i)) AS pragma_md5 FROM l GROUP BY record_id""")
def annotated_scripts(s, d):
    """Scripts with a note above each line that no run of their base reached, and with lines 3 to 6 alone to be covered."""
    m = runs(s, d).where("base is not null and coverage_missing_lines is not null").select("base", F.explode("coverage_missing_lines").alias("n")).groupBy("base").agg(F.array_sort(F.collect_set("n")).alias("m"))
    none = runs(s, d).where("base is not null and coverage_missing_lines is not null").select("base").distinct()
    m = none.join(m, "base", "left").select("base", F.coalesce("m", F.array().cast("array<int>")).alias("m"))
    r = table(s, d, RECORDS).where("eval_script is not null").select("record_id", "eval_script", base_idx("idx").alias("base")).join(m, "base")
    noted = per_row(lambda t, ns: codetext.with_unevaluated(t, list(ns) if ns is not None else None), "string", "eval_script", "m")
    return r.select("record_id", F.md5(noted).alias("text_md5"), F.md5(per_row(lambda t: codetext.with_pragmas(t, 2, 5), "string", "eval_script")).alias("pragma_md5"))


def _sql_text(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _sql_prompt(name: str, **slots: str) -> str:
    out = _sql_text(PROMPTS[name])
    for k, v in slots.items():
        out = f"replace({out}, '{{{{{k}}}}}', coalesce({v}, ''))"
    return out


_SLOTS = {"func_name": "func_name", "code": "orig_func", "test_func_name": "('test_' || string_split(func_name, '.')[-1])", "context": "orig_context", "err_msg": "coverage_report", "missing_code": "coverage_report", "orig_func": "orig_func", "new_code": "eval_script", "buggy_solution": "orig_func", "error_msg": "coverage_report", "solution": "orig_func", "reasoning": "sandbox_functionality_check.reasoning"}
_USED = {n: {k: v for k, v in _SLOTS.items() if "{{" + k + "}}" in t} for n, t in PROMPTS.items()}


@query(" UNION ALL ".join(f"SELECT record_id, '{n}' AS prompt, md5({_sql_prompt(n, **slots)}) AS text_md5 FROM checked_test_set_final" for n, slots in _USED.items()))
def prompts(s, d):
    """All prompts of the pipeline for every record."""
    cols = {k: F.concat(F.lit("test_"), T.function_part("func_name")) if k == "test_func_name" else F.col(v) for k, v in _SLOTS.items()}
    each = [F.struct(F.lit(n).alias("prompt"), F.md5(prompt(n, **{k: cols[k] for k in slots})).alias("text_md5")) for n, slots in _USED.items()]
    return table(s, d, RECORDS).select("record_id", F.explode(F.array(*each)).alias("p")).select("record_id", "p.prompt", "p.text_md5")


@query(f"""WITH f AS (SELECT record_id, func_name, orig_func AS instruction, eval_script AS generation, coverage_report AS error FROM checked_test_set_final)
SELECT record_id, 4 AS n_messages, md5('Continue this code:' || chr(10) || chr(10) || '```' || chr(10) || coalesce(instruction, '') || chr(10) || '```') AS plain_md5,
 md5({_sql_prompt('debug', func_name='func_name', context='instruction', buggy_solution='generation', error_msg='error')}) AS debug_md5,
 md5({_sql_prompt('debug_reasoning', func_name='func_name', context='instruction', buggy_solution='generation', error_msg='error')}) AS reasoning_md5 FROM f""")
def few_shot_chats(s, d):
    t = table(s, d, RECORDS).select("record_id", "func_name", F.col("orig_func").alias("instruction"), F.col("eval_script").alias("generation"), F.col("coverage_report").alias("error"))
    c = lambda **o: few_shot_messages(F.col("instruction"), F.col("func_name"), F.col("generation"), F.col("error"), **o)
    said = lambda m: F.md5(F.element_at(m, -1)["content"])
    return t.select("record_id", F.size(c()).alias("n_messages"), said(c()).alias("plain_md5"), said(c(debug=True)).alias("debug_md5"), said(c(debug=True, reasoning=True)).alias("reasoning_md5"))


_OUT = r"exec_result[2]"
_LINES = r"list_transform(string_split(regexp_replace({c}, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
_PARTS = r"string_split_regex(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\s+')"


@query(f"""WITH r AS (SELECT base, script_key, run_at, {_OUT} AS o FROM {RUNS} WHERE base IS NOT NULL AND {_OUT} IS NOT NULL),
p AS (SELECT a.base, a.script_key AS key_a, b.script_key AS key_b, a.run_at AS at_a, b.run_at AS at_b, a.o AS x, b.o AS y FROM r a JOIN r b ON a.base = b.base WHERE a.run_at < b.run_at),
n AS (SELECT *, list_transform({_PARTS.format(c='x')}, lambda v: TRY_CAST(v AS DOUBLE)) AS nx, list_transform({_PARTS.format(c='y')}, lambda v: TRY_CAST(v AS DOUBLE)) AS ny FROM p)
SELECT base, key_a, key_b, at_a, at_b, coalesce({_STRIP.format(c='x')} = {_STRIP.format(c='y')} OR {_LINES.format(c='x')} = {_LINES.format(c='y')}
 OR list_filter({_LINES.format(c='x')}, lambda v: v <> '') = list_filter({_LINES.format(c='y')}, lambda v: v <> '')
 OR (len(nx) = len(ny) AND len(list_filter(range(1, len(nx) + 1), lambda i: coalesce(abs(nx[i] - ny[i]) <= 1e-8 + 1e-5 * abs(ny[i]), false))) = len(nx))
 OR list_sort(list_distinct({_PARTS.format(c='x')})) = list_sort(list_distinct({_PARTS.format(c='y')})), false) AS agree FROM n""")
def outputs_agree(s, d):
    """Whether the output of a run answers that of a later run of the same base."""
    r = runs(s, d).select("base", "script_key", "run_at", F.get("exec_result", F.lit(1)).alias("o")).where("base is not null and o is not null")
    a, b = (r.select("base", F.col("script_key").alias(f"key_{x}"), F.col("run_at").alias(f"at_{x}"), F.col("o").alias(f"o_{x}")) for x in "ab")
    return a.join(b, "base").where("at_a < at_b").select("base", "key_a", "key_b", "at_a", "at_b", metrics.answers_agree(F.col("o_a"), F.col("o_b")).alias("agree"))


@query("""WITH p AS (SELECT record_id, list_transform(string_split(func_name, ''), lambda c: unicode(c)) AS p, list_transform(string_split(lower(func_name), ''), lambda c: CASE WHEN c = '_' THEN -100 ELSE unicode(c) END) AS l FROM checked_test_set_final WHERE func_name IS NOT NULL),
k AS (SELECT record_id, list_filter(range(1, least(len(p), len(l))), lambda i: l[i + 1] <> -100) AS k, p, l FROM p)
SELECT record_id, round(CASE WHEN len(k) > 0 THEN len(list_filter(k, lambda i: p[i] = l[i + 1]))::DOUBLE / len(k) END, 9) AS accuracy FROM k""")
def token_accuracy(s, d):
    """Names as predictions of their own lower-case form, underscores ignored."""
    t = table(s, d, RECORDS).where("func_name is not null")
    labels = F.transform(chat.code_points(F.lower("func_name")), lambda x: F.when(x == 95, F.lit(chat.IGNORE)).otherwise(x))
    return t.select("record_id", F.round(metrics.token_accuracy(chat.code_points(F.col("func_name")), labels), 9).alias("accuracy"))


_PAIRED = f"(SELECT {BASE} AS base, min(CASE WHEN isnan(coverage_rate) THEN NULL ELSE coverage_rate END) AS rejected, max(CASE WHEN isnan(coverage_rate) THEN NULL ELSE coverage_rate END) AS chosen FROM checked_test_set_final GROUP BY 1)"


@query(f"SELECT round(avg((chosen > rejected)::INT), 9) AS accuracy FROM {_PAIRED}")
def reward_accuracy(s, d):
    rate = F.nanvl("coverage_rate", F.lit(None).cast("double"))
    t = table(s, d, RECORDS).groupBy(base_idx("idx").alias("base")).agg(F.min(rate).alias("rejected"), F.max(rate).alias("chosen"))
    return metrics.reward_accuracy(t).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH r AS (SELECT base, list(CASE status WHEN 'success' THEN 1 WHEN 'error' THEN -1 WHEN 'timeout' THEN -2 END) AS results FROM {RUNS} WHERE base IS NOT NULL GROUP BY base)
SELECT base, len(results)::INT AS cases, len(list_filter(results, lambda x: coalesce(x > 0, false))) = len(results) AS passed FROM r""")
def all_cases_pass(s, d):
    code = F.when(F.col("status") == "success", 1).when(F.col("status") == "error", -1).when(F.col("status") == "timeout", -2)
    r = runs(s, d).where("base is not null").groupBy("base").agg(F.collect_list(F.struct(code.alias("c"))).alias("r"))
    r = r.select("base", F.transform("r", lambda x: x["c"]).alias("results"))
    return r.select("base", F.size("results").alias("cases"), metrics.all_cases_pass(F.col("results")).alias("passed"))


@query(f"""WITH l AS (SELECT {BASE} AS base, {_CODE.format(c='eval_script')} AS p, {_CODE.format(c='orig_func')} AS t, 1 - levenshtein(func_name, func_path)::DOUBLE / greatest(len(func_name), len(func_path)) AS es FROM checked_test_set_final WHERE eval_script IS NOT NULL AND orig_func IS NOT NULL),
s AS (SELECT base, arg_max(status, struct_pack(a := run_at, b := script_key)) AS status FROM {RUNS} WHERE base IS NOT NULL AND status IS NOT NULL GROUP BY base)
SELECT round(avg((array_to_string(p[:len(t)], chr(10)) = array_to_string(t, chr(10)))::INT), 9) AS em, round(avg(es), 9) AS es, round(avg((status = 'success')::INT), 9) AS pass_1,
 count(status) AS computed, count_if(status = 'timeout')::BIGINT AS timeouts FROM l LEFT JOIN s ON l.base = s.base""")
def repo_summary(s, d):
    """Scripts against functions line by line, names against paths, and the state of the last run of their base."""
    t = table(s, d, RECORDS).where("eval_script is not null and orig_func is not null")
    y = T.code_lines("orig_func")
    t = t.select(base_idx("idx").alias("base"), T.first_code_lines("eval_script", F.size(y)).alias("x"), F.array_join(y, "\n").alias("y"), "func_name", "func_path")
    last = runs(s, d).where("base is not null and status is not null").groupBy("base").agg(F.max_by("status", F.struct("run_at", "script_key")).alias("status"))
    r = t.join(last, "base", "left").select(metrics.exact_match(F.col("x"), F.col("y")).alias("em"), metrics.edit_similarity(F.col("func_name"), F.col("func_path")).alias("es"), "status")
    return metrics.repo_summary(r).withColumns({c: F.round(c, 9) for c in ("em", "es", "pass_1")})


@query(f"""WITH r AS (SELECT base, CASE WHEN status IS NOT NULL THEN status = 'success' END AS valid, (status = 'success')::INT AS passed, (status = 'error')::INT AS failed, (status = 'timeout')::INT AS errored, CASE WHEN isnan(coverage_rate) THEN NULL ELSE coverage_rate * 100 END AS bc FROM {RUNS}),
t AS (SELECT *, coalesce(passed, 0) + coalesce(failed, 0) + coalesce(errored, 0) AS total FROM r)
SELECT count(DISTINCT base) AS functions, count(DISTINCT CASE WHEN valid IS NOT NULL THEN base END) AS runnable, count(DISTINCT CASE WHEN valid THEN base END) AS valid,
 round(count(DISTINCT CASE WHEN valid THEN base END) * 100.0 / count(DISTINCT base), 6)::DOUBLE AS valid_percent, round(avg(CASE WHEN valid THEN bc END), 6) AS branch_coverage, round(sum(passed)::DOUBLE / sum(total), 6) AS pass_ratio,
 count_if(valid IS NOT NULL AND total > 0 AND failed = total)::BIGINT AS all_failed, count_if(valid IS NOT NULL AND total > 0 AND errored = total)::BIGINT AS all_errored FROM t""")
def test_summary(s, d):
    is_ = lambda x: (F.col("status") == x).cast("int")
    r = runs(s, d).select(F.col("base").alias("id"), (F.col("status") == "success").alias("valid"), is_("success").alias("passed"), is_("error").alias("failed"), is_("timeout").alias("errored"), (F.nanvl("coverage_rate", F.lit(None).cast("double")) * 100).alias("branch_coverage"))
    return evaluation.test_summary(r).withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("valid_percent", "branch_coverage", "pass_ratio")})


@query(f"""SELECT round(avg(n), 9) AS mean, round(stddev_pop(n), 9) AS std, count_if(n = 1)::BIGINT AS one, count_if(n = 2)::BIGINT AS two, count_if(n > 5)::BIGINT AS over_5, count_if(n > 10)::BIGINT AS over_10 FROM (SELECT count(*) AS n FROM {_EDGES} GROUP BY repo_id, caller)""")
def callee_distribution(s, d):
    return metrics.count_distribution(graph.callee_counts(graph.edges(table(s, d, "call_graphs"))), "n_callees").withColumns({c: F.round(c, 9) for c in ("mean", "std")})


@query("SELECT repo_id FROM repos ORDER BY md5('0|' || repo_id), repo_id LIMIT 20")
def repo_sample(s, d):
    """Twenty repositories in random order: the size of the sample is the feature."""
    return sampling.sample_exact(table(s, d, "repos").select("repo_id"), 20, "repo_id")


@query(f"""WITH r AS (SELECT doc_id, {_SRC} AS src, row_number() OVER (PARTITION BY {_SRC} ORDER BY doc_id) - 1 AS rk FROM documents WHERE source IS NOT NULL)
SELECT doc_id, src, round((rk + 0.5) / CASE src WHEN 'readme' THEN 3.0 WHEN 'issue' THEN 2.0 WHEN 'code' THEN 1.0 END, 6)::DOUBLE AS place FROM r WHERE src IN ('readme', 'issue', 'code')""")
def interleave_by_weight(s, d):
    t = table(s, d, "documents").where("source is not null").select("doc_id", canonical_label("source").alias("src"))
    return sampling.interleave_by_weight(t, "src", ["doc_id"], {"readme": 3.0, "issue": 2.0, "code": 1.0}, Workspace(s, "weights")).select("doc_id", "src", F.round("place", 6).alias("place"))


@query(f"""WITH q AS (SELECT {BASE} AS base, record_id, len(func_name) AS a, len(orig_func) AS b FROM checked_test_set_final WHERE func_name IS NOT NULL AND orig_func IS NOT NULL)
SELECT base, record_id, round(a::DOUBLE / (a + b), 9) AS score, row_number() OVER (PARTITION BY base ORDER BY a::DOUBLE / (a + b) DESC, record_id)::INT AS place FROM q WHERE base IS NOT NULL""")
def reranked(s, d):
    t = table(s, d, RECORDS).where("func_name is not null and orig_func is not null").select(base_idx("idx").alias("base"), "record_id", F.col("func_name").alias("query_value"), F.col("orig_func").alias("doc_value")).where("base is not null")
    out = retrieval.rerank(t, "base", "record_id", lambda q, x: F.length(q) / (F.length(q) + F.length(x)))
    return out.select("base", "record_id", F.round("score", 9).alias("score"), "place")


@query(f"""SELECT record_id, row_number() OVER (ORDER BY repo NULLS FIRST, base NULLS FIRST, record_id) - 1 AS place FROM (SELECT record_id, {REPO} AS repo, TRY_CAST({BASE} AS BIGINT) AS base FROM checked_test_set_final)""")
def sorted_records(s, d):
    """The place of each record by repository, then by the number of its base."""
    t = table(s, d, RECORDS).select("record_id", canonical_repo("repo_name").alias("repo"), base_idx("idx").try_cast("bigint").alias("base"), F.lit(0).alias("all"))
    return rank_within(t, ["all"], ["repo", "base", "record_id"], Workspace(s, "sorted")).select("record_id", F.col("rank").alias("place"))


@query(r"""SELECT doc_id FROM documents WHERE len(list_intersect(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> ''), ['test', 'transformer', 'training', 'https', 'http', 'todo'])) > 0""")
def docs_with_words(s, d):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    return table(s, d, "documents").where(F.arrays_overlap(words, F.array(*map(F.lit, filters.DOC_WORDS)))).select("doc_id")


@query("""WITH f AS (SELECT record_id, string_split(func_name, '.')[-1] AS n FROM checked_test_set_final WHERE func_name IS NOT NULL)
SELECT record_id, NOT starts_with(n, '__') AS dunder_ok, NOT regexp_matches(lower(n), '^(test|train_|main|demo|example|render_pep|_init)') AS name_ok FROM f""")
def function_names_kept(s, d):
    """The two name rules of the function filter, each with all others switched off."""
    t = table(s, d, RECORDS).where("func_name is not null").select("record_id", T.function_part("func_name").alias("name"), F.lit("function").alias("kind"))
    every = {"dunder", "docstring", "literal_return", "decorators", "doc_words", "body_words", "names", "arguments", "statements", "wrapper", "lines"}
    t = t.withColumns({"docstring": F.lit(""), "n_returns": F.lit(0), "n_literal_returns": F.lit(0), "decorators": F.array().cast("array<string>"), "doc_tokens": F.array().cast("array<string>"), "body_tokens": F.array().cast("array<string>"), "n_args": F.lit(1), "n_statements": F.lit(3), "is_wrapper": F.lit(False), "n_code_lines": F.lit(1)})
    only = lambda x: filters.function_keep(F.col("kind"), frozenset(every - {x}))
    return t.select("record_id", only("dunder").alias("dunder_ok"), only("names").alias("name_ok"))


_TYPES = "(SELECT repo_id, unnest(map_keys(id2type)) AS id, unnest(map_values(id2type)) AS type FROM call_graphs)"


@query(f"""WITH c AS (SELECT repo_id, caller AS id, count(*) AS n FROM {_EDGES} GROUP BY 1, 2), g AS (SELECT DISTINCT repo_id FROM call_graphs),
f AS (SELECT DISTINCT lower(repo_id) AS r, repo_id, id FROM {_TYPES} WHERE type IN ('FUNCTION', 'METHOD') UNION SELECT lower(repo_id), repo_id, 'x' FROM repos)
SELECT f.repo_id, f.id AS function_id FROM f LEFT JOIN c ON f.repo_id = c.repo_id AND f.id = c.id LEFT JOIN g ON f.repo_id = g.repo_id WHERE g.repo_id IS NULL OR coalesce(n, 0) > 0""")
def functions_with_callees(s, d):
    """Functions without callees go, but not those of repositories without a graph."""
    g = table(s, d, "call_graphs")
    f = g.select("repo_id", F.explode("id2type").alias("function_id", "type")).where("type in ('FUNCTION', 'METHOD')").select("repo_id", "function_id")
    f = f.unionByName(table(s, d, "repos").select("repo_id", F.lit("x").alias("function_id"))).distinct()
    return filters.callee_keep(f, graph.callee_counts(graph.edges(g)), g).select("repo_id", "function_id")


@query("WITH " + _BLOCKS + """,
x AS (SELECT record_id, bs, replace(func_path, '/', '-') AS name, string_split(orig_func, chr(10))[1] AS ref FROM b)
SELECT record_id, len(list_filter(bs, lambda t: NOT coalesce(contains(replace(coalesce(string_split(string_split(t, chr(10))[1], ' ')[2], ''), '/', '-'), name) AND contains(t, ref), false)))::INT AS n_kept, len(bs)::INT AS n_docs FROM x""")
def decontaminated_docs(s, d):
    """Blocks of the target's own file that hold its first line go."""
    t = table(s, d, RECORDS).where("orig_context is not null")
    docs = F.transform(T.fenced_blocks("orig_context"), lambda b: F.struct(F.replace(F.coalesce(T.doc_title(b["body"]), F.lit("")), F.lit("/"), F.lit("-")).alias("title"), b["body"].alias("text")))
    kept = filters.decontaminate_docs(docs, F.substring_index("orig_func", "\n", 1), F.split("func_path", "/"))
    return t.select("record_id", F.size(kept).alias("n_kept"), F.size(docs).alias("n_docs"))


@query(f"SELECT e.repo_id, e.caller, e.callee FROM {_EDGES} e JOIN (SELECT DISTINCT repo_id, id FROM {_TYPES}) t ON e.repo_id = t.repo_id AND e.caller = t.id")
def resolved_callers(s, d):
    g = table(s, d, "call_graphs")
    return graph.drop_unresolved(graph.edges(g), g.select("repo_id", F.explode("id2type").alias("id", "type"))).select("repo_id", "caller", "callee")


_LAST = r"regexp_replace({c}, '\.[^.]*$', '')"


@query(f"""WITH k AS (SELECT DISTINCT repo_id, id FROM {_TYPES} WHERE type <> 'OTHER'),
e AS (SELECT repo_id, caller, callee, string_split(callee, '.')[1] AS name, substr(callee, len(string_split(callee, '.')[1]) + 1) AS rest, {_LAST.format(c='caller')} AS module FROM {_EDGES}),
i AS (SELECT e.repo_id, e.module, e.name, min(regexp_replace(k.id, '\\.[^.]*$', '')) AS target FROM e JOIN k ON e.repo_id = k.repo_id AND string_split(k.id, '.')[1] = e.name GROUP BY ALL),
r AS (SELECT e.*, target || rest AS other FROM e LEFT JOIN i ON e.repo_id = i.repo_id AND e.module = i.module AND e.name = i.name),
t AS (SELECT r.repo_id, r.caller, r.callee, r.other, o.id IS NOT NULL AS own, f.id IS NOT NULL AS far FROM r LEFT JOIN k o ON o.repo_id = r.repo_id AND o.id = r.callee LEFT JOIN k f ON f.repo_id = r.repo_id AND f.id = r.other)
SELECT count_if(own)::BIGINT AS retained, count_if(NOT own AND far)::BIGINT AS normalized, count_if(NOT own AND NOT far)::BIGINT AS unnormalized, count_if(NOT own)::BIGINT AS unresolved FROM t""")
def callee_normalisation(s, d):
    """Callees that are no known id, resolved through what their first part means in the caller's file."""
    g = table(s, d, "call_graphs")
    known = g.select("repo_id", F.explode("id2type").alias("id", "type")).where("type <> 'OTHER'").select("repo_id", "id").distinct()
    e = graph.edges(g)
    names = e.select("repo_id", F.regexp_replace("caller", r"\.[^.]*$", "").alias("module"), F.substring_index("callee", ".", 1).alias("name")).distinct()
    given = known.select("repo_id", F.substring_index("id", ".", 1).alias("name"), F.regexp_replace("id", r"\.[^.]*$", "").alias("target"))
    return graph.normalised_callees(e, known, names.join(given, ["repo_id", "name"]).select("repo_id", "module", "name", "target"))[1]


@query(f"""WITH n AS (SELECT DISTINCT repo_id, id FROM {_TYPES}), t AS (SELECT repo_id, id, list(type) AS ts FROM {_TYPES} GROUP BY 1, 2)
SELECT n.repo_id, n.id, CASE WHEN starts_with(n.id, '<builtin>') THEN 'BUILTIN' WHEN list_contains(ts, 'FUNCTION') THEN 'FUNCTION' WHEN list_contains(ts, 'CLASS') THEN 'CLASS' WHEN list_contains(ts, 'METHOD') THEN 'METHOD'
 WHEN string_split(n.id, '.')[1] IN ('os', 'json', 're', 'numpy', 'pandas') THEN 'API' ELSE 'OTHER' END AS type FROM n JOIN t ON n.repo_id = t.repo_id AND n.id = t.id""")
def looked_up_types(s, d):
    t = table(s, d, "call_graphs").select("repo_id", F.explode("id2type").alias("id", "type"))
    modules = s.createDataFrame([(m,) for m in ("os", "json", "re", "numpy", "pandas")], "module string")
    return graph.id_type(t.select("repo_id", "id").distinct(), *(t.where(F.col("type") == k) for k in ("FUNCTION", "METHOD", "CLASS")), modules).select("repo_id", "id", "type")


@query(f"""WITH c AS (SELECT DISTINCT repo_id, id FROM {_TYPES} WHERE type = 'CLASS'),
a AS (SELECT repo_id, caller AS id, callee FROM {_EDGES} UNION SELECT e.repo_id, c.id, e.callee FROM {_EDGES} e JOIN c ON e.repo_id = c.repo_id AND c.id = {_LAST.format(c='e.caller')})
SELECT repo_id, id, list_sort(list(DISTINCT callee)) AS callees FROM a GROUP BY 1, 2""")
def callees_of_classes(s, d):
    g = table(s, d, "call_graphs")
    return graph.expanded_callees(graph.edges(g), g.select("repo_id", F.explode("id2type").alias("id", "type")))


_MODULE = "regexp_replace(regexp_replace(replace(func_path, '/', '.'), '\\.py$', ''), '^\\.+', '')"


@query(f"""WITH m AS (SELECT DISTINCT {_MODULE} || '.' || func_name AS method_id, coverage_rate FROM checked_test_set_final WHERE contains(func_name, '.')),
c AS (SELECT DISTINCT regexp_replace(method_id, '\\.[^.]*$', '') AS class_id FROM m WHERE coverage_rate = 1)
SELECT DISTINCT class_id, method_id FROM c JOIN m ON class_id = regexp_replace(method_id, '\\.[^.]*$', '')""")
def class_methods(s, d):
    """Methods of the classes of which one method is covered in full."""
    m = table(s, d, RECORDS).where("contains(func_name, '.')").select(F.concat_ws(".", T.path_module("func_path"), "func_name").alias("method_id"), "coverage_rate")
    c = m.where("coverage_rate = 1").select(F.regexp_replace("method_id", r"\.[^.]*$", "").alias("class_id"))
    return joins.methods_of_classes(c, m.select("method_id").distinct())


@query("WITH " + _BLOCKS + """,
l AS (SELECT record_id, i, coalesce(nullif(string_split(string_split(bs[i], chr(10))[1], ' ')[2], ''), '?') AS path, bs[i] AS body FROM b, unnest(range(1, len(bs) + 1)) AS u(i))
SELECT record_id AS target, md5(string_agg('```python' || chr(10) || '## ' || path || chr(10) || body || chr(10) || '```', chr(10) ORDER BY i)) AS context_md5 FROM l GROUP BY record_id""")
def rendered_slices(s, d):
    """Statements (here: lines) put together again as one fenced block for each file."""
    t = table(s, d, RECORDS).where("orig_context is not null").select("record_id", F.posexplode(T.fenced_blocks("orig_context")).alias("file_pos", "b"))
    t = t.select(F.col("record_id").alias("target"), "file_pos", F.coalesce(F.nullif(T.doc_title("b.body"), F.lit("")), F.lit("?")).alias("path"), F.posexplode(T.lines("b.body")).alias("pos", "code"))
    return graph.render_slice(t).select("target", F.md5("context").alias("context_md5"))


@query(f"""WITH i AS (SELECT idx, row_number() OVER (ORDER BY idx) AS pos, {BASE} AS base FROM generations),
r AS (SELECT base, arg_min(status, struct_pack(a := run_at, b := script_key, c := idx)) AS status FROM {RUNS} WHERE base IS NOT NULL GROUP BY base)
SELECT i.base, r.status FROM i JOIN r ON i.base = r.base""")
def first_runs_in_order(s, d):
    """For each generated row, in order, the first run of its base."""
    i = table(s, d, "generations").select(base_idx("idx").alias("base"), F.col("idx").alias("pos"))
    r = runs(s, d).where("base is not null").select("base", "status", F.struct("run_at", "script_key", "idx").alias("result_pos"))
    first = r.groupBy("base").agg(F.min("result_pos").alias("result_pos"))
    r = r.join(first, ["base", "result_pos"]).select("base", F.coalesce("status", F.lit(None).cast("string")).alias("status"), F.col("result_pos.run_at").alias("at")).dropDuplicates(["base"])
    return joins.first_match_in_order(i, r, "base", "pos", "at").select("base", "status")


@query(f"""WITH m AS (SELECT DISTINCT {_LAST.format(c='caller')} AS m FROM {_EDGES}), c AS (SELECT DISTINCT callee FROM {_EDGES}),
p AS (SELECT callee, (SELECT m FROM m WHERE m = callee) AS a, (SELECT m FROM m WHERE m = {_LAST.format(c='callee')}) AS b, (SELECT m FROM m WHERE m = string_split(callee, '.')[1]) AS c FROM c)
SELECT callee, coalesce(a, b, c) AS module FROM p""")
def three_step_modules(s, d):
    e = graph.edges(table(s, d, "call_graphs"))
    m = e.select(F.regexp_replace("caller", r"\.[^.]*$", "").alias("key")).distinct().withColumn("value", F.col("key"))
    keys = [F.col("callee"), F.regexp_replace("callee", r"\.[^.]*$", ""), F.substring_index("callee", ".", 1)]
    return joins.fallback_join(e.select("callee").distinct(), [(m, k, "") for k in keys], "module")


@query("SELECT d.doc_id, f.first_id FROM documents d LEFT JOIN (SELECT text, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text) f ON d.text = f.text WHERE d.text IS NOT NULL")
def first_equal_text(s, d):
    t = table(s, d, "documents").select("doc_id", "text").where("text is not null")
    return joins.first_by_text(t, "text", t, "text", "doc_id", "doc_id", "first_id").select("doc_id", "first_id")


@query("""SELECT doc_id, (len(text) - len(replace(text, 'TODO', ''))) / 4 = len(list_filter(string_split(text, chr(10)), lambda x: contains(x, 'TODO'))) AS fits FROM documents WHERE text IS NOT NULL""")
def placeholder_counts(s, d):
    """Whether a mark stands as often in a text as there are lines with it."""
    t = table(s, d, "documents").where("text is not null")
    media = F.filter(T.lines("text"), lambda x: F.contains(x, F.lit("TODO")))
    return t.select("doc_id", chat.placeholder_counts(F.array(chat.message("user", F.col("text"))), ["TODO"], {"TODO": media}).alias("fits"))


def _source_checks(blocks, path, name) -> list[tuple[str, bool]]:
    """Properties that edits of a delivered source must have, for the block of the target."""
    import ast

    from quarry.functions import pyast, pyedit

    own = next((b for b in (list(blocks) if blocks is not None else []) if path and path in b.split("\n", 1)[0]), None)
    text = pyast.function_text(own, name) if own and name else None
    if text is None:
        return []
    last = name.rsplit(".", 1)[-1]
    tree = lambda c: None if (t := pyast.safe_parse(c)) is None else ast.dump(t)
    masked, gone, copy = pyast.mask_body(own, name), pyast.remove_function(own, name), codetext.with_copy(own, name)
    at, inner = pyast.function_lines(own, name), pyedit.body_lines(text, last)
    sft = codetext.sft_example([own], path, name)
    rows = pyast.function_rows(own)
    return [
        ("extract: the text stands in the source", text in own and f"def {last}" in text),
        ("extract: the range has the text's length", at[1] - at[0] + 1 == len(text.splitlines())),
        ("body: lies inside the function", inner is None or 0 < inner[0] <= inner[1] < len(text.splitlines()) or len(text.splitlines()) == 1),
        ("mask: still a source with the function", masked is not None and pyast.function_text(masked, name) is not None),
        ("replace by itself: the same tree", tree(pyast.replace_function(own, name, text)) == tree(own)),
        ("remove: the function is gone", pyast.safe_parse(gone) is None or pyast.function_lines(gone, name) is None),
        ("copy: both versions are there", copy is not None and f"def {last}_new_implementation" in copy and pyast.function_text(copy, name) is not None),
        ("rename: only the definition", f"def {last}_2" in codetext.renamed(text, last, f"{last}_2")),
        ("example: input and output make up the function", sft is None or sft[1].strip() in text),
        ("features: a row for the function", any(r["name"] == last and r["first_line"] == at[0] + 1 for r in rows)),
        ("features: branches add up", sum(r["n_branches"] for r in rows) <= pyast.branches(own)),
        ("names: no read name is a builtin", all(x not in ("len", "print", "range") for x in pyast.free_names(text))),
        ("match: a function matches itself without its docstring", pyast.same_behaviour_tree(text, pyedit.without_docstring(text, last))),
        ("check: a script passes its own check", pyast.sandbox_check(name, text, own, own)[0] or pyast.token_count(own) == 0),
        ("imports: absolute ones stay", tree(pyedit.absolute_imports(own, "p.m")) == tree(own) or "from ." in own),
    ]


_CHECKS = [
    "extract: the text stands in the source", "extract: the range has the text's length", "body: lies inside the function", "mask: still a source with the function", "replace by itself: the same tree",
    "remove: the function is gone", "copy: both versions are there", "rename: only the definition", "example: input and output make up the function", "features: a row for the function", "features: branches add up",
    "names: no read name is a builtin", "match: a function matches itself without its docstring", "check: a script passes its own check", "imports: absolute ones stay",
]


@query("SELECT property, true AS checked, 0::BIGINT AS violations FROM (VALUES " + ", ".join("(" + _sql_text(c) + ")" for c in _CHECKS) + ") AS t(property)")
def source_properties(s, d):
    """How often edits of the delivered sources break a property they must have (never)."""
    t = spread(table(s, d, RECORDS)).select(F.transform(T.fenced_blocks("orig_context"), lambda b: b["body"]).alias("blocks"), "func_path", "func_name")
    each = t.select(F.explode(per_row(_source_checks_as_rows, "array<struct<property:string,ok:boolean>>", "blocks", "func_path", "func_name")).alias("c")).select("c.*")
    return each.groupBy("property").agg((F.count("*") > 0).alias("checked"), F.count_if(~F.col("ok")).alias("violations"))


def _source_checks_as_rows(blocks, path, name):
    return [{"property": p, "ok": bool(ok)} for p, ok in _source_checks(blocks, path, name)]


@query("""SELECT property, true AS checked, 0::BIGINT AS violations FROM (VALUES ('edges: both ends are defined in the files'), ('naive: the target alone'), ('slice: holds the naive context'), ('full: holds every line of the slice')) AS t(property)""")
def slice_properties(s, d):
    """How often call graphs and contexts of the delivered files break a property they must have (never)."""
    files = context_files(s, d).select("repo_id", "module", "code", "func_name", "pos")
    last = files.groupBy("repo_id").agg(F.max_by("module", "pos").alias("module"), F.first("func_name").alias("name"))
    files = files.select("repo_id", "module", "code")
    made = {k: slicing.contexts(files, last, k).select("repo_id", F.col("context").alias(k)) for k in ("naive", "sliced", "full")}
    c = made["naive"].join(made["sliced"], "repo_id").join(made["full"], "repo_id").where("naive is not null")
    body = lambda x: F.filter(T.lines(x), lambda r: ~r.startswith("```") & ~r.startswith("## ") & (T.strip(r) != ""))
    within = lambda x, y: F.size(F.array_except(body(x), body(y))) == 0
    rows = [("naive: the target alone", F.regexp_count("naive", F.lit("(?m)^```python$")) == 1), ("slice: holds the naive context", within("naive", "sliced")), ("full: holds every line of the slice", within("sliced", "full"))]
    of_contexts = c.select(F.explode(F.array(*[F.struct(F.lit(n).alias("property"), ok.alias("ok")) for n, ok in rows])).alias("c")).select("c.*")
    e = slicing.call_graph(files)
    module = files.select("repo_id", F.col("module").alias("m"))
    known = e.select("repo_id", F.explode(F.array("caller", "callee")).alias("id")).withColumn("m", F.regexp_replace("id", r"\.[^.]*$", "")).join(module.withColumn("there", F.lit(True)).distinct(), ["repo_id", "m"], "left")
    of_edges = known.select(F.lit("edges: both ends are defined in the files").alias("property"), F.coalesce("there", F.lit(False)).alias("ok"))
    return of_contexts.unionByName(of_edges).groupBy("property").agg((F.count("*") > 0).alias("checked"), F.count_if(~F.col("ok")).alias("violations"))
