"""Registered queries over the synthetic tables and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.fences import block_rows
from quarry.functions.names import base_idx, canonical_label, canonical_repo
from quarry.functions import codetext
from quarry.functions.pyast import function_table, per_row, same_behaviour_tree, token_count
from quarry.operators import chat, filters, graph, joins, metrics, retrieval, sampling, slicing
from quarry.operators.ranking import rank_within, row_before
from quarry.plans.sized import spread
from quarry.plans.runners import cached_calls, executed
from quarry.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

REPO = r"""nullif(regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(repo_name), '\s+', '', 'g'),
 '^([a-z][a-z0-9+.-]*://[^/]+/|[^@/:]+@[^:/]+:)', ''), '/+$', ''), '\.git$', ''), '^([^/]+)/(.+)$', '\1___\2'), '^.+?___.+$'), '')"""
BASE = r"nullif(regexp_replace(regexp_replace(string_split(idx, '_')[1], '^\s+|\s+$', '', 'g'), '^0+(.)', '\1'), '')"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "exec_results").withColumns({"status": F.get("exec_result", F.lit(0)), "stderr": F.get("exec_result", F.lit(2)), "base": base_idx("idx")})


RUNS = f"(SELECT *, exec_result[1] AS status, exec_result[3] AS stderr, {BASE} AS base FROM exec_results)"


@query("SELECT idx, script_key, coverage_rate FROM exec_results WHERE exec_result[1] = 'success' AND NOT isnan(coverage_rate) AND coverage_rate >= 0.8")
def final_filter(s, d):
    return runs(s, d).where(filters.executed_well(F.col("status"), F.col("coverage_rate"))).select("idx", "script_key", "coverage_rate")


@query(r"""WITH v AS (SELECT record_id, sandbox_ast_check AS a, regexp_replace(lower(trim(sandbox_functionality_check.answer)), '\.+$', '') AS f,
 regexp_replace(lower(trim(test_correctness_check.answer)), '\.+$', '') AS t FROM checked_test_set_final)
SELECT record_id FROM v WHERE (coalesce(f IN ('same', 'yes'), false) OR coalesce(a, false)) AND coalesce(t = 'yes', false)""")
def verdict_filter(s, d):
    return table(s, d, "checked_test_set_final").where(filters.verdicts_pass(F.col("sandbox_functionality_check.answer"), F.col("sandbox_ast_check"), F.col("test_correctness_check.answer"))).select("record_id")


@query("""SELECT record_id, CASE WHEN (NOT isnan(coverage_rate) AND coverage_rate >= 0.8) OR coverage_rate = -1 THEN 'pass' ELSE 'regenerate' END AS triage
FROM checked_test_set_final""")
def coverage_triage(s, d):
    return table(s, d, "checked_test_set_final").select("record_id", filters.coverage_triage(F.col("coverage_rate")).alias("triage"))


@query(f"SELECT idx, script_key, run_at, CASE WHEN status IS NULL THEN 'skip' WHEN status = 'success' THEN 'forward' ELSE 'debug' END AS step FROM {RUNS}")
def debug_triage(s, d):
    return runs(s, d).select("idx", "script_key", "run_at", filters.debug_triage(F.col("status")).alias("step"))


@query(f"""SELECT base, script_key, run_at, attempt FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY run_at, script_key, idx)::INT AS attempt
FROM {RUNS} WHERE status IS NOT NULL AND status <> 'success') WHERE attempt <= 2""")
def debug_budget(s, d):
    return filters.debug_budget(runs(s, d), ["run_at", "script_key", "idx"]).select("base", "script_key", "run_at", "attempt")


@query(f"""SELECT record_id, CASE WHEN contains(func_name, '.') THEN string_split(func_name, '.')[1] END AS class_name, string_split(func_name, '.')[-1] AS function_name,
 {BASE} AS base, {REPO} AS repo, regexp_replace(regexp_replace(replace(func_path, '/', '.'), '\\.py$', ''), '^\\.+', '') AS module, lower(trim(split_name)) AS split FROM checked_test_set_final""")
def final_record_names(s, d):
    t = table(s, d, "checked_test_set_final")
    return t.select("record_id", T.class_part("func_name").alias("class_name"), T.function_part("func_name").alias("function_name"), base_idx("idx").alias("base"), canonical_repo("repo_name").alias("repo"), T.path_module("func_path").alias("module"), F.lower(F.trim("split_name")).alias("split"))


@query(r"""WITH b AS (SELECT record_id, regexp_extract_all(orig_context, '(?s)```(\w*)\n(.*?)\n```', 1) AS l, regexp_extract_all(orig_context, '(?s)```(\w*)\n(.*?)\n```', 2) AS t FROM checked_test_set_final)
SELECT record_id, (i - 1)::INT AS pos, l[i] AS lang, md5(t[i]) AS body_md5 FROM b, unnest(range(1, len(l) + 1)) AS u(i)""")
def fence_extract(s, d):
    t = table(s, d, "checked_test_set_final").select("record_id", F.posexplode(T.fenced_blocks("orig_context")).alias("pos", "b"))
    return t.select("record_id", "pos", F.col("b.lang").alias("lang"), F.md5("b.body").alias("body_md5"))


@query(r"""SELECT count_if(len(regexp_extract_all(orig_context, '(?s)```(\w*)\n(.*?)\n```', 0)) > 1)::BIGINT AS n_multi, count(*) AS n FROM checked_test_set_final""")
def multi_file_contexts(s, d):
    return table(s, d, "checked_test_set_final").agg(F.count_if(F.size(T.fenced_blocks("orig_context")) > 1).alias("n_multi"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT idx, i - 1 AS pos, generations[i] AS raw FROM generations, unnest(range(1, len(generations) + 1)) AS u(i))
SELECT idx, pos::INT AS pos, concat(idx, '_', pos) AS new_idx, coalesce(len(raw), 0)::INT AS n_chars,
 CASE WHEN contains(raw, '```python') THEN md5(regexp_replace(string_split(string_split(raw, '```python')[2], '```')[1], '^\\s+|\\s+$', '', 'g')) ELSE md5(raw) END AS code_md5 FROM g""".replace("\\\\", "\\"))
def explode_generations(s, d):
    g = table(s, d, "generations").select("idx", F.posexplode("generations").alias("pos", "raw"))
    return g.select("idx", "pos", F.concat_ws("_", "idx", F.col("pos").cast("string")).alias("new_idx"), F.coalesce(F.length("raw"), F.lit(0)).alias("n_chars"), F.md5(T.first_code_piece("raw")).alias("code_md5"))


@query("""WITH t AS (SELECT doc_id, text, lower(string_split(text, 'ANSWER')[-1]) AS tail FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, nullif(strpos(tail, 'same'), 1) AS s, nullif(strpos(tail, 'yes'), 1) AS y, nullif(strpos(tail, 'no'), 1) AS n FROM t WHERE contains(text, 'REASONING:') AND contains(text, 'ANSWER:')),
q AS (SELECT doc_id, nullif(s, 0) AS s, nullif(y, 0) AS y, nullif(n, 0) AS n FROM p)
SELECT doc_id, CASE least(s, y, n) WHEN s THEN 'same' WHEN y THEN 'yes' WHEN n THEN 'no' END AS verdict FROM q""")
def verdict_parse(s, d):
    t = table(s, d, "documents").where(F.contains("text", F.lit("REASONING:")) & F.contains("text", F.lit("ANSWER:")))
    return t.select("doc_id", T.verdict("text").alias("verdict"))


@query(rf"""WITH l AS (SELECT unnest(string_split(stderr, chr(10))) AS x FROM {RUNS})
SELECT regexp_extract(x, '^\s*([\w.]*(?:Error|Exception)): ', 1) AS error_type, count(*) AS n FROM l WHERE regexp_extract(x, '^\s*([\w.]*(?:Error|Exception)): ', 1) <> '' GROUP BY 1""")
def error_type_counts(s, d):
    return metrics.error_type_counts(runs(s, d), F.col("stderr"))


@query(f"""SELECT script_key, count(*) AS runs, count_if(status = 'success')::BIGINT AS success, count_if(status = 'error')::BIGINT AS error, count_if(status = 'timeout')::BIGINT AS timeout,
 count_if(status IS NULL)::BIGINT AS missing, count(DISTINCT CASE WHEN status = 'success' THEN base END) AS covered FROM {RUNS} GROUP BY script_key""")
def execution_summary(s, d):
    return metrics.execution_summary(runs(s, d), ["script_key"])


@query("""SELECT lower(trim(split_name)) AS split, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, count_if(v > 80)::BIGINT AS over_80, count_if(v > 90)::BIGINT AS over_90, count_if(v = 100)::BIGINT AS "full"
FROM (SELECT split_name, coverage_rate * 100 AS v FROM checked_test_set_final WHERE NOT isnan(coverage_rate) AND coverage_rate >= 0) GROUP BY 1""")
def coverage_distribution(s, d):
    t = table(s, d, "checked_test_set_final").where(~F.isnan("coverage_rate") & (F.col("coverage_rate") >= 0)).select(F.lower(F.trim("split_name")).alias("split"), (F.col("coverage_rate") * 100).alias("v"))
    return metrics.distribution(t, "v", ["split"]).withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


_PASS = "CASE WHEN n - c < {k} THEN 1.0::DOUBLE WHEN c = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::DOUBLE - {k}::DOUBLE / i)) END"
_COUNTS = f"(SELECT base, count(*)::INT AS n, count_if(coalesce(status = 'success', false))::INT AS c FROM {RUNS} WHERE base IS NOT NULL GROUP BY base)"


@query(f"SELECT base, n, c, round({_PASS.format(k=1)}, 9) AS pass_1, round({_PASS.format(k=2)}, 9) AS pass_2 FROM {_COUNTS}")
def pass_at_k_problems(s, d):
    c = metrics.pass_counts(runs(s, d).where("base is not null"), "base", F.col("status") == "success")
    return c.select("base", "n", "c", F.round(metrics.pass_at_k_value(F.col("n"), F.col("c"), 1), 9).alias("pass_1"), F.round(metrics.pass_at_k_value(F.col("n"), F.col("c"), 2), 9).alias("pass_2"))


@query(f"""SELECT k, round(avg(v), 9) AS pass_at_k FROM (SELECT 1 AS k, n, {_PASS.format(k=1)} AS v FROM {_COUNTS} UNION ALL SELECT 2, n, {_PASS.format(k=2)} FROM {_COUNTS}) GROUP BY k HAVING min(n) >= k""")
def pass_at_k_mean(s, d):
    c = metrics.pass_counts(runs(s, d).where("base is not null"), "base", F.col("status") == "success")
    return metrics.pass_at_k(c, [1, 2]).withColumn("pass_at_k", F.round("pass_at_k", 9))


@query(f"""WITH r AS (SELECT record_id, func_name, lag(func_name) OVER (PARTITION BY {REPO} ORDER BY record_id) AS other FROM checked_test_set_final)
SELECT record_id, (func_name = other)::INT AS em, round(1.0::DOUBLE - levenshtein(func_name, other)::DOUBLE / greatest(len(func_name), len(other)), 9) AS es FROM r WHERE other IS NOT NULL""")
def exact_edit_similarity(s, d):
    r = table(s, d, "checked_test_set_final").select("record_id", "func_name", canonical_repo("repo_name").alias("repo"))
    r = row_before(r, ["repo"], ["record_id"], "func_name", "other", Workspace(s, "lag")).where("other is not null")
    return r.select("record_id", metrics.exact_match(F.col("func_name"), F.col("other")).alias("em"), F.round(metrics.edit_similarity(F.col("func_name"), F.col("other")), 9).alias("es"))


@query("""WITH c AS (SELECT lower(trim(split_name)) AS split, (coverage_rate = 1)::INT AS hit FROM checked_test_set_final WHERE split_name IS NOT NULL)
SELECT CASE WHEN grouping(split) = 1 THEN 'Average' ELSE split END AS category, round(avg(coalesce(hit, 0)), 9) AS accuracy, count(*) AS n FROM c GROUP BY ROLLUP (split)""")
def rollup_accuracy(s, d):
    t = table(s, d, "checked_test_set_final").where("split_name is not null").select(F.lower(F.trim("split_name")).alias("split"), F.coalesce(F.col("coverage_rate") == 1, F.lit(False)).alias("hit"))
    return metrics.rollup_accuracy(t, "split", F.col("hit")).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH r AS (SELECT record_id, {REPO} AS repo, CASE WHEN coverage_rate = 1 THEN 0 ELSE 1 END AS prio FROM checked_test_set_final)
SELECT record_id, repo FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY prio, md5('0|' || record_id), record_id) AS rn FROM r WHERE repo IS NOT NULL) WHERE rn <= 5""")
def stratified_sample(s, d):
    t = table(s, d, "checked_test_set_final").select("record_id", canonical_repo("repo_name").alias("repo"), F.when(F.col("coverage_rate") == 1, 0).otherwise(1).alias("prio")).where("repo is not null")
    return sampling.stratified_sample(t, ["repo"], 5, "record_id", F.col("prio")).select("record_id", "repo")


@query("""SELECT doc_id, h AS text_md5 FROM (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, doc_id) AS rn
FROM documents WHERE text IS NOT NULL) WHERE rn = 1""")
def priority_dedupe(s, d):
    t = table(s, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("text_md5"), F.when(F.col("source").isNull(), 1).otherwise(0).alias("prio"))
    return sampling.first_by_priority(t, ["text_md5"], [F.col("prio"), F.col("doc_id")]).select("doc_id", "text_md5")


@query(f"""SELECT base, record_id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY len(record_id::VARCHAR), record_id) AS rn FROM (SELECT {BASE} AS base, record_id FROM checked_test_set_final)
WHERE base IS NOT NULL) WHERE rn <= 2""")
def diverse_top(s, d):
    t = table(s, d, "checked_test_set_final").select(base_idx("idx").alias("base"), "record_id").where("base is not null")
    return sampling.diverse_top(t, ["base"], 2, "record_id")


@query(f"""WITH g AS (SELECT DISTINCT {BASE} AS base FROM generations), r AS (SELECT {BASE} AS base, record_id FROM checked_test_set_final)
SELECT base, record_id, 'generated' AS origin FROM r WHERE base IN (SELECT base FROM g WHERE base IS NOT NULL)
UNION ALL SELECT base, record_id, 'replay' FROM r WHERE base IS NOT NULL AND base NOT IN (SELECT base FROM g WHERE base IS NOT NULL)""")
def replay_union(s, d):
    g = table(s, d, "generations").select(base_idx("idx").alias("base")).where("base is not null").distinct()
    r = table(s, d, "checked_test_set_final").select(base_idx("idx").alias("base"), "record_id").where("base is not null")
    sampled = r.join(g, "base", "left_semi").withColumn("origin", F.lit("generated"))
    return sampling.replay(sampled, r.withColumn("origin", F.lit("replay")), ["base"]).select("base", "record_id", "origin")


@query(f"""WITH g AS (SELECT {BASE} AS base, instruction, len(generations) AS n_generations FROM generations)
SELECT r.record_id, g.instruction, g.n_generations::INT AS n_generations FROM (SELECT record_id, {BASE} AS base FROM checked_test_set_final) r JOIN g ON r.base = g.base""")
def join_generations(s, d):
    g = table(s, d, "generations").select(base_idx("idx").alias("base"), "instruction", F.when(F.col("generations").isNotNull(), F.size("generations")).alias("n_generations"))
    return table(s, d, "checked_test_set_final").select("record_id", base_idx("idx").alias("base")).join(g, "base").select("record_id", "instruction", "n_generations")


@query("""SELECT doc_id, CASE WHEN rn <= ceil((SELECT count(*) FROM documents) * 0.1) THEN 'validation' ELSE 'train' END AS part
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) AS rn FROM documents)""")
def exact_split(s, d):
    return sampling.split_exact(table(s, d, "documents").select("doc_id"), 0.1, "doc_id", Workspace(s, "split")).select("doc_id", "part")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) - 1 AS rk, (SELECT count(*) FROM documents) AS n FROM documents)
SELECT doc_id, c::INT AS "copy" FROM r, unnest(range(1, (2500 // n + CASE WHEN rk < 2500 % n THEN 1 ELSE 0 END + 1)::BIGINT)) AS u(c)""")
def exact_resample(s, d):
    return sampling.resample_exact(table(s, d, "documents").select("doc_id"), 2500, "doc_id", Workspace(s, "resample"))


_SRC = r"nullif(regexp_replace(regexp_replace(lower(source), '^\s+|\s+$', '', 'g'), '[\s-]+', '_', 'g'), '')"


@query(f"""WITH r AS (SELECT doc_id, {_SRC} AS src, row_number() OVER (PARTITION BY {_SRC} ORDER BY doc_id) - 1 AS turn FROM documents WHERE source IS NOT NULL)
SELECT doc_id, src, turn, row_number() OVER (ORDER BY turn, src) - 1 AS place FROM r""")
def interleave_sources(s, d):
    t = table(s, d, "documents").where("source is not null").select("doc_id", canonical_label("source").alias("src"))
    return sampling.interleave(t, "src", ["doc_id"], Workspace(s, "interleave")).select("doc_id", "src", "turn", "place")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS block FROM documents")
def numbered_blocks(s, d):
    return sampling.numbered_blocks(table(s, d, "documents").select("doc_id"), ["doc_id"], 100, Workspace(s, "blocks")).select("doc_id", "block")


@query("SELECT doc_id, rk AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rk FROM documents) WHERE rk >= 100 AND rk < 600")
def range_shard(s, d):
    return sampling.range_shard(table(s, d, "documents").select("doc_id"), ["doc_id"], Workspace(s, "shard"), 100, 600)


_RP = f"(SELECT *, lower(repo_id) AS repo FROM repos)"
_USED = f"(SELECT DISTINCT {REPO} AS repo FROM checked_test_set_final)"


@query(f"SELECT repo_id, n_stars FROM {_RP} WHERE repo IN (SELECT repo FROM {_USED} WHERE repo IS NOT NULL)")
def covered_repos(s, d):
    used = table(s, d, "checked_test_set_final").select(canonical_repo("repo_name").alias("repo"))
    return filters.covered_repos(table(s, d, "repos").withColumn("repo", canonical_repo("repo_id")), used, "repo").select("repo_id", "n_stars")


@query(f"SELECT repo_id FROM {_RP} WHERE repo NOT IN (SELECT lower(repo_id) FROM call_graphs WHERE repo_id IS NOT NULL)")
def unused_repos(s, d):
    """Repositories that no call graph uses."""
    used = table(s, d, "call_graphs").select(canonical_repo("repo_id").alias("repo"))
    return filters.unused_repos(table(s, d, "repos").withColumn("repo", canonical_repo("repo_id")), used, "repo").select("repo_id")


@query(f"SELECT {REPO} AS repo_id, sum(n_chars)::BIGINT AS bytes FROM documents WHERE {REPO} IS NOT NULL GROUP BY 1 HAVING sum(n_chars) <= 5000")
def small_repos(s, d):
    return filters.small_repos(table(s, d, "documents").select(canonical_repo("repo_name").alias("repo_id"), F.col("n_chars").alias("size")).where("repo_id is not null"), 5000)


@query(f"""WITH l AS (SELECT base, arg_max(coverage_rate, struct_pack(a := run_at, b := script_key, c := coverage_rate)) AS fresh FROM {RUNS} WHERE base IS NOT NULL AND NOT isnan(coverage_rate) GROUP BY base)
SELECT record_id, coalesce(fresh, CASE WHEN isnan(coverage_rate) THEN NULL ELSE coverage_rate END) AS coverage_rate FROM (SELECT record_id, coverage_rate, {BASE} AS base FROM checked_test_set_final) r LEFT JOIN l ON r.base = l.base""")
def update_coverage(s, d):
    """The last measured rate of each record, its own where no run has one; a rate that is no number is null."""
    last = runs(s, d).where("base is not null and coverage_rate is not null and not isnan(coverage_rate)").groupBy("base").agg(F.max_by("coverage_rate", F.struct("run_at", "script_key", "coverage_rate")).alias("coverage_rate"))
    r = table(s, d, "checked_test_set_final").select("record_id", F.nanvl("coverage_rate", F.lit(None).cast("double")).alias("coverage_rate"), base_idx("idx").alias("base"))
    return joins.update_columns(r, last, ["base"]).select("record_id", "coverage_rate")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
SELECT e.event_id, (SELECT max(s.ts) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts < e.ts) AS last_signup FROM e""")
def asof_last_event(s, d):
    ev = table(s, d, "events")
    left = ev.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = ev.where("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("signup"))
    return joins.last_before(left, right, ["user_id"], "ts", "signup", name="last_signup").select("event_id", "last_signup")


_EDGES = "(SELECT DISTINCT repo_id, caller, unnest(graph[caller]) AS callee FROM (SELECT repo_id, graph, unnest(map_keys(graph)) AS caller FROM call_graphs))"


@query(f"SELECT repo_id, caller, callee FROM {_EDGES}")
def call_edges(s, d):
    return graph.edges(table(s, d, "call_graphs"))


@query(f"""WITH n AS (SELECT DISTINCT repo_id, unnest(map_keys(graph)) AS id FROM call_graphs UNION SELECT repo_id, callee FROM {_EDGES})
SELECT n.repo_id, n.id, coalesce(id2type[n.id], 'OTHER') AS type FROM n JOIN call_graphs g ON n.repo_id = g.repo_id""")
def node_types(s, d):
    return graph.nodes(table(s, d, "call_graphs")).select("repo_id", "id", "type")


@query(f"""WITH RECURSIVE e AS (SELECT * FROM {_EDGES} WHERE caller <> callee),
r AS (SELECT repo_id, caller AS root, callee AS id FROM e UNION SELECT r.repo_id, r.root, e.callee FROM r JOIN e ON r.repo_id = e.repo_id AND r.id = e.caller)
SELECT repo_id, root, id FROM r WHERE root <> id""")
def graph_closure(s, d):
    return graph.closure(graph.edges(table(s, d, "call_graphs")), Workspace(s, "closure")).select("repo_id", "root", "id")


@query(f"SELECT repo_id, regexp_replace(caller, '\\.[^.]*$', '') AS group_id, list_sort(list(DISTINCT callee)) AS callees FROM {_EDGES} GROUP BY 1, 2")
def merged_callees(s, d):
    e = graph.edges(table(s, d, "call_graphs"))
    groups = e.select("repo_id", F.regexp_replace("caller", r"\.[^.]*$", "").alias("group_id"), "caller").distinct()
    return graph.merged_callees(e, groups)


@query(f"SELECT repo_id, caller AS function_id, count(*) AS n_callees FROM {_EDGES} GROUP BY 1, 2")
def callee_counts(s, d):
    return graph.callee_counts(graph.edges(table(s, d, "call_graphs")))


@query(f"""SELECT repo_id, count(DISTINCT id) AS n_ids, 0::BIGINT AS n_misplaced FROM (SELECT repo_id, caller AS id FROM {_EDGES} UNION SELECT repo_id, callee FROM {_EDGES}) GROUP BY repo_id""")
def topological_order(s, d):
    """Ids of each graph and how many of its edges stand in the wrong order though they lie on no cycle (none may)."""
    e = graph.edges(table(s, d, "call_graphs"))
    order = graph.topological_order(e)
    loops = graph.closure(e, Workspace(s, "loops")).select("repo_id", F.col("root").alias("callee"), F.col("id").alias("caller"))
    place = lambda c: order.select("repo_id", F.col("id").alias(c), F.col("place").alias(f"{c}_place"))
    wrong = e.where("caller <> callee").join(place("caller"), ["repo_id", "caller"]).join(place("callee"), ["repo_id", "callee"]).where("callee_place > caller_place").join(loops, ["repo_id", "caller", "callee"], "left_anti")
    bad = wrong.groupBy("repo_id").agg(F.count("*").alias("bad"))
    return order.groupBy("repo_id").agg(F.countDistinct("id").alias("n_ids")).join(bad, "repo_id", "left").select("repo_id", "n_ids", F.coalesce("bad", F.lit(0)).cast("bigint").alias("n_misplaced"))


@query(f"""WITH k AS (SELECT DISTINCT regexp_replace(caller, '\\.[^.]*$', '') AS m FROM {_EDGES}),
c AS (SELECT DISTINCT callee FROM {_EDGES}), p AS (SELECT callee, regexp_replace(callee, '\\.[^.]*$', '') AS p1, CASE WHEN len(string_split(callee, '.')) > 2 THEN regexp_replace(callee, '\\.[^.]*\\.[^.]*$', '') END AS p2 FROM c)
SELECT callee, coalesce((SELECT m FROM k WHERE m = callee), CASE WHEN p1 <> callee THEN (SELECT m FROM k WHERE m = p1) END, (SELECT m FROM k WHERE m = p2)) AS resolved FROM p""")
def prefix_resolve(s, d):
    e = graph.edges(table(s, d, "call_graphs"))
    known = e.select(F.regexp_replace("caller", r"\.[^.]*$", "").alias("module")).distinct()
    return joins.resolve_by_prefix(e.select("callee").distinct(), "callee", known, "module")


@query("""WITH n AS (SELECT idx, script_key, run_at, row_number() OVER (ORDER BY idx, script_key, run_at) AS rid, list_sort(list_distinct(coverage_missing_lines)) AS l FROM exec_results),
u AS (SELECT rid, idx, script_key, run_at, unnest(l) AS x, unnest(range(len(l))) AS i FROM n)
SELECT idx, script_key, run_at, min(x) AS "first", max(x) AS "last" FROM u GROUP BY rid, idx, script_key, run_at, x - i""")
def missing_blocks(s, d):
    t = table(s, d, "exec_results").select("idx", "script_key", "run_at", F.explode(T.missing_blocks(F.col("coverage_missing_lines"))).alias("b"))
    return t.select("idx", "script_key", "run_at", "b.first", "b.last")


@query(r"""WITH l AS (SELECT doc_id, i, len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)),
c AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM l)
SELECT doc_id, count_if(used <= 100)::INT AS n_lines FROM c GROUP BY doc_id""")
def chunk_first(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", T.first_chunk_lines("text", 100).alias("n_lines"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(array_to_string(w[greatest(len(w) - 49, 1):], ' ')) AS left_md5, md5(array_to_string(w[1:50], ' ')) AS right_md5 FROM t""")
def truncate_tokens(s, d):
    t = table(s, d, "documents").where("text is not null")
    return t.select("doc_id", F.md5(T.truncate_tokens("text", 50)).alias("left_md5"), F.md5(T.truncate_tokens("text", 50, "right")).alias("right_md5"))


@query(r"""SELECT doc_id, md5('# ' || replace(text, chr(10), chr(10) || '# ')) AS text_md5 FROM documents WHERE text IS NOT NULL""")
def comment_lines(s, d):
    t = table(s, d, "documents").where("text is not null")
    return t.select("doc_id", F.md5(F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))).alias("text_md5"))


@query("""WITH p AS (SELECT doc_id, text, least(nullif(strpos(text, ' the '), 0), nullif(strpos(text, 'def '), 0), nullif(strpos(text, '```'), 0)) AS stop FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(CASE WHEN stop IS NULL THEN text ELSE left(text, (stop - 1)::BIGINT) END) AS cut_md5 FROM p""")
def stop_token_cut(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(T.cut_at_stops("text", [" the ", "def ", "```"])).alias("cut_md5"))


@query(f"""WITH b AS (SELECT DISTINCT text AS item FROM documents WHERE {_SRC} IN ('commit_message', 'prompt') AND trim(text, ' ') <> ''),
s AS (SELECT DISTINCT func_name AS item FROM checked_test_set_final WHERE trim(func_name, ' ') <> '')
SELECT DISTINCT d.doc_id AS id FROM documents d JOIN (SELECT item FROM b UNION SELECT item FROM s) i ON contains(d.text, i.item)""")
def decontaminate(s, d):
    """Documents that contain a whole commit message or prompt, or the name of a delivered function."""
    t = spread(table(s, d, "documents"))
    items = t.where(canonical_label("source").isin("commit_message", "prompt")).select(F.col("text").alias("item"))
    names = table(s, d, "checked_test_set_final").select(F.col("func_name").alias("item"))
    return filters.contaminated(t.select(F.col("doc_id").alias("id"), "text"), items.unionByName(names).distinct(), Workspace(s, "decontaminate"))


_TOK = r"len(list_filter(string_split_regex({c}, '\s+'), lambda w: w <> ''))"


@query(f"""WITH g AS (SELECT idx, instruction, unnest(generations) AS a, unnest(range(len(generations))) AS pos FROM generations WHERE generations IS NOT NULL),
n AS (SELECT idx, pos, {_TOK.format(c='instruction')} AS s, {_TOK.format(c='a')} AS t FROM g WHERE a IS NOT NULL AND instruction IS NOT NULL),
k AS (SELECT *, least(t, CASE WHEN t * 2 < 64 THEN 64 WHEN s * 2 < 64 THEN 64 - s ELSE floor(64 * (t::DOUBLE / (s + t))) END)::INT AS target FROM n)
SELECT idx, pos::INT AS pos, least(s, greatest(64 - target, 0))::INT AS source, target FROM k""")
def sft_seqlen_budget(s, d):
    g = table(s, d, "generations").where("instruction is not null").select("idx", "instruction", F.posexplode("generations").alias("pos", "a")).where("a is not null")
    g = g.select("idx", "pos", chat.split_budget(F.size(T.white_tokens("instruction")), F.size(T.white_tokens("a")), 64).alias("b"))
    return g.select("idx", "pos", "b.source", "b.target")


@query(f"""SELECT doc_id // 1000 AS batch, sum(n)::BIGINT AS tokens, (sum(n) // 128)::BIGINT AS blocks, (sum(n) % 128)::BIGINT AS dropped FROM (SELECT doc_id, {_TOK.format(c='text')} + 1 AS n FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def pretrain_blocks(s, d):
    t = table(s, d, "documents").where("text is not null").select(F.expr("doc_id div 1000").alias("batch"), "doc_id", (F.size(T.white_tokens("text")) + 1).alias("n"))
    return chat.pretrain_blocks(t, ["batch"], "n", 128)


@query("""WITH p AS (SELECT doc_id, doc_id // 100 AS batch, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY doc_id // 100) AS n FROM documents)
SELECT a.doc_id, b.doc_id AS kl_value FROM p a JOIN p b ON a.batch = b.batch AND b.pos = a.n - 1 - a.pos""")
def kto_reversed_pairs(s, d):
    w = W.partitionBy("batch").orderBy("doc_id")
    t = table(s, d, "documents").select("doc_id", F.expr("doc_id div 100").alias("batch")).withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))
    return chat.reversed_pairs(t, "batch", "pos", "doc_id").select("doc_id", "kl_value")


@query(f"""SELECT idx, {_TOK.format(c='instruction')}::INT AS prompt_tokens, list_max(list_transform(generations, lambda g: {_TOK.format(c='g')}))::INT AS target_tokens FROM generations WHERE len(generations) >= 2""")
def pairwise_max_target(s, d):
    g = table(s, d, "generations").where(F.size("generations") >= 2)
    return g.select("idx", F.size(T.white_tokens("instruction")).alias("prompt_tokens"), F.array_max(F.transform("generations", lambda x: F.size(T.white_tokens(x)))).alias("target_tokens"))


@query(f"""WITH t AS (SELECT doc_id // 1000 AS batch, {_TOK.format(c='text')} AS n FROM documents WHERE text IS NOT NULL)
SELECT batch, count(*) AS n_rows, sum(n)::BIGINT AS n_tokens, true AS fits, true AS dense FROM t WHERE n > 0 AND n <= 512 GROUP BY batch""")
def pack_knapsack(s, d):
    """Packs of each batch: every row that fits is packed once, none is over 512, and all but one pack are over half full."""
    t = table(s, d, "documents").where("text is not null").select(F.expr("doc_id div 1000").alias("batch"), F.col("doc_id").alias("pos"), F.size(T.white_tokens("text")).alias("length")).where("length > 0")
    packs = chat.pack_batches(t, "batch", "pos", "length", 512).groupBy("batch", "pack").agg(F.sum("length").alias("used"), F.countDistinct("pos").alias("n"))
    return packs.groupBy("batch").agg(F.sum("n").alias("n_rows"), F.sum("used").alias("n_tokens"), (F.max("used") <= 512).alias("fits"), (F.count_if(F.col("used") * 2 <= 512) <= 1).alias("dense"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(qv::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(qv::DOUBLE[], qv::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS score FROM q, embeddings WHERE vec_id <> query_id)
SELECT query_id, doc_id, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM s) WHERE place <= 3""")
def nearest_vectors(s, d):
    e = table(s, d, "embeddings")
    return retrieval.nearest(e.where(F.col("vec_id") % 20 == 0), spread(e), 3, "vec_id", "embedding", Workspace(s, "nearest"))


_BRANCH = r"(?m)^[ \t]*(if|for|while|try)\b"


@query(f"""WITH b AS (SELECT {REPO} AS repo, coverage_rate, sandbox_ast_check, len(regexp_extract_all(orig_func, '{_BRANCH}')) AS n_branches FROM checked_test_set_final)
SELECT stage, count(*) AS records, count(DISTINCT repo) AS repos, round(avg(CASE WHEN coverage_rate >= 0 AND NOT isnan(coverage_rate) THEN coverage_rate END), 9) AS mean_coverage, count_if(sandbox_ast_check)::BIGINT AS ast_checked, count_if(n_branches > 1)::BIGINT AS multi_branch
FROM (SELECT 'before' AS stage, * FROM b UNION ALL SELECT 'after', * FROM b WHERE coverage_rate >= 0.8 AND NOT isnan(coverage_rate)) GROUP BY stage""")
def dataset_stats(s, d):
    """Statistics of the final set; lines that open a branch stand for branches here."""
    b = table(s, d, "checked_test_set_final").select(canonical_repo("repo_name").alias("repo"), "coverage_rate", "sandbox_ast_check", F.regexp_count("orig_func", F.lit(_BRANCH)).alias("n_branches"))
    return metrics.dataset_stats(b, b.where(~F.isnan("coverage_rate") & (F.col("coverage_rate") >= 0.8))).withColumn("mean_coverage", F.round("mean_coverage", 9))


@query(f"""WITH r AS (SELECT record_id, {REPO} AS repo, (row_number() OVER (PARTITION BY {REPO} ORDER BY record_id) - 1) // 100 AS part FROM checked_test_set_final)
SELECT repo, part, list_sort(list(record_id)) AS record_ids FROM r GROUP BY repo, part""")
def group_to_list(s, d):
    """Records of each repository as lists of at most 100; a repository of any size is spread over many rows."""
    t = table(s, d, "checked_test_set_final").select("record_id", canonical_repo("repo_name").alias("repo"))
    ranked = rank_within(t, ["repo"], ["record_id"], Workspace(s, "lists"))
    return ranked.groupBy("repo", F.expr("rank div 100").alias("part")).agg(F.array_sort(F.collect_list("record_id")).alias("record_ids"))


_NIST = r"""list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || lower(replace(replace(replace(replace(
 regexp_replace(regexp_replace(replace({c}, '<skipped>', ''), '-\n', '', 'g'), '\n', ' ', 'g'), '&gt;', '>'), '&lt;', '<'), '&quot;', '"'), '&amp;', '&')) || ' ',
 '([\{{-~\[-` -&\(-\+:-@/])', ' \1 ', 'g'), '([^0-9])([\.,])', '\1 \2 ', 'g'), '([\.,])([^0-9])', ' \1 \2', 'g'), '([0-9])(-)', '\1 \2 ', 'g'), '\s+'), lambda w: w <> '')"""


@query(f"""WITH g AS (SELECT {BASE} AS base, idx, i - 1 AS pos, generations[i] AS raw FROM generations, unnest(range(1, len(generations) + 1)) AS u(i) WHERE instruction IS NOT NULL),
a AS (SELECT idx, base, pos::INT AS pos, {_NIST.format(c='raw')} AS p FROM g WHERE raw IS NOT NULL),
r AS (SELECT DISTINCT {BASE} AS base, orig_func FROM checked_test_set_final WHERE orig_func IS NOT NULL),
rt AS (SELECT base, row_number() OVER () AS ref, {_NIST.format(c='orig_func')} AS t FROM r WHERE base IN (SELECT base FROM a)),
rl AS (SELECT base, min(len(t)) AS shortest FROM rt GROUP BY base),
rg AS (SELECT base, n, gram, max(k) AS k FROM (SELECT base, ref, n, t[i:i + n - 1] AS gram, count(*) AS k FROM rt, unnest([1, 2, 3, 4]) AS v(n), unnest(range(1, len(t) - n + 2)) AS u(i) GROUP BY ALL) GROUP BY ALL),
ag AS (SELECT idx, base, pos, n, p[i:i + n - 1] AS gram, count(*) AS k FROM a, unnest([1, 2, 3, 4]) AS v(n), unnest(range(1, len(p) - n + 2)) AS u(i) GROUP BY ALL),
m AS (SELECT idx, pos, ag.n, sum(least(ag.k, rg.k)) AS hit FROM ag JOIN rg ON ag.base = rg.base AND ag.n = rg.n AND ag.gram = rg.gram GROUP BY ALL),
s AS (SELECT a.idx, a.pos, len(a.p) AS len, rl.shortest, v.n, coalesce(m.hit, 0) AS hit FROM a JOIN rl ON a.base = rl.base, unnest([1, 2, 3, 4]) AS v(n) LEFT JOIN m ON m.idx = a.idx AND m.pos = a.pos AND m.n = v.n)
SELECT idx, pos, round(CASE WHEN bool_or(n = 1 AND hit = 0) THEN 0 ELSE exp(sum(CASE WHEN n = 1 AND hit = 0 THEN 0 ELSE ln((hit + (n > 1)::INT)::DOUBLE / (greatest(len - n + 1, 0) + (n > 1)::INT)) END) / 4 + least(0.0, 1 - (any_value(shortest) + 1)::DOUBLE / (any_value(len) + 1))) END, 9) AS bleu
FROM s GROUP BY idx, pos""")
def bleu_scores(s, d):
    """Each candidate against all different functions of its base; a base has few."""
    g = spread(table(s, d, "generations")).where("instruction is not null").select("idx", F.posexplode("generations").alias("pos", "a")).where("a is not null").withColumn("base", base_idx("idx"))
    r = table(s, d, "checked_test_set_final").where("orig_func is not null").select(base_idx("idx").alias("base"), metrics.normalise_for_bleu(F.col("orig_func")).alias("ref"))
    refs = r.join(g.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.collect_set("ref").alias("refs"))
    return g.join(refs, "base").select("idx", "pos", F.round(metrics.smoothed_bleu(metrics.normalise_for_bleu(F.col("a")), F.col("refs")), 9).alias("bleu"))


@query()
def function_features(s, d):
    """Functions of every fenced Python block that pass the filters."""
    blocks = block_rows(spread(table(s, d, "checked_test_set_final")), "orig_context", "record_id").where("lang = 'python'")
    f = function_table(blocks, "record_id", "body")
    return f.withColumn("kept", filters.function_keep(F.col("kind"))).select("record_id", "kind", "class_name", "name", "n_args", "n_statements", "n_branches", "n_code_lines", "kept")


@query(r"""SELECT record_id, coalesce(contains(regexp_replace(eval_script, '\s+', '', 'g'), regexp_replace(orig_func, '\s+', '', 'g')) AND orig_func <> '', false) AS same FROM checked_test_set_final""")
def body_match(s, d):
    """Whether the script holds the text of the original function, blanks aside."""
    t = table(s, d, "checked_test_set_final")
    return t.select("record_id", F.coalesce(T.squeezed_contains("eval_script", "orig_func") & (F.col("orig_func") != ""), F.lit(False)).alias("same"))


@query()
def tree_match(s, d):
    """Whether the script still holds the original function, by text or by tree, and the script's Python tokens."""
    t = spread(table(s, d, "checked_test_set_final"))
    by_text = F.coalesce(T.squeezed_contains("eval_script", "orig_func") & (F.col("orig_func") != ""), F.lit(False))
    # only what the text does not settle is parsed
    t = t.select("record_id", by_text.alias("by_text"), "eval_script", F.when(~by_text, F.col("orig_func")).alias("rest"))
    return t.select("record_id", (F.col("by_text") | per_row(same_behaviour_tree, "boolean", "eval_script", "rest")).alias("same"), per_row(lambda x: token_count(x) if x else 0, "int", "eval_script").alias("n_tokens"))


@query()
def script_compiles(s, d):
    t = spread(table(s, d, "checked_test_set_final")).select("record_id", "eval_script")
    return executed(t, "eval_script").select("record_id", F.col("exec.status").alias("status"))


@query("""WITH p AS (SELECT md5(instruction) AS key, min(instruction) AS prompt FROM generations WHERE instruction IS NOT NULL GROUP BY 1),
c AS (SELECT md5(instruction) AS key, arg_min(generations[1], idx) AS answer FROM generations WHERE instruction IS NOT NULL AND len(generations) > 0 AND generations[1] IS NOT NULL GROUP BY 1)
SELECT p.key, md5(coalesce(c.answer, md5('0|' || p.prompt))) AS answer_md5, false AS failed FROM p LEFT JOIN c ON p.key = c.key""")
def cached_model_calls(s, d):
    """One answer for each different prompt: from the cache, else from the model's stand-in."""
    g = table(s, d, "generations").where("instruction is not null").withColumn("key", F.md5("instruction"))
    p = g.select("key", F.col("instruction").alias("prompt")).dropDuplicates(["key"])
    cache = g.where("size(generations) > 0 and generations[0] is not null").groupBy("key").agg(F.min("instruction").alias("prompt"), F.min_by("generations", "idx").alias("answers")).withColumn("error", F.lit(None).cast("string"))
    return cached_calls(p, cache).select("key", F.md5(F.get("answers", F.lit(0))).alias("answer_md5"), F.col("error").isNotNull().alias("failed"))


def context_files(s, d):
    """The Python blocks of each context as the files of a small repository."""
    t = block_rows(spread(table(s, d, "checked_test_set_final")), "orig_context", "record_id", "func_name")
    path = F.regexp_replace("path", r"(?i)\.py$", ".py")
    return t.where(path.endswith(".py")).select(F.col("record_id").cast("string").alias("repo_id"), T.path_module(path).alias("module"), F.col("body").alias("code"), "func_name", "pos")


@query()
def sliced_contexts(s, d):
    """Dependency slices of the delivered functions over the files of their own context."""
    files = context_files(s, d)
    last = files.groupBy("repo_id").agg(F.max_by("module", "pos").alias("module"), F.first("func_name").alias("name"))
    return slicing.contexts(files.select("repo_id", "module", "code"), last).select("repo_id", "module", "name", F.length("context").alias("n_chars"))


@query()
def built_call_graph(s, d):
    return slicing.call_graph(context_files(s, d).select("repo_id", "module", "code"))


@query()
def evaluation_scripts(s, d):
    """Scripts of all records of a base with each generated answer in place of the function."""
    g = table(s, d, "generations").select(base_idx("idx").alias("base"), F.posexplode("generations").alias("pos", "answer"))
    r = table(s, d, "checked_test_set_final").select("record_id", base_idx("idx").alias("base"), "eval_script", "func_name")
    j = g.join(r, "base")
    return j.select("record_id", "base", "pos", per_row(codetext.evaluation_script, "string", "eval_script", "answer", "func_name").alias("script"), per_row(codetext.target_body, "string", "answer", T.function_part("func_name")).alias("target"))


def _candidate_pairs(s, d):
    """Every later candidate beside the first one of its row."""
    g = table(s, d, "generations").where("size(generations) >= 2").select("idx", F.get("generations", F.lit(0)).alias("first"), F.posexplode("generations").alias("pos", "raw")).where("pos > 0 and raw is not null and first is not null")
    return g.select("idx", "pos", T.white_tokens("raw").alias("a"), T.white_tokens("first").alias("b"))


_WORDS = r"list_filter(string_split_regex({c}, '\s+'), lambda w: w <> '')"
_PAIRS = f"""WITH g AS (SELECT idx, (i - 1)::INT AS pos, {_WORDS.format(c='generations[i]')} AS a, {_WORDS.format(c='generations[1]')} AS b FROM generations, unnest(range(2, len(generations) + 1)) AS u(i) WHERE generations[i] IS NOT NULL AND generations[1] IS NOT NULL)"""


@query(_PAIRS + """,
x AS (SELECT idx, pos, n, a[i:i + n - 1] AS gram, count(*) AS k FROM g, unnest([1, 2]) AS v(n), unnest(range(1, len(a) - n + 2)) AS u(i) GROUP BY ALL),
y AS (SELECT idx, pos, n, b[i:i + n - 1] AS gram, count(*) AS k FROM g, unnest([1, 2]) AS v(n), unnest(range(1, len(b) - n + 2)) AS u(i) GROUP BY ALL),
m AS (SELECT x.idx, x.pos, x.n, sum(least(x.k, y.k)) AS hit FROM x JOIN y USING (idx, pos, n, gram) GROUP BY ALL),
f AS (SELECT g.idx, g.pos, v.n, CASE WHEN len(a) < v.n OR len(b) < v.n THEN 0 ELSE 2 * coalesce(hit, 0)::DOUBLE / (len(a) + len(b) - 2 * (v.n - 1)) END AS f FROM g CROSS JOIN (VALUES (1), (2)) AS v(n) LEFT JOIN m ON m.idx = g.idx AND m.pos = g.pos AND m.n = v.n)
SELECT idx, pos, round(max(CASE WHEN n = 1 THEN f END), 9) AS rouge_1, round(max(CASE WHEN n = 2 THEN f END), 9) AS rouge_2 FROM f GROUP BY idx, pos""")
def rouge_n(s, d):
    g = _candidate_pairs(s, d)
    return g.select("idx", "pos", F.round(metrics.rouge_n(F.col("a"), F.col("b"), 1), 9).alias("rouge_1"), F.round(metrics.rouge_n(F.col("a"), F.col("b"), 2), 9).alias("rouge_2"))


@query()
def rouge_l(s, d):
    g = _candidate_pairs(s, d)
    return g.select("idx", "pos", F.round(metrics.rouge_l(F.col("a"), F.col("b")), 9).alias("rouge_l"))
