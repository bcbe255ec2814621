"""Registered queries that write a table in some layout and read it back through the sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.names import base_idx, canonical_repo
from quarry.operators import sampling
from quarry.operators.ranking import rank_within
from quarry.plans.queries import BASE, REPO, RUNS, query, runs, table
from quarry.plans.rounds import run_rounds
from quarry.plans.runners import timed_map
from quarry.sources import external, readers, sinks
from quarry.streaming.stages import parquet_stream, run_available
from quarry.workspace import Workspace


def _path(s, name: str) -> str:
    return f"{Workspace(s, 'io').path}/{name}"


@query("SELECT repo_id, coalesce(topic, '') AS topic, coalesce(n_stars, -1)::BIGINT AS n_stars FROM repos")
def json_arrays(s, d):
    """Repositories written as files of one JSON array each and read back."""
    path = _path(s, "array")
    sinks.export_json_array(table(s, d, "repos").select("repo_id", F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("n_stars", F.lit(-1)).alias("n_stars")), path, 50)
    return readers.json_array(s, path, "repo_id string, topic string, n_stars bigint")


@query("SELECT repo_id, coalesce(topic, '') AS topic FROM repos")
def json_lines(s, d):
    """Repositories written as JSON lines and read back; the probe tells them from arrays."""
    path = _path(s, "lines")
    sinks.export_json(table(s, d, "repos").select("repo_id", F.coalesce("topic", F.lit("")).alias("topic")), path, 40)
    return readers.json_lines(s, path, "repo_id string, topic string")


@query("SELECT CASE WHEN contains(func_name, '.') THEN 'method' ELSE 'function' END AS kind, record_id::VARCHAR AS id, md5(orig_func) AS code_md5, func_name AS name FROM checked_test_set_final")
def tagged_functions(s, d):
    t = table(s, d, "checked_test_set_final")
    m, rid = F.contains("func_name", F.lit(".")), F.col("record_id").cast("string")
    t = t.select(F.when(~m, rid).alias("function_id"), F.when(m, rid).alias("method_id"), F.when(~m, F.col("orig_func")).alias("function_code"), F.when(m, F.col("orig_func")).alias("method_code"), F.when(~m, F.col("func_name")).alias("function_name"), F.when(m, F.col("func_name")).alias("method_name"))
    return readers.tagged_functions(t).select("kind", "id", F.md5("code").alias("code_md5"), "name")


@query("SELECT repo_id AS value FROM repos WHERE repo_id <> ''")
def line_lists(s, d):
    path = _path(s, "list")
    table(s, d, "repos").select(F.explode(F.array(F.col("repo_id"), F.lit(""))).alias("value")).write.text(path)
    return readers.line_list(s, path)


@query("SELECT repo_id AS line FROM repos WHERE repo_id <> ''")
def file_trees(s, d):
    """Repositories as lines of text files in two folders, read by walking the tree; a hidden folder is skipped."""
    path, t = _path(s, "tree"), table(s, d, "repos").select(F.col("repo_id").alias("value"))
    even = F.pmod(F.xxhash64("value"), F.lit(2)) == 0
    for folder, rows in (("a/b", t.where(even)), ("c", t.where(~even)), (".hidden", t)):
        rows.write.text(f"{path}/{folder}")
    return readers.file_tree(s, path, "*.txt").select(F.explode(T.lines("text")).alias("line")).where("line <> ''")


@query("SELECT repo_id AS prompt, coalesce(topic, '') AS response FROM repos")
def registered_data(s, d):
    """A registered data set whose columns get their standard names."""
    path = _path(s, "sets")
    table(s, d, "repos").select(F.col("repo_id").alias("question"), F.coalesce("topic", F.lit("")).alias("answer")).write.json(f"{path}/repos.jsonl")
    info = readers.registry({"repos": {"file_name": "repos.jsonl", "columns": {"prompt": "question", "response": "answer"}}}, ["repos"])["repos"]
    return readers.load_registered(s, info, path).select("prompt", "response")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def truncated(s, d):
    """The first fifty documents by id: the number is the feature."""
    return readers.first_rows(table(s, d, "documents").select("doc_id"), ["doc_id"], 50)


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def resumed_stage(s, d):
    """A stage broken off after a third of the documents and resumed in four parts: every document once."""
    path, t = _path(s, "resumed"), table(s, d, "documents")
    stage = lambda df: df.select("doc_id", F.md5("text").alias("text_md5"))
    sinks.resume(t.where("doc_id % 3 = 0"), path, "doc_id", stage)
    return sinks.resume(t, path, "doc_id", stage, 4)


@query("SELECT doc_id, len(text)::INT AS n FROM documents WHERE text IS NOT NULL")
def stored_stage(s, d):
    """A stage whose result is stored the first time and only read the second time."""
    path, t = _path(s, "stored"), table(s, d, "documents").where("text is not null")
    sinks.cached_stage(s, path, lambda: t.select("doc_id", F.length("text").alias("n")))
    return sinks.cached_stage(s, path, lambda: t.select(F.raise_error(F.lit("made twice"))))


@query("SELECT count(*) AS n_rows, true AS small FROM documents")
def split_files(s, d):
    """Files of at most 100 rows."""
    path = _path(s, "split")
    sinks.split_files(table(s, d, "documents").select("doc_id"), path, 100)
    per = s.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 100).alias("small"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 250)::INT AS block FROM documents")
def stored_blocks(s, d):
    """Blocks written one after the other into one table; a block that is written again replaces itself alone."""
    path = _path(s, "blocks")
    t = sampling.numbered_blocks(table(s, d, "documents").select("doc_id"), ["doc_id"], 250, Workspace(s, "blocks")).withColumn("block", F.col("block").cast("int"))
    sinks.write_blocks(t, path)
    sinks.write_blocks(t.where("block = 1"), path)
    return s.read.parquet(path).select("doc_id", "block")


@query("SELECT '[' || (row_number() OVER (ORDER BY record_id) - 1) || ']' AS head, count(*) OVER () AS n FROM checked_test_set_final")
def code_dump(s, d):
    """Functions as text with numbered headers, read back by their headers."""
    path = _path(s, "dump")
    t = table(s, d, "checked_test_set_final").select("record_id", F.coalesce("orig_func", F.lit("")).alias("code"), F.lit(0).alias("all"))
    sinks.write_code_dump(rank_within(t, ["all"], ["record_id"], Workspace(s, "dump")).select(F.col("rank").alias("pos"), "code"), path)
    heads = s.read.text(path).where(F.col("value").rlike(r"^\[\d+\]$")).select(F.col("value").alias("head"))
    n = table(s, d, "checked_test_set_final").count()
    return heads.withColumn("n", F.lit(n).cast("bigint"))


@query(f"SELECT idx, model_name_or_path, answer_md5 FROM (SELECT idx, 'model-a' AS model_name_or_path, md5(generations[1]) AS answer_md5 FROM generations WHERE len(generations) > 0)")
def harness_rows(s, d):
    """The first candidate of each row with the model's name from the name of its file."""
    t = table(s, d, "generations").select(F.transform("generations", lambda g: F.struct(F.col("idx").alias("idx"), F.md5(g).alias("answer_md5"))).alias("records"))
    return sinks.swebench_rows(t, "records", F.lit("runs/model-a.json")).select("idx", "model_name_or_path", "answer_md5")


@query("""WITH g AS (SELECT idx, list_transform(generations, lambda x: left(coalesce(x, ''), 12)) AS l FROM generations WHERE generations IS NOT NULL)
SELECT idx, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), '|') AS heads FROM g""")
def distinct_in_order(s, d):
    t = table(s, d, "generations").where("generations is not null").select("idx", F.transform("generations", lambda x: F.left(F.coalesce(x, F.lit("")), F.lit(12))).alias("l"))
    return t.select("idx", F.array_join(sinks.distinct_in_order(F.col("l")), "|").alias("heads"))


@query("SELECT 'coverage' AS metric, round(avg(coverage_rate), 9) AS value, 'final' AS name FROM checked_test_set_final WHERE NOT isnan(coverage_rate)")
def results_with_config(s, d):
    v = table(s, d, "checked_test_set_final").where(~F.isnan("coverage_rate")).agg(F.avg("coverage_rate")).first()[0]
    r = sinks.results_with_config(s, {"coverage": v or 0.0}, {"name": "final"})
    return r.select(F.explode("metrics").alias("metric", "value"), F.col("config")["name"].alias("name")).withColumn("value", F.round("value", 9))


@query("""WITH m AS (SELECT DISTINCT repo_name, CASE WHEN repo_name IS NULL OR len(repo_name) % 5 = 0 THEN -1 ELSE len(repo_name) END AS stars, CASE WHEN len(repo_name) % 5 <> 0 AND len(repo_name) % 2 = 0 THEN 'setup.py' ELSE '' END AS setup_file FROM repos WHERE repo_name IS NOT NULL)
SELECT count(*) AS repos, count_if(setup_file <> '')::BIGINT AS with_setup, round(count_if(setup_file <> '')::DOUBLE / count(*), 9) AS share FROM m""")
def repo_metadata(s, d):
    """Metadata through a look-up that fails for some names, and the share with a setup file."""
    def look_up(name: str) -> dict:
        if len(name) % 5 == 0:
            raise ConnectionError(name)
        return {"topics": [], "stars": len(name), "contributors": 1, "files": ["README.md", "setup.py"] if len(name) % 2 == 0 else ["README.md"]}

    m = external.repo_metadata(table(s, d, "repos").where("repo_name is not null").select("repo_name"), look_up)
    return external.setup_share(m).withColumn("share", F.round("share", 9))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def streamed_filter(s, d):
    """A stateless stage over a stream of files, run until all is read."""
    ws = Workspace(s, "stream")
    src = table(s, d, "events").select("event_id", "user_id", "event_type")
    sinks.split_files(src, f"{ws.path}/in", 20_000)
    schema = ", ".join(f"{n} {t}" for n, t in src.dtypes)
    run_available(parquet_stream(s, f"{ws.path}/in", schema, 8), lambda df: df.where("event_type = 'error'").select("event_id", "user_id"), f"{ws.path}/out", f"{ws.path}/state")
    return s.read.parquet(f"{ws.path}/out")


@query(f"""WITH b AS (SELECT base, max(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS ok, count(*) AS n FROM {RUNS} WHERE base IS NOT NULL GROUP BY base),
r AS (SELECT base, least(CASE WHEN ok = 1 THEN n - 1 ELSE 99 END, 2) AS last, CASE WHEN ok = 1 AND n <= 3 THEN true ELSE false END AS good FROM b)
SELECT base, last::INT AS round, good FROM r""")
def rounds(s, d):
    """Three rounds of generation and execution: a base that ever succeeded is good in the round of its last run."""
    b = runs(s, d).where("base is not null").groupBy("base").agg(F.max((F.col("status") == "success").cast("int")).alias("ok"), F.count("*").alias("n")).select(F.col("base").alias("idx"), F.coalesce("ok", F.lit(0)).alias("ok"), "n")
    state = {"r": -1}

    def generate(df):
        state["r"] += 1
        return df.drop("level").withColumn("level", F.lit(state["r"]))

    done = run_rounds(b, Workspace(s, "rounds"), generate, lambda df: df.withColumn("good", (F.col("ok") == 1) & (F.col("n") - 1 <= F.col("level"))), rounds=3, enough=1.1)
    return done.select(F.col("idx").alias("base"), "round", "good")


@query("SELECT repo_id, CASE WHEN len(repo_id) % 7 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN len(repo_id) % 7 = 0 THEN NULL ELSE upper(repo_id) END AS result FROM repos WHERE repo_id IS NOT NULL")
def mapped_with_status(s, d):
    """A function over rows whose failures are a status and not the end of the job."""
    def work(x: str) -> str:
        if len(x) % 7 == 0:
            raise ValueError(x)
        return x.upper()

    t = timed_map(table(s, d, "repos").where("repo_id is not null").select("repo_id"), "repo_id", work, seconds=30)
    return t.select("repo_id", "task.status", "task.result")


@query(f"""SELECT u.base, count(*) AS n_new FROM (SELECT DISTINCT {BASE} AS base FROM generations WHERE {BASE} IS NOT NULL) u JOIN (SELECT {BASE} AS base FROM exec_results) r ON u.base = r.base GROUP BY u.base""")
def worklist_runs(s, d):
    """Runs of the rows that are on the worklist (the generated ones)."""
    work = table(s, d, "generations").select(base_idx("idx").alias("base")).where("base is not null").distinct()
    return runs(s, d).join(work, "base", "left_semi").groupBy("base").agg(F.count("*").alias("n_new"))


@query(f"SELECT repo, count(*) AS n FROM (SELECT {REPO} AS repo FROM checked_test_set_final UNION ALL SELECT {REPO} FROM documents) WHERE repo IS NOT NULL GROUP BY repo")
def concatenated(s, d):
    """Rows of two tables by repository."""
    both = table(s, d, "checked_test_set_final").select(canonical_repo("repo_name").alias("repo")).unionByName(table(s, d, "documents").select(canonical_repo("repo_name").alias("repo")))
    return both.where("repo is not null").groupBy("repo").agg(F.count("*").alias("n"))
