"""Registered queries over fine-tuning records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import codetext
from quarry.functions import text as T
from quarry.functions.pyast import per_row
from quarry.operators import chat, evaluation
from quarry.plans.queries import query, table
from quarry.workspace import Workspace

QWEN = chat.TEMPLATES["qwen"]
CUTOFF = 600
_ASK = "'<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || {q} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
_SAY = "{a} || '<|im_end|>' || chr(10)"
_AGAIN = "'<|im_start|>user' || chr(10) || {q} || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
_CAND = "g AS (SELECT idx, instruction, (i - 1)::INT AS pos, generations[i] AS raw, generations[1] AS first FROM generations, unnest(range(1, len(generations) + 1)) AS u(i) WHERE generations[i] IS NOT NULL)"
#: DuckDB's form of the budget split; s, t and c are lengths and the room.
_CUT = "least({t}, CASE WHEN {t} * 2 < {c} THEN {c} WHEN {s} * 2 < {c} THEN {c} - {s} ELSE floor({c} * ({t}::DOUBLE / ({s} + {t}))) END)::INT"


def _candidates(s, d):
    """Every candidate of every generated row."""
    g = table(s, d, "generations").select("idx", "instruction", F.get("generations", F.lit(0)).alias("first"), F.posexplode("generations").alias("pos", "raw"))
    return g.where("raw is not null")


@query(f"""WITH {_CAND}
SELECT idx, pos, 'alpaca' AS layout, 1 AS n_prompt, md5({_ASK.format(q="coalesce(instruction, '')")}) AS source_md5, md5({_SAY.format(a='raw')}) AS target_md5 FROM g
UNION ALL SELECT idx, pos, 'thread', 1, md5({_ASK.format(q="instruction")}), md5({_SAY.format(a='raw')}) FROM g WHERE instruction IS NOT NULL""")
def chat_align(s, d):
    """All candidates as alpaca and as thread records, rendered with a template."""
    g = _candidates(s, d)
    alpaca = chat.align(g.select("idx", "pos", "instruction", F.lit("").alias("input"), F.col("raw").alias("output")), "alpaca").withColumn("layout", F.lit("alpaca"))
    thread = g.where("instruction is not null").select("idx", "pos", F.array(chat.message("human", F.col("instruction")), chat.message("gpt", F.col("raw"))).alias("messages"))
    thread = chat.align(thread, "sharegpt").withColumn("layout", F.lit("thread"))
    cols = ["idx", "pos", "layout", "prompt", "response", "system"]
    rows = alpaca.select(*cols).unionByName(thread.select(*cols)).where(chat.valid_for("sft"))
    pairs = chat.render_pairs(QWEN, F.concat("prompt", "response"), F.col("system"))
    return rows.select("idx", "pos", "layout", F.size("prompt").alias("n_prompt"), F.explode(pairs).alias("p")).select("idx", "pos", "layout", "n_prompt", F.md5("p.source").alias("source_md5"), F.md5("p.target").alias("target_md5"))


@query(f"""WITH r AS (SELECT record_id, split_name, func_name, orig_func, (record_id % 3)::INT AS kind FROM checked_test_set_final)
SELECT record_id, CASE WHEN kind = 0 THEN 3 WHEN kind = 1 THEN 0 ELSE 0 END AS n_prompt, CASE WHEN kind = 0 THEN 1 ELSE 0 END AS n_response, CASE WHEN kind = 0 THEN coalesce(split_name, '?') ELSE CASE WHEN kind = 1 THEN coalesce(split_name, '?') ELSE '' END END AS system, kind = 0 AS valid FROM r""")
def thread_shapes(s, d):
    """Whole threads with a system message, threads with an answer missing, and threads that start with the answer."""
    say = lambda role, c: chat.message(role, F.coalesce(F.col(c), F.lit("?")))
    kind = F.col("record_id") % 3
    whole = F.array(say("system", "split_name"), say("human", "func_name"), say("gpt", "orig_func"), say("human", "func_name"), say("gpt", "orig_func"))
    t = table(s, d, "checked_test_set_final").withColumn("messages", F.when(kind == 0, whole).when(kind == 1, F.slice(whole, 1, 4)).otherwise(F.array(say("gpt", "orig_func"), say("human", "func_name"))))
    a = chat.align_sharegpt(t)
    return a.select("record_id", F.size("prompt").alias("n_prompt"), F.size("response").alias("n_response"), "system", chat.valid_for("sft").alias("valid"))


def _two_turns(s, d):
    """Two-turn threads of each record, encoded by code points: the name, then the function."""
    t = table(s, d, "checked_test_set_final").where("func_name is not null and orig_func is not null and split_name is not null")
    turns = F.array(chat.message("user", F.col("func_name")), chat.message("assistant", F.col("split_name")), chat.message("user", F.lit("go on")), chat.message("assistant", F.col("orig_func")))
    return t.select("record_id", chat.encoded_pairs(chat.render_pairs(QWEN, turns, F.lit(""))).alias("pairs"))


_TURNS = f"""t AS (SELECT record_id, {_ASK.format(q='func_name')} AS s1, {_SAY.format(a='split_name')} AS t1, {_AGAIN.format(q="'go on'")} AS s2, {_SAY.format(a='orig_func')} AS t2
 FROM checked_test_set_final WHERE func_name IS NOT NULL AND orig_func IS NOT NULL AND split_name IS NOT NULL),
n AS (SELECT *, len(s1) AS a1, len(t1) AS b1, len(s2) AS a2, len(t2) AS b2 FROM t),
f AS (SELECT *, {_CUT.format(s='a1', t='b1', c=CUTOFF)} AS k1 FROM n),
f2 AS (SELECT *, least(a1, greatest({CUTOFF} - k1, 0))::INT AS j1 FROM f),
f3 AS (SELECT *, {CUTOFF} - j1 - k1 AS room FROM f2),
f4 AS (SELECT *, CASE WHEN room <= 0 THEN 0 ELSE {_CUT.format(s='a2', t='b2', c='room')} END AS k2 FROM f3),
f5 AS (SELECT *, CASE WHEN room <= 0 THEN 0 ELSE least(a2, greatest(room - k2, 0)) END::INT AS j2 FROM f4),
h AS (SELECT record_id, {_CUT.format(s='a2', t='b2', c=CUTOFF)} AS k2, * EXCLUDE (record_id) FROM n),
h2 AS (SELECT *, least(a2, greatest({CUTOFF} - k2, 0))::INT AS j2 FROM h),
h3 AS (SELECT *, {CUTOFF} - j2 - k2 AS room FROM h2),
h4 AS (SELECT *, CASE WHEN room <= 0 THEN 0 ELSE {_CUT.format(s='a1', t='b1', c='room')} END AS k1 FROM h3),
h5 AS (SELECT *, CASE WHEN room <= 0 THEN 0 ELSE least(a1, greatest(room - k1, 0)) END::INT AS j1 FROM h4)"""
_IDS = "list_transform(string_split({c}, ''), lambda x: unicode(x))"
_TEXT = "left(s1, j1) || left(t1, k1) || left(s2, j2) || left(t2, k2)"


@query(f"""WITH {_TURNS}
SELECT record_id, len({_TEXT})::INT AS n, md5({_TEXT}) AS text_md5, (k1 + k2)::INT AS learned, j1::INT AS first_label FROM f5""")
def sft_encode(s, d):
    """Ids and labels of two turns under a budget; ids are code points, so they spell the text."""
    t = _two_turns(s, d).select("record_id", chat.encode_supervised(F.col("pairs"), CUTOFF).alias("e"))
    learned = F.filter("e.labels", lambda x: x != chat.IGNORE)
    first = F.array_position(F.transform("e.labels", lambda x: x != chat.IGNORE), True) - 1
    return t.select("record_id", F.size("e.input_ids").alias("n"), _spelled(F.col("e.input_ids")).alias("text_md5"), F.size(learned).alias("learned"), first.cast("int").alias("first_label"))


def _spelled(ids):
    """md5 of the text that code points spell."""
    one = per_row(lambda xs: None if xs is None else "".join(map(chr, xs)), "string", ids)
    return F.md5(one)


@query(f"""WITH {_TURNS}
SELECT record_id, len({_TEXT})::INT AS n, md5({_TEXT}) AS text_md5, k2::INT AS learned FROM h5""")
def sft_encode_last(s, d):
    """The same with the history masked: the last turn comes first in the budget and alone is learned."""
    t = _two_turns(s, d).select("record_id", chat.encode_supervised(F.col("pairs"), CUTOFF, mask_history=True).alias("e"))
    return t.select("record_id", F.size("e.input_ids").alias("n"), _spelled(F.col("e.input_ids")).alias("text_md5"), F.size(F.filter("e.labels", lambda x: x != chat.IGNORE)).alias("learned"))


@query(f"""WITH {_TURNS}, e AS (SELECT record_id // 500 AS batch, (j1 + k1 + j2 + k2) AS n FROM f5)
SELECT batch, sum(n)::BIGINT AS tokens, count(*) AS segments, true AS fits, true AS labels_fit FROM e WHERE n <= 1299 GROUP BY batch""")
def sft_packed(s, d):
    """Packs of encoded rows: every row that fits stands in one pack as a numbered segment, packs have the full length."""
    t = _two_turns(s, d).select("record_id", chat.encode_supervised(F.col("pairs"), CUTOFF).alias("e"))
    t = t.select(F.expr("record_id div 500").alias("batch"), F.col("record_id").alias("pos"), "e.input_ids", "e.labels")
    t = Workspace(s, "sft").save(t, "encoded")  # lengths and rows are read apart
    p = chat.packed_supervised(t, "batch", "pos", 1300)
    p = p.withColumn("lengths", chat.segment_lengths(F.col("attention_mask")))
    sizes = [F.size(c) == 1300 for c in ("input_ids", "labels", "attention_mask")]
    padding = F.size(F.filter("attention_mask", lambda x: x == 0))
    ends = chat.cumulative_lengths(F.col("lengths"))
    p = p.select("batch", F.element_at(ends, -1).alias("tokens"), F.size("lengths").alias("segments"), (sizes[0] & sizes[1] & sizes[2] & (padding >= 1)).alias("fits"), (F.size(F.filter("labels", lambda x: x == chat.IGNORE)) >= padding).alias("ok"))
    return p.groupBy("batch").agg(F.sum("tokens").alias("tokens"), F.sum("segments").alias("segments"), F.bool_and("fits").alias("fits"), F.bool_and("ok").alias("labels_fit"))


@query("""WITH t AS (SELECT doc_id // 200 AS batch, doc_id, lower(lang) || chr(3) AS x FROM documents WHERE lang IS NOT NULL),
w AS (SELECT batch, string_agg(x, '' ORDER BY doc_id) AS x FROM t GROUP BY batch)
SELECT batch, i::BIGINT AS block, md5(substr(x, (i * 64 + 1)::BIGINT, 64)) AS text_md5 FROM w, unnest(range(len(x) // 64)) AS u(i)""")
def pretrain_ids(s, d):
    """Languages of 200 documents at a time run together with an end token and cut into blocks of 64 tokens."""
    t = table(s, d, "documents").where("lang is not null").select(F.expr("doc_id div 200").alias("batch"), "doc_id", chat.code_points(F.concat(F.lower("lang"), F.lit("\x03"))).alias("ids"))
    return chat.pretrain_ids(t, ["batch"], ["doc_id"], "ids", 64).select("batch", "block", _spelled(F.col("input_ids")).alias("text_md5"))


@query(f"""WITH {_CAND}, p AS (SELECT idx, pos, coalesce(instruction, '') AS q, raw AS c, first AS r FROM g WHERE first IS NOT NULL),
n AS (SELECT idx, pos, {_ASK.format(q='q')} AS s, {_SAY.format(a='c')} AS c, {_SAY.format(a='r')} AS r FROM p),
k AS (SELECT *, {_CUT.format(s='len(s)', t='greatest(len(c), len(r))', c=400)} AS k FROM n),
j AS (SELECT *, least(len(s), greatest(400 - k, 0))::INT AS j FROM k)
SELECT idx, pos, md5(left(s, j) || left(c, k)) AS chosen_md5, md5(left(s, j) || left(r, k)) AS rejected_md5, least(len(c), k)::INT AS n_chosen, least(len(r), k)::INT AS n_rejected FROM j""")
def pairwise_encode(s, d):
    """Every candidate as chosen and the first one as rejected, behind the same prompt."""
    g = _candidates(s, d).where("first is not null").select("idx", "pos", "instruction", F.lit("").alias("input"), F.col("raw").alias("chosen"), F.col("first").alias("rejected"))
    e = chat.encode_stage(chat.align_alpaca(g, ranking=("chosen", "rejected")), "rm", QWEN, 400)
    learned = lambda c: F.size(F.filter(c, lambda x: x != chat.IGNORE))
    return e.select("idx", "pos", _spelled(F.col("chosen_input_ids")).alias("chosen_md5"), _spelled(F.col("rejected_input_ids")).alias("rejected_md5"), learned("chosen_labels").alias("n_chosen"), learned("rejected_labels").alias("n_rejected"))


@query(f"""WITH r AS (SELECT record_id, (record_id // 100) AS batch, func_name AS q, coalesce(repo_name, 'none') AS a, coverage_rate = 1 AS good FROM checked_test_set_final WHERE func_name IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY record_id) - 1 AS pos, count(*) OVER (PARTITION BY batch) AS n FROM r),
m AS (SELECT x.record_id, coalesce(x.good, false) AS kto_tag, x.q, x.a, y.a AS kl FROM p x JOIN p y ON x.batch = y.batch AND y.pos = x.n - 1 - x.pos),
k AS (SELECT *, {_CUT.format(s='len(q)', t='len(a)', c=40)} AS ka, {_CUT.format(s='len(q)', t='len(kl)', c=40)} AS kk FROM m)
SELECT record_id, kto_tag, md5(left(q, least(len(q), greatest(40 - ka, 0))::BIGINT) || left(a, ka)) AS text_md5, md5(left(q, least(len(q), greatest(40 - kk, 0))::BIGINT) || left(kl, kk)) AS kl_md5, ka AS learned FROM k""")
def feedback_encode(s, d):
    """Feedback rows with the mirrored answer of their batch of 100."""
    from pyspark.sql import Window as W

    t = table(s, d, "checked_test_set_final").where("func_name is not null").select("record_id", F.expr("record_id div 100").alias("batch"), F.col("func_name").alias("q"), F.coalesce("repo_name", F.lit("none")).alias("output"), F.coalesce(F.col("coverage_rate") == 1, F.lit(False)).alias("good"), F.lit("").alias("input"))
    t = t.withColumn("pos", (F.row_number().over(W.partitionBy("batch").orderBy("record_id")) - 1).cast("bigint"))
    a = chat.align_alpaca(t.withColumn("instruction", F.col("q")), kto_tag="good")
    e = chat.encode_feedback(a, "batch", "pos", "q", "response", 40)
    return e.select("record_id", "kto_tag", _spelled(F.col("input_ids")).alias("text_md5"), _spelled(F.col("kl_input_ids")).alias("kl_md5"), F.size(F.filter("labels", lambda x: x != chat.IGNORE)).alias("learned"))


@query(f"""WITH {_CAND}, n AS (SELECT idx, pos, {_ASK.format(q="coalesce(instruction, '')")} AS s, {_SAY.format(a="CASE WHEN pos % 2 = 0 THEN raw ELSE '' END")} AS t FROM g),
k AS (SELECT *, {_CUT.format(s='len(s)', t='len(t)', c=300)} AS k FROM n)
SELECT idx, pos, md5(left(s, least(len(s), greatest(300 - k, 0))::BIGINT)) AS prompt_md5, md5(left(t, k)) AS answer_md5 FROM k""")
def unsupervised_encode(s, d):
    """Prompt and answer apart; every second candidate is left without its answer."""
    g = _candidates(s, d).select("idx", "pos", "instruction", F.lit("").alias("input"), F.when(F.col("pos") % 2 == 0, F.col("raw")).alias("output"))
    e = chat.encode_stage(chat.align_alpaca(g), "generate", QWEN, 300)
    return e.select("idx", "pos", _spelled(F.col("input_ids")).alias("prompt_md5"), _spelled(F.col("labels")).alias("answer_md5"))


_TEMPLATES_SQL = " UNION ALL ".join(
    "SELECT record_id, '{n}' AS template, md5({lead} || replace({user}, '{{{{content}}}}', q)) AS source_md5, md5(replace({say}, '{{{{content}}}}', a)) AS target_md5 FROM r".format(
        n=n,
        lead="'" + (t.prefix + (t.system.replace("{{content}}", t.default_system) if t.default_system else "")).replace("'", "''") + "'",
        user="'" + t.user.replace("'", "''") + "'",
        say="'" + t.assistant.replace("'", "''") + "'",
    )
    for n, t in chat.TEMPLATES.items()
)


@query("WITH r AS (SELECT record_id, func_name AS q, func_path AS a FROM checked_test_set_final WHERE func_name IS NOT NULL AND func_path IS NOT NULL) " + _TEMPLATES_SQL)
def templates(s, d):
    """One turn of every record in every chat format."""
    t = table(s, d, "checked_test_set_final").where("func_name is not null and func_path is not null")
    turns = F.array(chat.message("user", F.col("func_name")), chat.message("assistant", F.col("func_path")))
    each = [F.struct(F.lit(n).alias("template"), chat.render_pairs(x, turns, F.lit(""))[0].alias("p")) for n, x in chat.TEMPLATES.items()]
    return t.select("record_id", F.explode(F.array(*each)).alias("e")).select("record_id", "e.template", F.md5("e.p.source").alias("source_md5"), F.md5("e.p.target").alias("target_md5"))


_JSON = """'{"name": "' || regexp_replace(lower(repo_name), '[^a-z]', '', 'g') || '", "description": "d' || n_stars || '", "parameters": {"properties": {"x": {"type": "string", "description": "p", "enum": ["a", "b"]}}, "required": ["x"]}}'"""


@query(f"""WITH r AS (SELECT repo_id, regexp_replace(lower(repo_name), '[^a-z]', '', 'g') AS n, n_stars, {_JSON} AS j FROM repos WHERE repo_name IS NOT NULL AND n_stars IS NOT NULL)
SELECT repo_id, md5('> Tool Name: ' || n || chr(10) || 'Tool Description: d' || n_stars || chr(10) || 'Tool Args:' || chr(10) || '  - x (string, required): p, should be one of [a, b]' || chr(10) || chr(10)) AS default_md5,
 md5('[' || '{{"type": "function", "function": ' || j || '}}' || ']') AS mistral_md5, md5(chr(10) || '{{"type": "function", "function": ' || j || '}}') AS qwen_md5 FROM r""")
def tool_texts(s, d):
    """A tool description for each repository in three dialects; the spacing of the JSON has to agree."""
    n = F.regexp_replace(F.lower("repo_name"), "[^a-z]", "")
    raw = F.concat(F.lit('[{"name": "'), n, F.lit('", "description": "d'), F.col("n_stars").cast("string"), F.lit('", "parameters": {"properties": {"x": {"type": "string", "description": "p", "enum": ["a", "b"]}}, "required": ["x"]}}]'))
    t = table(s, d, "repos").where("repo_name is not null and n_stars is not null").select("repo_id", raw.alias("tools"))
    for name in ("default", "mistral", "qwen"):
        t = chat.tool_text(t, "tools", name).withColumn(f"{name}_md5", F.md5("tool_text")).drop("tool_text")
    return t.drop("tools")


@query("""WITH r AS (SELECT repo_id, regexp_replace(lower(repo_name), '[^a-z]', '', 'g') AS n, '{"stars": ' || n_stars || '}' AS a FROM repos WHERE repo_name IS NOT NULL AND n_stars IS NOT NULL)
SELECT repo_id, dialect, md5(CASE dialect WHEN 'default' THEN 'Action: ' || n || chr(10) || 'Action Input: ' || a || chr(10) WHEN 'glm4' THEN n || chr(10) || a WHEN 'llama3' THEN '{"name": "' || n || '", "parameters": ' || a || '}'
 WHEN 'mistral' THEN '[{"name": "' || n || '", "arguments": ' || a || '}]' ELSE '<tool_call>' || chr(10) || '{"name": "' || n || '", "arguments": ' || a || '}' || chr(10) || '</tool_call>' END) AS text_md5, n AS name, a AS arguments
FROM r, unnest(['default', 'glm4', 'llama3', 'mistral', 'qwen']) AS u(dialect)""")
def tool_calls(s, d):
    """A call written and read again in every dialect."""
    call = F.array(F.struct(F.regexp_replace(F.lower("repo_name"), "[^a-z]", "").alias("name"), F.concat(F.lit('{"stars": '), F.col("n_stars").cast("string"), F.lit("}")).alias("arguments")))
    t = table(s, d, "repos").where("repo_name is not null and n_stars is not null").select("repo_id", call.alias("c"))
    out = None
    for name in chat.DIALECTS:
        one = t.select("repo_id", F.lit(name).alias("dialect"), chat.tool_call_text(F.col("c"), name).alias("text"))
        one = one.select("repo_id", "dialect", F.md5("text").alias("text_md5"), chat.tool_calls(F.col("text"), name).alias("back"))
        one = one.select("repo_id", "dialect", "text_md5", F.col("back")[0]["name"].alias("name"), F.col("back")[0]["arguments"].alias("arguments"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH s AS (SELECT list(struct_pack(q := description, a := subject) ORDER BY subject_id) AS l FROM subject_areas),
m AS (SELECT flatten(list_transform(l, lambda x: [x.q, x.a])) AS m FROM s)
SELECT doc_id, (len(m) + 2)::INT AS n_messages, md5('Answer with a subject. ' || m[1] || array_to_string(m[2:], '|') || '|' || coalesce(left(text, 100), '') || '|?') AS text_md5 FROM documents, m""")
def multi_shot(s, d):
    """The subjects as worked examples before each document's first hundred characters."""
    rows = table(s, d, "subject_areas").orderBy("subject_id").collect()  # ten rows, fixed
    shots = F.array(*[F.struct(F.lit(r["description"]).alias("question"), F.lit(r["subject"]).alias("answer")) for r in rows])
    t = table(s, d, "documents")
    m = chat.few_shot("Answer with a subject. ", shots, F.struct(F.coalesce(F.left("text", F.lit(100)), F.lit("")).alias("question"), F.lit("?").alias("answer")))
    first = F.concat(m[0]["content"], F.array_join(F.transform(F.slice(m, F.lit(2), F.size(m)), lambda x: x["content"]), "|"))
    return t.select("doc_id", F.size(m).alias("n_messages"), F.md5(first).alias("text_md5"))


@query("""SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 3 ELSE 4 END AS n_messages, md5('assistant:' || coalesce(func_name, '') || '|user:' || coalesce(coverage_report, '')) AS tail_md5 FROM checked_test_set_final""")
def updated_histories(s, d):
    """An answer and its feedback behind a history, in place of an answer that ends it."""
    old = F.array(chat.message("user", F.col("func_path")), chat.message("assistant", F.col("func_name")))
    t = table(s, d, "checked_test_set_final").withColumn("h", F.when(F.col("record_id") % 2 == 0, old).otherwise(F.array(old[1], old[0])))
    m = chat.interactive_update(F.col("h"), F.coalesce("func_name", F.lit("")), F.coalesce("coverage_report", F.lit("")))
    tail = F.array_join(F.transform(F.slice(m, F.size(m) - 1, F.lit(2)), lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|")
    return t.select("record_id", F.size(m).alias("n_messages"), F.md5(tail).alias("tail_md5"))


@query("""WITH b AS (SELECT record_id, func_name, regexp_extract_all(orig_context, '(?s)```(\\w*)\\n(.*?)\\n```', 2) AS bs FROM checked_test_set_final WHERE func_name IS NOT NULL)
SELECT record_id, md5(CASE WHEN coalesce(len(bs), 0) > 0 THEN '# ' || replace('Code of the same repository that may help:' || chr(10) || repeat('-', 50) || chr(10) ||
 array_to_string(list_transform(bs[:2], lambda x: 'From the file' || chr(10) || split_part(string_split(x, chr(10))[1], ' ', 2) || chr(10) || repeat('-', 50) || chr(10) || x || chr(10) || repeat('-', 50)), chr(10)), chr(10), chr(10) || '# ') || chr(10) || func_name ELSE func_name END) AS prompt_md5 FROM b""".replace("\\\\", "\\"))
def prompts_with_context(s, d):
    """Benchmark prompts: the two best documents as commented context before the task's own prompt, through the task interface."""
    task = evaluation.TASKS["humaneval"]()
    docs = F.transform(T.fenced_blocks("orig_context"), lambda b: F.struct(F.coalesce(T.doc_title(b["body"]), F.lit("")).alias("title"), b["body"].alias("text")))
    t = table(s, d, "checked_test_set_final").where("func_name is not null").withColumn("prompt", F.col("func_name"))
    return t.select("record_id", F.md5(evaluation.with_context(task.prompt(), docs, 2)).alias("prompt_md5"))


@query()
def sft_examples(s, d):
    """Fine-tuning examples from the delivered contexts: masked target file behind the other blocks, and the function's body."""
    t = table(s, d, "checked_test_set_final").select("record_id", F.transform(T.fenced_blocks("orig_context"), lambda b: b["body"]).alias("blocks"), "func_path", "func_name")
    made = per_row(lambda bs, path, name: codetext.sft_example(None if bs is None else list(bs), path, name), "array<string>", "blocks", "func_path", "func_name")
    return t.select("record_id", made.alias("e")).where("e is not null").select("record_id", F.col("e")[0].alias("input"), F.col("e")[1].alias("output"))


@query(rf"""SELECT record_id, md5(regexp_replace(coalesce(orig_func, ''), '\s+$', '') || chr(10) || '-') AS instruction_md5, md5(chr(10) || coalesce(func_name, '')) AS output_md5, 'checked_test_set_final' AS source FROM checked_test_set_final""")
def starcoder_rows(s, d):
    """Instructions without trailing blanks, outputs behind a line end, and the table a row comes from."""
    t = table(s, d, "checked_test_set_final").select("record_id", F.coalesce("orig_func", F.lit("")).alias("instruction"), F.coalesce("func_name", F.lit("")).alias("output"))
    t = chat.source_tagged(chat.starcoder_form(t), "checked_test_set_final")
    return t.select("record_id", F.md5(F.concat("instruction", F.lit("\n-"))).alias("instruction_md5"), F.md5("output").alias("output_md5"), "source")
