"""The registered queries of this subpackage and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.names import canonical_repo
from quarry.llm import budget, capping, credentials, mixing, neardup, overlap, packing, spans, splits, subjects
from quarry.plans.sized import spread
from quarry.workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "checked_test_set_final")


def _texts(spark: SparkSession, sf_dir: str, name: str = "checked_test_set_final") -> DataFrame:
    return spread(_table(spark, sf_dir, name))


def p1_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.token_totals(_texts(spark, sf_dir), _table(spark, sf_dir, "repos"), Workspace(spark, "p1"))


def p1_record_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.record_tokens(_texts(spark, sf_dir), Workspace(spark, "p1"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.named_groups(_records(spark, sf_dir), Workspace(spark, "p2"))


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped_splits(_records(spark, sf_dir), Workspace(spark, "p2"))


def p2_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_report(_records(spark, sf_dir), Workspace(spark, "p2")).withColumn("share", F.round("share", 9))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capping.cap_records(_records(spark, sf_dir), Workspace(spark, "p7")).where(~F.col("kept")).select("record_id")


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capping.cap_records(_records(spark, sf_dir), Workspace(spark, "p7")).where("kept").select("record_id", F.col("key").alias("repo"), "score")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.span_pairs(spans.shared_spans(_texts(spark, sf_dir), Workspace(spark, "p3")))


def p3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record's context is shared; a record without one has no characters."""
    records = _texts(spark, sf_dir)
    return spans.shared_share(spans.shared_spans(records, Workspace(spark, "p3")), records).fillna(0)


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "p4")
    return ws.save(credentials.scored(_texts(spark, sf_dir), ws), "scored")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_lines(_marked(spark, sf_dir))


def p4_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.masked(_records(spark, sf_dir), _marked(spark, sf_dir))


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each record: whether masking leaves nulls, lines and all texts without a find as they were."""
    records = _texts(spark, sf_dir)
    ws = Workspace(spark, "p4")
    marked = ws.save(_marked(spark, sf_dir).select("record_id", "field_name", "line_no", "pieces", "probability"), "again")
    new = credentials.masked(records, marked)
    fields = ("orig_context", "eval_script")
    new = new.select("record_id", "masked_values", *[F.col(f).alias(f"new_{f}") for f in fields])
    both = records.select("record_id", *fields).join(new, "record_id")
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    alike = lambda test: F.expr("true") & test(fields[0]) & test(fields[1])
    lines = alike(lambda f: ends(F.col(f)).eqNullSafe(ends(F.col(f"new_{f}"))))
    untouched = (F.col("masked_values") > 0) | alike(lambda f: F.col(f).eqNullSafe(F.col(f"new_{f}")))
    return both.select("record_id", lines.alias("same_lines"), untouched.alias("others_untouched"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = overlap.record_pairs(*overlap.cross_split(_texts(spark, sf_dir), Workspace(spark, "p5"), 0.7))
    return pairs.select(F.least("left_id", "right_id").alias("record_id_a"), F.greatest("left_id", "right_id").alias("record_id_b"))


def p5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlapping pair with the names of both sides and the words covered."""
    records = _texts(spark, sf_dir)
    pairs = overlap.record_pairs(*overlap.cross_split(records, Workspace(spark, "p5"), 0.7))
    names = records.select("record_id", F.lower(F.trim("split_name")).alias("split"), "repo_name", "func_name")
    left = names.select(*[F.col(c).alias("left_id" if c == "record_id" else f"train_{c}") for c in names.columns]).drop("train_split")
    right = names.select(*[F.col(c).alias("right_id" if c == "record_id" else f"eval_{c}") for c in names.columns])
    return pairs.join(left, "left_id").join(right, "right_id").withColumnsRenamed({"left_id": "train_id", "right_id": "eval_id"})


def p5_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlapping pair with its exact similarity."""
    pairs = overlap.record_pairs(*overlap.cross_split(_texts(spark, sf_dir), Workspace(spark, "p5"), 0.7))
    return pairs.select(F.col("left_id").alias("train_id"), F.col("right_id").alias("eval_id"), F.round("similarity", 9).alias("similarity"))


def p5_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and evaluation records by evaluation split and repository."""
    rows = p5_overlaps(spark, sf_dir)
    return rows.groupBy("eval_split", canonical_repo("eval_repo_name").alias("repo")).agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_id").alias("n_records"))


def p5_coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of an evaluation record's words its best training record covers: mean, and records covered in full, by split."""
    best = p5_overlaps(spark, sf_dir).groupBy("eval_split", "eval_id").agg(F.max("coverage_right").alias("covered"))
    return best.groupBy("eval_split").agg(F.count("*").alias("n_records"), F.avg("covered").alias("avg_coverage"), F.count_if(F.col("covered") >= 1).alias("n_whole"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_texts(spark, sf_dir), Workspace(spark, "p6"), ["orig_context", "eval_script"], 0.7)
    return neardup.expand_pairs(*found).select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b")).distinct()


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_texts(spark, sf_dir), Workspace(spark, "p6"), ["orig_context", "eval_script"], 0.7)
    names = F.array(F.lit("orig_context"), F.lit("eval_script"))
    return neardup.membership(*found).withColumn("field", names[F.col("field")])


def _sizes(spark: SparkSession, sf_dir: str, ws: Workspace) -> DataFrame:
    return ws.save(packing.document_tokens(_texts(spark, sf_dir, "documents"), ws), "sizes")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "p8")
    return packing.fill_containers(_sizes(spark, sf_dir, ws), ws)


def p8_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with a place: whether its parts follow each other, only an oversized one is cut, and its containers hold."""
    ws = Workspace(spark, "p8")
    placed = ws.save(p8_containers(spark, sf_dir), "placed")
    load = placed.groupBy("container").agg(F.sum("length").alias("load"))
    parts = placed.join(ws.save(load, "load"), "container").groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("part").alias("k"), F.sum("length").alias("tokens"), F.max(F.col("first_token") + F.col("length")).alias("end"), F.max("load").alias("load"))
    fits = F.col("load") <= packing.CAPACITY
    return parts.select("doc_id", ((F.col("n") == F.col("k")) & (F.col("tokens") == F.col("end"))).alias("whole"), (F.col("n") == F.ceil(F.col("tokens") / packing.CAPACITY)).alias("cut_only_if_long"), fits.alias("fits"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "p9")
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), _sizes(spark, sf_dir, ws), _table(spark, sf_dir, "source_targets"), ws)[0]


def p9_mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "p9")
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), _sizes(spark, sf_dir, ws), _table(spark, sf_dir, "source_targets"), ws)[1]


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source with a target and documents: whether the mix misses its share by two documents at most and keeps to its repeats."""
    ws = Workspace(spark, "p9")
    copies, report = mixing.mix_sources(_table(spark, sf_dir, "documents"), _sizes(spark, sf_dir, ws), _table(spark, sf_dir, "source_targets"), ws)
    largest, total = copies.agg(F.max("tokens"), F.sum(F.col("tokens") * F.col("copies"))).first()
    miss = F.abs(F.col("mix_tokens") - F.col("target_share") * (total or 0))
    r = report.where("target_share > 0 and available_documents > 0")
    return r.select("source", (miss <= 2 * (largest or 0)).alias("on_target"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "p10")
    found = subjects.document_subjects(_texts(spark, sf_dir, "documents"), _table(spark, sf_dir, "subject_labels"), _table(spark, sf_dir, "subject_areas"), ws)
    return ws.save(found, "found")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject")


def p10_make_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.corpus_make_up(_subjects(spark, sf_dir), _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_token_totals": p1_token_totals,
    "p1_record_tokens": p1_record_tokens,
    "p2_found": p2_found,
    "p2_splits": p2_splits,
    "p2_split_report": p2_split_report,
    "p3_found": p3_found,
    "p3_shared": p3_shared,
    "p4_found": p4_found,
    "p4_masked": p4_masked,
    "p4_checks": p4_checks,
    "p5_found": p5_found,
    "p5_overlaps": p5_overlaps,
    "p5_similarities": p5_similarities,
    "p5_overlap_report": p5_overlap_report,
    "p5_coverage_report": p5_coverage_report,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p7_kept": p7_kept,
    "p8_containers": p8_containers,
    "p8_fill_report": p8_fill_report,
    "p8_checks": p8_checks,
    "p9_mix": p9_mix,
    "p9_mix_report": p9_mix_report,
    "p9_checks": p9_checks,
    "p10_found": p10_found,
    "p10_make_up": p10_make_up,
}

#: DuckDB's form of the canonical repository name.
_REPO = r"""
regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\s+', '', 'g'),
 '^([a-z][a-z0-9+.-]*://[^/]+/|[^@/:]+@[^:/]+:)', ''), '/+$', ''), '\.git$', ''), '^([^/]+)/(.+)$', '\1___\2'), '^.+?___.+$')"""

_RANKED = f"""
WITH r AS (
  SELECT record_id, nullif({_REPO.format(c="repo_name")}, '') AS repo,
         CASE WHEN coverage_rate IS NULL OR isnan(coverage_rate) OR coverage_rate < 0 THEN -1.0::DOUBLE ELSE coverage_rate END AS score
  FROM checked_test_set_final),
k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY score DESC, record_id) AS rn FROM r)
"""

_GROUPS = f"""
WITH RECURSIVE r AS (
  SELECT record_id, nullif({_REPO.format(c="repo_name")}, '') AS repo,
         nullif(regexp_replace(regexp_replace(string_split(idx, '_')[1], '^\\s+|\\s+$', '', 'g'), '^0+(.)', '\\1'), '') AS base
  FROM checked_test_set_final),
k AS (SELECT record_id, repo, 'o:' || string_split(repo, '___')[1] AS o, 'b:' || base AS b FROM r),
e AS (SELECT DISTINCT coalesce(o, b) AS x, coalesce(b, o) AS y FROM k WHERE coalesce(o, b) IS NOT NULL),
f AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
c AS (SELECT x AS node, x AS seen FROM f UNION SELECT c.node, f.y FROM c JOIN f ON c.seen = f.x),
m AS (SELECT node, min(seen) AS root FROM c GROUP BY node),
g AS (SELECT k.record_id, k.repo, m.root FROM k JOIN m ON coalesce(k.b, k.o) = m.node),
h AS (SELECT root, min(repo) AS group_key, count(*) AS n FROM g GROUP BY root)
"""

_SHINGLES = """
w AS (SELECT id, list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS t FROM texts WHERE text IS NOT NULL),
s AS (SELECT DISTINCT id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM w, unnest(range(1, len(t) - 1)) AS u(i)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
found AS (SELECT c.a, c.b FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE c.k >= 0.7 * (x.n + y.n - c.k))
"""

_SPLIT = """CASE least({t}, {v}, {e}) WHEN {t} THEN 'train' WHEN {v} THEN 'valid' ELSE 'test' END""".format(
    **{k: f"(-ln((('0x' || substr(md5('0|{n}|' || key), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(16**13)!r}) / {w})" for k, n, w in (("t", "train", 0.8), ("v", "valid", 0.1), ("e", "test", 0.1))}
)

_SPLITS = (
    _GROUPS
    + """, every AS (SELECT record_id, root AS key FROM g UNION ALL SELECT record_id, 'r:' || record_id FROM k WHERE o IS NULL AND b IS NULL),
news AS (SELECT record_id, key, """
    + _SPLIT
    + """ AS new_split FROM every)
"""
)

_COPIES = """, sizes AS (SELECT a, b, CASE WHEN k = nx AND k = ny THEN true ELSE false END AS same FROM (SELECT c.a, c.b, c.k, x.n AS nx, y.n AS ny FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE c.k >= 0.7 * (x.n + y.n - c.k))),
ends AS (SELECT a AS id, b AS other, same FROM sizes UNION ALL SELECT b, a, same FROM sizes)
SELECT '{f}' AS field, n.id AS record_id, least(n.id, min(CASE WHEN same THEN other END)) AS class_id, count(other) AS links FROM n LEFT JOIN ends e ON e.id = n.id GROUP BY n.id"""

_PLACE = "regexp_matches(text, '[^\\s\\p{Z}\\x{85}\\x{1C}-\\x{1F}\\x0B]')"

ORACLES: dict[str, str] = {
    "p2_splits": _SPLITS + "SELECT record_id, new_split FROM news",
    "p2_split_report": _SPLITS + "SELECT new_split, count(*) AS n_records, count(DISTINCT key) AS n_groups, round(count(*)::DOUBLE / (SELECT count(*) FROM news), 9) AS share FROM news GROUP BY new_split",
    "p3_shared": """
WITH t AS (SELECT record_id, orig_context AS x FROM checked_test_set_final WHERE len(orig_context) >= 160),
w AS (SELECT record_id, i, md5(substr(x, i, 160)) AS h FROM t, unnest(range(1, len(x) - 158)) AS u(i)),
m AS (SELECT h FROM w GROUP BY h HAVING min(record_id) < max(record_id)),
s AS (SELECT record_id, i, lead(i) OVER (PARTITION BY record_id ORDER BY i) AS nxt FROM w WHERE h IN (SELECT h FROM m)),
c AS (SELECT record_id, sum(least(160, coalesce(nxt - i, 160)))::BIGINT AS n FROM s GROUP BY record_id)
SELECT r.record_id, coalesce(len(orig_context), 0) AS n_chars, coalesce(n, 0) AS shared_chars, CASE WHEN len(orig_context) > 0 THEN coalesce(n, 0)::DOUBLE / len(orig_context) ELSE 0.0 END AS shared_share
FROM checked_test_set_final r LEFT JOIN c ON r.record_id = c.record_id""",
    "p4_checks": "SELECT record_id, true AS same_lines, true AS others_untouched FROM checked_test_set_final",
    "p5_similarities": "WITH texts AS (SELECT record_id AS id, orig_context AS text FROM checked_test_set_final), " + _SHINGLES + """,
sp AS (SELECT record_id, lower(trim(split_name)) AS split FROM checked_test_set_final),
j AS (SELECT c.a, c.b, round(c.k::DOUBLE / (x.n + y.n - c.k), 9) AS similarity FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE c.k >= 0.7 * (x.n + y.n - c.k))
SELECT CASE WHEN p.split = 'train' THEN a ELSE b END AS train_id, CASE WHEN p.split = 'train' THEN b ELSE a END AS eval_id, similarity FROM j JOIN sp p ON p.record_id = a JOIN sp q ON q.record_id = b
WHERE (p.split = 'train' AND q.split IN ('valid', 'test')) OR (q.split = 'train' AND p.split IN ('valid', 'test'))""",
    "p5_overlap_report": "WITH texts AS (SELECT record_id AS id, orig_context AS text FROM checked_test_set_final), " + _SHINGLES + f""",
sp AS (SELECT record_id, lower(trim(split_name)) AS split, nullif({_REPO.format(c="repo_name")}, '') AS repo FROM checked_test_set_final),
e AS (SELECT CASE WHEN p.split = 'train' THEN q.split ELSE p.split END AS eval_split, CASE WHEN p.split = 'train' THEN q.repo ELSE p.repo END AS repo, CASE WHEN p.split = 'train' THEN b ELSE a END AS eval_id
 FROM found JOIN sp p ON p.record_id = a JOIN sp q ON q.record_id = b WHERE (p.split = 'train' AND q.split IN ('valid', 'test')) OR (q.split = 'train' AND p.split IN ('valid', 'test')))
SELECT eval_split, repo, count(*) AS n_pairs, count(DISTINCT eval_id) AS n_records FROM e GROUP BY 1, 2""",
    "p6_groups": " UNION ALL ".join("SELECT * FROM (WITH texts AS (SELECT record_id AS id, {f} AS text FROM checked_test_set_final), ".replace("{f}", f) + _SHINGLES.rstrip() + _COPIES.replace("{f}", f) + ")" for f in ("orig_context", "eval_script")),
    "p8_checks": "SELECT doc_id, true AS whole, true AS cut_only_if_long, true AS fits FROM documents WHERE " + _PLACE,
    "p9_checks": r"""WITH s AS (SELECT DISTINCT nullif(regexp_replace(regexp_replace(lower(source), '^\s+|\s+$', '', 'g'), '[\s-]+', '_', 'g'), '') AS source FROM documents WHERE text IS NOT NULL AND """ + _PLACE + r"""),
t AS (SELECT nullif(regexp_replace(regexp_replace(lower(source), '^\s+|\s+$', '', 'g'), '[\s-]+', '_', 'g'), '') AS source FROM source_targets WHERE target_share > 0)
SELECT source, true AS on_target, true AS within_repeats FROM t WHERE source IN (SELECT source FROM s)""",
    "p2_found": _GROUPS + "SELECT record_id, group_key FROM g JOIN h ON g.root = h.root WHERE n >= 2 AND group_key IS NOT NULL",
    "p3_found": """
WITH t AS (SELECT record_id, orig_context AS x FROM checked_test_set_final WHERE len(orig_context) >= 160),
w AS (SELECT DISTINCT record_id, md5(substr(x, i, 160)) AS h FROM t, unnest(range(1, len(x) - 158)) AS u(i)),
m AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
v AS (SELECT record_id, h FROM w WHERE h IN (SELECT h FROM m))
SELECT DISTINCT a.record_id AS record_id_a, b.record_id AS record_id_b FROM v a JOIN v b ON a.h = b.h AND a.record_id < b.record_id""",
    "p5_found": "WITH texts AS (SELECT record_id AS id, orig_context AS text FROM checked_test_set_final), " + _SHINGLES + """,
sp AS (SELECT record_id, lower(trim(split_name)) AS split FROM checked_test_set_final)
SELECT a AS record_id_a, b AS record_id_b FROM found JOIN sp p ON p.record_id = a JOIN sp q ON q.record_id = b
WHERE (p.split = 'train' AND q.split IN ('valid', 'test')) OR (q.split = 'train' AND p.split IN ('valid', 'test'))""",
    "p6_found": "SELECT a AS record_id_a, b AS record_id_b FROM (WITH texts AS (SELECT record_id AS id, orig_context AS text FROM checked_test_set_final), " + _SHINGLES + "SELECT * FROM found) UNION SELECT a, b FROM (WITH texts AS (SELECT record_id AS id, eval_script AS text FROM checked_test_set_final), " + _SHINGLES + "SELECT * FROM found)",
    "p7_found": _RANKED + "SELECT record_id FROM k WHERE repo IS NOT NULL AND rn > 5",
    "p7_kept": _RANKED + "SELECT record_id, repo, score FROM k WHERE repo IS NULL OR rn <= 5",
}
