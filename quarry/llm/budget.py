"""Token budget of fenced contexts by repository, language and topic."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.fences import FENCE, OUTSIDE, language
from quarry.functions.names import canonical_label, canonical_repo
from quarry.llm.bpe import VOCABULARY, token_sums
from quarry.workspace import Workspace

def segments(text: str) -> list[tuple[str, str]]:
    """``(language, text)`` of all parts of a context; joined they are the text again.

    A fence line belongs to the block it opens or closes.  A fence with a tag opens a
    new block even if the last one was left open; a bare fence closes an open block and
    opens one otherwise.  A block that is never closed reaches to the end.  Text outside
    the blocks has the language ``outside``.
    """
    out: list[tuple[str, str]] = []
    start, opened, tag, body = 0, False, "", 0

    def emit(end: int) -> None:
        if end > start:
            out.append((language(tag, text[body:end]) if opened else OUTSIDE, text[start:end]))

    for m in FENCE.finditer(text):
        if opened and not m.group(2).strip():
            end = min(m.end() + 1, len(text))
            emit(end)
            start, opened = end, False
        else:
            emit(m.start())
            start, opened, tag, body = m.start(), True, m.group(2), min(m.end() + 1, len(text))
    emit(len(text))
    return out


def block_texts(records: DataFrame, text_col: str = "orig_context", id_col: str = "record_id") -> DataFrame:
    """``(record_id, lang, text)`` of all segments; a null or empty text gives one empty ``outside`` row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(rid, lang, part) for rid, text in zip(*(c.to_pylist() for c in batch.columns)) for lang, part in (segments(text) if text else [(OUTSIDE, "")])]
            ids, langs, parts = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.string())], ["record_id", "lang", "text"])

    return records.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(text_col).alias("text")).mapInArrow(run, "record_id bigint, lang string, text string")


def record_tokens(records: DataFrame, ws: Workspace, path: str = VOCABULARY, **cols: str) -> DataFrame:
    """Tokens of each record by language of the block: ``(record_id, lang, tokens)``."""
    return token_sums(block_texts(records, **cols), ws, ["record_id", "lang"], path)


def token_totals(records: DataFrame, repos: DataFrame, ws: Workspace, path: str = VOCABULARY) -> DataFrame:
    """Totals ``(slice, name, records, tokens)`` for each repository, language and topic, and overall.

    ``records`` counts the records with a part in the slice.  Records without repository
    and repositories without a topic or a listing fall under a null name.
    """
    tokens = ws.save(record_tokens(records, ws, path), "tokens")
    names = records.select(F.col("record_id").cast("bigint").alias("record_id"), canonical_repo("repo_name").alias("repo")).distinct()
    topics = repos.select(canonical_repo("repo_id").alias("repo"), canonical_label("topic").alias("topic")).where("repo is not null").groupBy("repo").agg(F.min("topic").alias("topic"))
    per = tokens.groupBy("record_id").agg(F.sum("tokens").alias("tokens"))
    by_repo = per.join(names, "record_id").groupBy("repo").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
    by_repo = ws.save(by_repo, "by_repo")
    by_topic = by_repo.join(topics, "repo", "left").groupBy("topic").agg(F.sum("records").alias("records"), F.sum("tokens").alias("tokens"))
    by_lang = tokens.groupBy("lang").agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))
    overall = by_repo.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))

    def part(name: str, df: DataFrame, col: str | None) -> DataFrame:
        key = F.col(col) if col else F.lit("all")
        return df.select(F.lit(name).alias("slice"), key.alias("name"), F.col("records").cast("bigint").alias("records"), F.col("tokens").cast("bigint").alias("tokens"))

    return part("repository", by_repo, "repo").unionByName(part("language", by_lang, "lang")).unionByName(part("topic", by_topic, "topic")).unionByName(part("all", overall, None))
