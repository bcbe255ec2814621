"""Top-k and reranking of retrieved documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.workspace import Workspace


def top_docs(docs: Column, k: int) -> Column:
    return F.slice(docs, 1, k)


def rerank(df: DataFrame, query: str, doc: str, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds ``score`` and ``place`` within the query; ties by document."""
    scored = df.withColumn("score", scorer(F.col("query_value"), F.col("doc_value")))
    return scored.withColumn("place", F.row_number().over(W.partitionBy(query).orderBy(F.desc("score"), doc)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null when one is a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return dot(a, b) / F.nullif(norm, F.lit(0.0))


#: Bytes of query vectors that one pass over the base is compared with.
QUERY_BLOCK = 64 << 20


def nearest(queries: DataFrame, base: DataFrame, k: int, id_col: str, vec_col: str, ws: Workspace) -> DataFrame:
    """The k best base rows by cosine for each row of a stated query set: ``(query_id, doc_id, score, place)``.

    Scores are rounded to five places, ties go to the smaller id, a row is not its own
    neighbour.  Null and zero vectors have no similarity and are left out.  Queries are
    taken in blocks of at most ``QUERY_BLOCK`` bytes, whatever their number; a pass over the
    base multiplies whole Arrow batches with the block, and every batch keeps its k best
    rows of a query before anything is shuffled.
    """
    q = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    n, dim = q.agg(F.count("*"), F.max(F.size("v"))).first()
    d = base.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    blocks = -(-n * (dim or 1) * 8 // QUERY_BLOCK)
    out = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else q
        rows = part.toArrow()  # one block
        met = ws.save(_block_best(d, rows.column("id").to_numpy(), np.array(rows.column("v").to_pylist(), np.float64), k), f"block{b}")
        best = met.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("place") <= k)
        out = best if out is None else out.unionByName(best)
    return out if out is not None else q.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double, place int")


def _block_best(base: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """The k best rows of each Arrow batch of ``base(id, v)`` for each query of a block."""
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    ids, vectors, norms = ids[norms > 0], vectors[norms > 0], norms[norms > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("id").to_numpy(zero_copy_only=False)
            order = np.argsort(docs, kind="stable")
            docs = docs[order]
            values = np.array(batch.column("v").to_pylist(), np.float64)[order] if len(docs) else np.empty((0, vectors.shape[1]))
            size = np.sqrt((values * values).sum(axis=1))
            docs, values, size = docs[size > 0], values[size > 0], size[size > 0]
            for at in range(0, len(ids), 1024):
                own = ids[at : at + 1024]
                score = np.round(vectors[at : at + 1024] @ values.T / (norms[at : at + 1024, None] * size[None, :]), 5) + 0.0
                score[own[:, None] == docs[None, :]] = -np.inf
                cut = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(own), -np.inf)
                row, col = np.nonzero((score >= cut[:, None]) & np.isfinite(score))
                rank = np.lexsort((col, -score[row, col], row))
                row, col = row[rank], col[rank]
                first = np.searchsorted(row, row)
                keep = np.arange(len(row)) - first < k
                row, col = row[keep], col[keep]
                yield pa.record_batch([pa.array(own[row], pa.int64()), pa.array(docs[col], pa.int64()), pa.array(score[row, col], pa.float64())], ["query_id", "doc_id", "score"])

    return base.mapInArrow(run, "query_id bigint, doc_id bigint, score double")
