"""Word shingles and rolling hashes of texts, vectorised over each text.

Words are the longest runs of ASCII letters, digits and underscore, lower-cased.
A shingle is a run of consecutive words, held as a 64-bit hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.plans.sized import keep_keys
from quarry.workspace import Workspace

_WORD = re.compile(rb"[A-Za-z0-9_]+")
_ODD = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHINGLE = 3


class WordHasher(dict):
    """A bounded memo from word to 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: str, memo: WordHasher) -> np.ndarray:
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; empty when there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc += words[j : j + n] * _ODD[j]
    return mix(acc)


def shingle_set(words: np.ndarray) -> np.ndarray:
    return np.unique(gram_hashes(words, SHINGLE))


def set_signature(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, in time linear in len(x)."""
    n = len(x) - w + 1
    pad = -len(x) % w
    top = np.iinfo(x.dtype).max
    blocks = np.concatenate([x, np.full(pad, top, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the hashes that are the minimum of some window of w.

    Any run of w consecutive hashes that two texts share has a selected hash in
    common.  Fewer than w hashes form one window.
    """
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= w:
        return np.flatnonzero(hashes == hashes.min())
    low = sliding_min(hashes, w)
    # the largest window minimum among the windows that hold a position
    flipped = np.iinfo(hashes.dtype).max - low
    ends = np.full(w - 1, np.iinfo(hashes.dtype).max, hashes.dtype)
    best = np.iinfo(hashes.dtype).max - sliding_min(np.concatenate([ends, flipped, ends]), w)
    return np.flatnonzero(best == hashes)


def jaccard_pairs(pairs: DataFrame, texts: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """Exact similarity of ``pairs(field, a, b)`` over ``texts(field, id, text)``, at least ``threshold``.

    ``ids(field, id)`` lists the distinct ends of the pairs; only their texts are
    read into shingle sets.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHasher()
        for batch in batches:
            sets = [shingle_set(word_hashes(t, memo)).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["field", "id", "grams"])

    sets = keep_keys(texts.select("field", "id", "text"), ids, ["field", "id"]).mapInArrow(shingles, "field int, id bigint, grams array<bigint>")
    left = sets.select("field", F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = sets.select("field", F.col("id").alias("b"), F.col("grams").alias("gb"))
    both = pairs.select("field", "a", "b").join(left, ["field", "a"]).join(right, ["field", "b"])
    shared = F.size(F.array_intersect("ga", "gb"))
    scored = both.select("field", "a", "b", shared.alias("shared"), (F.size("ga") + F.size("gb") - shared).alias("total"))
    return scored.where((F.col("total") > 0) & (F.col("shared") >= F.lit(threshold) * F.col("total"))).select("field", "a", "b", (F.col("shared") / F.col("total")).alias("similarity"))


def prefix_pairs(sets: DataFrame, ws: Workspace, threshold: float, by: list[str], name: str) -> DataFrame:
    """All pairs ``(*by, a, b)``, a < b, of ``sets(*by, id, lefts, rights, grams)`` that may reach the threshold; none is lost.

    Sets of similarity t and more have t of each of them in common, so if the members are
    ranked by how many sets hold them, the rarest ``m - ceil(t m) + 1`` of two such sets
    meet.  ``lefts`` and ``rights`` say on which sides a set stands; only pairs of a left
    and a right one count.  A member that stands in a third of all sets comes last and is
    sent only by sets made of nothing else.
    """
    rows = sets.select(*by, "id", "lefts", "rights", F.size("grams").alias("m"), F.explode("grams").alias("h"))
    sides = rows.groupBy(*by, "h").agg(F.count("*").alias("df"), F.max("lefts").alias("l"), F.max("rights").alias("r")).where("df > 1 and l and r").select(*by, "h", "df")
    own = W.partitionBy(*by, "id")
    ranked = rows.join(sides, [*by, "h"]).withColumn("rank", F.row_number().over(own.orderBy("df", "h"))).withColumn("alone", F.col("m") - F.count("*").over(own))
    need = F.ceil(F.col("m") * F.lit(threshold) - F.lit(1e-9))
    rare = ws.save(ranked.where(F.col("rank") <= F.col("m") - need + 1 - F.col("alone")).select(*by, "id", "m", "lefts", "rights", "h"), name)
    left = rare.where("lefts").select(*by, "h", F.col("id").alias("x"), F.col("m").alias("mx"))
    right = rare.where("rights").select(*by, "h", F.col("id").alias("y"), F.col("m").alias("my"))
    met = left.join(right, [*by, "h"]).where((F.col("x") != F.col("y")) & (F.least("mx", "my") >= F.lit(threshold) * F.greatest("mx", "my") - F.lit(1e-9)))
    return met.select(*by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
