"""Records of one split that stand, exactly or almost, in another split.

Each text is a sequence of word hashes.  Winnowing selects minima of the rolling
hashes of five-word runs, so any shared run of twelve words has a selected hash in
common.  The selected hashes of the two sides are joined; a pair of records that
meets is aligned: seeds shared by both are chained in order (the longest collinear
chain), every seed of the chain is extended word by word, and the covered words of
both records are reported next to the exact set similarity.

Selected hashes that stand in very many records (import lines, licence headers)
would pair everything with everything.  They are not dropped: each record sends its
rarest hashes first and stops when a pair with at least ``min_common`` of its hashes
in common must have met already; that share follows from the threshold.  Texts of up to
``SHORT`` different three-word runs, and partners they can be similar to, have too few
selected hashes for it and meet by their runs, of which a similarity of t guarantees a
share of t.  ``exact`` lets texts of every length meet in that way, which loses no pair
whatever the edits.  Texts with equal shingle sets enter the joins once.

Null texts and texts under three words match nothing.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shingles import WordHasher, gram_hashes, prefix_pairs, set_signature, shingle_set, winnow, word_hashes
from quarry.plans.sized import keep_keys
from quarry.workspace import Workspace

RUN = 5
WINDOW = 8
#: Pairs with a side of up to so many different three-word runs meet by them.
SHORT = 100


def min_common(threshold: float) -> float:
    """Least share of selected hashes in common that is counted on at a similarity.

    Single changed words at a similarity of t are a share of (1 - t) / (3 (1 + t)) of all;
    a selected hash outlives them if none falls into its ``RUN + WINDOW - 1`` words.  Two
    fifths of that expectation are asked for: over 100 words no simulated pair, with edits
    evenly spread, at random or in the worst spacing, had less than four fifths.
    """
    return 0.4 * (1 - (1 - threshold) / (3 * (1 + threshold))) ** (RUN + WINDOW - 1)


def selected(words: np.ndarray, run: int = RUN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected rolling hashes and their positions; texts under ``run`` words use shorter runs."""
    run = min(run, len(words))
    hashes = gram_hashes(words, run)
    at = winnow(hashes, window)
    return hashes[at], at


def fingerprint(texts: DataFrame, most_grams: int | None) -> DataFrame:
    """``texts(id, side, text)`` to ``(id, side, sig_a, sig_b, hashes, grams)``; hashes are distinct.

    Grams are empty for texts with more than ``most_grams``, hashes if all texts have grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHasher()
        none = np.empty(0, np.int64)
        for batch in batches:
            rows = []
            for rid, side, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = word_hashes(text, memo) if text else ()
                if len(words) >= 3:
                    grams = shingle_set(words)
                    hashes = none if most_grams is None else np.unique(selected(words)[0]).view(np.int64)
                    rows.append((rid, side, *set_signature(grams), hashes, grams.view(np.int64) if most_grams is None or len(grams) <= most_grams else none))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["id", "side", "sig_a", "sig_b", "hashes", "grams"])

    return texts.select("id", "side", "text").where("text is not null").mapInArrow(run, "id bigint, side boolean, sig_a bigint, sig_b bigint, hashes array<bigint>, grams array<bigint>")


def meeting_pairs(reps: DataFrame, ws: Workspace, share: float) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of ``reps(id, lefts, rights, hashes)`` that share a selected hash.

    ``lefts`` and ``rights`` say on which sides a class has records.  Pairs with at least
    ``share`` of the hashes of each side in common are all found.
    """
    rows = reps.select("id", "lefts", "rights", F.size("hashes").alias("m"), F.explode("hashes").alias("h"))
    sides = rows.groupBy("h").agg(F.count("*").alias("df"), F.max("lefts").alias("l"), F.max("rights").alias("r")).where("df > 1 and l and r").select("h", "df")
    own = W.partitionBy("id")
    ranked = rows.join(sides, "h").withColumn("rank", F.row_number().over(own.orderBy("df", "h"))).withColumn("kept", F.count("*").over(own))
    need = F.ceil(F.col("m") * share)
    rare = ws.save(ranked.where(F.col("rank") <= F.col("m") - need + 1 - (F.col("m") - F.col("kept"))).select("id", "lefts", "rights", "h"), "rare")
    left = rare.where("lefts").select(F.col("id").alias("x"), "h")
    right = rare.where("rights").select(F.col("id").alias("y"), "h")
    met = left.join(right, "h").where("x != y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _chain(pos_a: list[int], pos_b: list[int]) -> list[tuple[int, int]]:
    """The longest chain of seeds that rises in both texts; seeds come ordered by (a, -b)."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = [-1] * len(pos_a)
    for i, b in enumerate(pos_b):
        j = bisect_left(tails, b)
        if j == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[j] = b
            at[j] = i
        back[i] = at[j - 1] if j else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append((pos_a[i], pos_b[i]))
        i = back[i]
    return out[::-1]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """``(seeds, words of a covered, words of b covered)`` of the best collinear chain."""
    ha, pa_ = selected(a)
    hb, pb = selected(b)
    # the n-th occurrence of a hash in a is a seed with its n-th occurrence in b
    places: dict[int, Iterator[int]] = {}
    for h, p in zip(hb.tolist(), pb.tolist()):
        places.setdefault(h, []).append(p)
    places = {h: iter(at) for h, at in places.items()}
    seeds = sorted((p, -q) for h, p in zip(ha.tolist(), pa_.tolist()) if (q := next(places.get(h, iter(())), None)) is not None)
    chain = _chain([s[0] for s in seeds], [-s[1] for s in seeds])
    cov_a = cov_b = end_a = end_b = 0
    for p, q in chain:
        if p < end_a or q < end_b:
            continue
        back = min(p - end_a, q - end_b)
        differ = np.flatnonzero(a[p - back : p][::-1] != b[q - back : q][::-1]) if back else ()
        back = int(differ[0]) if len(differ) else back
        ahead = min(len(a) - p, len(b) - q)
        differ = np.flatnonzero(a[p : p + ahead] != b[q : q + ahead])
        ahead = int(differ[0]) if len(differ) else ahead
        cov_a += back + ahead
        cov_b += back + ahead
        end_a, end_b = p + ahead, q + ahead
    return len(chain), cov_a, cov_b


def aligned(pairs: DataFrame, texts: DataFrame, ids: DataFrame, threshold: float) -> DataFrame:
    """Aligned pairs with a similarity of at least ``threshold``."""
    wanted = keep_keys(texts.select("id", "text"), ids, ["id"])
    both = pairs.join(wanted.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(wanted.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHasher()
        for batch in batches:
            rows = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                wa, wb = word_hashes(ta, memo), word_hashes(tb, memo)
                sa, sb = shingle_set(wa), shingle_set(wb)
                common = len(np.intersect1d(sa, sb, assume_unique=True))
                total = len(sa) + len(sb) - common
                if total and common >= threshold * total:
                    seeds, ca, cb = align(wa, wb)
                    rows.append((a, b, common / total, seeds, ca / len(wa), cb / len(wb)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["a", "b", "similarity", "seeds", "coverage_a", "coverage_b"])

    return both.mapInArrow(run, "a bigint, b bigint, similarity double, seeds int, coverage_a double, coverage_b double")


def cross_split(records: DataFrame, ws: Workspace, threshold: float = 0.8, text_col: str = "orig_context", id_col: str = "record_id", side: Column | None = None, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(links, members)`` of texts that stand on both sides.

    ``side`` is true for one side, false for the other, null for rows outside both;
    by default true for train and false for valid and test.  ``exact`` compares all runs
    of all texts instead of selected hashes (see above).  ``links`` has one row
    ``(a, b, similarity, seeds, coverage_a, coverage_b)`` for each pair of different
    classes that has records on opposite sides; ``members`` has ``(rep, id, side)``.
    """
    if side is None:
        name = F.lower(F.trim(F.col("split_name")))
        side = F.when(name == "train", F.lit(True)).when(name.isin("valid", "test"), F.lit(False))
    texts = records.select(F.col(id_col).cast("bigint").alias("id"), side.alias("side"), F.col(text_col).alias("text")).where("side is not null")
    prints = ws.save(fingerprint(texts, None if exact else math.ceil(SHORT / threshold)), "prints")
    key = ["sig_a", "sig_b"]
    classes = prints.groupBy(*key).agg(F.min_by("hashes", "id").alias("hashes"), F.min_by("grams", "id").alias("grams"), F.min("id").alias("id"), F.max("side").alias("lefts"), F.max(~F.col("side")).alias("rights"))
    classes = ws.save(classes, "classes")
    met = prefix_pairs(classes.where(F.size("grams") > 0), ws, threshold, [], "rare_grams")
    if not exact:
        met = met.unionByName(meeting_pairs(classes.where(F.size("hashes") > 0), ws, min_common(threshold))).distinct()
    pairs = ws.save(met, "pairs")
    for name in ("rare", "rare_grams"):
        ws.drop(name)
    ids = ws.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    links = ws.save(aligned(pairs, texts, ids, threshold), "links")
    # the classes are a written table, so a class with a third of all records is split
    members = ws.save(prints.select(*key, "id", "side").join(classes.select(*key, F.col("id").alias("rep")), key).select("rep", "id", "side"), "members")
    for name in ("prints", "classes"):
        ws.drop(name)
    return links, members


def record_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records on opposite sides: ``(left_id, right_id, similarity, coverage_left, coverage_right)``.

    ``left_id`` is on the side that is true; pairs within a class have similarity 1.
    """
    both = members.groupBy("rep").agg(F.max("side").alias("l"), F.max(~F.col("side")).alias("r")).where("l and r").select("rep")
    both = Workspace(members.sparkSession, "pairs").save(both, "both")
    own = both.select(F.col("rep").alias("p"), F.col("rep").alias("q"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("cp"), F.lit(1.0).alias("cq"))
    turns = F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q"), F.col("coverage_a").alias("cp"), F.col("coverage_b").alias("cq")), F.struct(F.col("b").alias("p"), F.col("a").alias("q"), F.col("coverage_b").alias("cp"), F.col("coverage_a").alias("cq"))))
    ways = links.select("similarity", turns.alias("e")).select("e.p", "e.q", "similarity", "e.cp", "e.cq").unionByName(own)
    left = members.where("side").select(F.col("rep").alias("p"), F.col("id").alias("left_id"))
    right = members.where("not side").select(F.col("rep").alias("q"), F.col("id").alias("right_id"))
    return ways.join(left, "p").join(right, "q").select("left_id", "right_id", "similarity", F.col("cp").alias("coverage_left"), F.col("cq").alias("coverage_right"))
