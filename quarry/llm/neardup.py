"""Near-duplicate records by anchor-point covering.

The anchors are the codewords of the perfect binary Golay code of length 23,
which covers the space of 23-bit fingerprints with radius 3.  The fingerprint of a
text is a one-bit min-hash sketch of its word-shingle set, so that similar sets
have fingerprints at a small Hamming distance.  A text lives at its home anchor
(the only one within the radius) and is replicated to every anchor within radius
plus threshold; each anchor compares its residents with its visitors.

4,096 anchors alone would hold a fixed share of a growing collection, so the
covering is repeated over independent fingerprints, and in each of them laid out
inside shards: texts that agree in two full min-hash symbols.  A shard with a single
text holds no pair and is dropped before replication.

How many fingerprints there are and at which sketch distance a pair is no longer
checked follow from the similarity asked for: a pair of just that similarity is missed
with a chance of at most ``MISS``, more similar ones with less (one fingerprint meets
0.26 of the pairs at 0.70, 0.48 at 0.80).  Whatever meets is checked exactly.  ``exact``
replaces the anchors by a prefix join over all shingles, which misses none.

Texts with the same shingle set form one class and enter once, through the member
with the smallest id; a class is expanded only where a result asks for pairs of
records.  Null texts and texts under three words have no similarity to any text.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shingles import WordHasher, jaccard_pairs, mix, prefix_pairs, set_signature, shingle_set, word_hashes
from quarry.workspace import Workspace

MISS = 0.001
SYMBOLS = 2
BITS = 64
LENGTH = 23
RADIUS = 3
THRESHOLD = 2
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the code.
GENERATOR = 0b110001110101


def syndrome(word: int) -> int:
    """The remainder of a fingerprint by the generator; zero for codewords."""
    for i in range(LENGTH - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@lru_cache(maxsize=4)
def coset_patterns(reach: int) -> dict[int, list[int]]:
    """By syndrome, the differences that lead from a fingerprint to the anchors within reach."""
    unit = [syndrome(1 << i) for i in range(LENGTH)]
    found: dict[int, list[int]] = {s: [] for s in range(2048)}
    for weight in range(reach + 1):
        for places in itertools.combinations(range(LENGTH), weight):
            s = e = 0
            for i in places:
                s ^= unit[i]
                e |= 1 << i
            found[s].append(e)
    return found


@lru_cache(maxsize=16)
def tables_for(similarity: float) -> int:
    """How many fingerprints miss a pair of the similarity with a chance of at most ``MISS``.

    Counted over 20,000 pairs of sketches whose bits differ independently; the fingerprints
    of a pair draw on the same sketch and are not independent.  Agreement in the symbols of
    a shard comes on top.
    """
    rng = np.random.default_rng(3)
    n = 20_000
    one = rng.integers(0, 2, (n, BITS))
    two = one ^ (rng.random((n, BITS)) < (1 - similarity) / 2)
    lead = np.array([p[0] for _, p in sorted(coset_patterns(RADIUS).items())])
    unit = np.array([syndrome(1 << i) for i in range(LENGTH)])
    weights = 1 << np.arange(LENGTH)
    missed = np.ones(n)
    for tables in range(1, 1000):
        at = rng.choice(BITS, LENGTH, replace=False)
        x, y = one[:, at], two[:, at]
        homes = [(z @ weights) ^ lead[np.bitwise_xor.reduce(z * unit, axis=1)] for z in (x, y)]
        reach = RADIUS + THRESHOLD
        met = (np.bitwise_count((y @ weights) ^ homes[0]) <= reach) | (np.bitwise_count((x @ weights) ^ homes[1]) <= reach)
        missed *= 1 - met * similarity**SYMBOLS
        if missed.mean() <= MISS:
            break
    return tables


def most_distance(similarity: float) -> int:
    """Bits of the sketches in which a pair of the similarity differs: the mean and five standard deviations."""
    p = (1 - similarity) / 2
    return min(BITS, math.ceil(BITS * p + 5 * math.sqrt(BITS * p * (1 - p))))


def _syndrome_column(code: Column) -> Column:
    unit = [syndrome(1 << i) for i in range(LENGTH)]
    out = None
    for bit in range(11):
        mask = sum(1 << i for i in range(LENGTH) if unit[i] >> bit & 1)
        term = F.shiftleft(F.bit_count(code.bitwiseAND(F.lit(mask))) % 2, bit)
        out = term if out is None else out + term
    return out


def sketch(texts: DataFrame, tables: int) -> DataFrame:
    """Fingerprints of ``texts(field, id, text)``; texts under three words are left out.

    ``shards[t]`` is the hash of the symbols and ``codes[t]`` the 23-bit fingerprint of table t.
    """
    rng = np.random.default_rng(11)
    odd = rng.integers(1, 2**63, tables * SYMBOLS + BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    places = np.stack([rng.choice(BITS, LENGTH, replace=False) for _ in range(tables)])
    weights = (1 << np.arange(LENGTH)).astype(np.int64)
    bit_weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    salt = mix(np.arange(1, tables + 1, dtype=np.uint64))
    split = tables * SYMBOLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHasher()
        for batch in batches:
            rows = []
            for field, rid, text in zip(*(c.to_pylist() for c in batch.columns)):
                grams = shingle_set(word_hashes(text, memo)) if text else ()
                if len(grams) == 0:
                    continue
                low = (odd[:, None] * grams[None, :]).min(axis=1) if len(grams) < 4096 else np.array([(o * grams).min() for o in odd])
                bits = mix(low[split:]) & np.uint64(1)
                shards = salt.copy()
                for part in low[:split].reshape(SYMBOLS, tables):
                    shards = mix(shards ^ part)
                codes = bits.astype(np.int64)[places] @ weights
                rows.append((field, rid, *set_signature(grams), len(grams), shards.view(np.int64), codes.astype(np.int32), int((bits * bit_weights).sum().view(np.int64))))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64()]
            names = ["field", "id", "sig_a", "sig_b", "n", "shards", "codes", "sketch"]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)

    schema = "field int, id bigint, sig_a bigint, sig_b bigint, n int, shards array<bigint>, codes array<int>, sketch bigint"
    return texts.select("field", "id", "text").where("text is not null").mapInArrow(run, schema)


def anchor_candidates(reps: DataFrame, ws: Workspace, threshold: float, reach: int = RADIUS + THRESHOLD) -> DataFrame:
    """Pairs ``(field, a, b)`` of representatives that met at an anchor."""
    spark = reps.sparkSession
    rows = reps.select("field", "id", F.posexplode("shards").alias("t", "shard"))
    crowded = rows.groupBy("field", "shard").agg(F.count("*").alias("members")).where("members >= 2").select("field", "shard")
    live = ws.save(rows.join(crowded, ["field", "shard"], "left_semi"), "live")
    # 2,048 rows whatever the input
    cosets = spark.createDataFrame([(s, p) for s, p in coset_patterns(reach).items()], "syndrome int, patterns array<int>")
    placed = live.join(reps.select("field", "id", "n", "sketch", "codes"), ["field", "id"]).withColumn("code", F.col("codes")[F.col("t")])
    placed = placed.withColumn("syndrome", _syndrome_column(F.col("code"))).join(F.broadcast(cosets), "syndrome")
    placed = placed.select("field", "shard", "id", "n", "sketch", "code", F.explode("patterns").alias("pattern"))
    # one hash for shard and anchor: a collision only adds a pair to check
    anchor = F.xxhash64("field", "shard", F.col("code").bitwiseXOR(F.col("pattern")))
    placed = placed.select("field", "id", "n", "sketch", anchor.alias("anchor"), (F.bit_count("pattern") <= RADIUS).alias("home"))
    homes = placed.where("home").select("anchor", F.col("field").alias("h_field"), F.col("id").alias("h_id"), F.col("n").alias("h_n"), F.col("sketch").alias("h_sketch"))
    meet = placed.drop("home").join(homes, "anchor").where(
        (F.col("field") == F.col("h_field"))
        & (F.col("id") != F.col("h_id"))
        & (F.least("n", "h_n") >= F.lit(threshold) * F.greatest("n", "h_n"))
        & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("h_sketch"))) <= most_distance(threshold))
    )
    return meet.select("field", F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b")).distinct()


def shingle_sets(texts: DataFrame) -> DataFrame:
    """The whole shingle sets of ``texts(field, id, text)``, for the exact search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHasher()
        for batch in batches:
            sets = [(f, i, g) for f, i, t in zip(*(c.to_pylist() for c in batch.columns)) if len(g := shingle_set(word_hashes(t, memo)))]
            rows = [(f, i, *set_signature(g), g.view(np.int64)) for f, i, g in sets]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["field", "id", "sig_a", "sig_b", "grams"])

    return texts.select("field", "id", "text").where("text is not null").mapInArrow(run, "field int, id bigint, sig_a bigint, sig_b bigint, grams array<bigint>")


def long_texts(records: DataFrame, fields: list[str], id_col: str = "record_id") -> DataFrame:
    """One row ``(field, id, text)`` for each text of the given columns; ``field`` is the column's place."""
    cells = [F.struct(F.lit(i).alias("field"), F.col(f).cast("string").alias("text")) for i, f in enumerate(fields)]
    return records.select(F.col(id_col).cast("bigint").alias("id"), F.explode(F.array(*cells)).alias("c")).select("c.field", "id", "c.text")


def near_duplicates(records: DataFrame, ws: Workspace, fields: list[str], threshold: float = 0.8, id_col: str = "record_id", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: similar pairs of class representatives and the classes.

    ``links`` has ``(field, a, b, similarity)`` with a < b, ``members`` has
    ``(field, rep, id)`` with one row for each text of three words or more.
    """
    texts = long_texts(records, fields, id_col)
    key = ["field", "sig_a", "sig_b"]
    if exact:
        sketches = ws.save(shingle_sets(texts), "sketches")
        reps = ws.save(sketches.groupBy(*key).agg(F.min_by("grams", "id").alias("grams"), F.min("id").alias("id")), "reps")
        every = F.lit(True)
        candidates = prefix_pairs(reps.select("field", "id", every.alias("lefts"), every.alias("rights"), "grams"), ws, threshold, ["field"], "live")
    else:
        sketches = ws.save(sketch(texts, tables_for(threshold)), "sketches")
        reps = sketches.groupBy(*key).agg(F.min_by(F.struct("n", "shards", "codes", "sketch"), "id").alias("s"), F.min("id").alias("id"))
        reps = ws.save(reps.select(*key, "id", "s.*"), "reps")
        candidates = anchor_candidates(reps, ws, threshold)
    candidates = ws.save(candidates, "candidates")
    ws.drop("live")
    ids = ws.save(candidates.select("field", F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    links = ws.save(jaccard_pairs(candidates, texts, ids, threshold), "links")
    # the classes are a written table, so a class with a third of all texts is split
    members = ws.save(sketches.select(*key, "id").join(reps.select(*key, F.col("id").alias("rep")), key).select("field", "rep", "id"), "members")
    for name in ("sketches", "reps"):
        ws.drop(name)
    return links, members


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of records ``(field, id_a, id_b)``, a < b: those between linked classes and those within one."""
    crowd = Workspace(members.sparkSession, "pairs").save(members.groupBy("field", "rep").agg(F.count("*").alias("k")).where("k > 1").drop("k"), "crowd")
    copies = members.join(crowd, ["field", "rep"], "left_semi")
    within = copies.select("field", "rep", F.col("id").alias("x")).join(copies.select("field", "rep", F.col("id").alias("y")), ["field", "rep"]).where("x < y").select("field", "x", "y")
    left = members.select("field", F.col("rep").alias("a"), F.col("id").alias("x"))
    right = members.select("field", F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.select("field", "a", "b").join(left, ["field", "a"]).join(right, ["field", "b"]).select("field", "x", "y")
    both = within.unionByName(across)
    return both.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def membership(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each text: its class and the number of other texts it is linked to."""
    ws = Workspace(members.sparkSession, "classes")
    sizes = ws.save(members.groupBy("field", "rep").agg(F.count("*").alias("copies")), "sizes")
    ends = links.select("field", F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("b").alias("other")), F.struct(F.col("b").alias("rep"), F.col("a").alias("other")))).alias("e")).select("field", "e.rep", "e.other")
    far = ends.join(sizes.select("field", F.col("rep").alias("other"), F.col("copies").alias("reach")), ["field", "other"]).groupBy("field", "rep").agg(F.sum("reach").alias("reach"))
    per = sizes.join(far, ["field", "rep"], "left").select("field", "rep", (F.col("copies") - 1 + F.coalesce("reach", F.lit(0))).alias("links"))
    return members.join(ws.save(per, "per"), ["field", "rep"]).select("field", F.col("id").alias("record_id"), F.col("rep").alias("class_id"), "links")
