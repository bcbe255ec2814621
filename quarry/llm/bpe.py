"""Byte-pair token counts of distinct pieces, without running a tokenizer over texts.

Texts are split into pieces by the tokenizer's public pattern in the JVM.  Every
distinct piece is held once, as an array of symbols; its adjacent pairs are joined
with the table of merge ranks, the lowest-ranked merge of each piece is applied at
all its places, and this repeats until no pair of any piece has a rank.  The number
of symbols left is the piece's token count, which is joined back to the occurrences.

The join of a round is a merge join of pair keys with the sorted key column of the
merge table, for all pieces of a batch at once; pieces never need each other, so
the rounds run inside the task that holds the piece and cause no shuffle.

The merge table has a fixed size (the vocabulary).  The vocabulary file is a parameter;
the driver's copy is sent to the executors through Spark's file server, and only where
the driver has none is the path opened on the executors.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.workspace import Workspace

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of the byte-level vocabularies; (?U) gives Unicode blanks in the JVM.
PIECE_PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: At most this many pieces can each hold more than 1 / HEAVY of all occurrences.
HEAVY = 65_536
#: Heavy pieces longer than this are joined by shuffle, which bounds the broadcast to 4 MB of text.
HEAVY_LENGTH = 64
_NONE = np.iinfo(np.int64).max


@lru_cache(maxsize=2)
def merge_table(path: str) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """``(ranks, symbol of each byte, sorted pair keys, rank of each key)``."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
    keys, values = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                values.append(rank)
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return ranks, single, np.array(keys, np.int64)[order], np.array(values, np.int64)[order]


def count_tokens(pieces: list[bytes], path: str = VOCABULARY) -> np.ndarray:
    """Token count of each piece; an empty piece has none."""
    ranks, single, keys, values = merge_table(path)
    counts = np.array([1 if p in ranks else 0 for p in pieces], np.int64)
    open_ = np.array([i for i, p in enumerate(pieces) if p and not counts[i]], np.int64)
    if len(open_) == 0:
        return counts
    sizes = np.array([len(pieces[i]) for i in open_], np.int64)
    symbols = single[np.frombuffer(b"".join(pieces[i] for i in open_), np.uint8)]
    owner = np.repeat(open_, sizes)
    while len(symbols):
        pair = symbols[:-1] << 32 | symbols[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.where((keys[at] == pair) & (owner[:-1] == owner[1:]), values[at], _NONE)
        rank = np.append(rank, _NONE)
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        low = np.minimum.reduceat(rank, starts)
        lengths = np.diff(np.append(starts, len(owner)))
        done = low == _NONE
        counts[owner[starts[done]]] = lengths[done]
        hit = (rank == np.repeat(low, lengths)) & (rank != _NONE)
        # of overlapping places (a a a) the first, third, ... are merged
        places = np.flatnonzero(hit)
        run = np.cumsum(np.append(True, np.diff(places) != 1)) if len(places) else places
        if len(places):
            first = places[np.append(True, np.diff(places) != 1)]
            places = places[(places - first[run - 1]) % 2 == 0]
        symbols = symbols.copy()
        symbols[places] = rank[places]
        keep = np.repeat(~done, lengths)
        keep[places + 1] = False
        symbols, owner = symbols[keep], owner[keep]
    return counts


def piece_counts(pieces: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``pieces(piece, ...)``, distinct, with their token count ``tokens``."""
    at = pieces.columns.index("piece")
    sent = os.path.exists(path)
    if sent:
        pieces.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [p.encode("utf-8", "replace") for p in batch.column(at).to_pylist()]
            counts = count_tokens(texts, SparkFiles.get(name) if sent else path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "tokens"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", tokens bigint"
    return pieces.mapInArrow(run, schema)


def split_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE_PATTERN), F.lit(0))


def token_sums(texts: DataFrame, ws: Workspace, keys: list[str], path: str = VOCABULARY) -> DataFrame:
    """Tokens of ``texts(*keys, text)`` summed by ``keys``, as ``(*keys, tokens)``.

    Keys without any token (null or empty texts only) have 0.  Pieces that hold more
    than 1 / 65,536 of all occurrences are at most 65,536 and are broadcast with their
    counts; only the occurrences of the rarer ones are shuffled, so no piece is a hot
    key.  Text that is not valid Unicode counts its replacement characters.
    """
    pieces = texts.select(*keys, F.explode(split_pieces(F.col("text"))).alias("piece"))
    counted = ws.save(piece_counts(pieces.groupBy("piece").agg(F.count("*").alias("n")), path), "pieces")
    total = counted.agg(F.sum("n")).first()[0] or 0
    is_heavy = (F.col("n") * HEAVY > F.lit(total)) & (F.length("piece") <= HEAVY_LENGTH)
    heavy = counted.where(is_heavy).select("piece", "tokens")
    rare = counted.where(~is_heavy).select("piece", "tokens")
    marked = pieces.join(F.broadcast(heavy), "piece", "left")
    # one pass: heavy occurrences are summed where they are read, rare ones keep their piece
    part = marked.groupBy(*keys, F.when(F.col("tokens").isNull(), F.col("piece")).alias("piece")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("times"))
    part = ws.save(part, "parts")
    tail = part.where("piece is not null").select(*keys, "piece", "times").join(rare, "piece").select(*keys, (F.col("times") * F.col("tokens")).alias("tokens"))
    none = texts.select(*keys, F.lit(0).cast("bigint").alias("tokens")).where(F.coalesce(F.length("text"), F.lit(0)) == 0)
    every = part.where("piece is null").select(*keys, "tokens").unionByName(tail).unionByName(none)
    return every.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
