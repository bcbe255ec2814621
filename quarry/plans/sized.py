"""Joins whose small side is broadcast only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a key list that are broadcast (about 16 MB of long keys).
MAX_BROADCAST_KEYS = 1_000_000


def keep_keys(df: DataFrame, keys: DataFrame, on: list[str], max_rows: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``; ``keys`` should be a written table.

    Up to ``max_rows`` keys are broadcast, so that wide rows of ``df`` are not
    shuffled; beyond that Spark picks a shuffle join.
    """
    small = keys.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(keys) if small else keys, on, "left_semi")


#: Most rows of a look-up table with short string keys that are broadcast (about 2 MB).
MAX_BROADCAST_ROWS = 20_000


def look_up(df: DataFrame, table: DataFrame, on: list[str], how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` joined with ``table``, which must be a written table with one row for each key.

    Up to ``max_rows`` rows are broadcast.  Beyond that both sides are shuffled and merged;
    since ``table`` is a scan and not an aggregate on the key, it gets an exchange of its own
    and adaptive execution can split a hot key of ``df``.  An aggregate that is joined as it
    is keeps its partitioning, and such a join is never split.
    """
    small = table.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(table) if small else table.hint("merge"), on, how)


def spread(df: DataFrame) -> DataFrame:
    """A scan with at least one partition for each core, for work that is heavy on CPU.

    A small table in one file would otherwise be read by one task.  Inputs that already
    have as many partitions as cores are returned as they are, so large ones are never
    shuffled for this.  Give a plain scan: columns are pruned below the exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
