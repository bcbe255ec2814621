"""Row ranks within groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.workspace import Workspace


def rank_within(df: DataFrame, group: list[str], order: list[str], ws: Workspace, name: str = "ranked") -> DataFrame:
    """Adds ``rank``, counting from 0 by ``order`` within ``group``.

    Rows are range-partitioned by group and order, numbered where they lie, and the
    offsets of the parts of a group are summed from one small row for each partition and
    group.  A window would put a group that holds a third of all rows into one task.
    Nulls form a group of their own.  Rows with equal order columns are ranked in an
    arbitrary but fixed order; give a unique last column for a repeatable one.
    """
    spread = df.repartitionByRange(*[F.col(c) for c in group + order]).sortWithinPartitions(*group, *order)
    seen = ws.save(spread.withColumn("_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("_row", 33)
    pieces = seen.groupBy(*group, part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.select(*group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    keys = [f"_g{i}" for i in range(len(group))]
    starts = starts.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], "_part", "_first", "_before")
    same = part == F.col("_part")
    for g, k in zip(group, keys):
        same = same & F.col(g).eqNullSafe(F.col(k))
    joined = seen.join(starts, same)
    return joined.select(*df.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("rank"))


def row_before(df: DataFrame, group: list[str], order: list[str], value: str, name: str, ws: Workspace) -> DataFrame:
    """Adds ``name``: the ``value`` of the row before within the group, null for the first.

    Rows are ranked across partitions and joined with the rank before, so a group of any
    size is spread; a window would sort it in one task.  Nulls form a group of their own.
    """
    ranked = ws.save(rank_within(df, group, order, ws, f"{name}_ranks"), f"{name}_ranked")
    keys = [f"_b{i}" for i in range(len(group))]
    before = ranked.select(*[F.col(g).alias(k) for g, k in zip(group, keys)], (F.col("rank") + 1).alias("_next"), F.col(value).alias(name))
    same = F.col("rank") == F.col("_next")
    for g, k in zip(group, keys):
        same = same & F.col(g).eqNullSafe(F.col(k))
    return ranked.join(before, same, "left").select(*df.columns, name)
