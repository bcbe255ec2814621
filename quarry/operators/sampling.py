"""Sampling, splits, mixes and order-preserving selections.

Random order is the md5 of (seed, id), so a sample depends on the ids alone: it is the
same on any cluster and under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.ranking import rank_within
from quarry.workspace import Workspace


def shuffled(id_: Column, seed: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), id_.cast("string")))


def first_by_priority(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order``; keeps all columns.

    An aggregate of the smallest order struct, so rows of a hot key are combined before
    the shuffle instead of being sorted in one task.
    """
    whole = F.struct(*[F.struct(o.alias(f"o{i}"))[f"o{i}"].alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c not in key]), whole).alias("_row"))
    return best.select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in df.columns])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark prunes each partition to n rows a group before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def stratified_sample(df: DataFrame, group: list[str], k: int, id_col: str, priority: Column | None = None, seed: int = 0) -> DataFrame:
    """At most ``k`` rows of each group: rows of low ``priority`` first, random within; ids with ``-`` dropped."""
    rank = [*([priority] if priority is not None else []), shuffled(F.col(id_col), seed), F.col(id_col)]
    return top_per_group(df.where(~F.contains(F.col(id_col).cast("string"), F.lit("-"))), group, rank, k)


def diverse_top(df: DataFrame, group: list[str], n: int, id_col: str, is_truth: Column | None = None, distinct: list[str] | None = None) -> DataFrame:
    """``n`` rows of each group, generated rows before ground truth, by (length of id, id).

    With ``distinct`` only the first row of each distinct output counts.
    """
    length = F.length(F.col(id_col).cast("string"))
    truth = [is_truth] if is_truth is not None else []
    if distinct:
        df = first_by_priority(df, group + distinct, [*truth, length, F.col(id_col)])
    return top_per_group(df, group, [*truth, length, F.col(id_col)], n)


def replay(sampled: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """The sample plus the ground truth of keys that were not sampled."""
    return sampled.unionByName(truth.join(sampled.select(*key).distinct(), key, "left_anti"))


def sample_exact(df: DataFrame, n: int, id_col: str, seed: int = 0) -> DataFrame:
    """``n`` rows in random order (all of them if fewer), without replacement."""
    return df.orderBy(shuffled(F.col(id_col), seed), F.col(id_col)).limit(n)


def resample_exact(df: DataFrame, n: int, id_col: str, ws: Workspace, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows: each row ``n div rows`` times and the first ``n mod rows`` of a random order once more.

    Adds ``copy``. An empty input gives an empty result.
    """
    total = df.count()
    if total == 0:
        return df.withColumn("copy", F.lit(1))
    ranked = rank_within(df.withColumn("_all", F.lit(0)).withColumn("_h", shuffled(F.col(id_col), seed)), ["_all"], ["_h", id_col], ws)
    times = F.lit(n // total) + (F.col("rank") < n % total).cast("int")
    return ranked.withColumn("_times", times.cast("int")).where("_times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_all", "_h", "rank")


def split_exact(df: DataFrame, validation: float | int, id_col: str, ws: Workspace, seed: int = 0) -> DataFrame:
    """Adds ``part``: an exact number (or share, rounded up) of rows is ``validation``, the rest ``train``."""
    total = df.count()
    n = validation if isinstance(validation, int) else -(-total * validation // 1)
    ranked = rank_within(df.withColumn("_all", F.lit(0)).withColumn("_h", shuffled(F.col(id_col), seed)), ["_all"], ["_h", id_col], ws)
    return ranked.withColumn("part", F.when(F.col("rank") < n, "validation").otherwise("train")).drop("_all", "_h", "rank")


def interleave(df: DataFrame, source: str, order: list[str], ws: Workspace, until: str = "all_exhausted") -> DataFrame:
    """Round-robin order over the sources, as ``turn`` and ``place``.

    ``first_exhausted`` stops after the turns of the shortest source.
    """
    ranked = rank_within(df, [source], order, ws, "turns").withColumnRenamed("rank", "turn")
    if until == "first_exhausted":
        least = ranked.groupBy(source).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
        ranked = ranked.crossJoin(F.broadcast(least)).where(F.col("turn") < F.col("least")).drop("least")
    elif until != "all_exhausted":
        raise ValueError(until)
    placed = rank_within(ranked.withColumn("_all", F.lit(0)), ["_all"], ["turn", source], ws, "places")
    return placed.withColumnRenamed("rank", "place").drop("_all")


def interleave_by_weight(df: DataFrame, source: str, order: list[str], weights: dict[str, float], ws: Workspace) -> DataFrame:
    """Sources drawn in proportion to ``weights``: row r of a source stands at (r + 1/2) / weight.

    Sources without a positive weight are left out.
    """
    ranked = rank_within(df, [source], order, ws, "weighed")
    weight = F.coalesce(*[F.when(F.col(source) == k, F.lit(float(v))) for k, v in weights.items() if v > 0], F.lit(None).cast("double"))
    return ranked.withColumn("place", (F.col("rank") + 0.5) / weight).where("place is not null").drop("rank")


def range_shard(df: DataFrame, order: list[str], ws: Workspace, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows ``start <= rank < end`` of the whole order, with ``rank``."""
    ranked = rank_within(df.withColumn("_all", F.lit(0)), ["_all"], order, ws, "shard").drop("_all")
    if end is not None:
        ranked = ranked.where(F.col("rank") < end)
    return ranked.where(F.col("rank") >= start) if start is not None else ranked


def numbered_blocks(df: DataFrame, order: list[str], size: int, ws: Workspace) -> DataFrame:
    """Adds ``block``, the rank in the whole order divided by ``size``."""
    ranked = rank_within(df.withColumn("_all", F.lit(0)), ["_all"], order, ws, "blocks").drop("_all")
    return ranked.withColumn("block", F.floor(F.col("rank") / size)).drop("rank")
