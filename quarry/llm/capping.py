"""Capping records per contributor by parallel bisection.

Every contributor over the cap gets a cutoff score such that fewer than ``cap``
records lie above it and at least ``cap`` at or above it.  All contributors are
bisected together: a round divides the bounds of every open contributor into
``SECTIONS``, counts the records of all sections in one aggregation, and keeps only
the section that holds the cutoff, with the bounds drawn in to values that occur in
the data.  A contributor with at most ``FEW`` different values left takes every value
as a midpoint and is done with the next count, so most never enter the rounds.  Only
values inside the bounds are read again.  Ties at the cutoff are resolved by the same
search over the identifiers of the tied records.  No group is ever sorted or
collected in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.names import canonical_repo
from quarry.plans.sized import look_up
from quarry.workspace import Workspace

SECTIONS = 16
#: Most different values that are counted value by value.
FEW = 256


def quality(col: Column | str) -> Column:
    """A score with null, NaN and negative values last and equal to each other."""
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (c < 0), F.lit(-1.0)).otherwise(c + F.lit(0.0))


def _holding(counts: DataFrame, order: str) -> DataFrame:
    """Of the few rows ``(key, order, n, need)`` of each key the one with ``above < need <= above + n``."""
    higher = W.partitionBy("key").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    above = counts.withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    return above.where((F.col("above") < F.col("need")) & (F.col("need") <= F.col("above") + F.col("n")))


def _section(integral: bool) -> Column:
    """The section of a value in its bounds; the lowest value is always in the first, the highest in the last."""
    value, lo, hi = (F.col(c).cast("decimal(20,0)") if integral else F.col(c) for c in ("value", "lo", "hi"))
    part = F.floor((value - lo).cast("double") / (hi - lo).cast("double") * SECTIONS)
    return F.when(F.col("value") >= F.col("hi"), SECTIONS - 1).otherwise(F.coalesce(F.greatest(F.lit(0), F.least(part, F.lit(SECTIONS - 1))), F.lit(0))).cast("int")


def bisect_cutoffs(weighted: DataFrame, needs: DataFrame, ws: Workspace, label: str, max_rounds: int = 80) -> DataFrame:
    """For each key the value v with ``weight above v < need <= weight at or above v``.

    ``weighted`` has ``(key, value, n)``, one row for each distinct value of a key, values
    doubles or longs; ``needs``, a written table, has ``(key, need, lo, hi, k)`` with the
    bounds and the number of values of the keys in question.  Returns
    ``(key, cutoff, left, tied)``: how many records with just that value are still needed,
    and how many there are.
    """
    integral = dict(weighted.dtypes)["value"] == "bigint"
    open_ = look_up(weighted.select("key", "value", "n"), needs, ["key"])
    done, bounds = [], needs
    for r in range(max_rounds):
        found = _holding(open_.where(F.col("k") <= FEW), "value")
        done.append(ws.save(found.select("key", F.col("value").alias("cutoff"), (F.col("need") - F.col("above")).alias("left"), F.col("n").alias("tied")), f"{label}_cut{r}"))
        if bounds.where(F.col("k") > FEW).isEmpty():
            break
        placed = open_.where(F.col("k") > FEW).select("key", "value", "n", "need", _section(integral).alias("part"))
        counts = placed.groupBy("key", "part").agg(F.sum("n").alias("n"), F.first("need").alias("need"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("k"))
        bounds = ws.save(_holding(counts, "part").select("key", "part", (F.col("need") - F.col("above")).alias("need"), "lo", "hi", "k"), f"{label}_bounds{r}")
        open_ = ws.save(look_up(placed.drop("need"), bounds, ["key", "part"]).drop("part"), f"{label}_open{r}")
        if r:
            ws.drop(f"{label}_open{r - 1}")
    else:
        raise RuntimeError(f"cutoffs not found after {max_rounds} rounds")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _needs(weighted: DataFrame, need: Column) -> DataFrame:
    """Bounds and weight of the keys that have more than they need."""
    sums = weighted.groupBy("key").agg(F.sum("n").alias("total"), need.cast("bigint").alias("need"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("k"))
    return sums.where(F.col("total") > F.col("need")).drop("total")


def cap_records(records: DataFrame, ws: Workspace, cap: int | None = 5, share: float | None = None, id_col: str = "record_id", key: Column | None = None, score: Column | None = None) -> DataFrame:
    """Each record with ``kept``: ``(record_id, key, score, kept)``.

    A contributor keeps its ``cap`` best records by score, descending, ties by
    ascending id.  With ``share`` the cap of every contributor is that share of all
    records with a key (at least one record); with both, the smaller one holds.
    Records with a null key are kept.  Rows that repeat an id count one by one and
    stand or fall together with their tie.  An empty table gives an empty result.
    """
    if cap is None and share is None:
        raise ValueError("give cap or share")
    key = canonical_repo(F.col("repo_name")) if key is None else key
    score = quality("coverage_rate") if score is None else score
    rows = ws.save(records.select(F.col(id_col).cast("bigint").alias("record_id"), key.cast("string").alias("key"), score.alias("score")), "scored")
    limit = cap
    if share is not None:
        by_share = max(1, int(share * rows.where("key is not null").count()))
        limit = by_share if cap is None else min(cap, by_share)
    if limit < 1:
        raise ValueError("the cap must be at least 1")
    hist = ws.save(rows.where("key is not null").groupBy("key", F.col("score").alias("value")).agg(F.count("*").alias("n")), "hist")
    cuts = ws.save(bisect_cutoffs(hist, ws.save(_needs(hist, F.lit(limit)), "needs"), ws, "score"), "cuts")
    some = ws.save(cuts.where("tied > left").select("key", "cutoff", "left"), "some")
    tied = look_up(rows, some, ["key"]).where(F.col("score") == F.col("cutoff"))
    tied = ws.save(tied.groupBy("key", (-F.col("record_id")).alias("value")).agg(F.count("*").alias("n"), F.first("left").alias("left")), "tied")
    last = bisect_cutoffs(tied.drop("left"), ws.save(_needs(tied, F.first("left")), "tied_needs"), ws, "ids")
    ends = ws.save(cuts.join(last.select("key", (-F.col("cutoff")).alias("last_id")), "key", "left").select("key", "cutoff", "last_id"), "ends")
    # without a last id all ties are kept
    kept = F.col("cutoff").isNull() | (F.col("score") > F.col("cutoff")) | ((F.col("score") == F.col("cutoff")) & (F.col("last_id").isNull() | (F.col("record_id") <= F.col("last_id"))))
    return look_up(rows, ends, ["key"], "left").select("record_id", "key", "score", kept.alias("kept"))
