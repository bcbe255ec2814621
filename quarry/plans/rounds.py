"""The generate, execute, filter loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.workspace import Workspace

Stage = Callable[[DataFrame], DataFrame]


def run_rounds(work: DataFrame, ws: Workspace, generate: Stage, execute: Stage, good: str = "good", key: str = "idx", rounds: int = 3, enough: float = 0.8) -> DataFrame:
    """Repeats generation and execution on the rows that are not good yet.

    Every round is written, which cuts the lineage, and carries ``round``.  Rows for which
    a stage returns nothing keep their last result.  Ends when the good share of the
    first worklist reaches ``enough``.  The result has the last row of each key.
    """
    total = work.select(key).distinct().count()
    todo, done = work, None
    for r in range(rounds):
        out = ws.save(execute(generate(todo)).withColumn("round", F.lit(r)), f"round{r}")
        done = out if done is None else done.unionByName(out)
        last = done.groupBy(key).agg(F.max_by(F.struct(*[c for c in done.columns if c != key]), "round").alias("_r"))
        last = ws.save(last.select(key, "_r.*"), f"last{r}")
        n_good = last.where(F.col(good)).count()
        if total == 0 or n_good >= enough * total:
            break
        todo = last.where(~F.coalesce(F.col(good), F.lit(False))).drop("round", good)
    return last
