"""Mixing sources to target shares by entropy balancing.

Each document gets a rate ``exp(lambda * tokens)``, capped at the repeats its source
allows: of all rates that meet a source's token target, those closest in relative
entropy to using every document once.  The multipliers solve the convex dual; all are
found together by Newton steps, each one aggregation over a histogram of document
sizes.  Rates are rounded into copies systematically along the order of size, so the
tokens of a source miss their target by less than one document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.names import canonical_label
from quarry.operators.ranking import rank_within
from quarry.workspace import Workspace


def _solve(hist: DataFrame, want: dict[str, tuple[float, int, float]], rounds: int = 100, tolerance: float = 1e-10) -> dict[str, float]:
    """Multipliers by source; ``want`` has (target tokens, repeats, mean tokens).

    Raises where a source has not come within a millionth of its target, rather than
    returning a mix that is off it.
    """
    spark = hist.sparkSession
    state = {s: [0.0, -math.inf, math.inf] for s in want}
    open_ = set(want)
    off: dict[str, float] = dict.fromkeys(want, math.inf)
    for _ in range(rounds):
        if not open_:
            break
        params = spark.createDataFrame([(s, state[s][0] / want[s][2], float(want[s][1]), want[s][2]) for s in sorted(open_)], "source string, slope double, most double, scale double")
        rows = hist.join(F.broadcast(params), "source")  # one row for each source with a target
        rate = F.exp(F.least(F.col("slope") * F.col("tokens"), F.lit(700.0)))
        x = F.col("tokens") / F.col("scale")
        sums = rows.groupBy("source").agg(
            F.sum(F.col("n") * F.col("tokens") * F.least(rate, F.col("most"))).alias("got"),
            F.sum(F.when(rate < F.col("most"), F.col("n") * F.col("tokens") * x * rate).otherwise(0.0)).alias("bend"),
        )
        for r in sums.collect():
            s = r["source"]
            target = want[s][0]
            at, lo, hi = state[s]
            miss = r["got"] - target
            off[s] = abs(miss) / target
            if abs(miss) <= tolerance * target:
                open_.discard(s)
                continue
            lo, hi = (at, hi) if miss < 0 else (lo, at)
            step = at - miss / r["bend"] if r["bend"] > 0 else math.inf
            if not lo < step < hi or abs(step - at) > 20:
                step = (lo + hi) / 2 if math.isfinite(lo) and math.isfinite(hi) else (lo * 2 + 1 if math.isfinite(lo) and lo >= 0 else lo / 2 + 1) if math.isfinite(lo) else (hi * 2 - 1 if hi <= 0 else hi / 2 - 1)
            if step == at or abs(step) > 1e6:
                open_.discard(s)
                continue
            state[s] = [step, lo, hi]
    missed = sorted(s for s in want if off[s] > 1e-6)
    if missed:
        raise RuntimeError(f"no rates found for {', '.join(missed)}")
    return {s: state[s][0] / want[s][2] for s in want}


def mix_sources(documents: DataFrame, sizes: DataFrame, targets: DataFrame, ws: Workspace, total_tokens: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(copies, report)`` of a mix with the target shares.

    ``copies`` has ``(doc_id, source, tokens, copies)`` for every used document,
    ``report`` one row for each source of ``targets`` and, under its own name, for each
    other source (target share 0, not used).  Source names are compared in canonical
    form; null and blank sources, documents without tokens and targets that are null or
    not positive are not used.  Without ``total_tokens`` the mix is as large as the
    repeats allow with exact shares; a larger wish falls short in the sources that run
    out, which the report shows.  A targeted source without documents is reported with 0.
    """
    spark = documents.sparkSession
    named = documents.select("doc_id", canonical_label("source").alias("source")).where("source is not null").distinct()
    rows = ws.save(sizes.where("tokens > 0").join(named, "doc_id").select("doc_id", "source", "tokens"), "sized")
    hist = ws.save(rows.groupBy("source", "tokens").agg(F.count("*").alias("n")), "hist")
    goals = targets.select(canonical_label("source").alias("source"), F.col("target_share").alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("most"))
    goals = {r["source"]: (r["share"], r["most"]) for r in goals.where("source is not null and share > 0 and most > 0").collect()}
    have = {r["source"]: (r["tokens"], r["docs"]) for r in hist.where(F.col("source").isin(*goals) if goals else F.lit(False)).groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("tokens"), F.sum("n").alias("docs")).collect()}
    can = {s: goals[s][1] * have[s][0] for s in have}
    size = total_tokens if total_tokens is not None else min((can[s] / goals[s][0] for s in have), default=0.0)
    full = {s for s in have if goals[s][0] * size >= can[s] * (1 - 1e-12)}
    slopes = _solve(hist, {s: (goals[s][0] * size, goals[s][1], have[s][0] / have[s][1]) for s in have if s not in full})
    params = spark.createDataFrame([(s, slopes.get(s, 0.0), float(goals[s][1]), s in full) for s in sorted(have)], "source string, slope double, most double, full boolean")
    rate = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.exp(F.least(F.col("slope") * F.col("tokens"), F.lit(700.0))), F.col("most")))
    rated = hist.join(F.broadcast(params), "source").select("source", "tokens", "n", rate.alias("rate"))
    before = W.partitionBy("source").orderBy("tokens").rowsBetween(W.unboundedPreceding, -1)
    rated = ws.save(rated.withColumn("base", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0))), "rated")
    ranked = rank_within(rows.join(F.broadcast(params.select("source")), "source", "left_semi"), ["source", "tokens"], ["doc_id"], ws, "order")
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("source"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    at = F.col("base") + F.col("rank") * F.col("rate") + offset
    whole = F.when(F.col("rate") == F.floor("rate"), F.floor("rate")).otherwise(F.floor(at + F.col("rate")) - F.floor(at))
    copies = ranked.join(rated, ["source", "tokens"]).select("doc_id", "source", "tokens", whole.cast("int").alias("copies")).where("copies > 0")
    copies = ws.save(copies, "copies")
    used = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("mix_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    goal_rows = spark.createDataFrame([(s, float(g[0]), int(g[1])) for s, g in sorted(goals.items())], "source string, target_share double, max_repeats int")
    avail = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("available_tokens"), F.sum("n").alias("available_documents"))
    report = avail.join(goal_rows, "source", "full").join(used, "source", "left").fillna(0)
    total = used.agg(F.sum("mix_tokens").alias("all_tokens"))
    report = report.crossJoin(F.broadcast(total)).select(
        "source", "available_documents", "available_tokens", "target_share", "max_repeats", "documents", "most_copies", "mix_tokens",
        F.coalesce(F.col("mix_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"),
    )
    return copies, report
