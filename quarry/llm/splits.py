"""Splits that keep related records together.

Related records are the connected components of a bipartite key graph: a record
links the owner of its repository with its base index.  Only the distinct
(owner, base) edges enter the iteration, so repeated deliveries cost nothing.

Components are found by hash-to-min: every node keeps a cluster of known members;
in a round it sends the cluster to the cluster's smallest member and that smallest
member to all others.  Clusters are held as (node, member) rows, never as arrays,
so a component with a third of all nodes is still spread over all tasks.  The minima
are written before they are joined with the cluster rows: adaptive execution splits a
large cluster only if the other side is not an aggregate on the same key.

Splits are assigned by weighted rendezvous hashing of the component, so adding
records or a new split moves as few components as possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import base_idx, canonical_repo, repo_owner
from quarry.plans.sized import look_up
from quarry.workspace import Workspace

DEFAULT_WEIGHTS = {"train": 0.8, "valid": 0.1, "test": 0.1}


def hash_to_min(edges: DataFrame, ws: Workspace, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as rows ``(node, root)``.

    ``root`` is the smallest node of the component.  Null ends are ignored,
    self-loops make a node known.  An empty input gives no rows.  Raises when the
    clusters have not become stable after ``max_rounds`` rounds, rather than
    returning a partial result.
    """
    known = edges.where("a is not null and b is not null")
    ends = [("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")]
    both = known.select(F.explode(F.array(*[F.struct(F.col(x).alias("node"), F.col(y).alias("member")) for x, y in ends])).alias("e"))
    clusters = ws.save(both.select("e.node", "e.member").distinct(), "clusters0")
    seen = _signature(clusters)
    for r in range(1, max_rounds + 1):
        low = ws.save(clusters.groupBy("node").agg(F.min("member").alias("low")), f"low{r}")
        sent = look_up(clusters, low, ["node"]).select(
            F.explode(F.array(F.struct(F.col("low").alias("node"), F.col("member").alias("member")), F.struct(F.col("member").alias("node"), F.col("low").alias("member")))).alias("e")
        )
        nxt = ws.save(sent.select("e.node", "e.member").distinct(), f"clusters{r}")
        now = _signature(nxt)
        ws.drop(f"clusters{r - 1}")
        ws.drop(f"low{r}")
        clusters = nxt
        if now == seen:
            return clusters.groupBy("node").agg(F.min("member").alias("root"))
        seen = now
    raise RuntimeError(f"components not stable after {max_rounds} rounds")


def _signature(clusters: DataFrame):
    return clusters.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "member")), F.bit_xor(F.xxhash64("member", "node", F.lit(1)))).first()


def record_groups(records: DataFrame, ws: Workspace, id_col: str = "record_id", repo_col: str = "repo_name", idx_col: str = "idx") -> DataFrame:
    """Each record with its group: ``(record_id, repo, root)``.

    ``repo`` is the canonical repository or null.  A record without owner and base
    index is related to none and gets a root of its own.  Extra columns are not
    read; repeated ids are kept as they are.
    """
    repo = canonical_repo(F.col(repo_col))
    keyed = records.select(F.col(id_col).alias("record_id"), repo.alias("repo"), F.concat(F.lit("o:"), repo_owner(repo)).alias("owner"), F.concat(F.lit("b:"), base_idx(F.col(idx_col))).alias("base"))
    keyed = ws.save(keyed.withColumn("node", F.coalesce("base", "owner")), "keyed")
    edges = keyed.where("node is not null").select(F.coalesce("owner", "base").alias("a"), F.coalesce("base", "owner").alias("b")).distinct()
    roots = ws.save(hash_to_min(edges, ws), "roots")
    joined = look_up(keyed.select("record_id", "repo", "node"), roots, ["node"], "left")
    return joined.select("record_id", "repo", F.coalesce("root", F.concat(F.lit("r:"), F.col("record_id").cast("string"))).alias("root"))


def rendezvous_split(key: Column, weights: dict[str, float], seed: int = 0) -> Column:
    """The split with the smallest ``-ln(u) / weight``, u uniform from (seed, split, key)."""
    scores = []
    for name, weight in weights.items():
        if weight <= 0:
            continue
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(name), key)), 1, 13), 16, 10).cast("double")
        u = (h + 0.5) / F.lit(float(16**13))
        scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(name).alias("name")))
    if not scores:
        raise ValueError("no split has a positive weight")
    return F.least(*scores)["name"] if len(scores) > 1 else scores[0]["name"]


def grouped_splits(records: DataFrame, ws: Workspace, weights: dict[str, float] | None = None, seed: int = 0, **cols: str) -> DataFrame:
    """A new split for each record: ``(record_id, new_split)``; related records agree."""
    groups = record_groups(records, ws, **cols)
    return groups.select("record_id", rendezvous_split(F.col("root"), weights or DEFAULT_WEIGHTS, seed).alias("new_split"))


def named_groups(records: DataFrame, ws: Workspace) -> DataFrame:
    """``(record_id, group_key)`` of the groups with two or more records and a repository.

    ``group_key`` is the smallest canonical repository name of the group by code
    point.  Groups without any repository name and single records are left out.
    """
    groups = ws.save(record_groups(records, ws), "groups")
    heads = groups.groupBy("root").agg(F.min("repo").alias("group_key"), F.count("*").alias("n")).where("n >= 2 and group_key is not null")
    return look_up(groups, ws.save(heads, "heads"), ["root"]).select("record_id", "group_key")


def split_report(records: DataFrame, ws: Workspace, weights: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Records, groups and share of each new split."""
    groups = ws.save(record_groups(records, ws), "groups")
    split = rendezvous_split(F.col("root"), weights or DEFAULT_WEIGHTS, seed)
    per_root = groups.groupBy("root").agg(F.count("*").alias("n"))
    sums = per_root.groupBy(split.alias("new_split")).agg(F.sum("n").alias("n_records"), F.count("*").alias("n_groups"))
    total = sums.agg(F.sum("n_records").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("new_split", "n_records", "n_groups", (F.col("n_records") / F.col("total")).alias("share"))
