"""Filling containers of a fixed capacity by a plan over the length histogram.

Only the histogram of lengths reaches the driver: at most ``capacity`` rows, whatever
the number of documents.  Best fit in descending order of length is run over counts:
containers with the same content form one group, so a placement fills many containers
at once and the plan has a few rows for each length.  Documents then take the planned
slots by joining on their rank within their length.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import VOCABULARY, token_sums
from quarry.operators.ranking import rank_within
from quarry.workspace import Workspace

CAPACITY = 2048
#: Most rows of a plan that are broadcast (about 40 MB); 2,048 lengths need some ten thousand.
MAX_PLAN = 500_000


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs ``(length, first_rank, last_rank, first_container, per_container)``.

    Items of a length with ranks in the run fill the containers from
    ``first_container`` on, ``per_container`` to each.
    """
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put_back(room: int, first: int, n: int) -> None:
        if room <= 0 or n <= 0:
            return
        if room not in free:
            free[room] = []
            insort(rooms, room)
        heapq.heappush(free[room], (first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = heapq.heappop(free[room])
                if not free[room]:
                    del free[room]
                    rooms.pop(i)
            else:
                room, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = room // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each - 1, first, each))
                rank += full * each
                left -= full * each
                put_back(room - each * length, first, full)
            if full < n and left and left < each:
                out.append((length, rank, rank + left - 1, first + full, left))
                put_back(room - left * length, first + full, 1)
                full += 1
                rank += left
                left = 0
            put_back(room, first + full, n - full)
    return out


def items_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """``sizes(doc_id, tokens)`` as items ``(doc_id, part, first_token, length)``; only oversized ones are cut."""
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1)).alias("part")
    rows = sizes.where("tokens > 0").select("doc_id", "tokens", parts)
    first = (F.col("part") * F.lit(capacity)).cast("bigint")
    return rows.select("doc_id", "part", first.alias("first_token"), F.least(F.lit(capacity), F.col("tokens") - first).cast("int").alias("length"))


def fill_containers(sizes: DataFrame, ws: Workspace, capacity: int = CAPACITY) -> DataFrame:
    """``sizes(doc_id, tokens)`` to ``(doc_id, part, first_token, length, container)``.

    Documents without tokens (null sizes too) take no place.  A document longer than the
    capacity is cut into full parts and a rest; no other is cut.  Ties of length are
    resolved by doc_id.  No container holds more than the capacity.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = sizes.sparkSession
    items = rank_within(items_of(sizes, capacity), ["length"], ["doc_id", "part"], ws, "items")
    items = ws.save(items, "placed")
    ws.drop("items")
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan_slots(histogram, capacity)
    # blocks of ranks make the lookup of a rank an equi-join with about one run for each block
    many: dict[int, int] = {}
    for r in runs:
        many[r[0]] = many.get(r[0], 0) + 1
    block = {length: max(1, -(-n // many[length])) for length, n in histogram.items()}
    rows = [(length, b, lo, hi, first, each) for length, lo, hi, first, each in runs for b in range(lo // block[length], hi // block[length] + 1)]
    plan = spark.createDataFrame(rows, "length int, block bigint, lo bigint, hi bigint, first bigint, each bigint")
    blocks = spark.createDataFrame(list(block.items()), "length int, width bigint")
    # one row for each length, and a few of the plan: bounded by the capacity, not by the documents
    bounded = lambda df, n: F.broadcast(df) if n <= MAX_PLAN else df.hint("merge")
    found = items.join(bounded(blocks, len(block)), "length").withColumn("block", F.floor(F.col("rank") / F.col("width")))
    found = found.join(bounded(plan, len(rows)), ["length", "block"]).where("rank between lo and hi")
    return found.select("doc_id", "part", "first_token", "length", (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).alias("container"))


def document_tokens(documents: DataFrame, ws: Workspace, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, tokens)`` of documents with a text that is not blank; rows of one id are added up."""
    texts = documents.select("doc_id", "text").where(F.col("text").rlike(r"(?U)\S"))
    return token_sums(texts, ws, ["doc_id"], path)


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, items, tokens and the share of the capacity that is used."""
    per = placed.groupBy("container").agg(F.sum("length").alias("used"), F.count("*").alias("items"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        (F.sum("used") / (F.count("*") * F.lit(capacity))).alias("fill"),
    )
