"""Joins that the pipeline expresses as look-ups, scans and bisections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def update_columns(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which non-null values of ``right`` replace those of ``left``; new columns are added."""
    fresh = [c for c in right.columns if c not in on]
    renamed = right.select(*on, *[F.col(c).alias(f"_r_{c}") for c in fresh])
    joined = left.join(renamed, on, "left")
    cols = [F.coalesce(F.col(f"_r_{c}"), F.col(c)).alias(c) if c in fresh else F.col(c) for c in left.columns]
    return joined.select(*cols, *[F.col(f"_r_{c}").alias(c) for c in fresh if c not in left.columns])


def last_before(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, strict: bool = True, name: str = "last_value", side_order: str | None = None) -> DataFrame:
    """As-of join: for each left row the ``value`` of the last right row before it.

    Both sides are interleaved in one sorted pass over a window, so the cost is a sort and
    not a join of all pairs.  Nulls in ``by`` or ``at`` match nothing.
    """
    cols = [c for c in left.columns if c not in (*by, at)]
    l_rows = left.select(*by, at, F.struct(*cols).alias("_row") if cols else F.struct(F.lit(1).alias("x")).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(0 if strict else 1).alias("_turn"), F.lit(True).alias("_left"))
    r_rows = right.select(*by, at, F.lit(None).cast(l_rows.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"), F.lit(1 if strict else 0).alias("_turn"), F.lit(False).alias("_left"))
    known = r_rows.where(" and ".join(f"{c} is not null" for c in [*by, at]))
    before = W.partitionBy(*by).orderBy(at, "_turn").rowsBetween(W.unboundedPreceding, 0)
    filled = l_rows.unionByName(known).withColumn(name, F.last("_value", ignorenulls=True).over(before))
    complete = F.expr(" and ".join(f"{c} is not null" for c in [*by, at]))
    out = filled.where("_left").withColumn(name, F.when(complete, F.col(name)))
    return out.select(*by, at, *[F.col("_row")[c].alias(c) for c in cols], name)


def resolve_by_prefix(df: DataFrame, col: str, known: DataFrame, key: str, cuts: tuple[int, ...] = (0, 1, 2), sep: str = ".") -> DataFrame:
    """The longest known prefix after dropping 0, 1 or 2 trailing parts, as ``resolved``.

    A prefix join as equi-joins on derived keys; ``known`` must have distinct keys.
    """
    out, parts = df, F.split(F.col(col), "\\" + sep)
    for c in cuts:
        prefix = F.when(F.size(parts) > c, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - c), sep))
        out = out.withColumn(f"_p{c}", prefix).join(known.select(F.col(key).alias(f"_p{c}"), F.lit(True).alias(f"_k{c}")), f"_p{c}", "left")
    resolved = F.coalesce(*[F.when(F.col(f"_k{c}"), F.col(f"_p{c}")) for c in cuts])
    return out.withColumn("resolved", resolved).select(*df.columns, "resolved")


def methods_of_classes(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """``(class_id, method_id)`` of methods that are named ``class.method``."""
    named = methods.select("method_id", F.substring_index("method_id", ".", -1).alias("last"))
    named = named.select("method_id", F.expr("left(method_id, length(method_id) - length(last) - 1)").alias("class_id"))
    return classes.select("class_id").distinct().join(named, "class_id")


def first_match_in_order(inputs: DataFrame, results: DataFrame, on: str, pos: str, result_pos: str) -> DataFrame:
    """For each input its first result, in input order; inputs without a result are left out."""
    others = [c for c in results.columns if c != on]
    first = results.groupBy(on).agg(F.min_by(F.struct(*others), result_pos).alias("_r"))
    return inputs.join(first, on).select(*inputs.columns, *[F.col("_r")[c].alias(c) for c in others if c not in inputs.columns]).orderBy(pos)


def fallback_join(df: DataFrame, tables: list[tuple[DataFrame, Column, str]], name: str) -> DataFrame:
    """Left joins in turn; the first table with a match gives ``name``.

    Each entry is (table(key, value) with distinct keys, key expression over df, tag).
    """
    out = df
    for i, (table, key, _) in enumerate(tables):
        out = out.withColumn(f"_k{i}", key).join(table.select(F.col("key").alias(f"_k{i}"), F.col("value").alias(f"_v{i}")), f"_k{i}", "left")
    return out.withColumn(name, F.coalesce(*[F.col(f"_v{i}") for i in range(len(tables))])).select(*df.columns, name)


def first_by_text(df: DataFrame, text: str, table: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    """Left look-up by equal text: the ``value`` of the first row of ``table``, by ``order``, whose ``key`` is the text.

    Joined on a 256-bit hash of the text; null texts find nothing.
    """
    first = table.where(F.col(key).isNotNull()).groupBy(F.sha2(key, 256).alias("_h")).agg(F.min_by(value, order).alias(name))
    return df.withColumn("_h", F.sha2(text, 256)).join(first, "_h", "left").drop("_h")
