"""Stateless stages on streams: the same functions as for batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Processes what is there, appends it to ``out`` and ends; restarts go on where they stopped."""
    query = stage(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def take_skip(df: DataFrame, pos: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n positions as validation, the rest as training, without state."""
    return df.where(F.col(pos) < n), df.where(F.col(pos) >= n)
