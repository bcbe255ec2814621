"""Sinks, resumable stages and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def export_json(df: DataFrame, path: str, max_records: int | None = None) -> None:
    """JSON lines; with ``max_records`` no file holds more."""
    w = df.write.mode("overwrite")
    (w.option("maxRecordsPerFile", max_records) if max_records else w).json(path)


def export_json_array(df: DataFrame, path: str, rows_per_file: int = 10_000) -> None:
    """Files that hold one JSON array each, of at most ``rows_per_file`` rows, in no order; no rows give no file."""
    from pyspark.sql import Window as W

    numbered = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).withColumn("_part", F.spark_partition_id())
    numbered = numbered.withColumn("_file", F.floor((F.row_number().over(W.partitionBy("_part").orderBy("j")) - 1) / rows_per_file))
    arrays = numbered.groupBy("_part", "_file").agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list("j"), ",\n"), F.lit("\n]")).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path`` if it was finished before, else ``make()`` written there and read back."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume(todo: DataFrame, path: str, key: str, stage, parts: int = 1) -> DataFrame:
    """Runs ``stage`` on the rows whose key is not yet at ``path`` and appends the result.

    Work is cut into ``parts`` by hash of the key, each appended on its own, so a broken
    run loses at most one part.
    """
    spark = todo.sparkSession
    for p in range(parts):
        rows = todo if parts == 1 else todo.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p)
        if exists(spark, path):
            rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
        stage(rows).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def split_files(df: DataFrame, path: str, most: int = 10_000) -> None:
    """Parquet files of at most ``most`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(path)


def write_blocks(df: DataFrame, path: str) -> None:
    """One folder for each ``block``; only the blocks in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(path)


def write_code_dump(df: DataFrame, path: str) -> None:
    """Sampled functions as text with numbered headers, ``df(pos, code)``."""
    df.select(F.format_string("[%d]\n%s\n", F.col("pos"), F.col("code")).alias("value")).write.mode("overwrite").text(path)


def distinct_in_order(commands: Column) -> Column:
    """The elements of an array without repetitions, in the order they first stand."""
    return F.array_distinct(commands)


def swebench_rows(df: DataFrame, records: str, file: Column) -> DataFrame:
    """Prediction rows for an evaluation harness: the first of a list of records, with the model's name from the file name.

    ``records`` is ``array<struct<...>>``; an empty list gives no row.
    """
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.json.*$", "")
    return df.where(F.size(records) > 0).select(F.col(records)[0].alias("_r"), name.alias("model_name_or_path")).select("_r.*", "model_name_or_path")


def results_with_config(spark: SparkSession, metrics: dict[str, float], config: dict[str, str]) -> DataFrame:
    """One row with the metrics and the configuration as maps."""
    return spark.createDataFrame([({k: float(v) for k, v in metrics.items()}, {k: str(v) for k, v in config.items()})], "metrics map<string,double>, config map<string,string>")
