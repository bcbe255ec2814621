"""Intermediate tables on storage that every executor shares.

Iterative operators cut their lineage by writing a table and reading it back.
The folder is the one the cluster names in ``spark.checkpoint.dir``; a written
table survives the loss of any executor.  Only a ``local`` master without that
setting (tests, a laptop) gets a temporary folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[app], True)
    return "file://" + _LOCAL_ROOTS[app]


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _folder(spark, path)
    fs.delete(where, True)


def finished_tables(spark: SparkSession, path: str) -> list[str]:
    """Names of the tables below a folder that were written to the end, in order; none if it does not exist."""
    where, fs = _folder(spark, path)
    if not fs.exists(where):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    return sorted(n for n in found if fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0]))


class Workspace:
    """A folder of written tables that belong to one operator call.

    ``save`` writes and reads back; ``drop`` deletes a table that no later step
    reads.  Tables that a returned DataFrame still reads live until ``clean_up`` or until
    the session's checkpoint folder is cleaned.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(self.path)

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.path}/{name}"
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, f"{self.path}/{name}")


def clean_up(spark: SparkSession) -> int:
    """Deletes all tables that workspaces of this application wrote, and says of how many workspaces.

    For the end of a job: results that were not stored elsewhere cannot be read afterwards.
    """
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        delete(spark, path)
    return len(made)
