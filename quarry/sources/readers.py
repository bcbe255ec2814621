"""Sources: JSON in several layouts, text, source trees, registered data sets."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quarry import schema as schema_of

#: Readers by file ending.
FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet", "txt": "text", "arrow": "arrow"}


def json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that holds one JSON array; with ``schema`` no pass for inference is made."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object for each line; a file whose first line opens a list is read as an array."""
    first = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    if first and first[0]["value"].lstrip().startswith("["):
        return json_array(spark, path, schema)
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def typed_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON records of a known type (``example``, ``final``, ``sft``, ``retrieval`` and so on) with its schema; fields they lack are null."""
    ddl = getattr(schema_of, kind.upper(), None)
    if ddl is None:
        raise ValueError(f"unknown record type {kind}")
    return json_lines(spark, path, ddl)


def arrow_files(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files or streams, read by the executors, a file for each task; the first file gives the schema."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def batches(content: bytes):
        source = pa.BufferReader(content)
        return pa.ipc.open_file(source).read_all() if content[:6] == b"ARROW1" else pa.ipc.open_stream(source).read_all()

    def head(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            empty = [pa.BufferOutputStream() for _ in range(len(part))]
            for c, sink in zip(part.column(0).to_pylist(), empty):
                schema = batches(c).schema
                with pa.ipc.new_stream(sink, schema) as w:
                    w.write_table(schema.empty_table())
            yield pa.record_batch([pa.array([e.getvalue().to_pybytes() for e in empty], pa.binary())], ["schema"])

    first = files.limit(1).mapInArrow(head, "schema binary").collect()
    if not first:
        raise ValueError(f"no file at {path}")
    schema = from_arrow_schema(pa.ipc.open_stream(bytes(first[0]["schema"])).schema)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for c in part.column(0).to_pylist():
                yield from batches(c).to_batches(max_chunksize=10_000)

    return files.mapInArrow(rows, schema)


def tagged_functions(df: DataFrame) -> DataFrame:
    """Rows with ``function_id`` or ``method_id`` under one schema: adds ``kind``, ``id``, ``code`` and ``name``.

    A row with neither id is an error when it is read.
    """
    have = set(df.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    fid, mid = col("function_id"), col("method_id")
    kind = F.when(fid.isNotNull(), "function").when(mid.isNotNull(), "method").otherwise(F.raise_error(F.lit("neither function_id nor method_id")))
    return df.select(kind.alias("kind"), F.coalesce(fid, mid).alias("id"), F.coalesce(col("function_code"), col("method_code")).alias("code"), F.coalesce(col("function_name"), col("method_name")).alias("name"), *[c for c in df.columns if c not in ("function_id", "method_id", "function_code", "method_code", "function_name", "method_name")])


def line_list(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines as ``value``."""
    return spark.read.text(path).where(F.length("value") > 0)


def file_tree(spark: SparkSession, root: str, pattern: str = "*", hidden: bool = False) -> DataFrame:
    """``(path, size, text)`` of all files below a folder; parts that start with a dot are skipped."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    df = df.select("path", F.col("length").alias("size"), F.decode("content", "UTF-8").alias("text"))
    return df if hidden else df.where(~F.regexp_replace("path", "^[a-z]+:/+", "/").rlike(r"/\.[^/]"))


def python_files(spark: SparkSession, root: str) -> DataFrame:
    """Python sources that parse: ``(path, size, text)``."""
    from quarry.functions.pyast import per_row, safe_parse

    return file_tree(spark, root, "*.py").where(per_row(lambda t: safe_parse(t) is not None, "boolean", "text"))


@dataclass(frozen=True)
class DatasetInfo:
    """A registered data set; ``columns`` maps standard names to its own."""

    name: str
    path: str
    formatting: str = "alpaca"
    ranking: bool = False
    subset: str | None = None
    split: str = "train"
    num_samples: int | None = None
    columns: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)


def registry(path: str | dict, names: list[str] | None = None) -> dict[str, DatasetInfo]:
    """Descriptors of a registry, given as a file or as its content; an unknown name or formatting is an error.

    An entry has a ``file_name`` (a file, or a folder of files of one kind), or names an
    online source (``hf_hub_url``, ``script_url`` and the like), which gets the path
    ``ONLINE:name`` and is read through ``load_registered``'s ``online``.
    """
    if isinstance(path, dict):
        raw = path
    else:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    out = {}
    for name in names if names is not None else raw:
        if name not in raw:
            raise ValueError(f"undefined data set {name}")
        r = raw[name]
        if r.get("formatting", "alpaca") not in ("alpaca", "sharegpt"):
            raise ValueError(f"unknown formatting of {name}")
        url = next((r[k] for k in r if k.endswith("_url")), None)
        if "file_name" not in r and url is None:
            raise ValueError(f"{name} has neither a file nor an address")
        where = r["file_name"] if "file_name" in r else f"ONLINE:{url}"
        out[name] = DatasetInfo(name, where, r.get("formatting", "alpaca"), r.get("ranking", False), r.get("subset"), r.get("split", "train"), r.get("num_samples"), r.get("columns", {}), r.get("tags", {}))
    return out


def load_registered(spark: SparkSession, info: DatasetInfo, root: str, online=None) -> DataFrame:
    """A registered data set with standard column names; the format follows the file ending.

    A folder must hold files of one kind.  ``online(spark, address, info)`` reads addresses
    and is an error where missing.  With ``num_samples`` the first rows in file order are
    taken, by the position a row is read at.
    """
    if info.path.startswith("ONLINE:"):
        if online is None:
            raise ValueError(f"{info.name} needs an online reader")
        df = online(spark, info.path.removeprefix("ONLINE:"), info)
    else:
        path = f"{root}/{info.path}"
        names = [n for n in os.listdir(path) if not n.startswith((".", "_"))] if os.path.isdir(path) else [info.path]
        endings = {n.rsplit(".", 1)[-1].lower() for n in names}
        if len(endings) != 1 or not endings <= set(FORMATS):
            raise ValueError(f"unknown or mixed file types {sorted(endings)}")
        kind = FORMATS[endings.pop()]
        df = json_lines(spark, path) if kind == "json" else arrow_files(spark, path) if kind == "arrow" else spark.read.option("header", True).format(kind).load(path)
    own = {v: k for k, v in info.columns.items()}
    df = df.select(*[F.col(c).alias(own.get(c, c)) for c in df.columns])
    return first_rows(df, [], info.num_samples) if info.num_samples else df


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in the given order, or in the order they are read."""
    if order:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_at", F.monotonically_increasing_id()).orderBy("_at").limit(n).drop("_at")


def check_data_options(val_size: float = 0, dataset: str | None = None, eval_dataset: str | None = None, mix: str = "concat", probabilities: list[float] | None = None, streaming: bool = False, max_samples: int | None = None, mask_history: bool = False, train_on_prompt: bool = False) -> None:
    """Raises ValueError for options that exclude each other."""
    if val_size > 0 and not dataset:
        raise ValueError("val_size needs a data set")
    if val_size > 0 and eval_dataset:
        raise ValueError("val_size and eval_dataset exclude each other")
    if eval_dataset and not dataset:
        raise ValueError("an eval_dataset needs a data set")
    if probabilities is not None and (not mix.startswith("interleave") or len(probabilities) != len((dataset or "").split(","))):
        raise ValueError("probabilities need interleaving and one value for each data set")
    if streaming and (max_samples is not None or 0 < val_size < 1):
        raise ValueError("streaming needs a whole val_size and no max_samples")
    if mask_history and train_on_prompt:
        raise ValueError("mask_history and train_on_prompt exclude each other")
