"""External sources behind a small interface, with an offline stand-in.

``RepoSearch`` is a Python data source: ``spark.read.format("repo_search")`` with the
options ``fixture`` (a JSON-lines file that stands for the service), ``language``,
``license``, ``created_from``, ``created_to`` and ``max_kb``.  Filters are applied while
reading; one partition reads one block of the fixture's lines.
"""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SEARCH = "full_name string, language string, license string, created string, size_kb bigint, n_stars bigint, topics array<string>"


class _Block(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.size = int(options.get("block_bytes", str(8 << 20)))

    def partitions(self):
        n = os.path.getsize(self.options["fixture"])
        return [_Block(i, min(n, i + self.size)) for i in range(0, n, self.size)] or [_Block(0, 0)]

    def read(self, partition):
        o = self.options
        with open(o["fixture"], "rb") as f:
            if partition.start:
                f.seek(partition.start - 1)
                f.readline()  # the line that began before
            while f.tell() < partition.stop:
                line = f.readline()
                if not line.strip():
                    continue
                r = json.loads(line)
                created = r.get("created") or ""
                if "language" in o and r.get("language") != o["language"] or "license" in o and (r.get("license") or "").lower() != o["license"].lower():
                    continue
                if created < o.get("created_from", "") or created[:10] > o.get("created_to", "9999") or (r.get("size_kb") or 0) > int(o.get("max_kb", 1 << 60)):
                    continue
                yield (r.get("full_name"), r.get("language"), r.get("license"), r.get("created"), r.get("size_kb"), r.get("n_stars", -1), r.get("topics") or [])


class RepoSearch(DataSource):
    @classmethod
    def name(cls):
        return "repo_search"

    def schema(self):
        return SEARCH

    def reader(self, schema):
        return _Reader(dict(self.options))


_META = "repo_name string, topics array<string>, stars bigint, contributors bigint, setup_file string"


def repo_metadata(repos: DataFrame, look_up: Callable[[str], dict]) -> DataFrame:
    """``repos(repo_name)`` to topics, stars, contributors and setup file; a failed look-up keeps -1 and empty values.

    ``look_up(name)`` gives ``topics``, ``stars``, ``contributors`` and ``files``, the paths
    at the top of the repository; the last one named like a setup file counts.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name in pdf.repo_name:
                try:
                    r = look_up(name)
                    setup = [p for p in r.get("files") or [] if "setup.py" in p or "pyproject.toml" in p]
                    rows.append((name, list(r.get("topics") or []), r.get("stars", -1), r.get("contributors", -1), setup[-1] if setup else ""))
                except Exception:  # noqa: BLE001  one repository must not stop the others
                    rows.append((name, [], -1, -1, ""))
            yield pd.DataFrame(rows, columns=["repo_name", "topics", "stars", "contributors", "setup_file"])

    return repos.select("repo_name").distinct().mapInPandas(run, _META)


def setup_share(metadata: DataFrame) -> DataFrame:
    """Repositories, those with a setup file, and their share (null without repositories)."""
    with_setup = F.count_if(F.coalesce(F.length("setup_file"), F.lit(0)) > 0)
    return metadata.agg(F.count("*").alias("repos"), with_setup.alias("with_setup"), (with_setup / F.nullif(F.count("*"), F.lit(0))).alias("share"))


def copied(repos: DataFrame, folder: str, fetch: Callable[[str, str], None] | None = None) -> DataFrame:
    """``repos(repo_name)``, each fetched to ``folder/owner___name`` on a shared file system: ``(repo_name, path, status)``.

    What is there already is ``present``.  ``fetch(source, target)`` defaults to copying a
    local tree; a failure leaves nothing behind and gives its error as the status.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = fetch or shutil.copytree
        for pdf in batches:
            rows = []
            for name in pdf.repo_name:
                path = os.path.join(folder, "___".join(name.rstrip("/").split("/")[-2:]))
                status = "present"
                if not os.path.isdir(path):
                    part = f"{path}.part-{os.getpid()}"
                    try:
                        get(name, part)
                        os.rename(part, path)
                        status = "copied"
                    except Exception as e:  # noqa: BLE001  the row carries it
                        shutil.rmtree(part, True)
                        status = f"failed: {e!r}"
                rows.append((name, path, status))
            yield pd.DataFrame(rows, columns=["repo_name", "path", "status"])

    return repos.select("repo_name").distinct().mapInPandas(run, "repo_name string, path string, status string")


def file_listing(root: str) -> str:
    """An indented listing of a tree: folders with a slash, names in order, four blanks for each level."""
    out = []
    for where, folders, names in os.walk(root):
        folders.sort()
        rel = os.path.relpath(where, root)
        level = 0 if rel == "." else rel.count(os.sep) + 1
        out.append(" " * 4 * level + "- " + os.path.basename(where.rstrip(os.sep)) + "/")
        out += [" " * 4 * (level + 1) + "- " + n for n in sorted(names)]
    return "\n".join(out)
