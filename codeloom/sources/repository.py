"""A checkout as a DataFrame of files, by way of a Python data source.

The driver walks the tree once, leaves excluded and ignored directories out before it descends, and deals the paths
over partitions; executors read the bytes. (Spark's own ``binaryFile`` hides names that start with ``_`` or ``.``.) The
checkout must be at the same path on every executor, as on any shared file system.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.functions.identity import EXCLUDED_DIR_SUFFIX, EXCLUDED_DIRS, EXCLUDED_SUFFIXES, LANGUAGES
from codeloom.sources.gitignore import Rules

FORMAT = "repository"
SCHEMA = "repo_name string, path string, language string, size_bytes bigint, content binary, error string"
FILES_PER_PARTITION = 200


def language(path: str) -> str | None:
    return LANGUAGES.get(os.path.splitext(path)[1].lower())


def excluded(path: str) -> bool:
    """Whether a path lies in an excluded directory or has an excluded suffix."""
    *folders, name = path.split("/")
    return name.endswith(EXCLUDED_SUFFIXES) or any(f in EXCLUDED_DIRS or f.endswith(EXCLUDED_DIR_SUFFIX) for f in folders)


def walk(root: str | Path, rules: Rules | None = None) -> list[str]:
    """Sorted paths, relative to root, of all files in a known language that nothing excludes."""
    root, found = str(root), []
    for folder, dirs, names in os.walk(root):
        base = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if base == "." else base + "/"
        dirs[:] = sorted(d for d in dirs if d not in EXCLUDED_DIRS and not d.endswith(EXCLUDED_DIR_SUFFIX) and not (rules and rules.ignores(prefix + d, True)))
        found += [prefix + n for n in names if language(n) and not n.endswith(EXCLUDED_SUFFIXES) and not (rules and rules.ignores(prefix + n))]
    return sorted(found)


def indexable(paths: list[str], rules: Rules | None, root: str | Path | None = None) -> list[str]:
    """Those of changed paths that an index would hold; with a root only files that are there."""
    return [p for p in paths if language(p) and not excluded(p) and not (rules and rules.ignores(p)) and (root is None or (Path(root) / p).is_file())]


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.repo = options["root"], options.get("repo", "repo")
        self.per_partition = int(options.get("filesperpartition", FILES_PER_PARTITION))
        self.use_gitignore = options.get("gitignore", "true").lower() == "true"
        self.only = options.get("paths")

    def partitions(self) -> list[_Files]:
        rules = Rules.load(self.root) if self.use_gitignore else None
        paths = walk(self.root, rules) if self.only is None else [p for p in self.only.split("\n") if p]
        return [_Files(tuple(paths[i : i + self.per_partition])) for i in range(0, len(paths), self.per_partition)] or [_Files(())]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                data = (Path(self.root) / path).read_bytes()
            except OSError as e:
                yield self.repo, path, language(path), None, None, f"{type(e).__name__}: {e}"
            else:
                yield self.repo, path, language(path), len(data), data, None


class RepositorySource(DataSource):
    """Options: root, repo, gitignore (true), filesPerPartition, paths (new-line separated, instead of a walk)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_repository(spark: SparkSession, root: str | Path, repo: str, gitignore: bool = True, paths: list[str] | None = None) -> DataFrame:
    """The files of a checkout, or those of the given paths."""
    spark.dataSource.register(RepositorySource)
    reader = spark.read.format(FORMAT).option("root", str(root)).option("repo", repo).option("gitignore", str(gitignore).lower())
    if paths is not None:
        reader = reader.option("paths", "\n".join(paths))
    return reader.load()
