"""A folder of many repositories as a table, by a data source of its own.

``spark.dataSource.register(Forest)`` makes ``spark.read.format("forest")`` read all repositories below a folder that every
executor sees. Folders that are skipped or hidden are left out while the folders are listed, so they are
never opened, and so are files that no rule reads. Work is dealt by subfolders of
repositories, not by repositories, so that a large one is read by many tasks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codetrellis.functions.rulebook import rules
from codetrellis.sources.corpus import read_corpus

FOREST = "repo string, snap string, path string, bytes bigint, content binary"
_ARROW = pa.schema(
    [("repo", pa.string()), ("snap", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("content", pa.binary())]
)
# bytes of files that are handed on together
_BATCH = 16 << 20


class Folders(InputPartition):
    """``units``: (repo, snap, folder below the repository, whether its subfolders are read too)."""

    def __init__(self, units: list[tuple[str, str, str, bool]]):
        super().__init__(None)
        self.units = units


class ForestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = re.sub("^file:(//)?", "", options["path"]).rstrip("/")
        self.snaps = options.get("snaps", "false").lower() == "true"
        self.snap = options.get("snap", "")
        self.tasks = int(options.get("tasks", "64"))
        self.levels = int(options.get("levels", "2"))
        limit = options.get("maxbytes", str(rules.MAX_FILE_BYTES))
        self.limit = None if limit.lower() == "none" else int(limit)
        self.skipped = set(rules.SKIPPED_DIRECTORIES)
        self.endings = tuple("." + x for found in rules.LANGUAGE_EXTENSIONS.values() for x in found)

    def _folders(self, folder: str) -> list[str]:
        """Names of the subfolders that are read, in order."""
        with os.scandir(folder) as entries:
            return sorted(e.name for e in entries if e.is_dir(follow_symlinks=False) and e.name[0] != "." and e.name not in self.skipped)

    def partitions(self) -> list[Folders]:
        """Subfolders of all repositories, some ``levels`` down, dealt into ``tasks`` groups."""
        tops = [(r, self.snap, r) for r in self._folders(self.root)]
        if self.snaps:
            tops = [(r, s, f"{r}/{s}") for r, _, _ in tops for s in self._folders(f"{self.root}/{r}")]
        units = []
        for repo, snap, top in tops:
            level = [""]
            for _ in range(self.levels):
                units += [(repo, snap, below, False) for below in level]
                level = [f"{below}{name}/" for below in level for name in self._folders(f"{self.root}/{top}/{below}")]
            units += [(repo, snap, below, True) for below in level]
        return [Folders(units[i :: self.tasks]) for i in range(min(self.tasks, len(units)))] or [Folders([])]

    def _files(self, folder: str, deep: bool) -> Iterator[tuple[str, os.DirEntry]]:
        """(path below the folder, entry) of the files that are read."""
        todo = [""]
        while todo:
            below = todo.pop()
            with os.scandir(folder + below) as entries:
                for e in sorted(entries, key=lambda e: e.name):
                    if e.name[0] == ".":
                        continue
                    if e.is_dir(follow_symlinks=False):
                        if deep and e.name not in self.skipped:
                            todo.append(f"{below}{e.name}/")
                    elif e.is_file() and e.name.lower().endswith(self.endings):
                        yield below + e.name, e

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for repo, snap, below, deep in partition.units:
            top = f"{self.root}/{repo}/{snap}/" if self.snaps else f"{self.root}/{repo}/"
            for path, entry in self._files(top + below, deep):
                size = entry.stat().st_size
                if self.limit is not None and size > self.limit:
                    continue
                with open(entry.path, "rb") as file:
                    rows.append((repo, snap, below + path, size, file.read()))
                held += size
                if held > _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class Forest(DataSource):
    """Options: ``path``; ``snaps`` (folders below a repository are its snapshots) or ``snap`` (one name for all);
    ``maxBytes`` (a number or ``none``), ``tasks``, ``levels``."""

    @classmethod
    def name(cls) -> str:
        return "forest"

    def schema(self) -> str:
        return FOREST

    def reader(self, schema) -> ForestReader:
        return ForestReader({k.lower(): v for k, v in self.options.items()})


def read_forest(spark: SparkSession, root: str, max_bytes: int | None = rules.MAX_FILE_BYTES, snaps: bool = False, snap: str = "", **options) -> DataFrame:
    """All repositories below ``root`` as a corpus table, by the rules of ``read_corpus``."""
    spark.dataSource.register(Forest)
    raw = (
        spark.read.format("forest")
        .option("maxBytes", "none" if max_bytes is None else max_bytes)
        .option("snaps", snaps)
        .option("snap", snap)
        .load(root)
    )
    return read_corpus(raw, max_bytes=max_bytes, **options)
