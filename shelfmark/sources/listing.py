"""A directory listing as a Spark data source ("listing").

Unlike binaryFile it returns names that begin with "_" or ".", does not follow links, and keeps nanoseconds. Hidden
and private folders are pruned before they are entered. Options: path, recursive (true), private (names joined by
"、"), head_bytes and tail_bytes (content from both ends of files that aren't private; 0: none).
The folder has to be visible to the executors under the same path.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, parent string, is_dir boolean, is_link boolean, size bigint, mtime_ns bigint, private boolean, head binary, tail binary"


def is_private_name(name: str, needles: list[str]) -> bool:
    folded = unicodedata.normalize("NFKC", name).casefold()
    return any(unicodedata.normalize("NFKC", n).casefold() in folded for n in needles)


class _Part(InputPartition):
    def __init__(self, relative: str) -> None:
        self.relative = relative


class ListingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.recursive = str(options.get("recursive", "true")).lower() == "true"
        self.private = [x for x in str(options.get("private", "")).split("、") if x]
        self.head, self.tail = int(options.get("head_bytes", 0)), int(options.get("tail_bytes", 0))

    def partitions(self) -> list[InputPartition]:
        """The root's own entries, and one part for each folder under it that may be entered."""
        folders = [e.name for e in os.scandir(self.root) if self._enters(e)] if self.recursive else []
        return [_Part(""), *(_Part(f) for f in sorted(folders))]

    def _enters(self, entry: os.DirEntry) -> bool:
        return entry.is_dir(follow_symlinks=False) and not entry.name.startswith(".") and not is_private_name(entry.name, self.private)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        waiting = [partition.relative]
        while waiting:
            relative = waiting.pop()
            try:
                entries = sorted(os.scandir(os.path.join(self.root, relative)), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                yield self._row(e, relative)
                if partition.relative and self._enters(e):
                    waiting.append(f"{relative}/{e.name}")

    def _row(self, e: os.DirEntry, parent: str) -> tuple:
        path = f"{parent}/{e.name}" if parent else e.name
        is_dir, is_link = e.is_dir(follow_symlinks=False), e.is_symlink()
        private = any(is_private_name(p, self.private) for p in path.split("/"))
        size = mtime = head = tail = None
        try:
            stat = e.stat(follow_symlinks=False)
            size, mtime = stat.st_size, stat.st_mtime_ns
            if not (is_dir or is_link or private) and (self.head or self.tail):
                with open(os.path.join(self.root, path), "rb") as f:
                    head = f.read(self.head)
                    f.seek(max(0, size - self.tail))
                    tail = f.read(self.tail)
        except OSError:
            pass
        return path, e.name, parent, is_dir, is_link, size, mtime, private, head, tail


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Listing)
