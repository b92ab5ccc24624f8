"""A Spark data source for change logs of JSON lines, for streams and batches.

A log is a folder of files that sort by name; the offset is the number of files
seen.  Offsets are committed by Spark after the batch, so a source never
acknowledges what a sink has not taken.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq bigint, op string, `database` string, `table` string, pk string, before map<string,string>, after map<string,string>, ts string"
_NAMES = ("seq", "op", "database", "table", "pk", "before", "after", "ts")


class LogFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def _files(folder: str) -> list[str]:
    return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith((".json", ".jsonl")))


def _rows(path: str, databases: set[str]) -> Iterator[tuple]:
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            if line.strip():
                row = json.loads(line)
                if not databases or row.get("database") in databases:
                    yield tuple(row.get(n) for n in _NAMES)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.folder, self.databases = options["path"].removeprefix("file://"), set(filter(None, options.get("databases", "").split(",")))

    def partitions(self):
        return [LogFile(f) for f in _files(self.folder)]

    def read(self, partition):
        return _rows(partition.path, self.databases)


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.databases = options["path"].removeprefix("file://"), set(filter(None, options.get("databases", "").split(",")))
        self.most = int(options.get("maxFilesPerTrigger", "0"))
        self.seen = 0

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        available = len(_files(self.folder))
        self.seen = min(available, self.seen + self.most) if self.most else available
        return {"files": self.seen}

    def partitions(self, start, end):
        self.seen = max(self.seen, end["files"])
        return [LogFile(f) for f in _files(self.folder)[start["files"] : end["files"]]]

    def read(self, partition):
        return _rows(partition.path, self.databases)

    def commit(self, end):
        pass


class ChangeLogSource(DataSource):
    """``spark.read(Stream).format("tidelog")``; option ``databases`` is a capture scope."""

    @classmethod
    def name(cls):
        return "tidelog"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
