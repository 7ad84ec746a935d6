"""A pull source with a cursor, for batch and streaming reads, over files of raw payloads.

``spark.read.format("cursor_feed")`` and ``readStream`` of it read JSON lines
with ``external_id`` and ``published_at`` from a folder, from a cursor on. The
stream's offset is the cursor, so a restart goes on where the last committed
batch ended, and a payload is read at least once.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "external_id string, published_at string, payload string"


def _rows(folder: str, after: str, until: str | None = None) -> list[tuple]:
    out = []
    for path in sorted(glob.glob(os.path.join(folder, "*.jsonl"))):
        with open(path, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    r = json.loads(line)
                    at = r.get("published_at") or ""
                    if at > after and (until is None or at <= until):
                        out.append((r.get("external_id"), at, line.strip()))
    return sorted(out, key=lambda r: (r[1], r[0] or ""))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.cursor = options["path"], options.get("cursor", "")

    def partitions(self) -> list[_File]:
        return [_File(p) for p in sorted(glob.glob(os.path.join(self.folder, "*.jsonl")))] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        import json

        if partition.path:
            with open(partition.path, encoding="utf-8") as f:
                for line in f:
                    if line.strip() and (r := json.loads(line)).get("published_at", "") > self.cursor:
                        yield r.get("external_id"), r.get("published_at"), line.strip()


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.first = options["path"], options.get("cursor", "")

    def initialOffset(self) -> dict:
        return {"cursor": self.first}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = _rows(self.folder, start["cursor"])
        return iter(rows), {"cursor": rows[-1][1] if rows else start["cursor"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(_rows(self.folder, start["cursor"], end["cursor"]))


class CursorFeed(DataSource):
    """Register with ``spark.dataSource.register(CursorFeed)``."""

    @classmethod
    def name(cls) -> str:
        return "cursor_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def enabled(sources: dict[str, tuple], environment: dict[str, str] | None = None) -> list[str]:
    """Names of sources whose needed variables are all set: {name: (variables)}."""
    env = os.environ if environment is None else environment
    return [name for name, needs in sources.items() if all(env.get(v) for v in needs)]
