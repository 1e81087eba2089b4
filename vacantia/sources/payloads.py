"""Landed board payloads as a data source: batch and streaming readers whose offsets are poll cursors.

A landing folder holds a folder for each source (``family:config``), and in it payload files whose names
grow (a time stamp, a number with leading zeros). A source's cursor is ``{"etag": <last name>,
"last_modified": <its time>}``; reading from a cursor gives what came after it. A cursor that can't be
read is an empty one, and so a full fetch. Any file system that Arrow knows by its address will do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from vacantia.sources.boards import MAX_BODY

SCHEMA = "source_id string, status string, polled_at timestamp, body string, cursor string, error string"
#: Payloads that one task fetches.
FILES_EACH = 64


def decode(cursor: str | None) -> dict[str, dict]:
    """Cursors by source; whatever isn't such an object is an empty one, for all sources or for one."""
    try:
        found = json.loads(cursor or "{}")
    except ValueError:
        return {}
    if not isinstance(found, dict):
        return {}
    return {k: v if isinstance(v, dict) and isinstance(v.get("etag", ""), str) else {} for k, v in found.items()}


def _files(at: str, one: str | None = None) -> dict[str, list[tuple[str, datetime]]]:
    """Names and times of the payloads of each source, in order."""
    system, root = fs.FileSystem.from_uri(at)
    out: dict[str, list[tuple[str, datetime]]] = {}
    for found in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        source, slash, name = found.path[len(root) :].strip("/").rpartition("/")
        if found.type == fs.FileType.File and slash and not name.startswith((".", "_")) and (one is None or source == one):
            out.setdefault(source, []).append((name, found.mtime or datetime.fromtimestamp(0, timezone.utc)))
    return {k: sorted(v) for k, v in sorted(out.items())}


class Part(InputPartition):
    def __init__(self, source: str, files: list[tuple[str, str]]):
        self.source, self.files = source, files


def parts(at: str, since: dict[str, dict], upto: dict[str, dict] | None = None, one: str | None = None) -> list[Part]:
    """Every source's payloads after one cursor and up to another, a bounded number to a task."""
    out = []
    for source, files in _files(at, one).items():
        first = since.get(source, {}).get("etag", "")
        last = None if upto is None else upto.get(source, {}).get("etag", "")
        wanted = [(name, when.isoformat()) for name, when in files if name > first and (last is None or name <= last)]
        out += [Part(source, wanted[k : k + FILES_EACH]) for k in range(0, len(wanted), FILES_EACH)]
    return out


def fetch(at: str, part: Part) -> Iterator[tuple]:
    """A row for each payload; one that can't be read or is too large is a failed poll."""
    system, root = fs.FileSystem.from_uri(at)
    for name, when in part.files:
        body, error = None, None
        try:
            with system.open_input_stream(f"{root}/{part.source}/{name}") as stream:
                raw = stream.read(MAX_BODY + 1)
            body, error = (raw.decode(), None) if len(raw) <= MAX_BODY else (None, "payload too large")
        except (OSError, UnicodeDecodeError) as e:
            error = f"fetch: {type(e).__name__}"
        cursor = json.dumps({"etag": name, "last_modified": when})
        yield part.source, "failed" if error else "ok", datetime.fromisoformat(when), body, cursor, error


class Once(DataSourceReader):
    def __init__(self, at: str, since: dict, one: str | None):
        self.at, self.since, self.one = at, since, one

    def partitions(self) -> list[Part]:
        return parts(self.at, self.since, one=self.one) or [Part("", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return fetch(self.at, partition)


class Ongoing(DataSourceStreamReader):
    """Offsets are the cursors of all sources, so a checkpoint says what each source has given."""

    def __init__(self, at: str, since: dict, one: str | None):
        self.at, self.since, self.one = at, since, one

    def initialOffset(self) -> dict:
        return self.since

    def latestOffset(self) -> dict:
        newest = {k: {"etag": v[-1][0], "last_modified": v[-1][1].isoformat()} for k, v in _files(self.at, self.one).items()}
        return {k: max(self.since.get(k, {}), newest.get(k, {}), key=lambda c: c.get("etag", "")) for k in {**self.since, **newest}}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts(self.at, start, end, self.one) or [Part("", [])]

    def read(self, partition: Part) -> Iterator[tuple]:
        return fetch(self.at, partition)

    def commit(self, end: dict) -> None:
        pass


class Payloads(DataSource):
    """``spark.read`` or ``spark.readStream``, format ``board_payloads``; options ``path``, ``cursor`` (JSON by source) and ``source``."""

    @classmethod
    def name(cls) -> str:
        return "board_payloads"

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, dict, str | None]:
        if not self.options.get("path"):
            raise ValueError("board_payloads needs a path")
        at = self.options["path"]
        return at if "://" in at else f"file://{at}", decode(self.options.get("cursor")), self.options.get("source")

    def reader(self, schema: StructType) -> Once:
        return Once(*self._given())

    def streamReader(self, schema: StructType) -> Ongoing:
        return Ongoing(*self._given())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Payloads)
