"""Versioned tables on plain Parquet, committed several at once.

A commit writes every new table version into a folder of its own and then a small manifest of its own
number that names the current version of each table. The manifest appears by one rename and none is
ever removed, so readers see all tables of a commit or those of the one before.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


class StaleCommit(RuntimeError):
    """Another commit came first."""


class TableStore:
    """Tables under one root on any file system that Spark reaches. One writer at a time; stale commits fail."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str | None:
        at = self._path(path)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path, text: str) -> None:
        out = self._fs.create(path, True)
        out.write(bytearray(text.encode()))
        out.close()

    def manifest(self) -> dict:
        root = self._path(self.root)
        names = [f.getPath().getName() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        versions = [int(n.split(".")[1]) for n in names if re.fullmatch(r"manifest\.\d+\.json", n)]
        text = self._text(f"{self.root}/manifest.{max(versions)}.json") if versions else None
        return json.loads(text) if text else {"version": 0, "tables": {}, "batch": None}

    def _mark(self, batch_id: str) -> str:
        return f"{self.root}/batches/{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def has_batch(self, batch_id: str) -> bool:
        """Each committed batch has a small file; only the newest manifest's may not be written yet."""
        return self.manifest()["batch"] == batch_id or self._fs.exists(self._path(self._mark(batch_id)))

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, name: str) -> DataFrame:
        at = self.manifest()["tables"].get(name)
        if at is None:
            raise KeyError(f"no table {name}")
        return self.spark.read.parquet(f"{self.root}/{at}")

    def commit(self, frames: dict[str, DataFrame], expected: int | None = None, batch_id: str | None = None) -> int:
        """Write ``frames`` as the new versions of their tables; a batch that was committed before is a no-op.

        ``expected`` is the version that the frames were computed from.
        """
        now = self.manifest()
        if now["batch"] is not None:  # before its manifest is outdated
            self._put(self._path(self._mark(now["batch"])), now["batch"])
        if batch_id is not None and self.has_batch(batch_id):
            return now["version"]
        if expected is not None and expected != now["version"]:
            raise StaleCommit(f"expected version {expected}, found {now['version']}")
        version, own = now["version"] + 1, uuid.uuid4().hex
        places = {name: f"{name}/v={version}-{own}" for name in frames}  # no other writer's
        for name, frame in frames.items():
            frame.write.parquet(f"{self.root}/{places[name]}")
        body = json.dumps({"version": version, "tables": now["tables"] | places, "batch": batch_id})
        part, final = self._path(f"{self.root}/manifest.{version}.{own}.tmp"), self._path(f"{self.root}/manifest.{version}.json")
        self._put(part, body)
        if self._fs.exists(final) or not self._fs.rename(part, final):
            self._fs.delete(part, False)
            for place in places.values():
                self._fs.delete(self._path(f"{self.root}/{place}"), True)
            raise StaleCommit(f"version {version} was committed meanwhile")
        return version

    def purge(self, names: list[str]) -> int:
        """Delete every version of tables but the one in force, as an erasure asks for; returns how many went.

        Readers that still hold an older version lose it. Run it while no commit is under way.
        """
        gone = 0
        for name in names:
            top, kept = self._path(f"{self.root}/{name}"), self.manifest()["tables"].get(name, "").rpartition("/")[2]
            for f in self._fs.listStatus(top) if self._fs.exists(top) else []:
                if f.getPath().getName() != kept:
                    gone += bool(self._fs.delete(f.getPath(), True))
        return gone


class BlobStore:
    """Objects by key under one prefix: put, get, delete, delete and count by prefix."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, key: str):
        if not key.strip("/") or ".." in key.split("/"):
            raise ValueError("a key must name something under the root")
        return self._path(f"{self.root}/{key}")

    def put(self, key: str, body: bytes) -> None:
        out = self._fs.create(self._at(key), True)
        out.write(bytearray(body))
        out.close()

    def get(self, key: str) -> bytes:
        rows = self.spark.read.format("binaryFile").load(self._at(key).toString()).select("content").collect()
        return bytes(rows[0]["content"])

    def read(self, pattern: str) -> DataFrame:
        """Many objects as rows: path, modificationTime, length, content."""
        return self.spark.read.format("binaryFile").load(f"{self.root}/{pattern}")

    def delete(self, key: str) -> None:
        """Deleting what isn't there is no error."""
        self._fs.delete(self._at(key), False)

    def delete_prefix(self, prefix: str) -> int:
        n = self.count_prefix(prefix)
        self._fs.delete(self._at(prefix.rstrip("/")), True)
        return n

    def count_prefix(self, prefix: str) -> int:
        at = self._at(prefix.rstrip("/"))
        return self._fs.getContentSummary(at).getFileCount() if self._fs.exists(at) else 0
