"""How often each 64-bit hash occurs in a corpus, as a filter for the tasks.

Tasks count their hashes and send them to hash ranges as sorted blocks of four bytes each, instead of
a row for each hash. The number of ranges follows the number of hashes, so a task adds up a bounded
part of them. What occurs often enough stays, in a table with its class. The filter holds two bits a
slot and about ``SLOTS_EACH`` slots for each hash in that table, so its size follows what it holds, up
to ``MOST_SLOTS`` (64 MB). Hashes that share a slot get the larger class: a class can be too high,
never too low, and it is the same wherever the hash occurs, so a filter that is full costs candidates,
not results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import materialize, parallelism, small_batches

SLOTS_EACH = 8
MOST_SLOTS = 1 << 28
FLUSH = 1_000_000
#: Hashes that a range should hold.
RANGE = 4_000_000
_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> _HALF) * np.uint64(parts)) >> _HALF


def _slot(low: np.ndarray, per: int) -> np.ndarray:
    """The place within a range's slice of ``per`` slots, in the order of the lower halves."""
    return (low.astype(np.uint64) * np.uint64(per)) >> _HALF


class Classes:
    """The filter: the class of each hash, 0 to 3. ``parts`` slices of ``per`` slots."""

    def __init__(self, bits: np.ndarray, parts: int, per: int):
        self.bits, self.parts, self.per = bits, parts, per

    def of(self, hashes: np.ndarray) -> np.ndarray:
        slot = _part(hashes, self.parts) * np.uint64(self.per) + _slot(hashes & _LOW, self.per)
        return (self.bits[slot >> np.uint64(2)] >> ((slot & np.uint64(3)) * np.uint64(2)).astype(np.uint8)) & 3


def _blocks(hashes: list[np.ndarray], parts: int) -> pa.RecordBatch:
    values, counts = np.unique(np.concatenate(hashes), return_counts=True)
    part = _part(values, parts).astype(np.int64)
    low, counts = (values & _LOW).astype("<u4"), np.minimum(counts, 65535).astype("<u2")  # no class needs larger counts
    begin = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
    cuts = list(zip(begin, [*begin[1:], len(values)], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[begin], pa.int32()), pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary())], ["part", "low", "n"]
    )


def classes(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bounds: tuple[int, ...], about: int, text_at: int | None = None) -> Classes:
    """The class of a hash is the number of ``bounds`` (three at most, below 65,535) that its occurrences reach.

    ``about``: roughly how many hashes there are; it only sets the number of ranges.
    """
    spark = rows.sparkSession
    parts = max(2 * parallelism(spark), ceil(about / RANGE))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches if text_at is None else small_batches(batches, text_at):
            got = hashes_of(batch)
            held.append(got)
            size += len(got)
            if size >= FLUSH:
                yield _blocks(held, parts)
                held, size = [], 0
        if size:
            yield _blocks(held, parts)

    def mark(block: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.frombuffer(b, "<u4") for b in block["low"]])
        n = np.concatenate([np.frombuffer(b, "<u2") for b in block["n"]]).astype(np.int64)
        order = np.argsort(low)
        low, n = low[order], n[order]
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        level = np.searchsorted(np.array(bounds), np.add.reduceat(n, first), "right")
        often = level > 0
        return pd.DataFrame({"part": block["part"].iloc[:1], "low": [low[first][often].tobytes()], "level": [level[often].astype(np.uint8).tobytes()], "n": [int(often.sum())]})

    sent = rows.mapInArrow(send, "part int, low binary, n binary")
    often = materialize(sent.groupBy("part").applyInPandas(mark, "part int, low binary, level binary, n long"), "often")
    total, per = often.agg(F.sum("n")).first()[0] or 0, 4
    while 2 * per * parts <= MOST_SLOTS and per * parts < SLOTS_EACH * total:
        per *= 2

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, low, level in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                slot = _slot(np.frombuffer(low.as_buffer(), "<u4"), per).astype(np.int64)
                if len(slot):
                    begin = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                    wide = np.zeros(per, np.uint8)
                    wide[slot[begin]] = np.maximum.reduceat(np.frombuffer(level.as_buffer(), np.uint8), begin)
                    four = wide.reshape(-1, 4)
                    packed = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed.tobytes()], pa.binary())], ["part", "bits"])

    bits = np.zeros(per * parts // 4, np.uint8)
    for r in often.select("part", "low", "level").mapInArrow(fill, "part int, bits binary").toLocalIterator():
        bits[r["part"] * per // 4 : (r["part"] + 1) * per // 4] = np.frombuffer(r["bits"], np.uint8)
    return Classes(bits, parts, per)


class Sent:
    """A filter as a broadcast, until it is released. Tasks take ``held`` with them and call ``opened``."""

    def __init__(self, spark: SparkSession, found: Classes):
        self.held = spark.sparkContext.broadcast((found.bits, found.parts, found.per))

    def release(self) -> None:
        self.held.destroy()


def opened(held) -> Classes:
    return Classes(*held.value)
