"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Python code works on parts of an Arrow batch that hold about so many bytes of text. Spark itself
#: bounds a batch by ``spark.sql.execution.arrow.maxBytesPerBatch``.
PART_BYTES = 2 << 20


#: What a Python worker keeps from one task to the next, by name. It stays while tasks of operators that
#: use it follow each other; the first task of another one lets it go, as workers live on for them.
_KEPT: dict[str, dict] = {}
ENCODERS = "encoders"


def kept(name: str) -> dict:
    """The worker's store of that name; tasks that use it give the name as ``keeps`` when they cut their batches."""
    return _KEPT.setdefault(name, {})


def _give_back() -> None:
    """Freed memory goes back to the system, where the allocators can do that; a worker that waits holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _let_go(keeps: str | None) -> None:
    gone = [held for name, held in _KEPT.items() if held and name != keeps]
    for held in gone:
        held.clear()
    if gone:
        _give_back()


def _cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    part = (np.cumsum(sizes) - sizes) // PART_BYTES
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def small_frames(batches: Iterable[pd.DataFrame], text_col: str, keeps: str | None = None) -> Iterator[pd.DataFrame]:
    """The same rows in parts of a bounded amount of text, one row at least. ``keeps``: see ``kept``."""
    _let_go(keeps)
    for batch in batches:
        for a, b in _cuts(np.array([len(t) if isinstance(t, str) else 0 for t in batch[text_col]], np.int64)):
            yield batch.iloc[a:b].reset_index(drop=True)
    _give_back()


def small_batches(batches: Iterable[pa.RecordBatch], text_at: int, keeps: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same for record batches; ``text_at`` is the place of the text column."""
    _let_go(keeps)
    for batch in batches:
        for a, b in _cuts(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)):
            yield batch.slice(a, b - a)
    _give_back()


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may lack the setting; it gets a temporary folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="vacantia-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Bounds of an Arrow batch while a table is written. Texts can be long.
ARROW = {"spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 2000}


@contextmanager
def small_arrow(spark: SparkSession) -> Iterator[None]:
    """Smaller Arrow batches inside; the session's own settings come back afterwards."""
    before = {key: spark.conf.get(key) for key in ARROW}
    try:
        for key, most in ARROW.items():
            spark.conf.set(key, str(most))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the shared folder and read it again.

    The rows are fixed from here on, also when executors are lost, and later steps that use them
    twice compute them once.
    """
    at = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_arrow(df.sparkSession):
        df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores put before it until no column in ``taken`` clashes."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def latest(name: str, columns: Iterable[str]) -> str:
    """The name that ``fresh`` gave a column when it was added: the one with underscores in front if there are such."""
    low = {c.lower() for c in columns}
    while f"_{name}".lower() in low:
        name = f"_{name}"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
