"""Best-two-fit packing of documents into sequences of bounded length.

Texts are encoded where they are read; from then on only one short row for each piece travels. Pieces
are dealt by row number to shards of about ``SHARD_PIECES``, and every shard packs its own bins: fill
a bin greedily with the longest piece that fits, then replace its smallest piece with two unpacked
ones that fit the expanded gap more tightly. A shard leaves at most about one bin part empty, so the
number of shards, not of documents, bounds what distribution costs.

Null texts count as empty: one piece that holds the end id alone. Every row of the input is packed,
repeated rows and rows without an identifier too. Pieces of equal length are taken in the order of
their row numbers. An empty table gives an empty result. Only the identifier and the text are read,
so other columns may have any names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import ENCODERS, materialize, small_batches

CAPACITY = 2048
SHARD_PIECES = 50_000
END = b"\x00\x00\x00\x00"

PIECES = "piece int, start long, length long, ids_crc32 long, row long"


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each text's ids and the end id; only longer ones are cut."""
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from vacantia.llm.tokens import encoder

        words = encoder(tokenizer)
        row = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, 1, ENCODERS):
            out = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), words.encode_all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = memoryview(ids + END)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), row), strict=True):
                        column.append(value)
                    row += 1
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return chosen.mapInArrow(run, T.StructType([chosen.schema["doc_id"], *T._parse_datatype_string(PIECES).fields]))


class Stock:
    """Unpacked pieces by length, with a bit set for each length that is left."""

    def __init__(self, lengths: list[int]):
        self.of: dict[int, list[int]] = {}
        for i in range(len(lengths) - 1, -1, -1):
            self.of.setdefault(lengths[i], []).append(i)
        self.left = sum(1 << n for n in self.of)

    def longest(self, room: int) -> int:
        """The longest length left that is at most ``room``; 0 if there is none."""
        return (self.left & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 and self.left & ((1 << (room + 1)) - 1) else 0

    def take(self, length: int) -> int:
        held = self.of[length]
        got = held.pop()
        if not held:
            del self.of[length]
            self.left ^= 1 << length
        return got

    def put(self, length: int, index: int) -> None:
        self.of.setdefault(length, []).append(index)
        self.left |= 1 << length

    def best_pair(self, room: int) -> tuple[int, int]:
        """Two pieces whose lengths together come closest to ``room`` without exceeding it."""
        best, a = (0, 0), self.longest(room - 1)
        while 2 * a > best[0] + best[1]:
            b = self.longest(min(a, room - a))
            if b == a and len(self.of[a]) < 2:
                b = self.longest(a - 1)
            if b and a + b > best[0] + best[1]:
                best = (a, b)
                if a + b == room:
                    break
            a = self.longest(a - 1)
        return best


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into ``lengths``."""
    stock, bins = Stock(lengths), []
    while stock.left:
        room, inside = capacity, []
        while n := stock.longest(room):
            inside.append((n, stock.take(n)))
            room -= n
        if room and len(inside) > 1:
            small, index = inside[-1]
            a, b = stock.best_pair(room + small)
            if a + b > small:
                inside[-1:] = [(a, stock.take(a)), (b, stock.take(b))]
                stock.put(small, index)
        bins.append([i for _, i in inside])
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; no sequence is longer than ``capacity``."""
    fixed = materialize(pieces, "pieces")
    shards = max(1, ceil(fixed.count() / shard_pieces))
    dealt = fixed.repartition(shards, "row").sortWithinPartitions(F.desc("length"), "row")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = pd.concat([pd.DataFrame(columns=names), *batches], ignore_index=True)
        first = TaskContext.get().partitionId() << 36
        lengths = shard["length"].astype(int).tolist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for k, inside in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in inside:
                sequence[i], offset[i] = first + k, at
                at += lengths[i]
        shard["sequence_id"], shard["offset"] = sequence, offset
        for i in range(0, len(shard), 10_000):
            yield shard.iloc[i : i + 10_000].drop(columns="row")

    names = fixed.columns
    kept = [f for f in fixed.schema.fields if f.name != "row"]
    return dealt.mapInPandas(run, T.StructType(kept).add("sequence_id", "long").add("offset", "long"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
