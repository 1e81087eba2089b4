"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``length`` (200) bytes that covers it also starts anywhere else. Prefix
doubling ranks the string at each position by the pair of ranks of its halves, at growing offsets,
and drops positions that are unique already. Here:

* Up to half the length the pairs are formed within a text, where the text is read: 1, 2, 4, ... bytes.
  A row for each position would take sixteen times the input on disk, so only a synchronised sample
  goes on: each string is stood for by its anchor, the leftmost half-length string inside it with the
  smallest hash. Equal strings have anchors at the same offset.
* 100 bytes: Spark counts the ranks of anchors over the corpus. Unique anchors end here, and with them
  all strings that they stand for.
* 300 bytes: anchors that share all that lies up to half a length before and after them with another
  one are repeated as a whole: all their strings are. Of each kind one goes on.
* 150 bytes: every string holds the quarter length before its anchor or the one after it. Spark reranks
  each kind by these two pairs of ranks and drops the kinds for which both are unique.
* 200 bytes: the strings of the kinds that are left are ranked within the groups of equal 150 bytes.
  Groups of more than ``LARGE`` kinds are not gathered; their ranks are rows, counted by Spark.

What is removed rests on equal 128-bit hashes of the bytes. Matches don't cross texts and strings are
judged on the input. Null texts count as empty; repeated rows are repetitions of each other. An empty
table gives an empty result. Identifiers are only carried along, and other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import materialize, small_batches, text_or_empty
from vacantia.llm.counting import Sent, classes, opened
from vacantia.llm.rolling import anchors, mix, string_hashes

LENGTH = 200
LARGE = 8192
GATHER = 20_000
#: Marks of the two kinds of groups.
BEFORE, AFTER = np.uint64(0x51ED270B), np.uint64(0xB5297A4D)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t.encode() for t in batch.column(column).to_pylist()]


def _ranks(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Anchors of the texts and their rank: text number, first and last start, position, hash."""
    doc, first, last, at = anchors(texts, length // 2, length)
    h = np.array([xxhash.xxh3_64_intdigest(texts[d][a : a + length // 2]) for d, a in zip(doc.tolist(), at.tolist(), strict=True)], np.uint64)
    return doc, first, last, at, h


def _place_key(prints: list[bytes], at: np.ndarray) -> np.ndarray:
    return mix(np.array([int.from_bytes(p[:8], "big") for p in prints], np.uint64) ^ mix(at.astype(np.uint64)))


def _hashes(parts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64)


def _quarter_ranks(texts: list[bytes], doc: np.ndarray, at: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an anchor's rank with that of the quarter length before it, and with that of the one after it; a text's end cuts them short."""
    quarter, half = length // 4, length // 2
    where = list(zip(doc.tolist(), at.tolist(), strict=True))
    before = _hashes([texts[d][max(0, a - quarter) : a] for d, a in where])
    after = _hashes([texts[d][a + half : a + half + quarter] for d, a in where])
    return mix(mix(h + BEFORE) ^ before), mix(mix(h + AFTER) ^ after)


def _repeated_anchors(docs: DataFrame, known, length: int) -> DataFrame:
    """``before``, ``after`` (ranks at 150 bytes), ``context``, ``print`` and ``pos`` of the anchors whose rank occurs again."""
    reach = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = opened(known).of
        for batch in small_batches(batches, 1):
            texts, prints = _texts(batch, 1), batch.column(0).to_pylist()
            doc, _, _, at, h = _ranks(texts, length)
            keep = level_of(h) > 0
            doc, at, h = doc[keep], at[keep], h[keep]
            # the start tells contexts apart that a text's begin cuts short at different places
            context = [xxhash.xxh3_128_digest(texts[d][max(0, a - reach) : a + length], min(a, reach)) for d, a in zip(doc.tolist(), at.tolist(), strict=True)]
            before, after = _quarter_ranks(texts, doc, at, h, length)
            columns = [pa.array(x.view(np.int64)) for x in (before, after)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(context, pa.binary()), pa.array([prints[d] for d in doc.tolist()], pa.binary()), pa.array(at, pa.int64())], ["before", "after", "context", "print", "pos"])

    return docs.mapInArrow(run, "before long, after long, context binary, print binary, pos long")


def _asked(docs: DataFrame, asked, again, large, length: int) -> DataFrame:
    """For the anchors that are asked for and each of their groups that occurs again: the group, the bytes around its strings, and whether it is large.

    A text's copies in one task are read once.
    """
    quarter = length // 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, twice, is_large = opened(asked).of, opened(again).of, opened(large).of
        seen: set[bytes] = set()
        for batch in small_batches(batches, 1):
            prints = batch.column(0).to_pylist()
            texts = [b"" if p in seen else t for p, t in zip(prints, _texts(batch, 1), strict=True)]
            doc, first, last, at, h = _ranks(texts, length)
            keep = wanted(_place_key([prints[d] for d in doc.tolist()], at)) > 0
            doc, first, last, at, h = doc[keep], first[keep], last[keep], at[keep], h[keep]
            seen.update(prints[d] for d in doc.tolist())
            before, after = _quarter_ranks(texts, doc, at, h, length)
            out = []
            # strings that hold the quarter before the anchor, and the others, which hold the one after it
            for group, a, b in ((before, first, np.minimum(last, at - quarter)), (after, np.maximum(first, at - quarter + 1), last)):
                held = (b >= a) & (twice(group) > 0)
                d, g, a, b = doc[held], group[held], a[held], b[held]
                around = [texts[i][x : y + length] for i, x, y in zip(d.tolist(), a.tolist(), b.tolist(), strict=True)]
                out.append([pa.array(g.view(np.int64)), pa.array([prints[i] for i in d.tolist()], pa.binary()), pa.array(a, pa.int64()), pa.array(around, pa.binary()), pa.array(is_large(g) > 0)])
            yield from (pa.RecordBatch.from_arrays(columns, ["h", "print", "first", "around", "large"]) for columns in out)

    return docs.mapInArrow(run, "h long, print binary, first long, around binary, large boolean")


def _string_ranks(around: list[bytes], h: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For every string inside ``around``: its row, its offset there, and two 64-bit ranks within the row's group."""
    sizes = np.array([len(x) for x in around])
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(around)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    raw = np.frombuffer(b"".join(around), np.uint8)
    at = np.repeat(np.cumsum(sizes) - sizes, counts) + offset
    return row, offset, mix(mix(string_hashes(raw, length)[at]) ^ h[row]), mix(string_hashes(raw ^ np.uint8(0x5A), length)[at] + h[row])


def _in_groups(rows: DataFrame, length: int) -> DataFrame:
    """Spans of repeated strings in groups that fit a task: ``print``, ``start``, ``end``. A copy's rows, which follow each other, count once."""

    def once(block: pd.DataFrame) -> pd.DataFrame:
        key = [block[c].to_numpy() for c in ("h", "print", "first")]
        return block.iloc[np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in key])))]

    def judge(block: pd.DataFrame) -> pd.DataFrame:
        row, offset, rank, other = _string_ranks(block["around"].tolist(), block["h"].to_numpy().view(np.uint64), length)
        order = np.lexsort((other, rank))
        same = (rank[order][1:] == rank[order][:-1]) & (other[order][1:] == other[order][:-1])
        again = np.zeros(len(rank), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        row, offset = row[again], offset[again]
        if not len(row):
            return pd.DataFrame({"print": [], "start": np.zeros(0, np.int64), "end": np.zeros(0, np.int64)})
        # neighbouring strings of a row make one span
        cut = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(offset) > length)))
        end = np.append(cut[1:], len(row)) - 1
        first = block["first"].to_numpy()[row[cut]]
        return pd.DataFrame({"print": block["print"].to_numpy()[row[cut]], "start": first + offset[cut], "end": first + offset[end] + length})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= GATHER:
                block = once(pd.concat(held, ignore_index=True))
                whole = int(np.searchsorted(block["h"].to_numpy(), block["h"].iloc[-1]))  # the last group may go on
                if whole:
                    yield judge(block.iloc[:whole])
                held = [block.iloc[whole:]]
                size = len(held[0])
        if size:
            yield judge(once(pd.concat(held, ignore_index=True)))

    grouped = rows.select("h", "print", "first", "around").repartition("h").sortWithinPartitions("h", "print", "first")
    return grouped.mapInPandas(run, "print binary, start long, end long")


def _as_rows(rows: DataFrame, length: int) -> DataFrame:
    """The same for large groups, with a row for each string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                row, offset, rank, other = _string_ranks(batch["around"].tolist(), batch["h"].to_numpy().view(np.uint64), length)
                start = batch["first"].to_numpy()[row]
                yield pd.DataFrame({"rank": rank.view(np.int64), "other": other.view(np.int64), "print": batch["print"].to_numpy()[row], "first": start, "start": start + offset})

    strings = rows.select("h", "print", "first", "around").dropDuplicates(["h", "print", "first"]).mapInPandas(run, "rank long, other long, print binary, first long, start long")
    again = strings.groupBy("rank", "other").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rank", "other")
    hit = strings.join(again, ["rank", "other"]).groupBy("print", "first").agg(F.min("start").alias("start"), (F.max("start") + length).alias("end"))
    return hit.select("print", "start", "end")


def repeated_spans(docs: DataFrame, length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """``print``, ``start``, ``end`` of byte runs to remove; ``docs`` has ``print`` and ``text``. Spans may overlap."""
    spark = docs.sparkSession

    def ranks(batch: pa.RecordBatch) -> np.ndarray:
        return _ranks(_texts(batch, 1), length)[4]

    def sent(rows: DataFrame, hashes_of, bounds: tuple[int, ...], about: int, text_at: int | None = None) -> Sent:
        return Sent(spark, classes(rows, hashes_of, bounds, about, text_at))

    about = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // (length // 4)
    twice = sent(docs, ranks, (2,), about, 1)
    places = materialize(_repeated_anchors(docs, twice.held, length), "anchors")
    twice.release()
    kinds = places.groupBy("context", "before", "after").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("print", "pos")).alias("one"))
    kinds = materialize(kinds, "contexts")
    whole = places.join(kinds.filter("n > 1").select("context"), "context")
    spans = whole.select("print", F.greatest(F.lit(0), F.col("pos") - length // 2).alias("start"), (F.col("pos") + length).alias("end")).distinct()

    # ranks at 150 bytes: how many kinds have each
    pairs = kinds.select(F.explode(F.array("before", "after")).alias("h"), "one")
    groups = materialize(pairs.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "quarters")
    ask = pairs.join(groups, "h").select("one.print", "one.pos").distinct()

    def place(batch: pa.RecordBatch) -> np.ndarray:
        return _place_key(batch.column(0).to_pylist(), batch.column(1).to_numpy())

    def group(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).to_numpy().view(np.uint64)

    asked, again, hot = sent(ask, place, (1,), about // 10), sent(groups.select("h"), group, (1,), about // 10), sent(groups.filter(F.col("kinds") > large).select("h"), group, (1,), 1)
    around = materialize(_asked(docs, asked.held, again.held, hot.held, length), "around")
    for filled in (asked, again, hot):
        filled.release()
    parts = _in_groups(around.filter("not large"), length).unionByName(_as_rows(around.filter("large"), length))
    return spans.unionByName(parts)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_kept: bool = False) -> DataFrame:
    """For every row of ``docs``: bytes, removed bytes and runs, digest of the rest, and the rest itself on demand."""
    text = text_or_empty(text_col)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("print"), text.alias("text"))
    spans = repeated_spans(docs.select("print", "text"), length).distinct().groupBy("print").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = docs.join(spans, "print", "left").select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for text, starts, ends in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                raw, at, kept, removed, runs = text.encode(), 0, [], 0, 0
                open_start = open_end = -1
                for a, b in [*zip(starts or [], ends or [], strict=True), (len(raw) + 1, len(raw) + 1)]:
                    if a > open_end:
                        if open_start >= 0:
                            kept.append(raw[at:open_start])
                            removed, runs, at = removed + open_end - open_start, runs + 1, open_end
                        open_start = a
                    open_end = max(open_end, min(b, len(raw)))
                rest = b"".join([*kept, raw[at:]])
                for column, value in zip(out, (len(raw), removed, runs, hashlib.sha256(rest).hexdigest(), rest if with_kept else None), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = T.StructType([docs.schema["doc_id"]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")
    found = joined.mapInArrow(run, schema)
    return found if with_kept else found.drop("kept")


def op4_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
