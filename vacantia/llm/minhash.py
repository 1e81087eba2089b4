"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

One hash of each shingle serves for all signature places: the range of hashes is cut into ``BANDS *
ROWS`` bins, and a bin's value is its smallest shingle. An empty bin borrows the value of the bin that
its own random sequence of bins, the same for all documents, reaches first among the filled ones
(optimal densification), so two sets agree in a place with a chance of about their similarity, small
sets too. ``ROWS`` places make a band, and equal bands put documents into one bucket.

Documents with equal sets are one node. Within a bucket each member is held against the first earlier
one that its parity sketch admits, so a bucket gives a star and at most one pair a member; what these
stars leave in different classes is then compared across classes only. Every pair is verified on whole
sets. At the threshold of 85 % a pair shares no bucket with a chance of (1 - 0.85**4)**20, some
4 in 10 million, at 90 % less than 1 in 10**9.

Null texts count as empty; documents without words have no shingles and no links and are kept. Repeated
rows link with each other if they have words, and all rows of the smallest identifier are kept. Rows
with a null identifier take part; they are kept only if their class (or, without words, the row) has no
identifier. An empty table gives an empty result. Only identifier and text are read, so other columns
may have any names. A text is worked on as a whole: a task holds some 40 bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import materialize, small_batches
from vacantia.llm.jaccard_join import can_link, components_of, node_of, shingles
from vacantia.llm.rolling import mix

SIZE = 3
PERCENT = 85
BANDS, ROWS = 20, 4
_PLACES = BANDS * ROWS
#: The first hash of each bin.
_EDGES = np.array([(k << 64) // _PLACES for k in range(_PLACES)], np.uint64)
_LAST = np.uint64((1 << 64) - 1)


def probes(attempt: int) -> np.ndarray:
    """The bin that each bin asks at an attempt: a fixed random function of bin and attempt."""
    key = np.arange(_PLACES, dtype=np.uint64) + np.uint64(attempt * _PLACES + 1)
    return (mix(key * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(_PLACES)).astype(np.int64)


def places(sets: list[np.ndarray]) -> np.ndarray:
    """The densified signature of each set (sorted, not empty), a row each."""
    out = np.zeros((len(sets), _PLACES), np.uint64)
    filled = np.zeros((len(sets), _PLACES), bool)
    for k, tokens in enumerate(sets):
        first = np.searchsorted(tokens, _EDGES)
        end = np.append(first[1:], len(tokens))
        filled[k] = first < end
        out[k, filled[k]] = tokens[first[filled[k]]]
    row, col = np.nonzero(~filled)
    attempt = 0
    while len(row):
        asked = probes(attempt)[col]
        found = filled[row, asked]
        out[row[found], col[found]] = out[row[found], asked[found]]
        row, col = row[~found], col[~found]
        attempt += 1
    return out


def buckets(sets: list[np.ndarray]) -> np.ndarray:
    """A hash for each band of each set."""
    bands = places(sets).reshape(len(sets), BANDS, ROWS)
    h = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), bands.shape[:2])
    for k in range(ROWS):
        h = mix(h + bands[:, :, k])
    return h


def _signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``node`` and ``sigs``, the buckets (none for sets that link with no other set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            sets = shingles(batch, 1, size)
            wide = [k for k, s in enumerate(sets) if can_link(len(s), percent)]
            sizes = np.zeros(len(sets), np.int64)
            sizes[wide] = BANDS
            values = buckets([sets[k] for k in wide]).reshape(-1).view(np.int64)
            sigs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))
            node = pa.array([node_of(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), node, sigs], ["doc_id", "n_shingles", "node", "sigs"])

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"]]).add("n_shingles", "long").add("node", "binary").add("sigs", T.ArrayType(T.LongType())))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_signed(docs, size, percent), "signed")
    nodes = rows.filter(F.size("sigs") > 0).groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("sigs").alias("sigs"))
    index = materialize(nodes.select(F.explode("sigs").alias("sig"), "node", "n").distinct(), "buckets")
    about = rows.agg(F.sum("n_shingles")).first()[0] or 0
    found = components_of(docs, rows.drop("sigs"), index, about, size, percent)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
