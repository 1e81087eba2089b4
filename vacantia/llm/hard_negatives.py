"""Hard-negative mining: the full list of scores of each anchor, sorted by score and identifier.

Vectors become integers, floor(256 * x). Rows are dealt by hash to blocks of about ``ROW_BLOCK``,
anchors to blocks of about ``ANCHOR_BLOCK``, both packed as matrices and sorted by identifier; every
block of anchors meets every block of rows. There the scores of an anchor with the block are computed
and sorted, higher first, ties by smaller identifier. The first pass takes each block's first rows of
the anchor's label, and Spark keeps the first ``POSITIVES`` overall. The second one sorts again, finds
each positive's upper limit in the sorted scores by binary search, and reads entries of other labels
from there down to the lower limit until it has ``NEGATIVES``; Spark keeps the first ones overall. An
anchor's list is thus sorted in parts of a bounded size, and the first entries of all parts hold the
first entries of the whole list.

Rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows
without an identifier, which could be neither ordered nor named. Of rows that repeat one another in all
three columns one counts; different rows of one identifier each count, as anchors too, and are no
"other" rows for each other. Vectors of different lengths are filled with zeros; an empty one scores 0.
Components and scores beyond 64 bits stop at the largest or smallest such number. An empty table, or one without
anchors, gives an empty result. Only three columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import materialize

EVERY = 50
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least and at most so many % of the positive's.
LEAST, MOST = 50, 95
ANCHOR_BLOCK, ROW_BLOCK = 256, 4096
_LONG = np.iinfo(np.int64)
PACKED = "block int, ids binary, labels binary, wide binary, width int"


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id``, ``label`` and ``v`` (floored components) of the rows that take part, each once."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    told = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & fine
    floored = F.transform(v, lambda x: F.floor(F.lit(256.0) * x).cast("double"))
    return rows.filter(told).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), floored.alias("v")).distinct()


def pack(rows: DataFrame, blocks: int) -> DataFrame:
    """Blocks of ``id``, ``label`` and ``v`` as one row each: identifiers in order, labels, and the matrix as 16-bit integers if they hold it, else as doubles."""

    def one(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id", kind="stable")
        width = max(map(len, block["v"]))
        wide = np.zeros((len(block), width))
        for k, v in enumerate(block["v"]):
            wide[k, : len(v)] = v
        if np.abs(wide).max(initial=0) < 1 << 15:
            wide = wide.astype("<i2")
        cells = [block["id"].to_numpy("<i8").tobytes(), block["label"].to_numpy("<i8").tobytes(), wide.tobytes()]
        return pd.DataFrame([[block["block"].iloc[0], *cells, width]], columns=["block", "ids", "labels", "wide", "width"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(one, PACKED)


def matrix(cell: bytes, n: int, width: int) -> np.ndarray:
    kind = "<i2" if len(cell) == 2 * n * width else "<f8"
    return np.frombuffer(cell, kind).reshape(n, width).astype(np.float64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of two matrices of whole numbers."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if bound < 1 << 62:
        return a.astype(np.int64) @ b.T.astype(np.int64)
    a, b = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b))
    return np.clip(a @ b.T, _LONG.min, _LONG.max).astype(np.int64)


def limits(positive: int) -> tuple[int, int]:
    """Smallest and largest score of a negative of a positive's score."""
    return -(-LEAST * positive // 100), MOST * positive // 100


def _met(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int) -> DataFrame:
    """Each block of anchors with each block of rows, one row each, dealt by both.

    Both sides hold every block many times, which Spark's estimates don't see: as a broadcast either
    would grow with the square of the rows on the driver, so they are shuffled.
    """
    far = rows.select(*[F.col(c).alias(f"r_{c}") for c in rows.columns], F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("block"))
    near = anchors.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    return far.hint("merge").join(near.hint("merge"), ["block", "r_block"])


def _opened(row) -> tuple[np.ndarray, ...]:
    ids, labels, others, kinds = (np.frombuffer(x, "<i8") for x in (row.ids, row.labels, row.r_ids, row.r_labels))
    return ids, labels, others, kinds, scores(matrix(row.wide, len(ids), row.width), matrix(row.r_wide, len(others), row.r_width))


def _ranked(s: np.ndarray) -> np.ndarray:
    """Places by falling score; rows are in order of their identifiers, so a stable sort settles ties."""
    return np.argsort(~s, kind="stable")


def _positives(met: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, labels, others, kinds, found = _opened(row)
                out = []
                for k, s in enumerate(found):
                    order = _ranked(s)
                    first = order[(kinds[order] == labels[k]) & (others[order] != ids[k])][:POSITIVES]
                    out.append(pd.DataFrame({"block": row.block, "k": k, "anchor_id": ids[k], "positive_id": others[first], "positive_score": s[first]}))
                yield pd.concat(out)

    return met.mapInPandas(run, "block int, k int, anchor_id long, positive_id long, positive_score long")


def _negatives(met: DataFrame) -> DataFrame:
    """``wanted``: the positives of the block's anchors as structs of k, identifier, score and place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, labels, others, kinds, found = _opened(row)
                out, last = [], -1
                for k, place, positive_id, positive in sorted((w["k"], w["place"], w["positive_id"], w["positive_score"]) for w in row.wanted):
                    if k != last:
                        order = _ranked(found[k])
                        order = order[kinds[order] != labels[k]]
                        falling, last = ~found[k][order], k
                    low, high = limits(positive)
                    begin = np.searchsorted(falling, ~np.int64(high))
                    got = order[begin : begin + NEGATIVES]
                    got = got[found[k][got] >= low]
                    out.append(pd.DataFrame({"block": row.block, "k": k, "place": place, "anchor_id": ids[k], "positive_id": positive_id, "positive_score": positive, "negative_id": others[got], "negative_score": found[k][got]}))
                yield pd.concat(out)

    return met.mapInPandas(run, "block int, k int, place int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")


def _first(rows: DataFrame, by: list[str], score: str, then: str, most: int, rank: str) -> DataFrame:
    """The first ``most`` rows of each ``by``; Spark drops the others of a task before the shuffle."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), then))
    return rows.withColumn(rank, at).filter(F.col(rank) <= most)


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor: Column | None = None) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    ``anchor``: which rows (with ``id`` and ``label``) are anchors; by default every fiftieth identifier.
    """
    rows = materialize(usable(rows, id_col, vector_col, label_col), "vectors")
    chosen = rows.filter(F.col("id") % EVERY == 0 if anchor is None else anchor)
    n_rows, n_anchors = max(1, ceil(rows.count() / ROW_BLOCK)), max(1, ceil(chosen.count() / ANCHOR_BLOCK))
    anchors = materialize(pack(chosen, n_anchors), "anchors")
    blocks = materialize(pack(rows, n_rows), "blocks")
    positives = _first(_positives(_met(anchors, blocks, n_anchors, n_rows)), ["block", "k"], "positive_score", "positive_id", POSITIVES, "place")
    wanted = F.collect_list(F.struct("k", "place", "positive_id", "positive_score")).alias("wanted")
    asked = materialize(positives, "positives").groupBy("block").agg(wanted)
    found = _first(_negatives(_met(anchors.join(asked, "block"), blocks, n_anchors, n_rows)), ["block", "k", "place"], "negative_score", "negative_id", NEGATIVES, "rank")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH ok AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS (SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM ok),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved))
