"""Nearest vectors and keyword search; the reference keeps only indexes for these."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.text import tokenize
from vacantia.sources.scratch import cut


def cosine(vector: Column, query: list[float]) -> Column:
    """Cosine similarity in double precision; 0 for a zero vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x)) * float(sum(x * x for x in query)) ** 0.5
    return F.when(size == 0, 0.0).otherwise(dot / size)


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The ``k`` vectors nearest to one query, ties by id; a top-k of each partition is all that is shuffled."""
    near = cosine(F.col("embedding"), query)
    return vectors.select("vec_id", near.alias("near")).orderBy(F.desc("near"), "vec_id").limit(k).select("vec_id", F.round("near", 6).alias("similarity"))


#: Queries, and vectors, that meet in one task.
QUERY_BLOCK, VECTOR_BLOCK = 256, 4096
#: Rows that centroids are fitted on at most, whatever the table's size, and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 12


def _unit(rows: list) -> np.ndarray:
    """Vectors of length one as rows; zero vectors stay."""
    v = np.array(rows, float)
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _best_in_lists(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of every query among the vectors of its ``list``s, itself left out.

    Lists are cut into blocks of vectors and blocks of queries, and every two blocks of a list meet in
    one task, which keeps the best ``k`` of each query; so neither a long list nor one that many queries
    ask is more than a block to anyone.
    """
    n = vectors.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).cast("int").alias("n"))
    m = queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("m"))
    blocks = n.join(m, "list")

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return rows.join(blocks, "list").withColumn(own, F.pmod(F.xxhash64(key), F.col("n" if own == "vb" else "m")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("m" if own == "vb" else "n") - 1))).drop("n", "m")

    def best(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "near": []}).astype({"query_id": "int64", "vec_id": "int64"})
        v = v.sort_values("vec_id")
        ids, near = v["vec_id"].to_numpy(), _unit(q["asked"].tolist()) @ _unit(v["embedding"].tolist()).T
        near[q["query_id"].to_numpy()[:, None] == ids[None, :]] = -np.inf
        at = np.argsort(-near, axis=1, kind="stable")[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), at.shape[1]), "vec_id": ids[at].ravel(), "near": np.take_along_axis(near, at, 1).ravel()})
        return out[np.isfinite(out["near"])]

    key = ["list", "vb", "qb"]
    left = dealt(vectors.select("list", "vec_id", "embedding"), "vec_id", "vb", "qb").groupBy(*key)
    asked = queries.select("list", "query_id", F.col("embedding").alias("asked"))
    right = dealt(asked, "query_id", "qb", "vb").select(*key, "query_id", "asked").toDF(*key, "query_id", "asked").groupBy(*key)
    found = left.cogroup(right).applyInPandas(best, "query_id long, vec_id long, near double")
    w = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("query_id", "vec_id", F.round("near", 6).alias("similarity"))


def _usable(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias(name), "embedding")


def nearest_to_each(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``vec_id`` and ``similarity`` of the ``k`` vectors nearest to each row of ``queries``, itself left out; exact, ties by id."""
    one = F.lit(0).alias("list")
    return _best_in_lists(_usable(vectors, "vec_id").select("*", one), _usable(queries, "query_id").select("*", one), k)


class VectorIndex:
    """An inverted file: every vector in the list of its nearest centroid; a search reads a few lists.

    Centroids are fitted by spherical k-means on ``SAMPLE`` rows at most, those of smallest hash, so a
    rebuilt index is the same. There is a bounded number of them, which goes to the tasks as it is.
    """

    def __init__(self, centroids: np.ndarray, lists: DataFrame):
        self.centroids, self.lists = centroids, lists

    @classmethod
    def build(cls, vectors: DataFrame, n_lists: int, sample: int = SAMPLE) -> VectorIndex:
        rows = _usable(vectors, "vec_id")
        some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        centroids = _centroids(_unit([r["embedding"] for r in some]), n_lists) if some else np.zeros((1, 1))
        return cls(centroids, cut(_assigned(rows, centroids, 1), "lists"))

    def nearest_to_each(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """As the exact search, among the vectors of each query's ``probes`` nearest lists; with as many as there are lists it is exact."""
        asked = _assigned(_usable(queries, "query_id"), self.centroids, min(probes, len(self.centroids)))
        return _best_in_lists(self.lists, cut(asked, "asked"), k)


def _centroids(unit: np.ndarray, n: int) -> np.ndarray:
    """Each new first centroid is the sample farthest from those before; then rounds of means."""
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    now = unit[chosen]
    for _ in range(ROUNDS):
        own = (unit @ now.T).argmax(axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, own, unit)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        now = np.where(size > 0, np.divide(sums, size, out=np.zeros_like(sums), where=size > 0), now)
    return now


def _assigned(rows: DataFrame, centroids: np.ndarray, most: int) -> DataFrame:
    """``rows`` once for each of their ``most`` nearest centroids, with ``list``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = np.argsort(-(_unit(batch["embedding"].tolist()) @ centroids.T), axis=1, kind="stable")[:, :most]
                out = batch.loc[batch.index.repeat(at.shape[1])].assign(list=at.ravel())
                yield out

    return rows.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", list int")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of the exact neighbours that were found."""
    hit = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "vec_id"], "left").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def keywords(texts: DataFrame, must: list[str], may: list[str] | None = None) -> DataFrame:
    """Texts with all of ``must``, and how many of both lists they hold."""
    found = texts.withColumn("tokens", F.array_distinct(tokenize(F.col("text"))))
    for w in must:
        found = found.filter(F.array_contains("tokens", w))
    hits = sum((F.array_contains("tokens", w).cast("int") for w in [*must, *(may or [])]), F.lit(0))
    return found.withColumn("hits", hits).drop("tokens")
