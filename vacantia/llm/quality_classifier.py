"""Quality scores from compressed sizes.

Two zstandard dictionaries, one trained on good and one on bad labelled text, compress every block of
a text. The normalised difference of the two sizes, ``(bad - good) / (bad + good)``, is calibrated to
a probability by logistic regression; nothing else enters the score.

The model comes from at most ``SAMPLE`` labelled rows a class, chosen by a hash of the identifier, so
it is of bounded size on any corpus. Half of them make the dictionaries, from all blocks of their whole
texts; the other half calibrates with the sizes of their whole texts, which Spark computes, so three
numbers a row reach the driver. Held-out rows
(``crc32(doc_id) % 5 = 0``) take no part. Every row is scored on its whole text.

Null and empty texts have the difference 0 and get the calibrated score of that. If a class has no
usable labelled text, every row gets the share of good labels. A class with too little text to train
on has the text itself as its dictionary. Repeated rows and ties get equal scores; of labelled rows
with one identifier the largest text teaches. Rows without an identifier count as held out, as the
checksum of the empty string is 0. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import small_frames

SAMPLE = 1000
BLOCK = 1200
DICTIONARY = 110_000
LEVEL = 3
THRESHOLD = 0.3


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def blocks_of(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def make_dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary; the text itself where there is too little to train on."""
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY, blocks).as_bytes()
    except z.ZstdError:
        return b"".join(blocks)


class Dictionaries:
    """Compressors that hold the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.both = []
        for raw in (good, bad):
            held = z.ZstdCompressionDict(raw)
            held.precompute_compress(level=LEVEL)
            self.both.append(z.ZstdCompressor(dict_data=held, compression_params=params))

    def sizes(self, text: str | None) -> tuple[int, int]:
        """Bytes of all blocks of the text, compressed with the good and with the bad dictionary."""
        blocks = blocks_of(text)
        return tuple(sum(len(c.compress(b)) for b in blocks) for c in self.both)


def difference(good, bad) -> np.ndarray:
    good, bad = np.asarray(good, float), np.asarray(bad, float)
    return np.divide(bad - good, bad + good, out=np.zeros_like(good), where=bad + good > 0)


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 100, ridge: float = 0.01) -> np.ndarray:
    """Newton's method; a step that doesn't lower the loss is halved, so separable classes converge too."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(d: np.ndarray, weights: list[float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + weights[1] * 20 * d, -30, 30)))


def _sizes(rows: DataFrame, keep: str, model: dict) -> DataFrame:
    """The columns ``keep`` of ``rows`` with ``good`` and ``bad``, the compressed sizes of ``text``."""
    names = [c.strip() for c in keep.split(",")]
    dictionaries = model["good"], model["bad"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = Dictionaries(*dictionaries)
        for batch in small_frames(batches, "text"):
            sizes = [both.sizes(t) for t in batch["text"]]
            yield batch[names].assign(good=[g for g, _ in sizes], bad=[b for _, b in sizes])

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names, "text").mapInPandas(run, f"{kinds}, good long, bad long")


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Dictionaries and calibration from at most ``SAMPLE`` labelled rows a class, none of them held out."""
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    share = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    model = {"share": share, "good": b"", "bad": b"", "weights": None}
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    chosen = [marks.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(SAMPLE) for q in (0, 1)]
    picked = chosen[0].unionByName(chosen[1]).withColumn("make", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(8)), F.lit(2)) == 0)
    texts = docs.select("doc_id", "text").filter("text <> ''").join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy("doc_id", "quality", "make").agg(F.max("text").alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_frames(batches, "text"):
            found = [(q, i, k, b) for q, i, t in zip(batch["quality"], batch["doc_id"], batch["text"], strict=True) for k, b in enumerate(blocks_of(t))]
            yield pd.DataFrame(found, columns=["quality", "doc_id", "k", "block"])

    pieces = texts.filter("make").select("quality", "doc_id", "text").mapInPandas(cut, f"quality int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, k int, block binary")
    spread = F.xxhash64("doc_id", "k", F.lit(9))
    bodies = {q: [bytes(r["block"]) for r in pieces.filter(F.col("quality") == q).orderBy(spread, "doc_id", "k").collect()] for q in (0, 1)}
    if not bodies[0] or not bodies[1]:
        return model
    made = model | {"good": make_dictionary(bodies[1]), "bad": make_dictionary(bodies[0])}
    tell = _sizes(texts.filter("NOT make"), "quality", made).toPandas()
    if tell["quality"].nunique() < 2:
        return model
    d, y = difference(tell["good"], tell["bad"]), tell["quality"].to_numpy(float)
    w = fit_logistic(np.column_stack([np.ones_like(d), 20 * d]), y)
    # the sample holds the classes in other shares than the labels do
    ratio = {q: counts[q] / int((y == q).sum()) for q in (0, 1)}
    w[0] += np.log(ratio[1] / ratio[0])
    return made | {"weights": w.tolist()}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id`` and ``score`` for every row."""
    if not model["weights"]:
        return docs.select("doc_id", F.lit(model["share"]).alias("score"))
    weights = model["weights"]

    @F.pandas_udf("double")
    def chance(good: pd.Series, bad: pd.Series) -> pd.Series:
        return pd.Series(calibrated(difference(good, bad), weights))

    return _sizes(docs, "doc_id", model).select("doc_id", chance("good", "bad").alias("score"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
