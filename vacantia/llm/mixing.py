"""Mixing sources to target weights by iterative proportional fitting.

One pass sums tokens for each cell of source, language and topic. The categories are those of the
given targets and ``other``, so the table of cells is as large as the targets allow, whatever the
corpus (``MOST_CELLS``, checked), and raking it to the three marginals is a small calculation on the
driver. Every cell has one chance to be kept, the product of a factor of its source, of its language
and of its topic, and 1 at most: raking fits the factors of one marginal after the other, with cells
that are kept whole taken into account, so the marginals hold although some cells are used up. Of the
wanted fraction of all tokens the largest part is drawn for which that is possible. ``Mixture`` tells
which, and the shares that are expected; where even a small part misses the targets by more than
``CLOSE``, a warning says so and the nearest mixture is drawn.

A second pass keeps each document with its cell's chance, by a hash of the identifier and the text:
the choice doesn't depend on partitions, and a lost task repeats it. Documents are not grouped or
moved.

Null or unknown categories count as ``other``. Texts without words, null ones too, have no tokens and
are never drawn. Rows with equal identifier and text share one decision. Targets of categories that
hold no tokens are spread over the others. An empty table gives an empty result. Columns of the input
may have any names; those that are added get underscores in front where they clash.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import WORD, fresh, latest, materialize, text_or_empty

OTHER = "other"
MOST_CELLS = 100_000
FRACTION = 0.6
CLOSE = 1e-4
ROUNDS = 2000
SEED = 20
AXES = ("source", "lang", "topic")

#: Target shares of tokens for the query and the pipeline.
TARGETS = {
    "source": {"src0": 0.2} | {f"src{i}": 0.04 for i in range(1, 20)} | {OTHER: 0.04},
    "lang": {"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.11, OTHER: 0.02},
    "topic": {"prose": 0.9, "note": 0.04, "symbols": 0.03, "capitals": 0.03},
}


def topic_of(text: Column, n_words: Column) -> Column:
    """A coarse kind of text, by length, capitals and symbols for each word, for tables without a topic column."""
    return (
        F.when(F.regexp_count(text, F.lit("[#*$%&|<>]")) * 2 > n_words, "symbols")
        .when(F.regexp_count(text, F.lit(r"\p{Lu}")) > 2 * n_words, "capitals")
        .when(n_words < 100, "note")
        .otherwise("prose")
    )


def _category(col: Column, targets: Mapping[str, float]) -> Column:
    return F.when(col.isin(*[k for k in targets if k != OTHER]), col).otherwise(OTHER)


def _fit(totals: np.ndarray, rest: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """For each row the factor ``s`` with ``sum(totals * min(1, s * rest)) = goal``; infinite where the row has no more."""
    order = np.argsort(-rest, axis=1, kind="stable")
    rest, totals = np.take_along_axis(rest, order, 1), np.take_along_axis(totals, order, 1)
    whole = np.cumsum(totals, axis=1) - totals  # the cells before this one are kept whole
    open_ = np.cumsum((totals * rest)[:, ::-1], axis=1)[:, ::-1]
    need = goal[:, None] - whole
    s = np.divide(need, open_, out=np.full_like(open_, np.inf), where=open_ > 0)
    fits = np.isfinite(s) & (np.where(np.isfinite(s), s, 0.0) * rest <= 1 + 1e-12)
    found = np.take_along_axis(s, fits.argmax(axis=1)[:, None], 1)[:, 0]
    return np.where(goal <= 0, 0.0, np.where(fits.any(axis=1), np.maximum(found, 0.0), np.inf))


def rake(totals: np.ndarray, goals: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> tuple[np.ndarray, float]:
    """Chances, at most 1, with which the kept tokens have the marginals ``goals`` (in tokens), and the largest deviation as a share of all kept."""
    axes, budget = range(totals.ndim), goals[0].sum()
    factors = [np.ones(n) for n in totals.shape]
    shape = [[-1 if a == k else 1 for a in axes] for k in axes]

    def chance() -> np.ndarray:
        full = np.ones(totals.shape)
        for k in axes:
            full = full * factors[k].reshape(shape[k])
        return np.minimum(full, 1.0)

    worst, checked = np.inf, np.inf
    for step in range(rounds):
        for k in axes:
            rest = np.ones(totals.shape)
            for a in axes:
                if a != k:
                    rest = rest * factors[a].reshape(shape[a])
            rows = np.moveaxis(rest, k, 0).reshape(totals.shape[k], -1)
            factors[k] = np.minimum(_fit(np.moveaxis(totals, k, 0).reshape(totals.shape[k], -1), rows, goals[k]), 1e12)
        if step % 10 == 9 or step < 10:
            worst = deviation(totals * chance(), goals) / budget
            if worst < close:
                break
        if step % 100 == 99:
            if worst > 0.98 * checked:  # it has stopped coming closer
                break
            checked = worst
    return chance(), worst


def marginals(tokens: np.ndarray) -> list[np.ndarray]:
    axes = range(tokens.ndim)
    return [tokens.sum(axis=tuple(a for a in axes if a != k)) for k in axes]


def deviation(tokens: np.ndarray, goals: list[np.ndarray]) -> float:
    return max(float(np.abs(now - goal).max()) for now, goal in zip(marginals(tokens), goals, strict=True))


@dataclass
class Mixture:
    """Chances of cells, the fraction of all tokens that they are expected to keep, expected shares, and the largest deviation from the targets."""

    chances: list[tuple] = field(default_factory=list)
    fraction: float = 0.0
    achieved: dict[str, dict[str, float]] = field(default_factory=dict)
    deviation: float = 0.0


def calibrate(cells: Iterable[tuple], targets: Mapping[str, Mapping[str, float]], fraction: float) -> Mixture:
    """The mixture for ``cells``: source, language, topic and tokens."""
    names = [list(targets[d]) + ([] if OTHER in targets[d] else [OTHER]) for d in AXES]
    totals = np.zeros([len(n) for n in names])
    for *at, tokens in cells:
        totals[tuple(n.index(c) for n, c in zip(names, at, strict=True))] = tokens
    if totals.sum() == 0:
        return Mixture()
    shares = []
    for axis, n, has in zip(AXES, names, marginals(totals), strict=True):
        goal = np.where(has > 0, [targets[axis].get(c, 0.0) for c in n], 0.0)
        shares.append(goal / goal.sum() if goal.sum() > 0 else has / has.sum())

    def tried(f: float) -> tuple[np.ndarray, float]:
        return rake(totals, [g * f * totals.sum() for g in shares])

    most = min(float(np.min(has[g > 0] / g[g > 0])) / totals.sum() for has, g in zip(marginals(totals), shares, strict=True))
    high = min(fraction, most)
    best, low = (high, *tried(high)), 0.0
    if best[2] >= CLOSE:
        for _ in range(12):
            mid = (low + high) / 2
            got = (mid, *tried(mid))
            if got[2] < CLOSE:
                low = mid
                best = got
            else:
                high = mid
                best = min(best, got, key=lambda x: x[2])
    f, chance, off = best
    kept = totals * chance
    achieved = {axis: dict(zip(n, (m / kept.sum()).tolist(), strict=True)) for axis, n, m in zip(AXES, names, marginals(kept), strict=True)}
    if off >= CLOSE:
        warnings.warn(f"the targets can't be met with these documents: the nearest mixture is off by {off:.4f} of its tokens", stacklevel=2)
    chances = [(*(n[i] for n, i in zip(names, at, strict=True)), float(chance[at])) for at in np.ndindex(totals.shape) if totals[at] > 0]
    return Mixture(chances, float(kept.sum() / totals.sum()), achieved, off)


MIX = ("mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_u")


def described(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """``docs`` with ``mix_source``, ``mix_lang``, ``mix_topic``, ``mix_tokens`` and ``mix_u`` in [0, 1)."""
    source, lang, topic, words, u = (fresh(c, docs.columns) for c in MIX)
    text = text_or_empty(text_col)
    counted = docs.withColumn(words, F.regexp_count(text, F.lit(WORD)))
    of_topic = F.col(topic_col) if topic_col else topic_of(text, F.col(words))
    return counted.withColumns(
        {
            source: _category(F.col(source_col), targets["source"]),
            lang: _category(F.col(lang_col), targets["lang"]),
            topic: _category(of_topic, targets["topic"]),
            u: F.pmod(F.xxhash64(F.col(id_col), text, F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40),
        }
    )


def mixture(known: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, fraction: float = FRACTION) -> Mixture:
    """The mixture for the rows of ``known`` (see ``described``)."""
    size = np.prod([len(targets[d]) + 1 for d in AXES])
    if size > MOST_CELLS:
        raise ValueError(f"the targets make {size} cells; {MOST_CELLS} at most")
    *key, words, _ = (latest(c, known.columns) for c in MIX)
    cells = known.groupBy(*key).agg(F.sum(words).alias("tokens")).collect()
    return calibrate([tuple(r) for r in cells], targets, fraction)


def draw(known: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, fraction: float = FRACTION) -> DataFrame:
    """The rows of ``known`` (see ``described``) that are drawn, with their ``weight``, the chance to be drawn."""
    *key, words, u = (latest(c, known.columns) for c in MIX)
    weight = fresh("weight", known.columns)
    chances = mixture(known, targets, fraction).chances
    table = known.sparkSession.createDataFrame(chances, ", ".join(f"`{k}` string" for k in key) + f", `{weight}` double")
    return known.join(F.broadcast(table), key).filter((F.col(words) > 0) & (F.col(u) < F.col(weight)))


def keep_mixed(docs: DataFrame, targets=TARGETS, fraction: float = FRACTION) -> DataFrame:
    """The rows of ``docs`` that are drawn, with its columns only."""
    return draw(described(docs, targets), targets, fraction).select(*docs.columns)


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    known = materialize(described(docs).drop("text"), "mix")
    return draw(known).select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").cast("long").alias("n_tokens"), "weight")
