"""Full-text search over an inverted index of English stems, with positions and ranks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.stem import STOP_WORDS, stem
from vacantia.functions.text import tokenize
from vacantia.sources.scratch import folder

#: Folders that terms are dealt to by their hash, and tasks that write the postings of one folder.
BUCKETS, SPREAD = 32, 8
#: Fixed values of the published BM25 rank.
K1, B = 1.2, 0.75
#: Words that a task works on at a time.
_PART = 1 << 18
#: In a built index the term of one row a text, for the number of its words; no stem is empty.
WHOLE = ""


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _posted(ids: pa.Array, tokens: pa.ListArray, whole: bool) -> pa.RecordBatch:
    """Postings of some texts; each different word is stemmed once."""
    coded = tokens.flatten().dictionary_encode()
    stems: dict[str, int] = {WHOLE: 0}
    of_word = np.array([-1 if w in STOP_WORDS else stems.setdefault(stem(w), len(stems)) for w in coded.dictionary.to_pylist()], np.int64)
    n_words = np.diff(tokens.offsets.to_numpy())
    text = np.repeat(np.arange(len(ids)), n_words)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    term = of_word[coded.indices.to_numpy(zero_copy_only=False)]
    posted = np.flatnonzero(term >= 0)
    key = text[posted] * len(stems) + term[posted]
    order = np.argsort(key, kind="stable")  # places stay in order
    key, place = key[order], place[posted][order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(first, len(key))
    if whole:
        key, ends = np.append(key[first], np.arange(len(ids)) * len(stems)), np.append(ends, np.full(len(ids), len(key)))
    else:
        key = key[first]
    text, term = key // len(stems), key % len(stems)
    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
    columns = [ids.take(pa.array(text)), pa.array(list(stems), pa.string()).take(pa.array(term)), positions, pa.array(n_words[text], pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["id", "term", "positions", "n_words"])


def postings(texts: DataFrame, whole: bool = False) -> DataFrame:
    """``id``, ``term``, ``positions`` (from 0, over all words, stop words included) and ``n_words`` of each text's stems; ``texts``: id, text.

    Null and empty texts have no row. Each text gives its own rows where it is read, and with ``whole``
    one more whose term is ``WHOLE``, without positions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = batch.column(0), batch.column(1)
            part = tokens.offsets.to_numpy()[:-1] // _PART
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    yield _posted(ids[a:b], tokens[a:b], whole)

    words = texts.select("id", tokenize(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    return words.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, term string, positions array<int>, n_words int")


def _rows_of(rows: DataFrame, terms: list[str]) -> DataFrame:
    at = rows.sparkSession.range(1).select(F.array(*[_bucket(F.lit(t)) for t in terms]).alias("b")).first()["b"] if terms else []
    return rows.filter(F.col("bucket").isin(sorted(set(at))) & F.col("term").isin(terms))


class TextIndex:
    """Postings in folders by the hash of their term, sorted by term within a file.

    A search reads the folders of its terms alone, and there the row groups that hold them. The postings
    of a frequent term are written by ``SPREAD`` tasks. ``size`` has one row: texts with words, and words,
    added up from the index, so that texts are split into words once.
    """

    def __init__(self, rows: DataFrame, size: DataFrame):
        self.rows, self.size = rows, size

    @classmethod
    def build(cls, texts: DataFrame) -> TextIndex:
        at = f"{folder(texts.sparkSession)}/text-index-{uuid.uuid4().hex}"
        found = postings(texts, whole=True).withColumn("bucket", _bucket(F.col("term")))
        dealt = found.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term", "id")
        dealt.write.partitionBy("bucket").parquet(f"{at}/postings")
        rows = texts.sparkSession.read.schema(dealt.schema).parquet(f"{at}/postings")
        return cls(rows, _rows_of(rows, [WHOLE]).agg(F.count("n_words").alias("n_texts"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words")))

    def _of(self, terms: list[str]) -> DataFrame:
        return _rows_of(self.rows, terms)

    def search(self, must: list[str], may: list[str] | None = None) -> DataFrame:
        """``id``, ``hits`` (places of all terms) and ``score`` (BM25) of the texts with every word of ``must``, or with any of ``may`` if that is all there is.

        Words count by their stems; stop words don't count. Without other words nothing is found.
        """
        need = list(dict.fromkeys(stem(w) for w in map(str.lower, must) if w not in STOP_WORDS))
        terms = list(dict.fromkeys([*need, *(stem(w) for w in map(str.lower, may or []) if w not in STOP_WORDS)]))
        rows = self._of(terms).select("id", "term", F.size("positions").alias("tf"), F.col("n_words").alias("own"))
        texts_with = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row a term
        known = rows.join(F.broadcast(texts_with), "term")
        size = self.size.first()
        average = size["n_words"] / max(size["n_texts"], 1) or 1.0
        idf = F.log1p((F.lit(size["n_texts"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("own") / average))
        found = known.groupBy("id").agg(F.sum("tf").alias("hits"), F.sum(part).alias("score"), F.count_if(F.col("term").isin(need)).alias("n"))
        return found.filter(F.col("n") == len(need)).select("id", "hits", F.round("score", 6).alias("score"))

    def phrase(self, words: list[str]) -> DataFrame:
        """``id`` and ``n``: how often the stems of ``words`` follow each other in that order; a stop word stands for any word."""
        at = [(k, stem(w)) for k, w in enumerate(map(str.lower, words)) if w not in STOP_WORDS]
        terms = list(dict.fromkeys(t for _, t in at))
        rows = self._of(terms).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("p")).filter(F.size("p") == len(terms))
        if not at:
            return rows.select("id", F.lit(0).alias("n"))

        def starts(k: int, term: str) -> Column:
            return F.transform(F.element_at("p", term), lambda x: x - F.lit(k))

        return rows.select("id", F.size(reduce(F.array_intersect, [starts(k, t) for k, t in at])).alias("n")).filter("n > 0")
