"""Spelling variants: words that differ by one code point, found through Aho-Corasick halves.

A word is cut into two segments at half its length. Of two words one edit apart, the edit lies in one
half of either, so the other half stands whole in the other word: the first at its beginning, the
second at its end. Every word's two segments go into automata, and every word is scanned by the
automata that can hold a segment of it: a segment has three code points at least, so words meet by
their first three (first segments) and by their last three (second ones), dealt by hash to shards. A
shard with more than ``SHARD`` words is cut into blocks, and each block of segments meets each block of
scanned words, so a task holds two blocks at most, whatever letters are common. A hit counts if its
offset fits (first segments at 0, second ones at the end) and the lengths differ by one at most; what is
left is told apart by the letters' parities, and then the whole words are compared. A pair found through
both halves counts once.

Automata yield for each scanned word the number of near words and the best of them, not pairs. Null
texts have no words; documents with a null identifier take part with an empty identifier in the hash.
Repeated rows count as often as they occur. An empty table gives an empty result. Only identifier and
text are read, so other columns may have any names. Runs are cut in the JVM, one text at a time.
"""

from __future__ import annotations

from math import ceil

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import materialize, text_or_empty

LETTER = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word's form occurs at least so many times as often.
TIMES = 10
#: Of 31 occurrences about one loses a code point.
EVERY = 31
#: Words of a shard, and of a block of one.
SHARD = 16384
#: Pairs that are looked at, and bytes that are compared, at a time.
PAIRS, BYTES = 1 << 20, 1 << 25
_KEY = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def dropped(run: Column, doc_id: Column) -> Column:
    """The run, without one code point where the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    n = F.char_length(run)
    at = (h % n).cast("int")
    return F.when(h % EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, n))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``. Shorter runs can't become words, so the pattern passes over them."""
    runs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(text_or_empty(text_col), F.lit(f"{LETTER}{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run"))
    words = runs.select(dropped(low, F.col("doc_id")).alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def _hits(words: list[str], patterns: np.ndarray, scanned: np.ndarray, side: int) -> tuple[np.ndarray, ...]:
    """Scanned word, and first and last place of the words in ``order`` that share the segment, for every hit of a fitting offset; ``order``."""
    by: dict[str, list[int]] = {}
    for k in patterns.tolist():
        by.setdefault(_halves(words[k])[side], []).append(k)
    automaton, begin, order = ahocorasick.Automaton(), 0, []
    for segment, held in by.items():
        automaton.add_word(segment, (len(segment), begin, begin + len(held)))
        order += held
        begin += len(held)
    found: list[tuple[int, int, int]] = []
    if order:
        automaton.make_automaton()
        for k in scanned.tolist():
            word = words[k]
            last = len(word) - 1
            found += [(k, a, b) for end, (size, a, b) in automaton.iter(word) if (end == last if side else end == size - 1)]
    hits = np.array(found, np.int64).reshape(-1, 3)
    return hits[:, 0], hits[:, 1], hits[:, 2], np.array(order, np.int64)


def _parities(words: list[str]) -> np.ndarray:
    """A bit for each letter (by its lower six bits) that occurs an odd number of times. One edit changes two at most."""
    sizes = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    bits = np.left_shift(np.uint64(1), (raw & 63).astype(np.uint64))
    return np.bitwise_xor.reduceat(bits, np.cumsum(sizes) - sizes) if len(words) else bits


def _one_edit(words: list[str], left: np.ndarray, right: np.ndarray, side: int) -> np.ndarray:
    """Which pairs differ by one edit. Second halves (``side`` 1) leave out pairs whose ``left``, the pattern, has its first half in place too."""
    width = max(len(words[k]) for k in np.unique(np.concatenate([left, right])).tolist())
    ok = []
    for at in range(0, len(left), max(1, BYTES // width)):
        a, b = left[at : at + max(1, BYTES // width)], right[at : at + max(1, BYTES // width)]
        kept, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        chosen = [words[k].encode("latin-1") for k in kept.tolist()]
        size = np.array([len(w) for w in chosen])
        first = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in chosen), np.uint8).reshape(-1, width)
        last = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in chosen), np.uint8).reshape(-1, width)
        x, y = place[: len(a)], place[len(a) :]
        differ = np.ones((len(a), width + 1), bool)
        differ[:, :width] = first[x] != first[y]
        prefix = differ.argmax(axis=1)
        differ[:, :width] = last[x] != last[y]
        suffix = differ.argmax(axis=1)
        near = (a != b) & (prefix + suffix >= np.maximum(size[x], size[y]) - 1)
        ok.append(near & (prefix < size[x] // 2) if side else near)
    return np.concatenate(ok)


def near_words(words: list[str], n: np.ndarray, patterns: np.ndarray, scanned: np.ndarray, side: int) -> pd.DataFrame:
    """For scanned words with near ones among the patterns: their number and the most frequent, smallest one of them."""
    who, begin, end, order = _hits(words, patterns, scanned, side)
    sizes, odd = np.array([len(w) for w in words], np.int64), _parities(words)
    found = [np.zeros((2, 0), np.int64)]
    total = np.cumsum(end - begin)
    at = 0
    while at < len(who):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        each = end[at:upto] - begin[at:upto]
        right = np.repeat(who[at:upto], each)
        left = order[np.arange(len(right)) + np.repeat(begin[at:upto] - (np.cumsum(each) - each), each)]
        fit = (np.abs(sizes[left] - sizes[right]) <= 1) & (np.bitwise_count(odd[left] ^ odd[right]) <= 2) & (left != right)
        left, right = left[fit], right[fit]
        if len(left):
            ok = _one_edit(words, left, right, side)
            found.append(np.stack([left[ok], right[ok]]))
        at = upto
    left, right = np.concatenate(found, axis=1)
    rank = np.argsort(np.argsort(np.array(words, object), kind="stable"), kind="stable") if len(left) else left
    by = np.lexsort((rank[left], -n[left], right))
    left, right = left[by], right[by]
    first = np.flatnonzero(np.append(True, right[1:] != right[:-1])[: len(right)])
    best = left[first]
    texts = [pd.Series([words[k] for k in at.tolist()], dtype=object) for at in (right[first], best)]
    return pd.DataFrame({"word": texts[0], "n_near": np.diff(np.append(first, len(right))), "best_n": n[best], "best": texts[1]})


def _sharded(words: DataFrame, total: int) -> DataFrame:
    """The words of every side, shard and pair of blocks, and whether they are pattern, scanned, or both there."""
    shards = max(1, ceil(total / SHARD * 2))
    ends = F.array(F.substring("word", 1, _KEY), F.substring("word", -_KEY, _KEY))
    each = words.select("word", "n", F.posexplode(ends).alias("side", "key"))
    each = each.select("word", "n", "side", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
    blocks = each.groupBy("side", "shard").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("blocks"))
    each = each.join(blocks, ["side", "shard"]).withColumn("own", F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int"))
    as_pattern = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("own").alias("p"), k.alias("q")))
    as_scanned = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.alias("p"), F.col("own").alias("q")))
    met = each.withColumn("met", F.explode(F.array_union(as_pattern, as_scanned)))
    return met.select("word", "n", "side", "shard", "own", F.col("met.p").alias("p"), F.col("met.q").alias("q"))


def near_counts(words: DataFrame, total: int) -> DataFrame:
    """``word``, ``n_near``, ``best_n`` and ``best`` of the words (word, n) that have near ones."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, p, q = group["own"].to_numpy(), group["p"].iloc[0], group["q"].iloc[0]
        return near_words(group["word"].tolist(), group["n"].to_numpy(), np.flatnonzero(own == p), np.flatnonzero(own == q), int(group["side"].iloc[0]))

    found = _sharded(words, total).groupBy("side", "shard", "p", "q").applyInPandas(run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


#: A form has ten times its word's count, so 64-bit counts allow fewer steps than two to this power.
DOUBLINGS = 5


def rooted(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of ``forms`` (word, form): the end of each chain, by pointer doubling until nothing changes."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(DOUBLINGS):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            break
        now = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "forms")
    return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of ``docs``."""
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    found = words.join(near_counts(words, words.count()), "word", "left")
    formed = F.col("best_n") >= F.col("n") * TIMES
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "variants")
    roots = rooted(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
