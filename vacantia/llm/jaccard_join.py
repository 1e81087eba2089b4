"""N-gram Jaccard join with token-combination prefixes.

The tokens of a document are the hashes of its word shingles. Of two documents that link, one's
prefix in a global order of tokens must share tokens with the other's. The order puts rare tokens
first, by frequency class; a token that occurs once heads the prefix and needs no index entry at all.
Rare tokens are indexed singly. Frequent ones are dealt by hash to groups; within a group pairs
(class 2) or triples (class 3) are indexed, and the prefix is extended until too few of its tokens
remain to avoid all combinations: with ``x`` tokens of a group whose combinations take ``k``, the
prefix has ``free + 1 + sum(min(x, k - 1))`` tokens, where ``free`` of its tokens may lack a partner.
The number of groups goes by size band, which both documents of a link share, so combinations grow
with the prefix and not with its square.

Documents with equal sets are one node throughout. An index entry carries the node's parity sketch: a
bit for each slot that holds an odd number of its tokens. Two sketches differ in at most as many bits
as their sets differ in tokens, so unlike members of an entry are told apart without reading sets, and
none that link are lost. A first round compares every member with the first earlier one that its
sketch admits; a second one takes what is left, all admitted pairs of different classes so far. Only
these are verified, on whole sets. Links are thus found as far as they connect, every class is whole,
and a group of near copies costs rows in proportion to its size. Entries with more than ``BLOCK``
members are compared block by block.

Null texts count as empty; documents without words have no shingles and no links. Repeated rows
link with each other if they have words. Rows with a null identifier take part, and a class of such
rows alone has a null component. An empty table gives an empty result. Only identifier and text are
read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import fresh, materialize, small_batches
from vacantia.llm.components import connected
from vacantia.llm.counting import Sent, classes, opened
from vacantia.llm.rolling import mix, shingle_sets

SIZE = 3
PERCENT = 90
#: Documents from which a token counts as seen again, as frequent, and as very frequent.
BOUNDS = (2, 33, 1025)
BLOCK = 2048
NO_ID = (1 << 63) - 1


def shingles(batch: pa.RecordBatch, column: int, size: int = SIZE) -> list[np.ndarray]:
    """Sets of the texts of a batch; A-Z are lower-cased, words are split at ASCII white space."""
    return shingle_sets([(t or "").encode().lower() for t in batch.column(column).to_pylist()], size)


def node_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def bands(n: int, percent: int) -> list[int]:
    """The size bands of a document: that of its size, and of the largest size that it can link with."""
    own, far = n.bit_length() - 1, (100 * n // percent).bit_length() - 1
    return [own] if own == far else [own, far]


def groups_of(band: int, percent: int) -> tuple[int, int]:
    """The number of hash groups for pairs and for triples in a band."""
    free = (2 << band) * (100 - percent) // 100
    return max(1, free // 6), max(1, free // 5)


def combines(band: int, percent: int) -> bool:
    """Whether the smallest documents of a band have enough tokens to be sure of a shared combination.

    Where they don't, at a few tokens and small percentages, the band indexes single tokens.
    """
    pairs, triples = groups_of(band, percent)
    least = -(-percent * (1 << band) // 100)
    return -(-least * percent // 100) >= 1 + pairs + 2 * triples


def can_link(n: int, percent: int) -> bool:
    """Whether a set of ``n`` can link with a different one; one more token is the least difference."""
    return n > 0 and 100 * n >= percent * (n + 1)


def sketch(tokens: np.ndarray, percent: int = PERCENT) -> bytes:
    """The parity sketch, with a bit for each token that a document of the largest band may have."""
    bits = max(64, 2 << bands(len(tokens), percent)[-1])
    odd = np.bincount(((tokens >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, the longer ones folded to the width of the shortest."""
    width = min(map(len, sketches))
    rows = [x if len(x) == width else np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width)).tobytes() for x in sketches]
    return np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1)


def admitted(words: np.ndarray, n: np.ndarray, at: int, others: slice, percent: int) -> np.ndarray:
    """Which of the others the node at ``at`` may link with: sets of sizes a and b that link differ in at most (a + b) (100 - p) / (100 + p) tokens."""
    differ = np.bitwise_count(words[others] ^ words[at]).sum(axis=1, dtype=np.int64)
    both = n[others] + n[at]
    return (np.maximum(differ, np.abs(n[others] - n[at])) * (100 + percent)) <= both * (100 - percent)


def signatures(tokens: np.ndarray, level: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Index entries of one document; ``level`` is the class of each token."""
    n = len(tokens)
    free = n - -(-n * percent // 100)
    order = np.lexsort((tokens, level))
    if not can_link(n, percent) or level[order[free]] == 0:  # equal sets only, or the whole prefix occurs here only
        return np.zeros(0, np.uint64)
    tokens, level = tokens[order], level[order]
    out = []
    for band in bands(n, percent):
        take = np.where(level == 3, 3, np.where(level == 2, 2, 1)) if combines(band, percent) else np.ones(n, np.int64)
        pairs, triples = groups_of(band, percent)
        group = np.where(take == 1, 0, np.where(take == 2, 1 + (tokens % np.uint64(pairs)).astype(np.int64), 1 + pairs + (tokens % np.uint64(triples)).astype(np.int64)))
        # tokens that may be shared without making a combination: the first k - 1 of each group
        rank = np.zeros(n, np.int64)
        by = np.argsort(group, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(group[by])) + 1])
        rank[by] = np.arange(n) - np.repeat(cut, np.diff(np.append(cut, n)))
        counted = np.cumsum(rank >= take - 1)
        length = int(np.searchsorted(counted, free + 1)) + 1
        salt = np.uint64(band + 1)
        single = tokens[:length][(take[:length] == 1) & (level[:length] > 0)]
        out.append(mix(single + salt))
        for g in np.unique(group[:length][take[:length] > 1]).tolist():
            inside = np.flatnonzero(group[:length] == g)
            k = int(take[inside[0]])
            if len(inside) >= k:
                chosen = np.array(list(combinations(np.sort(tokens[inside]).tolist(), k)), np.uint64)
                h = chosen[:, 0]
                for j in range(1, k):
                    h = mix(h) + chosen[:, j]
                out.append(mix(mix(h) + salt + np.uint64(64 * k)))
    return np.unique(np.concatenate(out))


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``node`` (null without words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            sets = shingles(batch, 1, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "n_shingles", "node"]
            )

    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"]]).add("n_shingles", "long").add("node", "binary"))


def _index(docs: DataFrame, known, size: int, percent: int) -> DataFrame:
    """``sig``, ``node``, ``n`` for every index entry of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level_of = opened(known).of
        for batch in small_batches(batches, 1):
            sig, node, n = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)]
            for tokens in shingles(batch, 1, size):
                got = signatures(tokens, level_of(tokens), percent) if len(tokens) else tokens
                if len(got):
                    sig.append(got)
                    node.extend([node_of(tokens)] * len(got))
                    n.append(np.full(len(got), len(tokens)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(node, pa.binary()), pa.array(np.concatenate(n))], ["sig", "node", "n"])

    return docs.mapInArrow(run, "sig long, node binary, n long").distinct()


def _sets(docs: DataFrame, wanted, size: int, percent: int) -> DataFrame:
    """``node``, ``tokens`` and ``sketch`` of the documents whose node the filter ``wanted`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = opened(wanted).of
        for batch in small_batches(batches, 1):
            sets = [s for s in shingles(batch, 1, size) if len(s)]
            nodes = [node_of(s) for s in sets]
            keep = has(np.array([int.from_bytes(x[:8], "big") for x in nodes], np.uint64)) > 0
            found = [(x, s) for x, s, k in zip(nodes, sets, keep.tolist(), strict=True) if k]
            columns = ([x for x, _ in found], [s.tobytes() for _, s in found], [sketch(s, percent) for _, s in found])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["node", "tokens", "sketch"])

    found = docs.mapInArrow(run, "node binary, tokens binary, sketch binary")
    return found.groupBy("node").agg(F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _blocks(index: DataFrame) -> DataFrame:
    """The index with ``p`` and ``q``: a large entry's members meet in every pair of blocks of theirs."""
    n = F.ceil(F.col("members") / BLOCK).cast("int")
    small = index.filter(F.col("members") <= BLOCK).withColumns({"p": F.lit(0), "q": F.lit(0)})
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    large = index.filter(F.col("members") > BLOCK).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    large = large.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("own", "other")
    return small.unionByName(large)


def _candidates(index: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of members that their sketches admit.

    Without a column ``root`` each member with the first admitted one before it, with it all admitted
    pairs of different roots; ``sigs``, a node's sorted entries, lets only the first entry that two
    nodes share report them.
    """
    rooted = "root" in index.columns

    def pairs(group: pd.DataFrame) -> tuple[list, list]:
        node, n, words = group["node"].tolist(), group["n"].to_numpy(), fold(group["sketch"].tolist())
        if rooted:
            root, sigs, own = group["root"].to_numpy(), group["sigs"].tolist(), group["sig"].iloc[0]
        left, right = [], []
        for y in range(1, len(node)):
            ok = admitted(words, n, y, slice(0, y), percent)
            if rooted:
                ok &= root[:y] != root[y]
                found = [x for x in np.flatnonzero(ok).tolist() if np.intersect1d(sigs[x], sigs[y], True)[0] == own]
            else:
                first = int(ok.argmax())
                found = [first] if ok[first] else []
            left.extend(node[x] for x in found)
            right.extend([node[y]] * len(found))
        return left, right

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = held[["sig", "p", "q"]].to_numpy()
            cut = (np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()  # the last group may go on
            left, right = [], []
            for i, j in zip([0, *cut[:-1]], cut, strict=False):
                got = pairs(held.iloc[i:j])
                left += got[0]
                right += got[1]
            held = held.iloc[cut[-1] :] if cut else held
            yield pd.DataFrame({"a": left, "b": right})
        if held is not None:
            left, right = pairs(held)
            yield pd.DataFrame({"a": left, "b": right})

    key = ["sig", "p", "q"]
    dealt = _blocks(index).repartition(*key).sortWithinPartitions(*key, "node")
    chosen = dealt.select(*key, "node", "n", "sketch", *(["root", "sigs"] if rooted else []))
    return chosen.mapInPandas(run, "a binary, b binary").distinct()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further ``links``: these connect whole classes, so only the roots take part in the rounds."""
    for end in ("a", "b"):
        of_end = roots.select(F.col("node").alias(end), "root")
        links = links.join(of_end, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    tops = materialize(connected(links), "roots").select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.unionByName(tops.select(F.col("root").alias("node"), "root")).distinct()
    return materialize(known.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_nodes(docs, size), "nodes")
    about = rows.agg(F.sum("n_shingles")).first()[0] or 0
    known = Sent(spark, classes(docs, lambda batch: np.concatenate([np.zeros(0, np.uint64), *shingles(batch, 1, size)]), BOUNDS, about, 1))
    index = materialize(_index(docs, known.held, size, percent), "index")
    known.release()
    return components_of(docs, rows, index, about, size, percent)


def components_of(docs: DataFrame, rows: DataFrame, index: DataFrame, about: int, size: int, percent: int) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of ``rows`` (with ``node``), whose candidates meet in an ``index`` (sig, node, n).

    ``about``: roughly how many shingles all documents have.
    """
    spark = docs.sparkSession
    # of the entries that hold the same members one is enough; near copies share most of theirs
    held = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"held_{k}") for k in (1, 2)]
    shared = index.groupBy("sig").agg(F.count(F.lit(1)).alias("members"), *held).filter("members > 1")
    shared = shared.groupBy("members", "held_1", "held_2").agg(F.min("sig").alias("sig")).select("sig", "members")
    index = materialize(index.join(shared, "sig"), "shared-index")

    def first_long(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([int.from_bytes(x[:8], "big") for x in batch.column(0).to_pylist()], np.uint64)

    wanted = Sent(spark, classes(index.select("node").distinct(), first_long, (1,), about // 100))
    sets = materialize(_sets(docs, wanted.held, size, percent), "sets")
    wanted.release()
    index = index.join(sets.select("node", "sketch"), "node")
    pairs = materialize(_candidates(index, percent), "pairs")
    links = materialize(_verified(pairs, sets, percent), "links")
    roots = materialize(connected(links), "roots")
    placed = index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("sig")
    placed = materialize(placed.join(mixed, "sig", "left_semi"), "mixed-index")
    sigs = placed.groupBy("node").agg(F.sort_array(F.collect_list("sig")).alias("sigs"))
    rest = materialize(_candidates(placed.join(sigs, "node"), percent), "pairs")
    roots = _merged(roots, materialize(_verified(rest, sets, percent), "links"))

    ids = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"))
    linked = ids.join(roots, "node")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    in_class = linked.join(least, "root").select("node", "component_id")
    of_node = ids.join(in_class, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    found = rows.join(of_node, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.nullif("component_id", F.lit(NO_ID)))
    return found.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of their class, with its columns only.

    Rows without words or without an identifier stay.
    """
    found = jaccard_components(docs, id_col, text_col, size, percent)
    gone_id = fresh("gone_id", docs.columns)
    gone = found.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(gone_id), "left_anti")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
