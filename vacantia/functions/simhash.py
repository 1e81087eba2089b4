"""64-bit SimHash over three-word shingles with FNV-1a.

A shingle's hash needs one multiplication modulo 2**64 for each byte, which Catalyst can only fold
element by element. A pandas UDF does it for all shingles of a part of a batch at once with NumPy. Tokens
cross as one string a text, in which every shingle is a run of bytes, so no shingle becomes an object.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset basis and prime of 64-bit FNV-1a.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3


#: Characters of tokens that are worked on at once.
PART = 1 << 20


def fnv1a(words: list[bytes]) -> np.ndarray:
    sizes = np.array([len(w) for w in words], np.int64)
    return _fnv1a_runs(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)


def _fnv1a_runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash of each run of bytes of ``flat``; runs may overlap."""
    out = np.full(len(sizes), BASIS, np.uint64)
    if not len(sizes) or not sizes.max():
        return out
    order = np.argsort(-sizes, kind="stable")
    starts = starts[order]
    left = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right")  # words with so many bytes
    h = out[order]
    for i, n in enumerate(left.tolist()):
        h[:n] = (h[:n] ^ flat[starts[:n] + i]) * np.uint64(PRIME)
    out[order] = h
    return out


def signatures(grams: list[list[str]]) -> np.ndarray:
    """One signature for each list of shingles: a bit is set if more than half of the hashes have it."""
    return _votes(fnv1a([s.encode() for g in grams for s in g]), np.array([len(g) for g in grams], np.int64))


def _votes(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    out = np.zeros(len(counts), np.uint64)
    for bit in range(64):
        votes = np.concatenate([[0], np.cumsum((h >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        ones = votes[ends] - votes[ends - counts]
        out |= (2 * ones > counts).astype(np.uint64) << np.uint64(bit)
    return out


def three_grams(tokens: list[str]) -> list[str]:
    if len(tokens) < 3:
        return [" ".join(tokens)] if len(tokens) else []
    return list(map(" ".join, zip(tokens, tokens[1:], tokens[2:], strict=False)))


def joined_signatures(texts: list[str]) -> np.ndarray:
    """``signatures`` of the three-word grams of texts of ASCII tokens that single spaces join."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer("".join(texts).encode("ascii"), np.uint8)
    spaces, ends = np.flatnonzero(flat == 32), np.cumsum(sizes)
    begin = np.sort(np.concatenate([(ends - sizes)[sizes > 0], spaces + 1]))
    end = np.sort(np.concatenate([spaces, ends[sizes > 0]]))
    tokens = np.searchsorted(spaces, ends) - np.searchsorted(spaces, ends - sizes) + (sizes > 0)
    counts = np.where(tokens > 0, np.maximum(tokens - 2, 1), 0)
    first = np.arange(counts.sum()) + np.repeat((np.cumsum(tokens) - tokens) - (np.cumsum(counts) - counts), counts)
    last = np.minimum(first + 2, np.repeat(np.cumsum(tokens) - 1, counts))
    return _votes(_fnv1a_runs(flat, begin[first], end[last] - begin[first]), counts)


def _simhash(texts: pd.Series) -> pd.Series:
    texts = ["" if t is None else t for t in texts]
    part = np.cumsum([0, *map(len, texts)])[:-1] // PART
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(texts)]
    return pd.Series(np.concatenate([joined_signatures(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]).view(np.int64))


def _fnv1a(words: pd.Series) -> pd.Series:
    return pd.Series(fnv1a([w.encode() for w in words]).view(np.int64))


def simhash(tokens: Column) -> Column:
    """Signature of a text's tokens (see ``text.tokenize``), over the same shingles as ``text.shingles``."""
    return F.pandas_udf(_simhash, "long")(F.array_join(tokens, " "))


def fnv1a64(c: Column) -> Column:
    """FNV-1a of a string's UTF-8 bytes; null counts as empty."""
    return F.pandas_udf(_fnv1a, "long")(F.coalesce(c, F.lit("")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
