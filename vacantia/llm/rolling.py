"""Hashes of words, shingles and fixed-length byte strings, and anchors among byte positions."""

from __future__ import annotations

import numpy as np

#: A fixed random 64-bit number for each byte value, and odd multipliers.
_BYTES = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64)
_ODD = np.random.default_rng(12).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_ODD[0])
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted and without repetitions; faster than ``np.unique`` for short arrays."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            inverse = pow(_BASE, -1, 1 << 64)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_powers = Powers()


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins (words are split at ASCII white space) and its hash."""
    blank = np.concatenate([[True], _BLANK.take(raw, mode="clip"), [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    begin, end = edges[::2], edges[1::2]
    up, down = _powers.to(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES.take(raw, mode="clip") * up[:-1], dtype=np.uint64)])
    return begin, mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def shingle_sets(texts: list[bytes], size: int, chunk: int = 1 << 21) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; shorter texts are one shingle, empty ones none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        upto, room = at, 0
        while upto < len(texts) and (upto == at or room + len(texts[upto]) < chunk):
            room += len(texts[upto]) + 1
            upto += 1
        raw = np.frombuffer(b"\n".join(texts[at:upto]), np.uint8)
        begin, words = word_hashes(raw)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[at:upto])])
        cuts = np.searchsorted(begin, starts).tolist()
        full = words[: max(0, len(words) - size + 1)] * _ODD[1]
        for k in range(1, size):
            full = full + words[k : len(words) - size + 1 + k] * _ODD[1 + k]
        full = mix(full)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= size:
                out.append(distinct(full[a : b - size + 1]))
            elif b > a:
                short = np.append(words[a:b] * _ODD[1 : 1 + b - a], _ODD[40 + b - a]).sum(keepdims=True, dtype=np.uint64)
                out.append(mix(short))
            else:
                out.append(np.zeros(0, np.uint64))
        at = upto
    return out


def string_hashes(raw: np.ndarray, length: int, kind: type = np.uint64) -> np.ndarray:
    """Hash of the ``length`` bytes from each position on (last axis), by prefix doubling: pairs of halves, then one overlapping pair.

    ``kind`` np.uint32 is several times faster and serves to order strings, not to tell them apart.
    """
    h, have, step = _BYTES.astype(kind).take(raw, mode="clip"), 1, 0
    while have < length:
        shift = min(have, length - have)
        h = h[..., : h.shape[-1] - shift] * _ODD[step].astype(kind) + h[..., shift:]
        have, step = have + shift, step + 1
    return h


def _sliding(h: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    have = 1
    while have < width:
        shift = min(have, width - have)
        h = pick(h[: len(h) - shift], h[shift:])
        have += shift
    return h


def leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` neighbours the place of the smallest, the leftmost one among equals; by doubling."""
    at, have = np.arange(len(h)), 1
    while have < width:
        shift = min(have, width - have)
        a, b = at[: len(at) - shift], at[shift:]
        at = np.where(h[b] < h[a], b, a)
        have += shift
    return at


def _anchor_runs(raw: np.ndarray, ok: np.ndarray, part: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, width = string_hashes(raw, part, np.uint32), window - part + 1
    least = _sliding(h, width, np.minimum)
    # a position is the smallest of some run of neighbours if the largest minimum around it is its own hash
    edge = np.zeros(width - 1, np.uint32)
    smallest = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), width, np.maximum) == h)
    value = np.append(h[smallest], 0)
    first = np.concatenate([[0], np.flatnonzero((least[1:] != least[:-1]) | (ok[1:] != ok[:-1])) + 1])
    last = np.concatenate([first[1:], [len(least)]]) - 1
    first, last = first[ok[first]], last[ok[first]]
    found = []
    for _ in range(40):
        k = np.searchsorted(smallest, first)
        wrong = np.flatnonzero(value[k] != least[first])
        while len(wrong):
            k[wrong] += 1
            wrong = wrong[value[k[wrong]] != least[first[wrong]]]
        at = smallest[k]
        found.append((first, np.minimum(last, at), at))
        more = at < last  # another string of equal hash follows within the run
        if not more.any():
            break
        first, last = at[more] + 1, last[more]
    else:  # periodic text
        at = leftmost_minima(h, width)
        cut = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]) | (ok[1:] != ok[:-1])) + 1])
        end = np.concatenate([cut[1:], [len(at)]]) - 1
        found = [(cut[ok[cut]], end[ok[cut]], at[cut[ok[cut]]])]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchors(texts: list[bytes], part: int, window: int, chunk: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """The anchor of a ``window``-byte string is its leftmost ``part``-byte string of smallest hash.

    Equal strings have their anchor at the same offset, since it depends on their bytes alone. Returns,
    for runs of strings that share an anchor: number of the text, first and last start, anchor position.
    """
    out = [tuple(np.zeros(0, np.int64) for _ in range(4))]
    long = [i for i, t in enumerate(texts) if len(t) >= window]
    at = 0
    while at < len(long):
        upto, room = at, 0
        while upto < len(long) and (upto == at or room + len(texts[long[upto]]) <= chunk):
            room += len(texts[long[upto]])
            upto += 1
        own = np.array(long[at:upto])
        sizes = np.array([len(texts[i]) for i in own])
        starts = np.cumsum(sizes) - sizes
        ok = np.ones(room - window + 1, bool)
        for s in starts[1:].tolist():
            ok[s - window + 1 : s] = False
        raw = np.frombuffer(b"".join([texts[i] for i in own.tolist()]), np.uint8)
        first, last, place = _anchor_runs(raw, ok, part, window)
        doc = np.searchsorted(starts, first, "right") - 1
        out.append((own[doc], first - starts[doc], last - starts[doc], place - starts[doc]))
        at = upto
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))
