"""Encoding with a public word-level tokenizer, one whitespace-free word at a time.

The tokenizer drops white space and never joins characters across it, so a text's ids are its words'
ids one after another. A worker keeps the ids of the words that it has met, up to a fixed number, until
it gets a task of an operator that doesn't encode.

New Latin words go through ``tiktoken``, which merges several times faster than ``tokenizers``: every
pre-token gets a marker byte that stands for the vocabulary's word end. All other new words go
through the tokenizer itself. ``tests/llm`` holds both against whole-text encoding.
"""

from __future__ import annotations

import json
import re

import numpy as np

from vacantia.llm.common import ENCODERS, kept

WORDS_KEPT = 800_000
#: White space for Python's ``str.split`` that is not white space here.
_OTHER = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")
#: Printable ASCII and the Latin letters and signs up to U+024F: lower-casing and NFC are simple there.
_PLAIN = re.compile("[\x21-\x7e\xa1-\u024f]+")
MARK = "\x00"


def split_words(text: str) -> list[str]:
    return [w for w in _SPLIT.split(text) if w] if _OTHER.search(text) else text.split()


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 bytes are themselves, the others follow U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordEncoder:
    """``word -> little-endian unsigned 32-bit ids`` for one tokenizer file."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        chars, end = _byte_of_char(), spec["model"]["end_of_word_suffix"]
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            body, mark = (token[: -len(end)], MARK) if token.endswith(end) else (token, "")
            if all(c in chars for c in body) and "<|" not in body:
                ranks[bytes(chars[c] for c in body) + mark.encode()] = rank
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[r for b, r in ranks.items() if b[-1:] == b"\x00"]] = True

    def _learn_plain(self, words: list[str]) -> None:
        split = list(map(self.pieces.findall, map(str.lower, words)))
        ids = np.array(self.fast.encode_ordinary("".join([MARK.join([*p, ""]) for p in split])), "<u4")
        after = np.flatnonzero(self.ends[ids]) + 1
        cuts = np.concatenate([[0], after])[np.cumsum([0, *map(len, split)])].tolist()
        flat = ids.tobytes()
        for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True):
            self.known[w] = flat[4 * a : 4 * b]

    def _learn_other(self, words: list[str]) -> None:
        for w, got in zip(words, self.tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
            self.known[w] = np.array(got.ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the words that are new."""
        new = words.difference(self.known)  # a dict itself: its keys() would be iterated
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = words
        plain = [w for w in new if _PLAIN.fullmatch(w)]
        if plain:
            self._learn_plain(plain)
        if len(plain) < len(new):
            self._learn_other(sorted(new.difference(plain)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        split = [split_words(t) for t in texts]
        self.learn(set().union(*split))
        known = self.known
        return [b"".join(map(known.__getitem__, words)) for words in split]


def encoder(path: str) -> WordEncoder:
    """One for each tokenizer file and Python worker; the task must keep ``ENCODERS``."""
    held = kept(ENCODERS)
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]
