"""Token counts that follow edits.

Each document keeps a segment tree: its text cut into segments of about ``SEGMENT`` characters that
end with white space, where no token can cross, and the sums of their token counts in a heap-shaped
array (``tree[1]`` is the total). An edit finds its place by descending a tree of the segments'
lengths, and re-encodes only the segments that it touches, with the one
that holds the character before it and the one that holds the character after it; the tree changes
along the paths of these leaves. Only where an edit changes the number of segments are the sums above
them formed anew, from the counts at hand.

Trees travel with their texts as two array columns, so edits need no join and no shuffle. Null texts
count as empty. Positions count code points and are clipped to the text; edits apply one after the
other; null or empty lists of edits change nothing. Repeated rows are counted one by one. An empty
table gives an empty result. Added columns get underscores in front where the input has their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import ENCODERS, fresh, latest, small_frames, text_or_empty

SEGMENT = 256
_CUT = re.compile(rf"(?s).{{{SEGMENT}}}[^\x20\x09-\x0D]*[\x20\x09-\x0D]*|.+")
EDITS = "array<struct<pos: long, n_delete: long, inserted: string>>"


def cut(text: str) -> list[str]:
    return _CUT.findall(text)


def tree_of(counts: list[int]) -> list[int]:
    """Leaves in the second half, sums before them; entry 0 is unused."""
    n = len(counts)
    tree = [0] * n + counts
    for i in range(n - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


def places_of(segments: list[str]) -> list[int]:
    """A tree of the segments' lengths whose leaves lie in order: their number is filled up to a power of two."""
    width = 1 << max(len(segments) - 1, 0).bit_length()
    return tree_of([len(s) for s in segments] + [0] * (width - len(segments)))


class Counted:
    """One text's segments and tree."""

    def __init__(self, segments: list[str], tree: list[int], count):
        self.segments, self.tree, self.count, self.encoded = segments, tree, count, 0
        self.places = places_of(segments)

    @property
    def total(self) -> int:
        return self.tree[1] if len(self.tree) > 1 else 0

    def find(self, pos: int) -> tuple[int, int]:
        """The first segment that ends at ``pos`` or later, and where it begins; ``pos`` is within the text."""
        i, begin, width = 1, 0, len(self.places) // 2
        while i < width:
            i *= 2
            if pos - begin > self.places[i]:
                begin += self.places[i]
                i += 1
        return i - width, begin

    def edit(self, pos: int, n_delete: int, inserted: str) -> None:
        """Replace ``n_delete`` characters from ``pos`` on."""
        n, length = len(self.segments), self.places[1]
        pos = min(max(pos, 0), length)
        stop = min(pos + max(n_delete, 0), length)
        first, begin = self.find(pos) if n else (0, 0)  # holds the character before
        last = self.find(stop + 1)[0] if stop < length else n - 1  # holds the character after
        old = "".join(self.segments[first : last + 1])
        new = cut(old[: pos - begin] + inserted + old[stop - begin :])
        self.encoded += len(new)
        counts = self.count(new)
        if len(new) == last + 1 - first:
            for i, (segment, c) in enumerate(zip(new, counts, strict=True), first):
                _raise(self.tree, n + i, c - self.tree[n + i])
                _raise(self.places, len(self.places) // 2 + i, len(segment) - len(self.segments[i]))
            self.segments[first : last + 1] = new
        else:
            leaves = self.tree[n:]
            leaves[first : last + 1] = counts
            self.segments[first : last + 1] = new
            self.tree, self.places = tree_of(leaves), places_of(self.segments)


def _raise(tree: list[int], k: int, change: int) -> None:
    """Add ``change`` to a leaf and to all sums above it."""
    while change and k:
        tree[k] += change
        k //= 2


def _counter(tokenizer: str):
    from vacantia.llm.tokens import encoder

    words = encoder(tokenizer)
    return lambda segments: [len(b) // 4 for b in words.encode_all(segments)]


def build_trees(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``segment_chars`` and ``tree``."""
    added = [fresh(c, docs.columns) for c in ("segment_chars", "tree")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(tokenizer)
        for batch in small_frames(batches, text_col, ENCODERS):
            parts = [cut(t or "") for t in batch[text_col]]
            flat = count([s for p in parts for s in p])
            sizes, trees, at = [], [], 0
            for p in parts:
                sizes.append([len(s) for s in p])
                trees.append(tree_of(flat[at : at + len(p)]))
                at += len(p)
            yield batch.assign(**dict(zip(added, (sizes, trees), strict=True)))

    kinds = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in added]
    return docs.mapInPandas(run, T.StructType(docs.schema.fields + kinds))


def apply_edits(trees: DataFrame, tokenizer: str, text_col: str = "text", edits_col: str = "edits", with_text: bool = True) -> DataFrame:
    """``trees`` with its edits applied: text, segments and tree are those after them.

    Adds ``n_tokens`` before the edits, ``n_tokens_after``, ``n_edits`` and ``n_reencoded`` segments.
    Without ``with_text`` the text, its tree and the edits go, and the number of segments before the
    edits is added as ``n_segments``. A null edit, or one without a place, changes nothing and isn't
    counted; without a number of characters to delete none goes, and a null insertion is empty.
    """
    segments_col, tree_col = (latest(c, trees.columns) for c in ("segment_chars", "tree"))
    new_names = [fresh(c, trees.columns) for c in ("n_tokens", "n_tokens_after", "n_edits", "n_reencoded", "n_segments")]
    gone = () if with_text else (text_col, segments_col, tree_col, edits_col)
    kept = [f for f in trees.schema.fields if f.name not in gone]
    names = [f.name for f in kept] + new_names[: 4 if with_text else 5]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(tokenizer)
        for batch in small_frames(batches, text_col, ENCODERS):
            out = []
            for text, sizes, tree, edits in zip(batch[text_col], batch[segments_col], batch[tree_col], batch[edits_col], strict=True):
                segments, at = [], 0
                for n in sizes:
                    segments.append(text[at : at + n])
                    at += n
                doc = Counted(segments, [int(c) for c in tree], count)
                before, done = doc.total, 0
                for e in edits if edits is not None else ():
                    if e is not None and not pd.isna(e["pos"]):
                        doc.edit(int(e["pos"]), 0 if pd.isna(e["n_delete"]) else int(e["n_delete"]), e["inserted"] or "")
                        done += 1
                out.append(("".join(doc.segments), [len(s) for s in doc.segments], doc.tree, before, doc.total, done, doc.encoded, len(sizes)))
            new = pd.DataFrame(out, columns=[text_col, segments_col, tree_col, *new_names], index=batch.index)
            yield batch.assign(**{c: new[c] for c in new})[names]

    return trees.mapInPandas(run, T.StructType(kept + [T.StructField(c, T.LongType()) for c in names[len(kept) :]]))


def revision(text: Column) -> Column:
    """The query's edits: a deletion, an insertion and a replacement at quarters of the text."""
    n = F.length(text).cast("long")

    def at(quarter: int, delete: int, inserted: str) -> Column:
        return F.struct((F.floor(n * quarter / 4)).cast("long").alias("pos"), F.lit(delete).cast("long").alias("n_delete"), F.lit(inserted).alias("inserted"))

    return F.array(at(1, 7, ""), at(2, 0, " amended in revision 2, "), at(3, 12, "x-"))


def op7_edit_aware_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text_or_empty().alias("text"))
    trees = build_trees(docs, path).withColumn("edits", revision(F.col("text")))
    return apply_edits(trees, path, with_text=False)
