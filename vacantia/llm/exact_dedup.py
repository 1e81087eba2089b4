r"""Exact deduplication by content sort.

Sampled splitters (``repartitionByRange``) deal the rows out by the normalised text. A splitter holds
a bounded part of it, its first ``PREFIX_CHARS`` characters and a 64-bit hash, and then what decides
which row stays: length and identifier. So splitters are small whatever the texts, and a group with a
third of all rows spreads over many partitions. Spark sorts each partition externally by the same key
with the whole normalised text in it, which puts equal texts beside each other, the one that stays
first. One pass compares every text in full with its neighbour's and turns each run of equal texts
into its decision.

Only the first and the last run of a partition (with any others that share its hash) can go on in
another one. Of these, two small rows a partition, Spark stitches those with equal SHA-256; no other
row is grouped or joined.

Null texts count as empty. Among rows with equal text, length and identifier (repeated rows) exactly
one stays. Null identifiers sort after all others. An empty table gives an empty result. Columns of
the input may have any names: those that are added get underscores in front where they clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import fresh, materialize, small_batches, text_or_empty
from vacantia.llm.tokens import split_words

PREFIX_CHARS = 64
#: The white space that the comparison leaves out.
BLANKS = " \t\n\v\f\r"


def normalised(text: Column) -> Column:
    return F.translate(text, BLANKS, "")


class Run:
    """Neighbouring rows with equal text, as far as they have been read."""

    def __init__(self, norm: str, key: int, size: int, best: object):
        self.key, self.size, self.best, self.n = key, size, best, 0
        self.digest = hashlib.sha256(norm.encode()).hexdigest()


def _decide(text_at: int, id_at: int, heads_only: bool, names: list[str]) -> Callable:
    """The pass over a sorted partition. Added columns: digest, rows in the run, length and identifier of its first row, whether the row is that one, and for runs at a border the partition (else null).

    With ``heads_only`` the first rows of the runs, with all columns; else all rows without the text.
    The last column of the input is the hash of the sort key. Rows of one key are held, without their
    texts, until it ends: no more of them than a partition has.
    """
    kinds = (pa.string(), pa.int64(), pa.int64(), None, pa.bool_(), pa.int32())

    def emitted(held: list, border_of: Callable[[Run], int | None]) -> Iterator[pa.RecordBatch]:
        """``held``: record batches, and for each of their rows its run and whether it is the first of it."""
        for rest, runs, head in held:
            if rest.num_rows:
                id_type = rest.schema.field(id_at - (not heads_only and text_at < id_at)).type
                added = ([r.digest for r in runs], [r.n for r in runs], [r.size for r in runs], [r.best for r in runs], head, [border_of(r) for r in runs])
                arrays = [*rest.columns[:-1], *(pa.array(v, k or id_type) for v, k in zip(added, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, [*rest.schema.names[:-1], *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        held: list = []  # what belongs to the present key
        held_key = None
        now, before, first_key = None, "", None
        for part in small_batches(batches, text_at):
            keys = part.column(part.num_columns - 1).to_pylist()
            ids, runs, head = part.column(id_at).to_pylist(), [], []
            for key, doc, text in zip(keys, ids, part.column(text_at).to_pylist(), strict=True):
                norm = "".join(split_words(text or ""))
                new = now is None or key != now.key or norm != before
                if new:
                    now, before = Run(norm, key, len(text or ""), doc), norm
                now.n += 1
                runs.append(now)
                head.append(new)
            first_key = keys[0] if first_key is None else first_key
            rest = part if heads_only else part.drop_columns([part.schema.names[text_at]])
            if heads_only:
                rest = rest.filter(pa.array(head))
                runs, head = [r for r, h in zip(runs, head, strict=True) if h], [True] * rest.num_rows
            cut = 0
            if keys[-1] != held_key:  # the rows held are complete, and so are this part's up to its last key
                cut = next(i for i, r in enumerate(runs) if r.key == keys[-1])
                yield from emitted([*held, (rest.slice(0, cut), runs[:cut], head[:cut])], lambda r: here if r.key == first_key else None)
                held, held_key = [], keys[-1]
            if cut < len(runs):
                held.append((rest.slice(cut), runs[cut:], head[cut:]))
        yield from emitted(held, lambda r: here)

    return run


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, heads_only: bool) -> tuple[DataFrame, dict[str, str]]:
    """The materialised rows of ``_decide`` and the names of its columns."""
    n = {k: fresh(k, docs.columns) for k in ("prefix", "hash", "minus", "no_id", "norm", "digest", "in_run", "size", "best", "head", "border", "text_sha256", "group_size", "keep_id", "kept", "n", "first")}
    norm = normalised(text_or_empty(text_col))
    keyed = docs.withColumns({n["prefix"]: F.substring(norm, 1, PREFIX_CHARS), n["hash"]: F.xxhash64(norm), n["minus"]: -F.length(text_or_empty(text_col)), n["no_id"]: F.col(id_col).isNull()})
    rest = [F.col(n["minus"]), F.col(n["no_id"]), F.col(id_col)]
    dealt = keyed.repartitionByRange(F.col(n["prefix"]), F.col(n["hash"]), *rest)
    ordered = dealt.sortWithinPartitions(F.col(n["prefix"]), F.col(n["hash"]), norm, *rest).select(*[F.col(c) for c in docs.columns], F.col(n["hash"]))
    added = [n[k] for k in ("digest", "in_run", "size", "best", "head", "border")]
    out = T.StructType([f for f in docs.schema.fields if heads_only or f.name != text_col])
    out = out.add(added[0], "string").add(added[1], "long").add(added[2], "long").add(added[3], docs.schema[id_col].dataType).add(added[4], "boolean").add(added[5], "integer")
    return materialize(ordered.mapInArrow(_decide(docs.columns.index(text_col), docs.columns.index(id_col), heads_only, added), out), "content-sort"), n


def _stitched(rows: DataFrame, n: dict[str, str], id_col: str) -> DataFrame:
    """For the runs at borders: digest, rows in the whole group, and its first run. At most two rows a partition come in."""
    runs = rows.filter(F.col(n["border"]).isNotNull() & F.col(n["head"]))
    best = F.min(F.struct(-F.col(n["size"]), F.col(n["best"]).isNull(), F.col(n["best"]), F.col(n["border"]))).alias(n["first"])
    return runs.groupBy(F.col(n["digest"]).alias(n["norm"])).agg(F.sum(n["in_run"]).alias(n["n"]), best)


def mark_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` without their text and with the decision on each.

    Added columns: ``text_sha256``, ``group_size``, ``keep_id`` and ``kept``. Of a group the row with
    the longest original text stays, then the smallest identifier.
    """
    rows, n = _sorted_runs(docs, id_col, text_col, False)
    others = [F.col(c) for c in docs.columns if c != text_col]
    digest = F.col(n["digest"]).alias(n["text_sha256"])
    inside = rows.filter(F.col(n["border"]).isNull()).select(*others, digest, F.col(n["in_run"]).alias(n["group_size"]), F.col(n["best"]).alias(n["keep_id"]), F.col(n["head"]).alias(n["kept"]))
    groups = _stitched(rows, n, id_col)
    first = F.col(n["first"])
    at_border = rows.filter(F.col(n["border"]).isNotNull()).join(F.broadcast(groups), F.col(n["digest"]) == F.col(n["norm"]))
    stays = F.col(n["head"]) & (first[n["border"]] == F.col(n["border"]))
    return inside.unionByName(at_border.select(*others, digest, F.col(n["n"]).alias(n["group_size"]), first[n["best"]].alias(n["keep_id"]), stays.alias(n["kept"])))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns only."""
    heads, n = _sorted_runs(docs, id_col, text_col, True)
    columns = [F.col(c) for c in docs.columns]
    groups = _stitched(heads, n, id_col)
    at_border = heads.filter(F.col(n["border"]).isNotNull()).join(F.broadcast(groups), F.col(n["digest"]) == F.col(n["norm"]))
    stays = at_border.filter(F.col(n["first"])[n["border"]] == F.col(n["border"]))
    return heads.filter(F.col(n["border"]).isNull()).select(*columns).unionByName(stays.select(*columns))


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mark_exact_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(raw) DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""
