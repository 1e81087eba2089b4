"""Quality rules: base counts of every text, and line frequency across the documents of a host.

A line is normalised (lower case, white space runs as one space) and hashed. For each host (column
``source``) Spark counts in how many distinct documents a line occurs. Documents with the same text
count once, so a group of copies does not turn its own lines into boilerplate; ``copies=True`` counts
each of them. A line is removed if it is in more than ``LEAST_DOCS`` documents and more than
``MOST_SHARE`` % of the host's, or, however large the host is, in more than ``MOST_DOCS`` documents and
takes ``LINE_WORDS`` words in each. A document that loses more than ``MOST_LOST`` % of its words so is
rejected as depleted; the others go on without these lines (``keep_good``).

The verdict depends on host and text only, so it is worked out once for each distinct pair; joins
back to the rows are on that pair. Null texts count as empty and fail the base rules; a null source
is the host ''. Repeated rows get equal verdicts. An empty table gives an empty result. Columns of the
input may have any names; ``keep_good`` returns just these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.common import fresh, materialize, small_batches, small_frames, text_or_empty
from vacantia.llm.tokens import split_words

LEAST_WORDS = 50
MOST_REPEATED = 50
LEAST_DOCS = 20
MOST_SHARE = 5
MOST_DOCS = 1000
LINE_WORDS = 5
MOST_LOST = 70
SYMBOLS = "#*$%&|<>"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[str]) -> int:
    """Words that lie in some 3-word window found twice or more."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered, end = 0, 0
    for i, g in enumerate(grams):
        if g in often:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def line_hash(inside: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(inside).lower()) - (1 << 63)


def count_text(text: str) -> tuple:
    """The five base counts, then hash and words of each distinct normalised line."""
    words = split_words(text)
    seen: set[str] = set()
    dup, lines = 0, {}
    for line in text.split("\n"):
        inside = split_words(line)
        if inside:
            dup += line in seen
            seen.add(line)
            h = line_hash(inside)
            lines[h] = lines.get(h, 0) + len(inside)
    symbols = sum(map(text.count, SYMBOLS))
    return len(words), sum(map(len, words)), symbols, dup, repeated_words(words), list(lines), list(lines.values())


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Row by row: ``doc_id``, ``host``, ``print`` (of the text), the base counts and the lines."""
    text = text_or_empty(text_col)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(host_col, F.lit("")).alias("host"), F.md5(text).alias("print"), text.alias("text"))
    names = [*(c.split()[0] for c in COUNTS.split(", ")), "lines", "line_words"]
    out = T.StructType([chosen.schema[c] for c in ("doc_id", "host", "print")] + T._parse_datatype_string(f"{COUNTS}, lines array<long>, line_words array<int>").fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small_frames(batches, "text"):
            counts = pd.DataFrame([count_text(t) for t in batch["text"]], columns=names)
            yield pd.concat([batch[["doc_id", "host", "print"]], counts], axis=1)

    return chosen.mapInPandas(run, out)


def line_cuts(base: DataFrame, copies: bool = False) -> DataFrame:
    """``host``, ``print``, ``n_words``, ``lost`` words and the hashes ``cut`` of the frequent lines, for every text that has such."""
    once = base.groupBy("host", "print").agg(F.first("lines").alias("lines"), F.first("line_words").alias("line_words"), F.first("n_words").alias("n_words"), F.count(F.lit(1)).alias("rows"))
    once = once.withColumn("weight", F.col("rows") if copies else F.lit(1).cast("long"))
    lines = once.select("host", "print", "n_words", "weight", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select("host", "print", "n_words", "weight", "l.*")
    often = lines.groupBy("host", "lines").agg(F.sum("weight").alias("n_docs"), F.min("line_words").alias("words")).filter(F.col("n_docs") > LEAST_DOCS)
    hosts = once.groupBy("host").agg(F.sum("weight").alias("host_docs"))
    anywhere = (F.col("n_docs") > MOST_DOCS) & (F.col("words") >= LINE_WORDS)
    common = often.join(hosts, "host").filter((100 * F.col("n_docs") > MOST_SHARE * F.col("host_docs")) | anywhere).select("host", "lines")
    return lines.join(common, ["host", "lines"]).groupBy("host", "print").agg(F.first("n_words").alias("n_words"), F.sum("line_words").alias("lost"), F.collect_list("lines").alias("cut"))


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def depleted():
    return 100 * F.col("lost") > MOST_LOST * F.col("n_words")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", copies: bool = False) -> DataFrame:
    """The base counts and verdicts of every row, and what its host's frequent lines take from it: ``n_cut_lines`` different ones with ``n_lost_words`` words."""
    base = materialize(base_counts(docs, id_col, text_col, host_col), "line-counts")
    cuts = line_cuts(base, copies).select("host", "print", "lost", F.size("cut").cast("long").alias("n_cut_lines"))
    found = base.drop("lines", "line_words").join(cuts, ["host", "print"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)).cast("long"))
    return found.select(
        "doc_id", *(c.split()[0] for c in COUNTS.split(", ")), base_failed().alias("base_failed"), (~base_failed() & ~depleted()).alias("kept"),
        F.coalesce("n_cut_lines", F.lit(0)).cast("long").alias("n_cut_lines"), F.col("lost").alias("n_lost_words"),
    )


def without_lines(text: str, cut: set[int]) -> str:
    """The text without the lines whose hashes are in ``cut``."""
    return "\n".join([line for line in text.split("\n") if not (inside := split_words(line)) or line_hash(inside) not in cut])


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", copies: bool = False) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with its columns only and without the host's frequent lines in their texts."""
    base = materialize(base_counts(docs, id_col, text_col, host_col), "line-counts")
    failed = base.filter(base_failed()).select("host", "print", F.lit(True).alias("bad"), F.lit(None).cast("array<long>").alias("cut"))
    found = failed.unionByName(line_cuts(base, copies).select("host", "print", depleted().alias("bad"), "cut"))
    found = found.groupBy("host", "print").agg(F.max("bad").alias("bad"), F.first("cut", ignorenulls=True).alias("cut"))
    n = {c: fresh(c, docs.columns) for c in ("host", "print", "bad", "cut", "of_host", "of_print")}
    keyed = docs.withColumns({n["host"]: F.coalesce(F.col(host_col), F.lit("")), n["print"]: F.md5(text_or_empty(text_col))})
    found = found.select(F.col("host").alias(n["of_host"]), F.col("print").alias(n["of_print"]), F.col("bad").alias(n["bad"]), F.col("cut").alias(n["cut"]))
    joined = keyed.join(found, (F.col(n["host"]) == F.col(n["of_host"])) & (F.col(n["print"]) == F.col(n["of_print"])), "left")
    kept = joined.filter(~F.coalesce(F.col(n["bad"]), F.lit(False))).select(*[F.col(c) for c in docs.columns], F.col(n["cut"]))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at):
            columns, cuts = batch.columns[:-1], batch.column(batch.num_columns - 1)
            if cuts.null_count < len(cuts):
                texts = [t.as_py() if not c.is_valid else without_lines(t.as_py() or "", set(c.as_py())) for t, c in zip(columns[at], cuts, strict=True)]
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return kept.mapInArrow(run, docs.schema)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), b AS (
  SELECT doc_id, host, t, md5(t) AS p, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), wp AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM b
), g AS (
  SELECT doc_id, i, word, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM wp WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), gc AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM g WHERE w3 IS NOT NULL
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM gc, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id
), li AS (
  SELECT doc_id, host, p, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS place FROM b
), lw AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM li
), ld AS (SELECT * FROM lw WHERE words > 0),
dl AS (
  SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM ld GROUP BY doc_id, line) GROUP BY doc_id
), ln AS (
  SELECT host, norm, count(DISTINCT p) AS n_docs, min(line_words) AS least FROM (SELECT host, p, norm, sum(words) AS line_words FROM (SELECT DISTINCT host, p, line, norm, words, place FROM ld) GROUP BY host, p, norm) GROUP BY host, norm
), hd AS (SELECT host, count(DISTINCT p) AS host_docs FROM b GROUP BY host),
common AS (
  SELECT host, norm FROM ln JOIN hd USING (host)
  WHERE n_docs > {LEAST_DOCS} AND (100 * n_docs > {MOST_SHARE} * host_docs OR n_docs > {MOST_DOCS} AND least >= {LINE_WORDS})
), lost AS (
  SELECT doc_id, sum(words) AS lost, count(DISTINCT norm) AS n_cut_lines FROM ld JOIN common USING (host, norm) GROUP BY doc_id
), f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(n_cut_lines, 0) AS n_cut_lines
  FROM b LEFT JOIN rep USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN lost USING (doc_id)
), v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost <= {MOST_LOST} * n_words AS kept, n_cut_lines, CAST(lost AS BIGINT) AS n_lost_words
FROM v
"""
