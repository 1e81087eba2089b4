"""The corpus pipeline: stages that each call one operator and are written and read again between.

Stage functions take (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of ``documents``, and more columns, whatever their names, go along. An empty table goes
through all stages as one. ``ORACLE_SQL`` is None: components, raking and packing are iterative, so
``tests/llm`` holds ``run`` against a brute-force version instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from vacantia.llm.common import materialize

#: Near copies share at least this share in % of their shingles of so many words.
NEAR_SIZE, NEAR_PERCENT = 5, 80


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others lose the frequent lines of their host.

    Null and empty texts fail the rules. Repeated rows and ties are judged alike.
    """
    return quality_rules.keep_good(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest, then the one of smallest identifier.

    Null texts count as empty ones. Of repeated rows one stays; a null identifier comes last.
    """
    return exact_dedup.drop_exact_copies(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that of smallest identifier.

    Documents without words stay, and so do rows without an identifier, which can't be told apart, and
    rows that repeat the one that stays.
    """
    return jaccard_join.keep_one_of_each(docs, size=NEAR_SIZE, percent=NEAR_PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of source, language and topic.

    Null and unknown categories count as other. Documents without words are never drawn; repeated rows
    are drawn together or not at all.
    """
    return mixing.keep_mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sampled documents, packed into sequences. Every row is packed, empty and repeated ones too."""
    import public_tokenizers

    return packing.pack(packing.tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
