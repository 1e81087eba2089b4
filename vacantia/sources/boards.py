"""Source adapters: landed board payloads in, postings out."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import text as X

#: Payloads above this size are refused.
MAX_BODY = 8 * 1024 * 1024

PAYLOAD = (
    "jobs array<struct<id: bigint, title: string, company_name: string, absolute_url: string, content: string, language: string, "
    "location: struct<name: string>, first_published: string, updated_at: string, requisition_id: string>>, _bad string"
)


class Adapter(Protocol):
    """Where a family of sources lands its documents and how they parse. Parsing is pure."""

    tier: str

    def fetch(self, spark: SparkSession, path: str) -> DataFrame: ...

    def parse(self, documents: DataFrame) -> DataFrame: ...


_adapters: dict[str, Callable[[str], Adapter]] = {}


def register(family: str, build: Callable[[str], Adapter]) -> None:
    """A family can be registered once."""
    if family in _adapters:
        raise ValueError(f"adapter {family} is registered already")
    _adapters[family] = build


def build(name: str) -> Adapter:
    """The adapter of a source named ``family:config``."""
    family, colon, config = name.partition(":")
    if not colon or not config or family not in _adapters:
        raise ValueError(f"no adapter for {name!r}")
    return _adapters[family](config)


def registered() -> list[str]:
    return sorted(_adapters)


def source_names(spark: SparkSession, path: str) -> DataFrame:
    """A list file: one ``family:config`` a line, ``#`` comments, repetitions once."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    names = spark.read.text(path).select(line.alias("name")).filter("name <> ''").dropDuplicates()
    parts = F.split("name", ":", 2)
    return names.select("name", F.get(parts, F.lit(0)).alias("family"), F.get(parts, F.lit(1)).alias("config"), (F.col("name").rlike("^[^:]+:.+$")).alias("valid"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole landed payloads: ``path``, ``body``; the body of one above ``MAX_BODY`` is null, so that it fails like one that isn't JSON."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.when(F.col("length") <= MAX_BODY, F.col("content").cast("string")).alias("body"))


def decode(documents: DataFrame) -> DataFrame:
    """``documents`` with ``jobs`` and ``ok``; a payload that isn't the expected JSON fails as a whole."""
    parsed = F.from_json("body", PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    good = F.col("p").isNotNull() & F.col("p._bad").isNull() & F.trim("body").startswith("{")
    return documents.withColumn("p", parsed).withColumn("ok", F.coalesce(good, F.lit(False))).withColumn("jobs", F.when(F.col("ok"), F.coalesce("p.jobs", F.array().cast(PAYLOAD.split("jobs ")[1].rsplit(", _bad", 1)[0])))).drop("p")


def postings(decoded: DataFrame) -> DataFrame:
    """A row for each usable job; jobs without an id or a title are dropped."""
    keep = [c for c in decoded.columns if c not in ("body", "jobs", "ok")]
    jobs = decoded.filter("ok").select(*keep, F.explode("jobs").alias("j")).filter((F.coalesce("j.id", F.lit(0)) != 0) & (F.trim(F.coalesce("j.title", F.lit(""))) != ""))

    def text(name: str) -> Column:
        return F.trim(F.coalesce(f"j.{name}", F.lit("")))

    place = F.trim(F.coalesce("j.location.name", F.lit("")))
    described = jobs.withColumn("description", X.html_unescape(F.coalesce("j.content", F.lit(""))))
    return described.select(
        *keep,
        F.col("j.id").cast("string").alias("source_job_id"),
        F.lit("greenhouse").alias("ats_type"),
        F.col("j.id").cast("string").alias("ats_job_id"),
        text("title").alias("title"),
        text("company_name").alias("company_name"),
        "description",
        text("absolute_url").alias("apply_url"),
        X.language_code(F.col("j.language")).alias("language"),
        place.alias("location_raw"),
        X.board_work_mode(place).alias("work_mode"),
        X.parse_time(F.col("j.first_published")).alias("source_reported_posted_at"),
        X.parse_time(F.col("j.updated_at")).alias("source_updated_at"),
        X.content_hash(text("title"), F.col("description"), place, text("absolute_url")).alias("content_hash"),
    )


class Board:
    """One company's board: a JSON document that lists all its jobs."""

    tier = "a"

    def __init__(self, config: str):
        self.config = config

    def fetch(self, spark: SparkSession, path: str) -> DataFrame:
        return read_documents(spark, path)

    def parse(self, documents: DataFrame) -> DataFrame:
        return postings(decode(documents))


register("greenhouse", Board)


def decode_cursor(c: Column) -> Column:
    """A poll cursor; malformed ones are empty, which means a full fetch."""
    shape = "struct<etag: string, last_modified: string>"
    return F.coalesce(F.from_json(c, shape), F.struct(F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified")))


def encode_cursor(c: Column) -> Column:
    return F.to_json(c)


def company_domain(domain: Column, source: Column) -> Column:
    """The registrable domain, else a reserved one made of the source's family and config."""
    family, config = F.split_part(source, F.lit(":"), F.lit(1)), F.split_part(source, F.lit(":"), F.lit(2))
    return F.coalesce(F.nullif(F.lower(F.trim(domain)), F.lit("")), F.concat_ws(".", config, family, F.lit("ats"), F.lit("invalid")))


def report_lines(report: DataFrame) -> DataFrame:
    """A health report as fixed-width text lines.

    Shares (``share`` in %, or 100 times ``parse_yield``) are rounded as their exact binary values are, halves to even;
    a format of one decimal would round the shown digits' halves up.
    """
    share = F.col("share") if "share" in report.columns else F.col("parse_yield") * 100
    rounded = F.call_function("format_number", share, F.lit("0.0"))
    line = F.format_string("%-32s %-12s %8d %6s%%", F.substring("name", 1, 32), F.col("status"), F.col("postings").cast("long"), rounded)
    return report.select(line.alias("line"))
