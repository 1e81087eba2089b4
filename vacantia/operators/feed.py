"""Serving: feed pages, details and the figures beside them."""

from __future__ import annotations

import base64
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import policy as P
from vacantia.functions import text as X

PAGE, MOST = 25, 100
FILTERS = ("role_family", "work_mode", "country", "page_size", "cursor")


def encode_cursor(first_seen: datetime, key: str) -> str:
    stamp = first_seen.strftime("%Y-%m-%dT%H:%M:%S") + (f".{first_seen.microsecond:06d}".rstrip("0") if first_seen.microsecond else "") + "Z"
    return base64.urlsafe_b64encode(f"{stamp}|{key}".encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    """Raises ValueError on anything that ``encode_cursor`` didn't make."""
    try:
        stamp, bar, key = base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().partition("|")
        if not bar or not key:
            raise ValueError
        return datetime.fromisoformat(stamp.replace("Z", "+00:00")).replace(tzinfo=None), key
    except ValueError as e:
        raise ValueError("malformed cursor") from e


def check_filters(filters: dict) -> dict:
    """Unknown names and bad sizes are refused; the size is clamped to the page limits."""
    if unknown := set(filters) - set(FILTERS):
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    size = int(filters.get("page_size") or PAGE)
    if size < 1:
        raise ValueError("page_size must be at least 1")
    return {k: v for k, v in filters.items() if v is not None} | {"page_size": min(size, MOST)}


def is_live() -> Column:
    """Ready, open and not merged away."""
    return (F.col("pipeline_state") == "ready") & F.col("closed_at").isNull() & F.col("merged_into").isNull()


def provenance(sources: DataFrame) -> DataFrame:
    """For each opportunity its number of sources and its oldest apply address."""
    order = F.struct("created_at", "source_row_id")
    oldest = F.min(F.when(F.col("apply_url").isNotNull(), F.struct(order.alias("o"), "apply_url")))
    return sources.groupBy("opportunity_id").agg(F.count(F.lit(1)).alias("source_count"), oldest["apply_url"].alias("apply_url"))


def with_provenance(opps: DataFrame, companies: DataFrame, sources: DataFrame) -> DataFrame:
    names = companies.select(F.col("id").alias("company_id"), F.col("display_name").alias("company_name"))
    chosen = sources.join(opps.select(F.col("id").alias("opportunity_id")), "opportunity_id", "left_semi")
    found = provenance(chosen).withColumnRenamed("opportunity_id", "id")
    return opps.join(names, "company_id").join(found, "id", "left").withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def page(opps: DataFrame, companies: DataFrame, sources: DataFrame, filters: dict | None = None, after: tuple | None = None, now: Column | None = None) -> DataFrame:
    """One page of live opportunities, newest first; ``after`` is the last row's (first_seen_at, id).

    Only the page itself is joined with companies and provenance.
    """
    f = check_filters(filters or {})
    live = opps.filter(is_live())
    for name in ("role_family", "work_mode"):
        if name in f:
            live = live.filter(F.col(name) == f[name])
    if "country" in f:
        live = live.filter((F.col("location_country") == f["country"]) | F.col("remote_geo_scope").like(f"%{f['country']}%"))
    if after is not None:
        seen, key = after
        live = live.filter((F.col("first_seen_at") < F.lit(seen)) | ((F.col("first_seen_at") == F.lit(seen)) & (F.col("id") < F.lit(key))))
    top = live.orderBy(F.desc("first_seen_at"), F.desc("id")).limit(f["page_size"])
    found = with_provenance(top, companies, sources)
    if now is not None:
        days = P.days_open(F.col("first_seen_at"), now)
        risk = P.ghost_risk(days, F.col("repost_count"), F.col("apply_url").isNotNull(), F.lit(0))
        found = found.withColumn("days_open", days).withColumn("ghost_band", risk["band"])
    return found.orderBy(F.desc("first_seen_at"), F.desc("id"))


def detail(opps: DataFrame, companies: DataFrame, sources: DataFrame) -> DataFrame:
    """All fields of unmerged opportunities, with the company's pace and open similar roles."""
    own = opps.filter(F.col("merged_into").isNull())
    found = with_provenance(own, companies, sources).join(median_days_to_close(opps), "company_id", "left")
    similar = open_similar_roles(opps)
    found = found.join(similar, ["company_id", "role_family"], "left")
    return found.withColumn("median_days", F.coalesce("median_days", F.lit(0))).withColumn("open_similar", F.coalesce("open_similar", F.lit(0)))


def median_days_to_close(opps: DataFrame) -> DataFrame:
    closed = opps.filter(F.col("closed_at").isNotNull() & F.col("merged_into").isNull())
    days = (F.unix_micros("closed_at") - F.unix_micros("first_seen_at")) / 8.64e10
    return closed.groupBy("company_id").agg(F.rint(F.percentile(days, F.lit(0.5))).cast("int").alias("median_days"))


def open_similar_roles(opps: DataFrame) -> DataFrame:
    return opps.filter(is_live()).groupBy("company_id", "role_family").agg(F.count(F.lit(1)).alias("open_similar"))


def salary() -> Column:
    """Null if neither bound is given; a missing lower bound is 0."""
    low, high = F.col("salary_min_minor"), F.col("salary_max_minor")
    return F.when(low.isNotNull() | high.isNotNull(), F.struct(F.coalesce(low, F.lit(0)).alias("min_minor"), high.alias("max_minor"), F.col("salary_currency").alias("currency")))


def as_json(found: DataFrame) -> DataFrame:
    """One JSON document for each row; missing values are explicit nulls, lists are never null."""
    body = F.struct(
        "id",
        F.struct(F.col("company_id").alias("id"), F.col("company_name").alias("name")).alias("company"),
        F.struct(F.col("location_country").alias("country"), X.split_scope(F.col("remote_geo_scope")).alias("geo_scope")).alias("location"),
        salary().alias("salary"),
    )
    return found.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
