"""Dashboards and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTERS = ("postings", "usable", "company", "location", "apply_url", "language", "salary")


def pipeline_stats(opps: DataFrame) -> DataFrame:
    return opps.filter("merged_into IS NULL").groupBy("pipeline_state").agg(F.count(F.lit(1)).alias("n"), F.min("state_entered_at").alias("oldest"))


def normalization_stats(opps: DataFrame) -> DataFrame:
    return opps.filter("merged_into IS NULL").groupBy("normalization_version").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("role_family").alias("with_family"),
        F.count("seniority_ordinal").alias("with_seniority"),
        F.count("location_country").alias("with_country"),
        F.count_if("is_management").alias("management"),
    )


def multi_member_blocks(opps: DataFrame, most: int = 200) -> DataFrame:
    """The largest blocks with more than one open member; ties go by key."""
    open_ones = opps.filter("block_key IS NOT NULL AND merged_into IS NULL AND closed_at IS NULL")
    return open_ones.groupBy("block_key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").orderBy(F.desc("members"), "block_key").limit(most)


def live_per_source(opps: DataFrame, sources: DataFrame) -> DataFrame:
    """Open opportunities of each source; one with several rows of a source counts once."""
    pairs = sources.select("source_id", "opportunity_id").distinct()
    return pairs.join(opps.filter("closed_at IS NULL").select(F.col("id").alias("opportunity_id")), "opportunity_id", "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("live"))


def daily_health(polls: DataFrame) -> DataFrame:
    """Counters of each source and day; ``polls`` has source_id, day and the counters of one poll a row."""
    return polls.groupBy("source_id", "day").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def add_daily_health(stored: DataFrame, polls: DataFrame) -> DataFrame:
    """The additive upsert: old counters and a batch's, by source and day."""
    return daily_health(stored.select("source_id", "day", *COUNTERS).unionByName(polls.select("source_id", "day", *COUNTERS)))


def baseline(daily: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Sums of each source over the days before ``today``."""
    before = daily.filter((F.col("day") >= F.date_sub(today, days)) & (F.col("day") < today))
    return before.groupBy("source_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])


def trailing_baseline(daily: DataFrame, days: int = 7) -> DataFrame:
    """For every source and day the sums over the days before it, in one window."""
    w = Window.partitionBy("source_id").orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    return daily.select("source_id", "day", *COUNTERS, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"base_{c}") for c in COUNTERS])


def health_report(sources: DataFrame, daily: DataFrame, today: Column) -> DataFrame:
    """Every source with today's counters and its baseline; missing ones are 0."""
    now = daily.filter(F.col("day") == today).select("source_id", *[F.col(c).alias(f"today_{c}") for c in COUNTERS])
    base = baseline(daily, today).select("source_id", *[F.col(c).alias(f"base_{c}") for c in COUNTERS])
    found = sources.join(now, "source_id", "left").join(base, "source_id", "left")
    return found.withColumns({f"{p}_{c}": F.coalesce(f"{p}_{c}", F.lit(0)) for p in ("today", "base") for c in COUNTERS})


def runs_of_degraded(evaluations: DataFrame) -> DataFrame:
    """``consecutive`` degraded evaluations up to each one; healthy resets, unknown changes nothing."""
    w = Window.partitionBy("source_id").orderBy("polled_at", "evaluation_id")
    resets = F.sum((F.col("status") == "healthy").cast("int")).over(w)
    known = evaluations.withColumn("run", resets)
    count = F.sum((F.col("status") == "degraded").cast("int")).over(Window.partitionBy("source_id", "run").orderBy("polled_at", "evaluation_id"))
    return known.withColumn("consecutive", count).drop("run")


def fold_poll(outcomes: DataFrame) -> DataFrame:
    """Counters of one poll from its postings' outcomes."""
    said = {c: F.count_if(F.coalesce(c, F.lit("")) != "") for c in ("company", "location", "apply_url", "language")}
    kinds = {k: F.count_if(F.col("outcome") == k) for k in ("created", "updated", "skipped")}
    kinds["unchanged"] = F.count_if(F.col("outcome").isin("unchanged", "linked"))  # a link changes no posting
    fetched = F.count(F.lit(1))
    parse_yield = F.when(fetched == 0, 1.0).otherwise((fetched - kinds["skipped"]) / fetched)
    return outcomes.groupBy("source_id").agg(fetched.alias("fetched"), *[v.alias(k) for k, v in kinds.items()], *[v.alias(f"filled_{k}") for k, v in said.items()], parse_yield.alias("parse_yield"))


def precision_recall(judged: DataFrame) -> DataFrame:
    """Confusion counts and rates of ``judged`` (predicted, truth)."""
    p, t = F.col("predicted"), F.col("truth")
    tp, fp, fn = F.count_if(p & t), F.count_if(p & ~t), F.count_if(~p & t)
    return judged.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        F.when(tp + fp == 0, 1.0).otherwise(tp / (tp + fp)).alias("precision"),
        F.when(tp + fn == 0, 1.0).otherwise(tp / (tp + fn)).alias("recall"),
    )
