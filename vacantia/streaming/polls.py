"""Polls as a stream: landed payload files in, reconciled tables out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.functions import policy
from vacantia.operators import ingest, stats
from vacantia.operators.stats import COUNTERS
from vacantia.sources.boards import decode, postings
from vacantia.sources.store import TableStore

LANDED = "source_id string, company_id string, status string, polled_at timestamp, body string, cursor string, error string"


def as_opportunities(decoded: DataFrame) -> DataFrame:
    """Parsed postings under the names that ``ingest`` takes."""
    p = postings(decoded)
    return p.select(
        "source_id", "company_id", "company_name", "source_job_id", "ats_type", "ats_job_id", F.col("title").alias("title_raw"), F.col("description").alias("description_text"),
        "work_mode", F.col("location_raw").alias("location_region"), "language", "content_hash", "source_reported_posted_at", "apply_url",
    )


def bookkeeping(store: TableStore, counts: DataFrame, polled: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The store's ``source_health``, ``source`` and ``source_schedule`` after a batch, as far as it has them.

    Counters are added to the day's; sources whose poll showed postings are judged against the seven
    days before, marked and, if that lasts, quarantined; every polled source's result and cursor is kept.
    """
    have, out, today = set(store.tables()), {}, F.to_date(now)
    if "source_health" in have:
        out["source_health"] = stats.add_daily_health(store.read("source_health"), counts.withColumn("day", today))
    if "source" in have:
        told = polled.groupBy("source_id").agg(F.max("error").alias("error"))
        ok = (F.col("status") != "failed").alias("ok")
        results = counts.join(told, "source_id", "left").select("source_id", ok, "discovered", "processed", "parse_yield", "error")
        sources = ingest.source_results(store.read("source"), results, now)
        if "source_health" in out:
            judged = counts.filter("status = 'ok'").select("source_id").distinct()
            report = stats.health_report(judged, out["source_health"], today)
            verdict = policy.health_verdict(lambda c: F.col(f"today_{c}"), lambda c: F.col(f"base_{c}"))
            verdicts = report.select("source_id", verdict.alias("v")).select("source_id", "v.status", policy.health_note(F.col("v.reasons")).alias("note"))
            sources = ingest.mark_health(sources, verdicts)
        out["source"] = sources
        if "source_schedule" in have:
            # an unmodified poll keeps its cursor; a failed one ends neither lease nor wait
            stored = store.read("source_schedule")
            new = polled.filter("status <> 'failed'").groupBy("source_id").agg(F.max_by(F.when(F.col("status") == "ok", F.col("cursor")), "polled_at").alias("new_cursor"))
            kept = new.join(stored.select("source_id", "cursor"), "source_id").select("source_id", F.coalesce("new_cursor", "cursor").alias("cursor"))
            out["source_schedule"] = ingest.save_cursors(stored, sources, kept, now)
    return out


def apply_batch(store: TableStore, batch: DataFrame, batch_id: int, now: Column, stream: str = "poll") -> None:
    """One micro-batch of polls with all its bookkeeping, committed as a unit. A replayed batch id of ``stream`` changes nothing.

    A payload that doesn't decode makes its poll a failed one.
    """
    if store.has_batch(f"{stream}-{batch_id}"):
        return
    decoded = decode(batch)
    undecoded = (F.col("status") == "ok") & ~F.col("ok")
    decoded = decoded.withColumns({"status": F.when(undecoded, "failed").otherwise(F.col("status")), "error": F.when(undecoded, "parse: not the expected document").otherwise(F.col("error"))})
    base = store.manifest()["version"]
    found, polled = as_opportunities(decoded), decoded.select("source_id", "status", "cursor", "error", "polled_at")
    texts = store.read("opportunity_text") if "opportunity_text" in store.tables() else None
    tables = ingest.poll(store.read("opportunity"), store.read("opportunity_source"), found, polled, now, texts)
    store.commit(tables | bookkeeping(store, ingest.counted(found, polled), polled, now), expected=base, batch_id=f"{stream}-{batch_id}")


def run_polls(spark: SparkSession, landing: str, store: TableStore, checkpoint: str, clock: Callable[[], Column], files_per_batch: int = 100, name: str = "poll") -> StreamingQuery:
    """Work off all landed poll files (JSON lines, see ``LANDED``) and stop. ``name`` goes with ``checkpoint``: another checkpoint counts batches anew."""
    stream = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).json(landing)
    sink = stream.writeStream.foreachBatch(lambda batch, i: apply_batch(store, batch, i, clock(), name)).option("checkpointLocation", checkpoint)
    return sink.trigger(availableNow=True).start()


def daily_counters(polls: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Counters of each source and day of an event-time stream of polls; late polls count until the watermark passes."""
    days = polls.withWatermark("polled_at", lateness).groupBy(F.window("polled_at", "1 day"), "source_id")
    return days.agg(*[F.sum(c).alias(c) for c in COUNTERS]).select("source_id", F.to_date("window.start").alias("day"), *COUNTERS)


def sweep(store: TableStore, now: Column, batch: int = 100) -> int:
    """Requeue stranded rows; returns the committed version."""
    from vacantia.operators import queue

    base = store.manifest()["version"]
    rows = store.read("opportunity")
    return store.commit({"opportunity": queue.requeue(rows, queue.stranded(rows, batch, now), now)}, expected=base)
