"""Keyed state of a stream: what each source's jobs have shown so far, and the deadlines of queue rows.

Both processors order a batch's rows of a key by time and give the same rows however a stream is cut
into batches, as long as batches come in order. State lives in RocksDB, which Spark checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vacantia.operators.ingest import MAX_MISSES

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

#: A source's jobs are dealt to so many keys; each hears of every poll of its source.
BUCKETS = 16
#: Times are microseconds here, so that no time zone takes part.
JOB = "content_hash string, claim_at_change long, version int, refreshes int, misses int, closures int, first_seen_at long, last_seen_at long, closed_at long"
LIFECYCLE = f"source_id string, source_job_id string, {JOB}, seq long"
TIMES = ("claim_at_change", "first_seen_at", "last_seen_at", "closed_at")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """Keyed state needs this provider."""
    if spark.conf.get(PROVIDER, "") != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    return spark


def _known(x) -> int | None:
    return None if x is None or x is pd.NA or x != x else int(x)


def _order(content: str | None, claim: int | None) -> tuple:
    return content is not None, content or "", claim is not None, claim or 0


#: Rows among which repeated polls become one before they are dealt to keys.
_TOGETHER = 1 << 20


def _told_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def distinct(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        return pa.Table.from_batches(held).group_by(held[0].schema.names).aggregate([]).to_batches(max_chunksize=10_000) if held else []

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _TOGETHER:
            yield from distinct(held)
            held, n = [], 0
    yield from distinct(held)


class JobLifecycle(StatefulProcessor):
    """One entry for each job of a source: versions, refreshes, misses, open or closed.

    Rows of a key are polls (no job) and what they showed. A successful poll counts a miss for every
    open job that it didn't show; at ``MAX_MISSES`` the job closes, and showing again reopens it. Of
    several rows of a job in one poll the last by content hash and claim counts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "source_job_id string", JOB)
        self.seq = handle.getValueState("seq", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls: dict[int, dict[str, tuple]] = {}
        for part in rows:
            for at, job, content, claim in zip(*(part[c].tolist() for c in ("at", "source_job_id", "content_hash", "claim")), strict=True):
                shown = polls.setdefault(at, {})
                if not isinstance(job, str):
                    continue
                content, claim = content if isinstance(content, str) else None, _known(claim)
                old = shown.get(job)
                if old is None or _order(*old) < _order(content, claim):
                    shown[job] = (content, claim)
        seq = self.seq.get()[0] if self.seq.exists() else 0
        known = {k[0]: tuple(v) for k, v in self.jobs.iterator()}
        touched: dict[str, tuple] = {}
        for at, shown in sorted(polls.items()):
            for job, (content, claim) in shown.items():
                old = known.get(job)
                if old is None:
                    new = (content, claim, 1, 0, 0, 0, at, at, None)
                elif old[0] != content:
                    new = (content, claim, old[2] + 1, old[3], 0, old[5], old[6], at, None)
                else:
                    refreshed = claim is not None and old[1] is not None and claim > old[1]
                    new = (content, old[1], old[2], old[3] + int(refreshed), 0, old[5], old[6], at, None)
                known[job] = touched[job] = new
            for job, old in known.items():
                if job not in shown and old[8] is None:
                    gone = old[4] + 1 >= MAX_MISSES
                    touched[job] = known[job] = (*old[:4], old[4] + 1, old[5] + int(gone), *old[6:8], at if gone else None)
            seq += 1
        for job, value in touched.items():
            self.jobs.updateValue((job,), value)
        self.seq.update((seq,))
        if touched:
            columns = zip(*((key[0], job, *value, seq) for job, value in touched.items()), strict=True)
            names = [c.split()[0] for c in LIFECYCLE.split(", ")]
            yield pd.DataFrame({c: pd.array(v, "Int64") if c in TIMES else list(v) for c, v in zip(names, columns, strict=True)})

    def close(self) -> None:
        pass


def job_lifecycles(polls: DataFrame, shown: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of changed entries; ``seq`` grows with each key's polls, so the largest is a job's present state.

    ``polls``: source_id and polled_at of the successful polls; ``shown``: source_id, polled_at,
    source_job_id, content_hash and claim. Both may be streams; a poll may come several times in a batch.
    """
    own = F.pmod(F.xxhash64("source_job_id"), F.lit(buckets)).cast("int")
    at, name = F.unix_micros(F.col("polled_at").cast("timestamp")).alias("at"), F.col("source_id").cast("string").alias("source_id")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("source_job_id", "string"), ("content_hash", "string"), ("claim", "long"))]
    once = polls.select(name, at).mapInArrow(_told_once, "source_id string, at long")
    every = once.select("source_id", "at", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), *none)
    rows = every.unionByName(shown.select(name, at, own.alias("bucket"), "source_job_id", "content_hash", F.unix_micros(F.col("claim").cast("timestamp")).alias("claim")))
    with_rocksdb(rows.sparkSession)
    found = rows.groupBy("source_id", "bucket").transformWithStateInPandas(JobLifecycle(), LIFECYCLE, "Update", "None")
    return found.select(*[F.timestamp_micros(c).alias(c) if c in TIMES else c for c in found.columns])


def present(changes: DataFrame) -> DataFrame:
    """The present entries of a change log that was written out; repeated and replayed changes count once."""
    names = [c for c in changes.columns if c not in ("source_id", "source_job_id", "seq")]
    last = changes.groupBy("source_id", "source_job_id").agg(F.max_by(F.struct(*names), "seq").alias("e"))
    return last.select("source_id", "source_job_id", "e.*")


class Deadlines(StatefulProcessor):
    """Lease expiry and stranded rows of a queue, by event-time timers.

    A row's events are ``enter`` (a state, at its beginning), ``claim`` (a lease of ``lease_s``) and
    ``done`` (a terminal state). A lease that no later event ends expires; a row that stays in a state
    for ``strand_s`` is swept then and every ``sweep_s`` after, but not while it is leased.
    """

    def __init__(self, lease_s: int, strand_s: int, sweep_s: int):
        self.lease, self.strand, self.sweep = lease_s * 1_000_000, strand_s * 1_000_000, sweep_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", "state string, lease_until long, sweep_at long")

    def _due(self, row: tuple, upto: int, key: str) -> tuple[list, tuple]:
        """What falls due up to a time, in order, and the row after it."""
        state, lease, sweep = row
        out = []
        while True:
            if lease is not None and lease <= upto and (sweep is None or lease <= sweep):
                out.append((key, lease, "lease_expired", state))
                lease = None
            elif sweep is not None and sweep <= upto:
                if lease is None:
                    out.append((key, sweep, "swept", state))
                sweep += self.sweep
            else:
                return out, (state, lease, sweep)

    def _read(self) -> tuple:
        return tuple(self.row.get()) if self.row.exists() else (None, None, None)

    def _store(self, row: tuple) -> None:
        """Keep the row, with one timer at its next deadline; timers count milliseconds."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.row.update(row)
        due = [t for t in row[1:] if t is not None]
        if due:
            self.handle.registerTimer(-(-min(due) // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        row, out = self._read(), []
        for e in pd.concat(list(rows)).sort_values(["at", "event", "state"]).itertuples():
            found, (state, lease, sweep) = self._due(row, e.at - 1, key[0])
            out += found
            if e.event == "claim":
                row = (state, lease if sweep is None else e.at + self.lease, sweep)
            else:
                row = (e.state, None, e.at + self.strand if e.event == "enter" else None)
        self._store(row)
        yield from self._frames(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, row = self._due(self._read(), timerValues.getCurrentWatermarkInMs() * 1000, key[0])
        self._store(row)
        yield from self._frames(out)

    def _frames(self, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["id", "at", "what", "state"])

    def close(self) -> None:
        pass


def deadlines(events: DataFrame, lease_s: int = 300, strand_s: int = 1800, sweep_s: int = 300, lateness: str = "0 seconds") -> DataFrame:
    """``id``, ``at``, ``what`` and ``state`` of everything that fell due on a stream of ``id``, ``ts``, ``event`` and ``state``.

    The clock is the stream's watermark, in whole milliseconds: a deadline fires once all events up to
    it have been seen. Events of one time are taken by kind and state.
    """
    rows = events.select(F.col("id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event", "state").withWatermark("ts", lateness)
    with_rocksdb(rows.sparkSession)
    found = rows.withColumn("at", F.unix_micros("ts")).groupBy("id").transformWithStateInPandas(Deadlines(lease_s, strand_s, sweep_s), "id string, at long, what string, state string", "Append", "EventTime")
    return found.withColumn("at", F.timestamp_micros("at"))


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str) -> DataFrame:
    """Work off a stream and return what it has written so far.

    Each batch goes into a folder of its own number, which a replayed batch overwrites.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
