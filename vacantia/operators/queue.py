"""The pipeline as a queue of rows: claim, advance, fail, release, sweep. One writer at a time; ``now`` is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import policy as P
from vacantia.functions import vocabulary as V


def _unleased(now: Column) -> Column:
    return F.col("lease_until").isNull() | (F.col("lease_until") < now)


def claimable(rows: DataFrame, state: str, batch: int | None, now: Column) -> DataFrame:
    """Ids that are due, in order of their next attempt; ties go by id. Without ``batch`` all of them, in no order."""
    due = rows.filter((F.col("pipeline_state") == state) & F.col("merged_into").isNull() & (F.col("next_attempt_at") <= now) & _unleased(now))
    return due.select("id") if batch is None else due.orderBy("next_attempt_at", "id").limit(batch).select("id")


def claim(rows: DataFrame, state: str, batch: int, now: Column, lease_seconds: int) -> DataFrame:
    """``rows`` with the claimed ones leased and counted as one more attempt."""
    hit = claimable(rows, state, batch, now).withColumn("claimed", F.lit(True))
    found = rows.join(hit, "id", "left")
    until = now + F.make_dt_interval(secs=F.lit(float(lease_seconds)))
    return found.withColumns({"lease_until": F.when(F.col("claimed"), until).otherwise(F.col("lease_until")), "attempts": F.col("attempts") + F.when(F.col("claimed"), 1).otherwise(0)}).select(*rows.columns)


def due_sources(schedules: DataFrame, sources: DataFrame, batch: int, now: Column) -> DataFrame:
    due = schedules.filter((F.col("next_run_at") <= now) & _unleased(now))
    return due.join(sources.filter("status = 'active'").select("source_id"), "source_id", "left_semi").orderBy("next_run_at", "source_id").limit(batch).select("source_id", "cursor")


def advance(rows: DataFrame, done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Rows after ``done`` (id, version, state) advance, and the conflicts: entries whose row has moved on."""
    d = done.select("id", F.col("version").alias("d_version"), F.col("state").alias("d_state"))
    found = rows.join(d, "id", "left")
    hit = (F.col("d_version") == F.col("version")) & (F.col("d_state") == F.col("pipeline_state"))
    ok = F.coalesce(hit, F.lit(False))
    new = found.withColumns({
        "pipeline_state": F.when(ok, P.next_state(F.col("pipeline_state"))).otherwise(F.col("pipeline_state")),
        "version": F.col("version") + ok.cast("int"),
        "lease_until": F.when(~ok, F.col("lease_until")),
        "attempts": F.when(ok, 0).otherwise(F.col("attempts")),
        "last_error": F.when(~ok, F.col("last_error")),
        "next_attempt_at": F.when(ok, now).otherwise(F.col("next_attempt_at")),
        "state_entered_at": F.when(ok, now).otherwise(F.col("state_entered_at")),
    }).select(*rows.columns)
    current = rows.select("id", "version", F.col("pipeline_state").alias("state"))
    return new, done.join(current, ["id", "version", "state"], "left_anti")


def fail(rows: DataFrame, failures: DataFrame, now: Column, max_attempts: int = V.MAX_ATTEMPTS) -> DataFrame:
    """Failed attempts wait; after the last one a degradable stage moves on and any other parks."""
    hit = failures.select("id", F.col("error").alias("new_error"), F.lit(True).alias("failed"))
    found = rows.join(hit, "id", "left")
    failed, last = F.coalesce("failed", F.lit(False)), F.col("attempts") >= max_attempts
    degrade = failed & last & F.col("pipeline_state").isin(V.DEGRADABLE)
    wait = now + F.make_dt_interval(secs=P.backoff_seconds(F.col("attempts")).cast("double"))
    return found.withColumns({
        "last_error": F.when(failed, F.col("new_error")).otherwise(F.col("last_error")),
        "lease_until": F.when(~failed, F.col("lease_until")),
        "next_attempt_at": F.when(degrade, now).when(failed, wait).otherwise(F.col("next_attempt_at")),
        "pipeline_state": F.when(degrade, P.next_state(F.col("pipeline_state"))).when(failed & last, V.FAILED).otherwise(F.col("pipeline_state")),
        "attempts": F.when(degrade, 0).otherwise(F.col("attempts")),
    }).select(*rows.columns)


def release(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Give leases back without counting the attempt."""
    found = rows.join(ids.select("id", F.lit(True).alias("hit")), "id", "left")
    hit = F.col("hit").isNotNull() & F.col("lease_until").isNotNull()
    return found.withColumns({"attempts": F.when(hit, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")), "lease_until": F.when(~hit, F.col("lease_until"))}).select(*rows.columns)


def stranded(rows: DataFrame, batch: int, now: Column, threshold_seconds: int = 1800) -> DataFrame:
    """Rows too long in a state, the never or longest ago swept first."""
    since = now - F.make_dt_interval(secs=F.lit(float(threshold_seconds)))
    late = rows.filter(~P.is_terminal(F.col("pipeline_state")) & F.col("merged_into").isNull() & _unleased(now) & (F.col("state_entered_at") < since))
    return late.orderBy(F.col("swept_at").asc_nulls_first(), "state_entered_at", "id").limit(batch).select("id", "pipeline_state", "attempts", "state_entered_at")


def requeue(rows: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    found = rows.join(ids.select("id", F.lit(True).alias("hit")), "id", "left")
    hit = F.col("hit").isNotNull()
    return found.withColumns({"next_attempt_at": F.when(hit, now).otherwise(F.col("next_attempt_at")), "lease_until": F.when(~hit, F.col("lease_until")), "swept_at": F.when(hit, now).otherwise(F.col("swept_at"))}).select(*rows.columns)


#: What normalisation derives.
DERIVED = ("title_normalized", "role_family", "seniority_ordinal", "is_management", "work_mode", "location_country", "location_city", "remote_geo_scope", "simhash", "text_len", "block_key", "normalization_version")


def apply_normalization(rows: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """Derived fields and the next state in one step; ``done`` (id, version, state and the fields) holds only for rows that haven't moved on."""
    fields = [c for c in DERIVED if c in done.columns and c in rows.columns]
    d = done.select("id", F.struct("version", "state", *fields).alias("d"))
    found = rows.join(d, "id", "left")
    ok = F.coalesce((F.col("d.version") == F.col("version")) & (F.col("d.state") == F.col("pipeline_state")), F.lit(False))
    derived = found.withColumns({c: F.when(ok, F.col(f"d.{c}")).otherwise(F.col(c)) for c in fields}).select(*rows.columns)
    return advance(derived, done.select("id", "version", "state"), now)[0]
