"""Polls into canonical rows: classify, reconcile, liveness and source bookkeeping. Every operator takes ``now``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import text as X
from vacantia.functions.vocabulary import QUARANTINE_AFTER
from vacantia.sources.scratch import cut

MAX_MISSES = 2


BOARD = ("ats_type", "ats_job_id")


def classify(postings: DataFrame, provenance: DataFrame) -> DataFrame:
    """``postings`` with ``outcome``: unchanged, updated or created, by source and job id and content hash.

    Repetitions of a job within a poll count as one, the last by content hash. Where both tables carry
    the board's own identity, a job that is new to its source but known by that is ``linked`` to the
    existing row; of several new ones with one identity the first by source and job id is created.
    """
    key = ("source_id", "source_job_id")
    one = postings.groupBy(*key).agg(F.max(F.struct("content_hash", *[c for c in postings.columns if c not in (*key, "content_hash")])).alias("p"))
    one = one.select(*key, "p.*")
    known = provenance.groupBy(*key).agg(F.min(F.struct("opportunity_id", F.col("content_hash").alias("known_hash"))).alias("k")).select(*key, "k.*")
    found = one.join(known, list(key), "left")
    same = F.col("known_hash").eqNullSafe(F.col("content_hash"))
    found = found.withColumn("outcome", F.when(F.col("opportunity_id").isNull(), "created").when(same, "unchanged").otherwise("updated"))
    if not all({*BOARD} <= {*t.columns} for t in (postings, provenance)):
        return found
    named = F.col("ats_type").isNotNull() & F.col("ats_job_id").isNotNull()
    by_board = provenance.filter(named).groupBy(*BOARD).agg(F.min("opportunity_id").alias("board_id"))
    first = found.filter(named & (F.col("outcome") == "created")).groupBy(*BOARD).agg(F.min(F.struct(*key)).alias("first"))
    found = found.join(by_board, list(BOARD), "left").join(first, list(BOARD), "left")
    return _linked(found, provenance)


def _linked(found: DataFrame, provenance: DataFrame) -> DataFrame:
    """``found`` with created rows turned into linked ones, from ``board_id`` (known by the board's identity) and ``first`` (of the new ones)."""
    created = F.col("outcome") == "created"
    follows = created & F.col("board_id").isNull() & (F.struct("source_id", "source_job_id") != F.col("first"))
    link = F.when(created & F.col("board_id").isNotNull(), F.col("board_id").cast("string")).when(follows, new_id("first.source_id", "first.source_job_id"))
    kind = provenance.schema["opportunity_id"].dataType
    linked = found.withColumn("link", link).withColumns({"outcome": F.when(F.col("link").isNotNull(), "linked").otherwise(F.col("outcome")), "opportunity_id": F.coalesce("opportunity_id", F.col("link").try_cast(kind))})
    return linked.drop("board_id", "first", "link")


#: The jobs of a source are dealt to so many parts, so that a large board isn't one task.
PARTS = 16


def match(postings: DataFrame, provenance: DataFrame, ok: DataFrame) -> DataFrame:
    """Provenance rows beside what a poll said of them, and the jobs that are new to their source.

    ``p`` has the other columns of a provenance row and ``s`` those of a posting; ``stored`` and ``seen`` tell
    whether they are there. ``nth`` numbers the provenance rows of a job, of which the first one counts, ``new``
    postings have none, ``polled`` rows are of a source in ``ok``. All rows are dealt once, by source and part,
    and sources, postings and provenance then meet in their order of ``kind``.
    """
    key = ("source_id", "source_job_id")
    part = F.pmod(F.xxhash64("source_job_id"), F.lit(PARTS)).alias("part")
    sources = ok.filter("source_id IS NOT NULL").select("source_id", F.explode(F.expr(f"sequence(0L, {PARTS - 1}L)")).alias("part"), F.lit(0).alias("kind"))
    said, stored = ([c for c in t.columns if c not in key] for t in (postings, provenance))
    said.sort(key="content_hash".__ne__)
    # plain columns until they are dealt: structs within rows would be moved with their own offsets
    rows = sources.unionByName(postings.select(*key, part, F.lit(1).alias("kind"), *[F.col(c).alias(f"s_{c}") for c in said]), allowMissingColumns=True)
    rows = rows.unionByName(provenance.select(*key, part, F.lit(2).alias("kind"), *[F.col(c).alias(f"p_{c}") for c in stored]), allowMissingColumns=True).repartition("source_id", "part")
    whole = {"s": F.when(F.col("kind") == 1, F.struct(*[F.col(f"s_{c}").alias(c) for c in said])), "p": F.when(F.col("kind") == 2, F.struct(*[F.col(f"p_{c}").alias(c) for c in stored]))}
    unnamed = F.when(F.col("source_job_id").isNull(), F.col("kind")).alias("unnamed")  # equals no other
    rows = rows.select(*key, "part", "kind", unnamed, *[e.alias(k) for k, e in whole.items()], "p_opportunity_id", "p_content_hash")
    # one order serves both: a source's own row has no job and comes first
    order, so_far = ("kind", F.desc("s"), "p_opportunity_id", "p_content_hash"), (Window.unboundedPreceding, Window.currentRow)
    source = Window.partitionBy("source_id", "part").orderBy("source_job_id", "unnamed", *order)
    job = Window.partitionBy("source_id", "part", "source_job_id", "unnamed").orderBy(*order)
    rows = rows.withColumn("polled", F.min("kind").over(source.rowsBetween(*so_far)) == 0).filter("kind = 2 OR (kind = 1 AND polled)")
    met = {"s": F.first("s").over(job.rowsBetween(*so_far)), "nth": F.sum(F.col("kind") - 1).over(job.rowsBetween(*so_far)), "next": F.lead("kind").over(job)}
    met = rows.withColumns(met).filter("kind = 2 OR next IS NULL")
    stored, seen = F.col("kind") == 2, F.col("s").isNotNull()
    return met.select(*key, "p", "s", "nth", "polled", stored.alias("stored"), seen.alias("seen"), (seen & (~stored | ((F.col("nth") == 1) & F.col("p.opportunity_id").isNull()))).alias("new"))


def _new_jobs(matched: DataFrame, provenance: DataFrame) -> DataFrame:
    """Postings that are new to their source, as ``classify`` gives them: created or linked."""
    new = matched.filter("new").select("source_id", "source_job_id", "s.*", F.lit(None).cast(provenance.schema["opportunity_id"].dataType).alias("opportunity_id"), F.lit("created").alias("outcome"))
    if not all({*BOARD} <= {*t.columns} for t in (new, provenance)) or matched.filter("new").isEmpty():
        return new
    named = F.col("ats_type").isNotNull() & F.col("ats_job_id").isNotNull()
    by_board = provenance.filter(named).groupBy(*BOARD).agg(F.min("opportunity_id").alias("board_id"))
    first = F.min(F.struct("source_id", "source_job_id")).over(Window.partitionBy(*BOARD))
    linked = _linked(new.filter(named).join(by_board, list(BOARD), "left").withColumn("first", first), provenance)
    return cut(linked.unionByName(new.filter(~named)), "new", "zstd")


#: What a posting says, under the names of the stored rows.
SAID = ("title_raw", "description_text", "work_mode", "location_region", "language", "content_hash")


def sightings(classified: DataFrame) -> DataFrame:
    """``id`` and ``n``, one row for each known posting that a batch saw, through however many sources.

    An updated one wins, of several the one with the newest claimed date, then by hash, source and job;
    ``claims`` are the claimed dates of the unchanged ones and ``claim`` is the newest of all.
    """
    said = [c for c in SAID if c in classified.columns]
    order = F.struct(F.coalesce("source_reported_posted_at", F.lit("0001-01-01").cast("timestamp")), "content_hash", "source_id", "source_job_id")
    changed = F.col("outcome") == "updated"
    one = classified.filter("opportunity_id IS NOT NULL AND outcome <> 'linked'").groupBy(F.col("opportunity_id").alias("id")).agg(
        F.max(changed).alias("changed"),
        F.max_by(F.struct(*said, "source_reported_posted_at"), F.struct(changed, order)).alias("said"),
        F.collect_list(F.when(~changed, F.col("source_reported_posted_at"))).alias("claims"),
        F.max("source_reported_posted_at").alias("claim"),
    )
    return one.select("id", F.struct("changed", "said", "claims", "claim").alias("n"))


def reconcile(opps: DataFrame, classified: DataFrame, now: Column, strict_refresh: bool = False) -> DataFrame:
    """``opps`` after a poll, one row for each of its rows and all its columns: seen ones are touched and
    reopened, changed ones re-enter the pipeline, new ones appear.

    A refresh is an unchanged posting whose claimed date is after the one at its last change (with
    ``strict_refresh``: after its last claim); each source that shows one counts, none where another
    source shows a change. New rows take their id from source and job, and null in columns that a poll
    doesn't know.
    """
    kept = _touched(opps.join(sightings(classified), "id", "left"), opps, now, strict_refresh)
    return kept.unionByName(_created(opps, classified, now), allowMissingColumns=True)


def _touched(old: DataFrame, opps: DataFrame, now: Column, strict_refresh: bool = False) -> DataFrame:
    """``opps`` after what ``n`` says of them (see ``sightings``); ``old`` has both, and other columns stay."""
    seen, sayable = F.col("n").isNotNull(), old.schema["n"].dataType["said"].dataType.names
    changed = F.coalesce(F.col("n.changed"), F.lit(False))
    before = F.col("source_reported_posted_at") if strict_refresh else F.col("source_posted_at_at_last_change")
    refreshes = F.when(seen & ~changed, F.size(F.filter("n.claims", lambda c: c > before))).otherwise(0)
    said = {c: F.when(changed, F.col(f"n.said.{c}")).otherwise(F.col(c)) for c in SAID if c in sayable}
    new = said | {
        "title_normalized": F.when(changed, X.collapse_lower(F.col("n.said.title_raw"))).otherwise(F.col("title_normalized")),
        "source_reported_posted_at": F.when(changed, F.col("n.said.source_reported_posted_at")).when(seen, F.coalesce("n.claim", "source_reported_posted_at")).otherwise(F.col("source_reported_posted_at")),
        "source_posted_at_at_last_change": F.when(changed, F.col("n.said.source_reported_posted_at")).otherwise(F.col("source_posted_at_at_last_change")),
        "pipeline_state": F.when(changed, "parsed").otherwise(F.col("pipeline_state")),
        "state_entered_at": F.when(changed & (F.col("pipeline_state") != "parsed"), now).otherwise(F.col("state_entered_at")),
        "next_attempt_at": F.when(changed, now).otherwise(F.col("next_attempt_at")),
        "attempts": F.when(changed, 0).otherwise(F.col("attempts")),
        "last_error": F.when(~changed, F.col("last_error")),
        "version": F.col("version") + changed.cast("int"),
        "repost_count": F.col("repost_count") + refreshes,
        "last_seen_at": F.when(seen, now).otherwise(F.col("last_seen_at")),
        "liveness_checked_at": F.when(seen, now).otherwise(F.col("liveness_checked_at")),
        "consecutive_misses": F.when(seen, 0).otherwise(F.col("consecutive_misses")),
        "closed_at": F.when(~seen, F.col("closed_at")),
        "close_reason": F.when(~seen, F.col("close_reason")),
    }
    return old.withColumns({c: e.cast(opps.schema[c].dataType) for c, e in new.items() if c in opps.columns}).drop("n")


def _created(opps: DataFrame, classified: DataFrame, now: Column) -> DataFrame:
    first = {
        "id": new_id(), "title_normalized": X.collapse_lower(F.col("title_raw")), "source_posted_at_at_last_change": F.col("source_reported_posted_at"), "pipeline_state": F.lit("parsed"),
        "apply_method": F.col("ats_type") if "ats_type" in classified.columns else F.lit(None).cast("string"),
        "attempts": F.lit(0), "version": F.lit(1), "repost_count": F.lit(0), "consecutive_misses": F.lit(0),
    } | {c: now for c in ("state_entered_at", "next_attempt_at", "first_seen_at", "last_seen_at", "liveness_checked_at")}
    created = classified.filter("outcome = 'created'").withColumns(first)
    return created.select(*[F.col(c).cast(opps.schema[c].dataType) for c in opps.columns if c in created.columns])


def new_id(source: str = "source_id", job: str = "source_job_id") -> Column:
    return F.sha2(F.concat_ws("\u0000", source, job), 256)


def reconcile_sources(provenance: DataFrame, classified: DataFrame, now: Column) -> DataFrame:
    """Provenance rows after a poll: known ones are touched, new ones point at the new rows or at those that they are linked to."""
    seen = classified.select("source_id", "source_job_id", F.struct("content_hash").alias("seen"))
    hit = F.col("seen").isNotNull()
    old = provenance.join(seen, ["source_id", "source_job_id"], "left")
    old = old.withColumns({"last_seen_at": F.when(hit, now).otherwise(F.col("last_seen_at")), "content_hash": F.when(hit, F.col("seen.content_hash")).otherwise(F.col("content_hash"))}).select(*provenance.columns)
    return old.unionByName(_new_sources(provenance, classified, now), allowMissingColumns=True)


def _new_sources(provenance: DataFrame, classified: DataFrame, now: Column) -> DataFrame:
    linked = F.col("outcome") == "linked"
    new = classified.filter("outcome IN ('created', 'linked')").withColumns(
        {"opportunity_id": F.when(linked, F.col("opportunity_id")).otherwise(new_id()), "last_seen_at": now, "created_at": now, "source_row_id": new_id(), "merge_reason": F.when(linked, "exact_ats"), "merge_confidence": F.when(linked, F.lit(1.0).cast("float")), "merged_by": F.lit("ingest")}
    )
    return new.select(*[c for c in new.columns if c in provenance.columns])


def absent(opps: DataFrame, provenance: DataFrame, seen: DataFrame) -> DataFrame:
    """Ids of open rows that a polled source has and did not show; ``seen``: source_id, source_job_id of successful polls."""
    polled = provenance.join(seen.select("source_id").distinct(), "source_id", "left_semi")
    shown = polled.join(seen.select("source_id", "source_job_id"), ["source_id", "source_job_id"], "left_semi").select("source_id", "opportunity_id").distinct()
    missing = polled.select("source_id", "opportunity_id").distinct().join(shown, ["source_id", "opportunity_id"], "left_anti")
    open_ids = opps.filter("closed_at IS NULL").select(F.col("id").alias("opportunity_id"))
    return open_ids.join(missing.select("opportunity_id").distinct(), "opportunity_id", "left_semi").select(F.col("opportunity_id").alias("id"))


def bump_and_close(opps: DataFrame, missing: DataFrame, now: Column, most: int = MAX_MISSES) -> DataFrame:
    """Absent rows miss once more; open rows with too many misses close, whatever their source."""
    hit = missing.select("id", F.lit(1).alias("missed"))
    return _bumped(opps.join(hit, "id", "left"), now, most).select(*opps.columns)


def _bumped(opps: DataFrame, now: Column, most: int = MAX_MISSES) -> DataFrame:
    """``opps`` with ``missed`` (1 or null)."""
    bumped = opps.withColumn("consecutive_misses", F.col("consecutive_misses") + F.coalesce("missed", F.lit(0)))
    if "liveness_checked_at" in opps.columns:
        bumped = bumped.withColumn("liveness_checked_at", F.when(F.col("missed").isNotNull(), now).otherwise(F.col("liveness_checked_at")))
    close = F.col("closed_at").isNull() & (F.col("consecutive_misses") >= most)
    return bumped.withColumns({"closed_at": F.when(close, now).otherwise(F.col("closed_at")), "close_reason": F.when(close, "absent").otherwise(F.col("close_reason"))})


def said_texts(texts: DataFrame, classified: DataFrame) -> DataFrame:
    """``texts`` (id, description_text) of postings after a poll: those of changed rows are replaced, those of new ones added."""
    changed = sightings(classified).filter("n.changed").select("id", F.col("n.said.description_text").alias("description_text"))
    new = changed.unionByName(classified.filter("outcome = 'created'").select(new_id().alias("id"), "description_text"))
    return texts.join(new.select("id"), "id", "left_anti").select("id", "description_text").unionByName(new)


def poll(opps: DataFrame, provenance: DataFrame, postings: DataFrame, polled: DataFrame, now: Column, texts: DataFrame | None = None) -> dict[str, DataFrame]:
    """One batch of polls. ``polled``: source_id, status (ok, not_modified or failed).

    Only sources that answered with content change liveness: an unmodified or failed poll closes nothing.
    ``texts`` are given where they are kept apart from ``opps``.
    """
    ok = polled.filter("status = 'ok'").select("source_id").distinct()
    matched = cut(match(postings, provenance, ok), "matched", "zstd")  # parsed and matched once for all that follows
    new = _new_jobs(matched, provenance)
    old = _touched(opps.join(_told(matched, new), "id", "left"), opps, now).withColumn("missed", F.when(F.col("missed") & F.col("closed_at").isNull(), 1))
    out = {"opportunity": _bumped(old.unionByName(_created(opps, new, now), allowMissingColumns=True), now).select(*opps.columns), "opportunity_source": _sources(matched, new, provenance, now)}
    if texts is None:
        return out
    known = matched.filter("seen AND nth = 1 AND NOT new").select("source_id", "source_job_id", "s.*", "p.opportunity_id", F.when(_same(), "unchanged").otherwise("updated").alias("outcome"))
    return out | {"opportunity_text": said_texts(texts, known.unionByName(new))}


def _same() -> Column:
    return F.col("p.content_hash").eqNullSafe(F.col("s.content_hash"))


def _told(matched: DataFrame, new: DataFrame) -> DataFrame:
    """``id``, ``n`` as ``sightings`` gives it and ``missed``: a polled source has the posting and showed none of its jobs.

    A posting's rows are dealt once, and only changed ones carry what they say.
    """
    said = [c for c in SAID if c in matched.schema["s"].dataType.names]
    sighted = F.col("seen") & (F.col("nth") == 1)
    changed = sighted & ~_same()
    order = F.struct(F.coalesce("s.source_reported_posted_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), F.col("s.content_hash").alias("hash"), "source_id", "source_job_id")
    rows = matched.filter("stored AND p.opportunity_id IS NOT NULL AND (seen OR polled)").select(
        F.col("p.opportunity_id").alias("id"), "source_id", "seen", F.when(sighted, changed).alias("changed"),
        F.when(changed, F.struct(order.alias("order"), *[F.col(f"s.{c}").alias(c) for c in dict.fromkeys([*said, "source_reported_posted_at"])])).alias("said"),
        F.when(sighted, F.col("s.source_reported_posted_at")).alias("claim"),
    )
    linked = new.filter("outcome = 'linked' AND opportunity_id IS NOT NULL").select(F.col("opportunity_id").alias("id"), "source_id", F.lit(True).alias("seen"))
    each = rows.unionByName(linked, allowMissingColumns=True).repartition("id").groupBy("id", "source_id").agg(
        F.max("seen").alias("seen"), F.max("changed").alias("changed"), F.max("said").alias("said"), F.collect_list(F.when(~F.col("changed"), F.col("claim"))).alias("claims"), F.max("claim").alias("claim")
    )
    one = each.groupBy("id").agg((~F.min("seen")).alias("missed"), F.max("changed").alias("changed"), F.max("said").alias("said"), F.flatten(F.collect_list("claims")).alias("claims"), F.max("claim").alias("claim"))
    return one.select("id", "missed", F.when(F.col("changed").isNotNull(), F.struct("changed", "said", "claims", "claim")).alias("n"))


def _sources(matched: DataFrame, new: DataFrame, provenance: DataFrame, now: Column) -> DataFrame:
    """Provenance rows after a poll, as ``reconcile_sources`` gives them."""
    seen = {"last_seen_at": now, "content_hash": F.col("s.content_hash")}
    kept = {c: F.when(F.col("seen"), seen[c]).otherwise(F.col(f"p.{c}")) if c in seen else F.col(f"p.{c}") for c in provenance.columns if c not in ("source_id", "source_job_id")}
    old = matched.filter("stored").select(*[kept[c].alias(c) if c in kept else c for c in provenance.columns])
    return old.unionByName(_new_sources(provenance, new, now), allowMissingColumns=True)


def counted(postings: DataFrame, polled: DataFrame) -> DataFrame:
    """What each poll of a batch counts: source_id, status, discovered, processed, parse_yield and the health counters.

    A poll that failed or found nothing changed observed no postings, and counts none.
    """
    ok = polled.filter("status = 'ok'").select("source_id").distinct()
    said = {f"said_{c}": F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "") if c in postings.columns else F.lit(0) for c in ("company_name", "location_region", "apply_url", "language")}
    usable = (F.trim(F.coalesce("source_job_id", F.lit(""))) != "") & (F.trim(F.coalesce("title_raw", F.lit(""))) != "")
    count = postings.join(ok, "source_id", "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("discovered"), F.count_if(usable).alias("processed"), *[e.alias(c) for c, e in said.items()])
    each = polled.groupBy("source_id").agg(F.max(F.struct(F.col("status") == "ok", "status")).alias("s")).select("source_id", "s.status").join(count, "source_id", "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("discovered", "processed", *said)}
    counters = {"postings": n["discovered"], "usable": n["processed"], "company": n["said_company_name"], "location": n["said_location_region"], "apply_url": n["said_apply_url"], "language": n["said_language"], "salary": F.lit(0)}
    bookkeeping = {"discovered": n["discovered"], "processed": n["processed"], "parse_yield": F.when(n["discovered"] == 0, 1.0).otherwise(n["processed"] / n["discovered"])}
    return each.select("source_id", "status", *[e.cast("double" if c == "parse_yield" else "long").alias(c) for c, e in (counters | bookkeeping).items()])


def upsert(stored: DataFrame, new: DataFrame, key: list[str], merge: dict[str, Column] | None = None) -> DataFrame:
    """Rows of both by ``key``; ``merge`` gives columns in terms of ``old.x`` and ``new.x``, others are the new row's."""
    values = [c for c in stored.columns if c not in key]
    o = stored.select(*key, F.struct(*values).alias("old"))
    n = new.select(*key, F.struct(*values).alias("new"))
    both = o.join(n, key, "full_outer")
    merge = merge or {}
    return both.select(*key, *[F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(merge.get(c, F.col(f"new.{c}"))).alias(c) for c in values]).select(*stored.columns)


def upsert_companies(stored: DataFrame, new: DataFrame) -> DataFrame:
    """By lower-case domain; a name that isn't empty replaces the old one."""
    low = new.withColumn("canonical_domain", F.lower("canonical_domain"))
    return upsert(stored, low, ["canonical_domain"], {"display_name": F.coalesce(F.nullif("new.display_name", F.lit("")), "old.display_name"), "id": F.col("old.id")})


def drop_companies(opps: DataFrame, companies: DataFrame) -> DataFrame:
    """``opps`` without the postings of ``companies`` (company_id)."""
    return opps.join(companies.select("company_id"), "company_id", "left_anti").select(*opps.columns)


def source_results(sources: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Bookkeeping of a batch: ``results`` has source_id, ok, discovered, processed, parse_yield, error."""
    r = results.select("source_id", F.struct("ok", "discovered", "processed", "parse_yield", "error").alias("r"))
    found = sources.join(r, "source_id", "left")
    ok, bad = F.col("r.ok") == F.lit(True), F.col("r.ok") == F.lit(False)
    new = {
        "last_success_at": F.when(ok, now).otherwise(F.col("last_success_at")),
        "last_failure_at": F.when(bad, now).otherwise(F.col("last_failure_at")),
        "last_error": F.when(bad, F.col("r.error")).when(~ok | F.col("r").isNull(), F.col("last_error")),
        "items_discovered": F.col("items_discovered") + F.when(ok, F.col("r.discovered")).otherwise(0),
        "items_processed": F.col("items_processed") + F.when(ok, F.col("r.processed")).otherwise(0),
        "parse_yield_7d": F.when(ok, F.floor(F.col("r.parse_yield") * 10000) / 10000).otherwise(F.col("parse_yield_7d")),
    }
    return found.withColumns(new).select(*sources.columns)


def save_cursors(schedules: DataFrame, sources: DataFrame, polled: DataFrame, now: Column) -> DataFrame:
    """Schedules after a poll: ``polled`` has source_id and the new cursor; the lease ends and the next run is a source's interval (seconds) away."""
    interval = sources.select("source_id", "poll_interval_s")
    got = polled.join(interval, "source_id", "left").select("source_id", F.struct(F.col("cursor"), F.col("poll_interval_s")).alias("p"))
    found, hit = schedules.join(got, "source_id", "left"), F.col("p").isNotNull()
    next_run = F.timestamp_micros(F.unix_micros(now) + F.col("p.poll_interval_s") * 1_000_000)
    new = {
        "cursor": F.when(hit, F.col("p.cursor")).otherwise(F.col("cursor")),
        "last_run_at": F.when(hit, now).otherwise(F.col("last_run_at")),
        "lease_until": F.when(~hit, F.col("lease_until")),
        "next_run_at": F.when(hit, next_run).otherwise(F.col("next_run_at")),
    }
    return found.withColumns(new).select(*schedules.columns)


def mark_health(sources: DataFrame, verdicts: DataFrame, quarantine_after: int = QUARANTINE_AFTER) -> DataFrame:
    """Sources after an evaluation: ``verdicts`` has source_id, status (healthy, degraded or unknown) and note.

    A degraded one counts up and is quarantined when that lasts; a healthy one is cleared; unknown does neither.
    """
    found = sources.join(verdicts.select("source_id", F.struct("status", "note").alias("v")), "source_id", "left")
    bad, good = F.coalesce(F.col("v.status") == "degraded", F.lit(False)), F.coalesce(F.col("v.status") == "healthy", F.lit(False))
    count = F.when(bad, F.col("consecutive_degraded") + 1).when(good, 0).otherwise(F.col("consecutive_degraded"))
    cleared = good & (F.col("consecutive_degraded") != 0)
    new = {
        "status": F.when(bad & (count >= quarantine_after) & (F.col("status") == "active"), "quarantined").otherwise(F.col("status")),
        "last_health_note": F.when(bad, F.col("v.note")).when(~cleared, F.col("last_health_note")),
        "consecutive_degraded": count,
    }
    return found.withColumns(new).select(*sources.columns)


def review_sources(sources: DataFrame, reviews: DataFrame, now: Column) -> DataFrame:
    """Sources after a terms review: ``reviews`` has source_id, reviewed_by and platform_review_ref."""
    found = sources.join(reviews.select("source_id", F.struct("reviewed_by", "platform_review_ref").alias("r")), "source_id", "left")
    hit = F.col("r").isNotNull()
    new = {c: F.when(hit, F.col(f"r.{c}")).otherwise(F.col(c)) for c in ("reviewed_by", "platform_review_ref")}
    return found.withColumns(new | {"terms_reviewed_at": F.when(hit, now).otherwise(F.col("terms_reviewed_at"))}).select(*sources.columns)


def upsert_sources(stored: DataFrame, new: DataFrame) -> DataFrame:
    """By name; of a known source only its type is overwritten."""
    kept = {c: F.col(f"old.{c}") for c in stored.columns if c not in ("name", "type")}
    return upsert(stored, new, ["name"], kept)


def upsert_schedules(stored: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """``new`` has source_id and cursor: the schedule is due at once with that cursor; a known one keeps its lease and last run."""
    due = new.withColumn("next_run_at", now).select("source_id", *[F.col(c).cast(t) if c in ("cursor", "next_run_at") else F.lit(None).cast(t).alias(c) for c, t in stored.dtypes if c != "source_id"])
    return upsert(stored, due, ["source_id"], {c: F.col(f"old.{c}") for c in stored.columns if c not in ("source_id", "cursor", "next_run_at")})
