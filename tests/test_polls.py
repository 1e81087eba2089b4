"""The poll cycle on small tables: one row for each posting, all columns, racing writers, bookkeeping."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vacantia.operators import dedupe, ingest, queue
from vacantia.sources.store import StaleCommit, TableStore
from vacantia.streaming.polls import LANDED, apply_batch, sweep

NOW = datetime(2026, 8, 21, 12)
OPP = """id string, company_id string, title_raw string, title_normalized string, description_text string, work_mode string, location_region string, language string, content_hash string,
source_reported_posted_at timestamp, source_posted_at_at_last_change timestamp, pipeline_state string, state_entered_at timestamp, attempts int, last_error string, lease_until timestamp,
next_attempt_at timestamp, swept_at timestamp, version int, repost_count int, first_seen_at timestamp, last_seen_at timestamp, liveness_checked_at timestamp, consecutive_misses int,
closed_at timestamp, close_reason string, merged_into string, role_family string, simhash long"""
PROV = "source_row_id string, opportunity_id string, source_id string, source_job_id string, ats_type string, ats_job_id string, apply_url string, content_hash string, last_seen_at timestamp, created_at timestamp, merge_reason string, merge_confidence float, merged_by string"


def board(jobs):
    return json.dumps({"jobs": [{"id": i, "title": t, "content": c, "absolute_url": f"https://x/{i}", "location": {"name": "Remote"}, "company_name": "C", "language": "en", "updated_at": "2026-08-01T00:00:00Z", "first_published": "2026-08-01T00:00:00Z"} for i, t, c in jobs]})


def landed(spark, rows):
    return spark.createDataFrame([(s, "c", status, NOW, body, cursor, error) for s, status, body, cursor, error in rows], LANDED)


@pytest.fixture
def store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    store.commit({"opportunity": spark.createDataFrame([], OPP), "opportunity_source": spark.createDataFrame([], PROV)})
    return store


def test_linked_sources_keep_one_row_and_every_column(spark, store):
    """A board seen through two sources is one posting, also in later polls; what other stages know stays."""
    apply_batch(store, landed(spark, [("a", "ok", board([(1, "A", "x")]), None, None)]), 0, F.lit(NOW))
    rows = store.read("opportunity").withColumns({"role_family": F.lit("backend"), "simhash": F.lit(7).cast("long"), "pipeline_state": F.lit("enriched"), "last_error": F.lit("boom"), "lease_until": F.lit(NOW)})
    store.commit({"opportunity": rows})
    for k, text in enumerate(["x", "x", "y"]):
        batch = [(s, "ok", board([(1, "A", text)]), None, None) for s in ("a", "b")]
        apply_batch(store, landed(spark, batch), k + 1, F.lit(NOW + timedelta(hours=k + 1)))
        r = store.read("opportunity").collect()
        assert len(r) == 1 and r[0]["role_family"] == "backend" and r[0]["simhash"] == 7 and r[0]["work_mode"] == "remote"
    assert (r[0]["version"], r[0]["pipeline_state"], r[0]["last_error"]) == (2, "parsed", None)
    assert r[0]["next_attempt_at"] == r[0]["liveness_checked_at"] == NOW + timedelta(hours=3)
    assert store.read("opportunity").schema == spark.createDataFrame([], OPP).schema
    sources = {s["source_id"]: s for s in store.read("opportunity_source").collect()}
    assert (sources["b"]["merge_reason"], sources["b"]["merge_confidence"], sources["a"]["merge_reason"]) == ("exact_ats", 1.0, None)
    version = sweep(store, F.lit(NOW + timedelta(hours=9)))
    assert store.manifest()["version"] == version and store.read("opportunity").first()["swept_at"] == NOW + timedelta(hours=9)
    assert queue.stranded(store.read("opportunity"), 5, F.lit(NOW + timedelta(hours=20))).count() == 1


def test_refreshes_of_several_sources_count(spark):
    classified = spark.createDataFrame(
        [("a", "1", "h", NOW + timedelta(days=1), "o", "unchanged"), ("b", "1", "h", NOW + timedelta(days=2), "o", "unchanged"), ("c", "1", "h", None, "o", "unchanged")],
        "source_id string, source_job_id string, content_hash string, source_reported_posted_at timestamp, opportunity_id string, outcome string",
    ).withColumn("title_raw", F.lit("T")).withColumn("company_id", F.lit("c"))
    opps = spark.createDataFrame([("o", "T", "t", NOW, NOW, 0)], "id string, title_raw string, title_normalized string, source_reported_posted_at timestamp, source_posted_at_at_last_change timestamp, repost_count int")
    r = ingest.reconcile(opps, classified, F.lit(NOW)).collect()
    assert len(r) == 1 and (r[0]["repost_count"], r[0]["source_reported_posted_at"]) == (2, NOW + timedelta(days=2))


def test_a_losing_writer_leaves_the_winner_alone(spark, store, monkeypatch):
    base = store.manifest()["version"]
    late, put = TableStore(spark, store.root), TableStore._put

    def race(self, path, text):
        if self is late and path.getName().endswith(".tmp"):
            store.commit({"opportunity_source": spark.range(7)}, expected=base)
        put(self, path, text)

    monkeypatch.setattr(TableStore, "_put", race)
    with pytest.raises(StaleCommit):
        late.commit({"opportunity_source": spark.range(100)}, expected=base)
    assert store.read("opportunity_source").count() == 7 and store.manifest()["version"] == base + 1


def test_purge_leaves_the_version_in_force(spark, store, tmp_path):
    for n in (1, 2, 3):
        store.commit({"opportunity": spark.range(n)})
    assert store.purge(["opportunity", "nothing"]) == 3
    assert store.read("opportunity").count() == 3 and len(list((tmp_path / "store" / "opportunity").iterdir())) == 1


def test_a_merge_keeps_other_reasons(spark):
    opps = spark.createDataFrame([("o1", 1, None), ("o2", 1, None), ("o3", 1, None)], "id string, version int, merged_into string")
    sources = spark.createDataFrame([("s1", "o1", "exact_ats", 1.0), ("s2", "o2", "exact_ats", 1.0), ("s3", "o3", None, None)], "source_row_id string, opportunity_id string, merge_reason string, merge_confidence float")
    merges = spark.createDataFrame([("o2", "o1", "content_hash", 0.99)], "from_id string, into_id string, reason string, confidence float")
    out = dedupe.apply_merges(opps, sources, merges, F.lit(NOW))
    got = {r["source_row_id"]: (r["opportunity_id"], r["merge_reason"]) for r in out["opportunity_source"].collect()}
    assert got == {"s1": ("o1", "exact_ats"), "s2": ("o1", "content_hash"), "s3": ("o3", None)}
    assert out["opportunity_source"].columns == sources.columns or set(out["opportunity_source"].columns) == set(sources.columns)
    bare = dedupe.apply_merges(opps, sources.drop("merge_reason", "merge_confidence"), merges, F.lit(NOW))["opportunity_source"]
    assert {r["merge_reason"] for r in bare.collect()} == {None, "content_hash"}


def test_bookkeeping_of_a_batch(spark, store):
    """Results, cursors, counters and marks go with the postings' commit; failed and unmodified polls judge nothing."""
    day = NOW.date()
    store.commit({
        "source": spark.createDataFrame([(s, "active", None, None, None, 0, 0, None, 2 if s == "bad" else 1, "note", 600) for s in ("good", "bad", "down", "same")], "source_id string, status string, last_success_at timestamp, last_failure_at timestamp, last_error string, items_discovered long, items_processed long, parse_yield_7d double, consecutive_degraded int, last_health_note string, poll_interval_s int"),
        "source_schedule": spark.createDataFrame([(s, "old", None, NOW, NOW) for s in ("good", "bad", "down", "same")], "source_id string, cursor string, last_run_at timestamp, lease_until timestamp, next_run_at timestamp"),
        "source_health": spark.createDataFrame([(s, day - timedelta(days=2), 100, 100, 100, 100, 100, 100, 0) for s in ("good", "bad")], "source_id string, day date, postings long, usable long, company long, location long, apply_url long, language long, salary long"),
    })
    jobs = [(k, f"T{k}", "x") for k in range(1, 31)]
    empty = json.dumps({"jobs": [{"id": k, "title": "T", "content": ""} for k in range(1, 31)]})
    rows = [("good", "ok", board(jobs), "new", None), ("bad", "ok", empty, "new", None), ("down", "failed", None, None, "503"), ("same", "not_modified", None, None, None)]
    apply_batch(store, landed(spark, rows), 0, F.lit(NOW))
    source = {r["source_id"]: r for r in store.read("source").collect()}
    assert (source["good"]["consecutive_degraded"], source["good"]["last_health_note"], source["good"]["items_processed"], source["good"]["parse_yield_7d"]) == (0, None, 30, 1.0)
    assert (source["bad"]["status"], source["bad"]["consecutive_degraded"]) == ("quarantined", 3) and "populated on 0%" in source["bad"]["last_health_note"]
    assert (source["down"]["last_error"], source["down"]["last_failure_at"], source["down"]["last_success_at"], source["down"]["consecutive_degraded"]) == ("503", NOW, None, 1)
    assert (source["same"]["last_success_at"], source["same"]["consecutive_degraded"]) == (NOW, 1)
    schedule = {r["source_id"]: (r["cursor"], r["lease_until"], r["next_run_at"]) for r in store.read("source_schedule").collect()}
    later = NOW + timedelta(seconds=600)
    assert schedule == {"good": ("new", None, later), "bad": ("new", None, later), "down": ("old", NOW, NOW), "same": ("old", None, later)}
    health = {r["source_id"]: r["postings"] for r in store.read("source_health").filter(F.col("day") == F.lit(day)).collect()}
    assert health == {"good": 30, "bad": 30, "down": 0, "same": 0}
    before = store.manifest()["version"]
    apply_batch(store, landed(spark, rows), 0, F.lit(NOW))
    assert store.manifest()["version"] == before


def test_sources_and_schedules(spark):
    stored = spark.createDataFrame([("n", "t1", 1), ("m", "t1", 2)], "name string, type string, tier int")
    got = ingest.upsert_sources(stored, spark.createDataFrame([("n", "t2", 9), ("new", "t3", 3)], stored.schema))
    assert {tuple(r) for r in got.collect()} == {("n", "t2", 1), ("m", "t1", 2), ("new", "t3", 3)}
    schedules = spark.createDataFrame([("a", "c", NOW, NOW, NOW)], "source_id string, cursor string, last_run_at timestamp, lease_until timestamp, next_run_at timestamp")
    later = NOW + timedelta(days=1)
    got = ingest.upsert_schedules(schedules, spark.createDataFrame([("a", "d"), ("b", "e")], "source_id string, cursor string"), F.lit(later))
    assert {tuple(r) for r in got.collect()} == {("a", "d", NOW, NOW, later), ("b", "e", None, None, later)}
    sources = spark.createDataFrame([("a", None, None, None), ("b", "x", NOW, "r1")], "source_id string, reviewed_by string, terms_reviewed_at timestamp, platform_review_ref string")
    got = ingest.review_sources(sources, spark.createDataFrame([("a", "me", "r2")], "source_id string, reviewed_by string, platform_review_ref string"), F.lit(later))
    assert {tuple(r) for r in got.collect()} == {("a", "me", later, "r2"), ("b", "x", NOW, "r1")}
