"""A poll matches each row once; what comes out is what its parts give one by one."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.test_shuffles import DIR, exchanges
from vacantia.operators import ingest
from vacantia.plans import queries

NOW = datetime(2026, 8, 21, 12)
OPP = """id string, title_raw string, title_normalized string, work_mode string, content_hash string, source_reported_posted_at timestamp, source_posted_at_at_last_change timestamp, pipeline_state string,
state_entered_at timestamp, attempts int, next_attempt_at timestamp, version int, repost_count int, first_seen_at timestamp, last_seen_at timestamp, liveness_checked_at timestamp, consecutive_misses int, closed_at timestamp, close_reason string"""
PROV = "source_row_id string, opportunity_id string, source_id string, source_job_id string, ats_type string, ats_job_id string, content_hash string, last_seen_at timestamp, merge_reason string, merge_confidence float"
POST = "source_id string, source_job_id string, ats_type string, ats_job_id string, title_raw string, work_mode string, content_hash string, source_reported_posted_at timestamp"


def plainly(opps, provenance, postings, polled, now):
    ok = polled.filter("status = 'ok'").select("source_id").distinct()
    classified = ingest.classify(postings.join(ok, "source_id", "left_semi"), provenance)
    rows, sources = ingest.reconcile(opps, classified, now), ingest.reconcile_sources(provenance, classified, now)
    seen = ok.join(classified.select("source_id", "source_job_id"), "source_id", "left")
    return {"opportunity": ingest.bump_and_close(rows, ingest.absent(rows, sources, seen), now), "opportunity_source": sources}


def test_poll_equals_its_parts(spark):
    """Repeated provenance and postings, stored jobs and sources without a name, failed polls, empty boards, linked and merged postings."""
    for seed in range(2):
        r = random.Random(seed)
        pick, day = (lambda *v: r.choice(v)), (lambda: r.choice([None, *[NOW + timedelta(days=k) for k in range(-2, 3)]]))
        opps = spark.createDataFrame([(f"o{k}", "T", "t", "remote", "h1", day(), day(), pick("parsed", "ready"), NOW, k, NOW, 1, 0, NOW, NOW, NOW, pick(0, 1), pick(None, NOW), None) for k in range(40)], OPP)
        board = lambda k: (pick("gh", "gh", None), pick(f"{k}", f"{k}", None))
        provenance = spark.createDataFrame([(f"r{k}", pick(f"o{k % 40}", f"o{k % 40}", f"o{r.randrange(40)}", None), pick("a", "b", "c", "d", "e", None), pick(f"{k % 50}", f"{k % 50}", None), *board(k % 40), pick("h1", "h2", None), NOW, None, None) for k in range(160)], PROV)
        postings = spark.createDataFrame([(pick("a", "b", "c", "d", None), f"{k}", *board(r.randrange(60)), pick("A", "B"), "hybrid", pick("h1", "h2", None), day()) for k in [r.randrange(70) for _ in range(220)]], POST)
        polled = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("b", "failed"), ("c", "failed"), ("e", "ok"), (None, "ok")], "source_id string, status string")
        now = F.lit(NOW + timedelta(days=1))
        got, want = (f(opps, provenance, postings, polled, now) for f in (ingest.poll, plainly))
        for name, df in want.items():
            rows = [sorted(map(repr, (tuple(x[c] for c in df.columns) for x in t.collect()))) for t in (got[name], df)]
            assert rows[0] == rows[1], name


def test_polls_deal_their_rows_once(spark, monkeypatch):
    keys, found = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"), []
    real = ingest.cut

    def counted(df, *named):
        plan = df._jdf.queryExecution().executedPlan().toString()
        found.append(sum("Exchange hashpartitioning" in line for line in plan.splitlines()))
        return real(df, *named)

    monkeypatch.setattr(ingest, "cut", counted)
    monkeypatch.setattr(queries, "cut", counted)
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        assert exchanges(queries.queries()["poll_reconcile"](spark, DIR)) + sum(found) <= 20
    finally:
        for k in keys:
            spark.conf.unset(k)
