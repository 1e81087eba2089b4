"""The stored stages: batches of due rows, merges with their provenance and log, the queue of weak pairs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_dedupe import MEMBER, candidates, walk
from vacantia.functions import policy as P
from vacantia.operators import dedupe
from vacantia.sources.store import StaleCommit, TableStore
from vacantia.streaming import stages

NOW = datetime(2026, 8, 21, 12)
QUEUE = {"version": 1, "attempts": 2, "last_error": "late", "merged_into": None, "lease_until": None, "closed_at": None}
KINDS = {"version": "int", "attempts": "int", "last_error": "string", "merged_into": "long", "lease_until": "timestamp", "closed_at": "timestamp"}


def queued(rows, state):
    """``rows`` with the columns of a queue; they are due in order of their age."""
    due = F.timestamp_micros(F.unix_micros(F.lit(NOW)) - F.lit(10_000_000) + F.col("first_seen_at"))
    more = {c: F.lit(v).cast(KINDS[c]) for c, v in QUEUE.items()}
    return rows.withColumns(more | {"pipeline_state": F.lit(state), "next_attempt_at": due, "state_entered_at": F.lit(NOW - timedelta(days=1))})


@pytest.fixture
def store(spark, tmp_path):
    """Normalised rows with one provenance row each, as old as they are, which holds board identity and address."""
    found = spark.createDataFrame(candidates(), MEMBER).filter("company_id IS NOT NULL")
    rows = found.withColumns({"title_normalized": F.col("title"), "remote_geo_scope": F.col("geo_scope"), "description_text": F.repeat(F.lit("x"), F.col("text_len"))})
    sources = found.select(F.col("id").alias("opportunity_id"), F.lpad(F.col("id").cast("string"), 6, "0").alias("source_row_id"), "ats_type", "ats_job_id", "apply_url", F.timestamp_seconds("first_seen_at").alias("created_at"), F.lit("ingest").alias("merged_by"))
    store = TableStore(spark, str(tmp_path / "store"))
    store.commit({"opportunity": queued(rows.drop("title", "geo_scope", "text_len", "ats_type", "ats_job_id", "apply_url"), "normalized"), "opportunity_source": sources})
    return store


def model(store):
    """Order, and the pairs that are the same, of the stored members."""
    members = dedupe.block_members(dedupe.stored_candidates(store.read("opportunity"), store.read("opportunity_source")))
    order = {r["id"]: (r["block_key"], r["ord"]) for r in members.select("id", "block_key", "ord").collect()}
    pairs = dedupe.pairs(members).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "verdict.same", "verdict.reason", P.auto_apply(F.col("verdict")).alias("auto")).collect()
    return order, [r for r in pairs if r["same"]]


def state(store):
    return {r["id"]: r for r in store.read("opportunity").collect()}


def test_one_batch_merges_like_the_walk(store):
    order, judged = model(store)
    want = {b: (a, why) for b, a, why in walk(judged, order)}
    stages.dedupe_due(store, F.lit(NOW))
    rows = state(store)
    assert {i: r["merged_into"] for i, r in rows.items() if r["merged_into"] is not None} == {b: a for b, (a, _) in want.items()}
    for i, r in rows.items():
        assert (r["pipeline_state"], r["version"], r["attempts"]) == (("normalized", 2, 2) if i in want else ("deduped", 2, 0))
    moved = {int(r["source_row_id"]): (r["opportunity_id"], r["merge_reason"], r["merged_by"]) for r in store.read("opportunity_source").collect()}
    assert moved == {i: (*want[i], "dedupe") if i in want else (i, None, "ingest") for i in rows}
    log = {r["from_id"]: (r["into_id"], r["rows_moved"], r["moved_rows"]) for r in store.read("opportunity_merge").collect()}
    assert log == {b: (a, 1, [f"{b:06}"]) for b, (a, _) in want.items()}
    before = store.manifest()["version"]
    assert stages.sweep_blocks(store, F.lit(NOW)) == before  # nothing is left to merge or to queue


def test_blocks_that_come_late_are_mended_by_the_sweep(store):
    """Old rows get their block keys after the young ones are done, and are not held against these; the sweep finds such pairs and queues none twice."""
    rows = store.read("opportunity")
    keys = rows.select("id", F.col("block_key").alias("known"))
    old = F.col("first_seen_at") < 25
    store.commit({"opportunity": rows.withColumns({"block_key": F.when(~old, F.col("block_key")), "pipeline_state": F.when(old, "parsed").otherwise("normalized")})})
    n = store.read("opportunity").filter(~old).count()
    for batch in (n // 2, None):
        stages.dedupe_due(store, F.lit(NOW), batch)
    assert store.read("opportunity").filter("pipeline_state = 'normalized' AND merged_into IS NULL").count() == 0
    late = store.read("opportunity").join(keys, "id").withColumns({"block_key": F.col("known"), "pipeline_state": F.when(old, "normalized").otherwise(F.col("pipeline_state"))})
    store.commit({"opportunity": late.drop("known")})
    stages.dedupe_due(store, F.lit(NOW))
    order, judged = model(store)
    want = {(b, a) for b, a, _ in walk(judged, order)}
    assert len(want) > 3  # pairs that the batches missed
    standing, queued_before = set(order), {(r["left_id"], r["right_id"]) for r in store.read("dedupe_review").collect()}
    stages.sweep_blocks(store, F.lit(NOW + timedelta(minutes=2)))
    assert {(r["id"], r["merged_into"]) for r in store.read("opportunity").collect() if r["id"] in standing and r["merged_into"] is not None} == want
    left = standing - {b for b, _ in want}
    review = [(r["left_id"], r["right_id"]) for r in store.read("dedupe_review").collect()]
    assert len(review) == len(set(review)) and queued_before <= set(review)
    assert {p for p in review if set(p) <= left} >= {(r["b"], r["a"]) for r in judged if not r["auto"] and {r["a"], r["b"]} <= left}
    again = store.manifest()["version"]
    assert stages.sweep_blocks(store, F.lit(NOW + timedelta(minutes=4))) == again
    with pytest.raises(StaleCommit):  # a sweep that another writer overtook changes nothing
        store.commit({"opportunity": store.read("opportunity").limit(0)}, expected=again - 1)


def test_normalisation_is_one_step(spark, tmp_path):
    """Due rows alone, longest waiting first; leased, merged, later and other ones stay as they are; empty tables pass."""
    store = TableStore(spark, str(tmp_path / "store"))
    base = spark.createDataFrame(
        [(1, 1, "c", "Senior Backend Engineer", "Paris, France", "text of it"), (2, 2, "c", "", None, None), (3, 3, "c", None, "Remote", ""), (4, 4, "c", "Recruiter", "x", "y"), (5, 5, "c", "Recruiter", "x", "y")],
        "id long, first_seen_at long, company_id string, title_raw string, location_region string, description_text string",
    )
    derived = {"title_normalized": "string", "role_family": "string", "seniority_ordinal": "int", "is_management": "boolean", "work_mode": "string", "location_country": "string", "location_city": "string", "content_hash": "string", "remote_geo_scope": "string", "simhash": "long", "block_key": "string", "normalization_version": "string"}
    rows = queued(base, "parsed").withColumns({c: F.lit(None).cast(t) for c, t in derived.items()})
    rows = rows.withColumns({"lease_until": F.when(F.col("id") == 4, F.lit(NOW + timedelta(minutes=1))), "pipeline_state": F.when(F.col("id") == 5, "ready").otherwise("parsed")})
    store.commit({"opportunity": rows, "opportunity_source": spark.createDataFrame([], "opportunity_id long, source_row_id string, ats_type string, ats_job_id string, apply_url string, created_at timestamp")})
    stages.normalize_due(store, F.lit(NOW), batch=2)
    got = state(store)
    assert [got[i]["pipeline_state"] for i in range(1, 6)] == ["normalized", "normalized", "parsed", "parsed", "ready"]
    assert (got[1]["location_country"], got[1]["location_city"], got[1]["role_family"], got[1]["version"], got[1]["attempts"], got[1]["last_error"]) == ("FR", "Paris", "backend", 2, 0, None)
    assert got[2]["normalization_version"] == "1" and got[4]["version"] == 1 and got[3]["title_normalized"] is None
    stages.normalize_due(store, F.lit(NOW))
    assert state(store)[3]["pipeline_state"] == "normalized" and store.read("opportunity").schema["normalization_version"].dataType.simpleString() == "string"
    stages.dedupe_due(store, F.lit(NOW))
    assert [state(store)[i]["pipeline_state"] for i in range(1, 6)] == ["deduped", "deduped", "deduped", "parsed", "ready"]
    store.commit({"opportunity": rows.limit(0)})
    for stage in (stages.normalize_due, stages.dedupe_due, stages.sweep_blocks):
        stage(store, F.lit(NOW))
    assert store.read("opportunity").count() == 0


def test_texts_kept_apart(spark, tmp_path):
    """Polls, normalisation and search with the texts in a table of their own end as they do with texts in the rows."""
    from tests.test_polls import OPP, PROV, board, landed
    from vacantia.streaming.polls import apply_batch

    more = ", is_management boolean, seniority_ordinal int, location_country string, location_city string, remote_geo_scope string, text_len int, block_key string, normalization_version int"
    empty, ends = spark.createDataFrame([], OPP + more), []
    jobs = [[(1, "Senior Data Engineer", "a b c"), (2, "Recruiter", "x")], [(1, "Senior Data Engineer", "a b c d"), (2, "Recruiter", "x"), (3, "Senior Data Engineer", "a b c d")]]
    for apart in (False, True):
        store = TableStore(spark, str(tmp_path / f"apart-{apart}"))
        texts = {"opportunity_text": spark.createDataFrame([], "id string, description_text string")} if apart else {}
        store.commit({"opportunity": empty.drop("description_text") if apart else empty, "opportunity_source": spark.createDataFrame([], PROV), **texts})
        for k, posted in enumerate(jobs):
            apply_batch(store, landed(spark, [("a", "ok", board(posted), None, None)]), k, F.lit(NOW + timedelta(hours=k)))
            stages.normalize_due(store, F.lit(NOW + timedelta(hours=k)))
        stages.dedupe_due(store, F.lit(NOW + timedelta(hours=2)))
        rows = store.read("opportunity").join(store.read("opportunity_text"), "id", "left") if apart else store.read("opportunity")
        ends.append({tuple(r) for r in rows.select(*empty.columns).collect()})
    assert ends[0] == ends[1] and len(ends[0]) == 3
    assert {(r[4], r[empty.columns.index("text_len")]) for r in ends[0]} == {("a b c d", 7), ("x", 1)} and sum(r[empty.columns.index("merged_into")] is not None for r in ends[0]) <= 1
