"""Operators of the posting corpus on small tables; the unit tables follow the published expectations."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vacantia.functions import policy as P
from vacantia.functions import text as X
from vacantia.functions.constraints import orphans, repeated_keys, violations
from vacantia.functions.simhash import fnv1a64, hamming, simhash
from vacantia.operators import dedupe, feed, identity, ingest, profiles, queue, stats
from vacantia.sources import boards
from vacantia.sources.store import BlobStore, StaleCommit, TableStore

NOW = datetime(2026, 8, 21, 12)


def now():
    return F.lit(NOW)


TITLES = [
    ("Senior Backend Engineer - Monitoring and Anomaly Detection", "backend", 4, False), ("Senior Backend Engineer (Ruby), Plan: Portfolio Experience", "backend", 4, False),
    ("Intermediate Backend Engineer, Platform Readiness", "backend", 3, False), ("Staff Frontend Engineer", "frontend", 5, False), ("Principal Engineer, Data Platform", "data", 6, False),
    ("Senior Threat Intelligence Engineer", "security", 4, False), ("Site Reliability Engineer", "platform", None, False), ("Machine Learning Engineer", "ml", None, False),
    ("Engineering Manager, Growth", "engineering", None, True), ("Director of Engineering", "engineering", None, True), ("Strategic Account Executive - Turkey", "sales", None, False),
    ("Ecosystem Sales Manager, Carahsoft (Washington DC)", "sales", None, True), ("Customer Success Architect, CEUR", "support", None, False), ("Senior Team Member Relations Partner", None, 4, False),
    ("Forward Deployed Engineer - META", "engineering", None, False), ("Backend Engineering Intern", "backend", 1, False), ("", None, None, False),
    ("Tech Lead, Payments", None, None, False), ("Senior Staff Engineer", "engineering", 5, False), (None, None, None, False),
]


def test_titles(spark):
    rows = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TITLES)], "i int, raw string").select("i", X.parse_title(F.col("raw")).alias("t")).collect()
    for r in rows:
        assert (r["t"]["role_family"], r["t"]["seniority"], r["t"]["is_management"]) == TITLES[r["i"]][1:]
    again = spark.createDataFrame([(r["t"]["normalized"],) for r in rows], "raw string").select(X.parse_title(F.col("raw"))["normalized"].alias("n")).collect()
    assert [r["n"] for r in again] == [r["t"]["normalized"] for r in rows]


PLACES = [
    ("Remote, United States", "remote", "US", None, ["US"]), ("Remote, US", "remote", "US", None, ["US"]), ("Bangalore, India", "onsite", "IN", "Bangalore", ["IN"]),
    ("Remote, Canada; Remote, United States", "remote", None, None, ["CA", "US"]), ("Remote, Poland; Remote, United Kingdom", "remote", None, None, ["GB", "PL"]),
    ("Remote, United Arab Emirates", "remote", "AE", None, ["AE"]), ("Remote", "remote", None, None, []), ("Remote, Bangalore", "remote", None, "Bangalore", []),
    ("Hybrid - Berlin", "hybrid", None, "Berlin", []), ("", None, None, None, []), ("Canada; US", None, None, None, []), (None, None, None, None, []),
]


def test_places(spark):
    for r in spark.createDataFrame([(i, p[0]) for i, p in enumerate(PLACES)], "i int, raw string").select("i", X.parse_location(F.col("raw")).alias("p")).collect():
        assert (r["p"]["work_mode"], r["p"]["country"], r["p"]["city"], r["p"]["geo_scope"]) == PLACES[r["i"]][1:]


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_text_functions(spark):
    x = F.col("x")
    for raw in ("https://careers.a.com/jobs/1?utm=x", "http://careers.a.com/jobs/1/", "HTTPS://Careers.A.com/Jobs/1#apply"):
        assert one(spark, raw, X.normalize_url(x))[0] == "careers.a.com/jobs/1"
    for raw in ("", "   ", "https://careers.a.com"):
        assert one(spark, raw, X.normalize_url(x))[0] is None
    assert [one(spark, t, F.size(X.shingles(x)))[0] for t in ("", "two words", "word " * 10)] == [0, 1, 8]
    assert one(spark, "a \x01 b\n\tc ", X.clean_text(x))[0] == "a b c"
    assert one(spark, "a<b>c</b>d > e <f", X.tokenize(x))[0] == ["a", "c", "d", "e"]
    assert one(spark, "a", fnv1a64(x))[0] & (2**64 - 1) == 0xAF63DC4C8601EC8C
    assert one(spark, "2026-01-02T03:04:05+02:00", X.parse_time(x))[0] == datetime(2026, 1, 2, 1, 4, 5)
    assert one(spark, "yesterday", X.parse_time(x))[0] is None
    assert one(spark, "&lt;p&gt; A&amp;B", X.html_unescape(x))[0] == "<p> A&B"
    assert one(spark, "bad", X.json_map(x))[0] == {} and one(spark, '{"k": 1}', X.json_map(x))[0] == {"k": "1"}
    assert one(spark, "Text/Markdown; charset=utf-8", X.media_extension(x))[0] == ".md"


def body(role, extra):
    """A description of realistic length whose parts are mostly the same for every role."""
    shared = "We build tools for people who hire, across many countries and time zones, and we work mostly in writing. " * 6
    return f"{shared} The role: {role}. {extra} {shared}"


def test_decisions(spark):
    backend = body("Senior Backend Engineer for Go services", "You own reliability and mentor engineers.")
    edited = body("Senior Backend Engineer for Go services", "You own reliability and mentor other engineers.")
    frontend = body("Senior Frontend Engineer for React screens", "You own the design system and mentor engineers.")
    be, fe = "Senior Backend Engineer", "Senior Frontend Engineer"
    rows = [
        ("ats", "a", "gh", "1", "https://x.io/jobs/1", None, be, backend, "h1", "a", "gh", "1", "https://x.io/jobs/1?s=x", None, be, backend, "h2", "exact_ats"),
        ("hash", "a", "gh", "2", "https://x.io/jobs/2", None, be, backend, "h", "a", "lv", "9", "https://y.io/a/9", None, be, backend, "h", "content_hash"),
        ("url", "a", "gh", "3", "https://x.io/jobs/3", None, be, backend, "h1", "a", "", "", "https://x.io/jobs/3?u=1", None, be, frontend, "h2", "apply_url"),
        ("edit", "a", "gh", "4", "https://x.io/jobs/4", None, be, backend, "h1", "a", "", "", "https://z.io/a/4", None, be, edited, "h2", "simhash"),
        ("roles", "a", "gh", "5", "https://x.io/jobs/5", None, be, backend, "h1", "a", "gh", "6", "https://x.io/jobs/6", None, fe, frontend, "h2", ""),
        ("firms", "a", "gh", "7", "https://x.io/jobs/7", None, be, backend, "h", "b", "gh", "8", "https://x.io/jobs/8", None, be, backend, "h", ""),
        ("vague", "a", "gh", "7", "https://x.io/jobs/7", None, "Engineer", backend, "h1", "a", "gh", "8", "https://x.io/jobs/8", None, "Engineer", backend, "h2", ""),
        ("geo", "a", "gh", "7", "https://x.io/jobs/7", "IT,SE", be, backend, "h", "a", "gh", "8", "https://x.io/jobs/8", "AT,CH", be, backend, "h", ""),
        ("none", "a", None, None, None, None, "Engineer", None, None, "a", None, None, None, None, "Engineer", None, None, ""),
        ("null", None, "gh", "1", None, None, be, backend, "h", None, "gh", "1", None, None, be, backend, "h", ""),
    ]
    names = ["company_id", "ats_type", "ats_job_id", "apply_url", "geo_scope", "title", "body", "content_hash"]
    schema = ", ".join(["name string", *(f"{s}_{n} string" for s in "ab" for n in names), "want string"])
    df = spark.createDataFrame(rows, schema)
    for s in "ab":
        df = df.withColumn(f"{s}_simhash", simhash(X.tokenize(F.col(f"{s}_body")))).withColumn(f"{s}_text_len", F.length(F.coalesce(f"{s}_body", F.lit(""))))
    ab = P.decide(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}"))
    ba = P.decide(lambda c: F.col(f"b_{c}"), lambda c: F.col(f"a_{c}"))
    for r in df.select("name", "want", ab.alias("ab"), ba.alias("ba"), hamming(F.col("a_simhash"), F.col("b_simhash")).alias("d")).collect():
        assert r["ab"]["reason"] == r["want"], r
        assert r["ab"]["same"] == r["ba"]["same"] == bool(r["want"])
    edge = spark.range(1).select(F.struct(F.lit(True).alias("same"), (F.lit(0.90).cast("float") - F.lit(3).cast("float") * F.lit(0.05).cast("float")).alias("confidence")).alias("v"))
    assert edge.select(P.auto_apply(F.col("v"))).first()[0]


def risk(spark, days=1, reposts=0, apply=True, median=0):
    r = spark.range(1).select(P.ghost_risk(P.days_open(F.lit(NOW - timedelta(days=days)), now()), F.lit(reposts), F.lit(apply), F.lit(median)).alias("r")).first()["r"]
    return r["band"], [x["code"] for x in r["reasons"]]


def test_ghost_risk(spark):
    assert risk(spark) == ("normal", [])
    assert risk(spark, reposts=2) == ("elevated", ["refreshed"])
    assert risk(spark, reposts=4) == ("high", ["repeated_refresh"])
    assert risk(spark, days=130) == ("elevated", ["open_a_long_time"])
    assert risk(spark, days=130, apply=False) == ("high", ["open_a_long_time", "no_apply_route"])
    assert risk(spark, days=70) == ("elevated", ["open_a_while"])
    assert risk(spark, days=130, median=100) == ("normal", [])
    assert risk(spark, days=61, median=10) == ("elevated", ["open_far_longer_than_usual"])
    assert risk(spark, days=-5) == ("normal", [])


def verdict(spark, current, base):
    names = ("postings", "usable", *P.V.ALERTING_FIELDS)
    row = spark.createDataFrame([tuple(current) + tuple(base)], ", ".join(f"{s}_{n} int" for s in "cb" for n in names))
    v = row.select(P.health_verdict(lambda c: F.col(f"c_{c}"), lambda c: F.col(f"b_{c}")).alias("v")).first()["v"]
    return v["status"], [(r["code"], r["field"]) for r in v["reasons"]]


def test_health(spark):
    full = (200, 200, 200, 200, 200, 200)
    assert verdict(spark, full, full) == ("healthy", [])
    assert verdict(spark, (200, 200, 200, 142, 200, 200), full) == ("degraded", [("field_fill_drop", "location")])
    assert verdict(spark, (19, 0, 0, 0, 0, 0), full)[0] == "unknown"
    assert verdict(spark, (200, 180, 200, 200, 200, 200), full) == ("healthy", [])  # 1.0 - 0.9 is less than 0.1 in doubles
    assert verdict(spark, (200, 170, 200, 200, 200, 200), full)[1] == [("yield_drop", "")]
    assert verdict(spark, (200, 200, 200, 200, 200, 0), (200, 200, 200, 200, 200, 50)) == ("healthy", [])


OPP = "id string, company_id string, title_raw string, description_text string, location_region string, language string, content_hash string, title_normalized string, source_reported_posted_at timestamp, source_posted_at_at_last_change timestamp, pipeline_state string, state_entered_at timestamp, attempts int, version int, repost_count int, first_seen_at timestamp, last_seen_at timestamp, consecutive_misses int, closed_at timestamp, close_reason string, merged_into string"
PROV = "source_row_id string, opportunity_id string, source_id string, source_job_id string, apply_url string, content_hash string, created_at timestamp, last_seen_at timestamp"


def board(jobs):
    return json.dumps({"jobs": [{"id": i, "title": t, "content": d, "absolute_url": f"https://x.io/{i}", "location": {"name": "Remote"}, "updated_at": u} for i, t, d, u in jobs], "extra": 1})


def test_payloads(spark):
    docs = spark.createDataFrame([("s", "ok", board([(0, "x", "", ""), (1, "  ", "", ""), (7, " Usable ", "&lt;b&gt;", "2026-01-01")])), ("s", "bad", "<html>not json</html>"), ("s", "none", "{}")], "source_id string, name string, body string")
    decoded = boards.decode(docs)
    assert {r["name"]: r["ok"] for r in decoded.collect()} == {"ok": True, "bad": False, "none": True}
    rows = boards.postings(decoded).collect()
    assert [(r["ats_job_id"], r["title"], r["description"], r["work_mode"]) for r in rows] == [("7", "Usable", "<b>", "remote")]
    a, b = (boards.postings(boards.decode(spark.createDataFrame([(board([(7, "T", "d", u)]),)], "body string"))).first()["content_hash"] for u in ("2026-01-01", "2026-02-02"))
    assert a == b
    assert boards.registered() == ["greenhouse"]
    with pytest.raises(ValueError):
        boards.register("greenhouse", boards.Board)
    with pytest.raises(ValueError):
        boards.build("greenhouse:")


def test_poll_stream(spark, tmp_path):
    """Appear, change, vanish twice, reappear; failed and unmodified polls close nothing; replays change nothing."""
    from vacantia.streaming.polls import LANDED, apply_batch, run_polls

    store = TableStore(spark, str(tmp_path / "store"))
    store.commit({"opportunity": spark.createDataFrame([], OPP), "opportunity_source": spark.createDataFrame([], PROV)})
    two = board([(1, "A", "x", ""), (2, "B", "y", "")])
    rounds = [("ok", two), ("ok", two), ("ok", board([(1, "A", "x", ""), (2, "B", "changed", "")])), ("failed", None), ("not_modified", None), ("ok", "<html>"), ("ok", board([(1, "A", "x", "")])), ("ok", board([(1, "A", "x", "")]))]
    for i, (status, payload) in enumerate(rounds):
        batch = spark.createDataFrame([("gh:x", "c", status, NOW, payload, None, None)], LANDED)
        apply_batch(store, batch, i, F.lit(NOW + timedelta(days=i)))
        if i < 7:
            assert store.read("opportunity").filter("closed_at IS NOT NULL").count() == 0
    rows = {r["title_raw"]: r for r in store.read("opportunity").collect()}
    assert rows["B"]["close_reason"] == "absent" and rows["B"]["version"] == 2 and rows["A"]["closed_at"] is None and rows["A"]["version"] == 1
    version = store.manifest()["version"]
    apply_batch(store, spark.createDataFrame([("gh:x", "c", "ok", NOW, board([]), None, None)], LANDED), 7, now())
    assert store.manifest()["version"] == version
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "a.json").write_text(json.dumps({"source_id": "gh:x", "company_id": "c", "status": "ok", "polled_at": "2026-09-01T00:00:00Z", "body": two}))
    run_polls(spark, str(tmp_path / "landed"), store, str(tmp_path / "cp"), now, name="second").awaitTermination(120)
    assert store.read("opportunity").filter("closed_at IS NOT NULL").count() == 0
    with pytest.raises(StaleCommit):
        store.commit({}, expected=1)


def test_refresh_counts(spark):
    base = ("i", "c", "T", "d", "", "en", "h", "t", NOW, NOW, "ready", NOW, 0, 1, 0, NOW, NOW, 1, NOW, "absent", None)
    opps = spark.createDataFrame([base], OPP)
    seen = spark.createDataFrame([("s", "1", "h", "T", "d", "", "en", NOW + timedelta(days=1), "c", "i", "unchanged")], "source_id string, source_job_id string, content_hash string, title_raw string, description_text string, location_region string, language string, source_reported_posted_at timestamp, company_id string, opportunity_id string, outcome string")
    r = ingest.reconcile(opps, seen, now()).first()
    assert (r["repost_count"], r["closed_at"], r["consecutive_misses"], r["pipeline_state"]) == (1, None, 0, "ready")


def test_merges(spark):
    text = body("Senior Backend Engineer for Go services", "x")
    docs = spark.createDataFrame([(i, "c", "Senior Backend Engineer", t, "US", i) for i, t in enumerate([text, text, text, "other " * 100])], "id long, company_id string, title string, body string, country string, first_seen_at long")
    decided = dedupe.pairs(dedupe.block_members(dedupe.candidates_from(docs)))
    merges = dedupe.leaders(decided)
    assert sorted((r["from_id"], r["into_id"]) for r in merges.collect()) == [(1, 0), (2, 0)]
    opps = docs.select("id", F.lit(1).alias("version"), F.lit(None).cast("long").alias("merged_into"))
    sources = docs.select(F.col("id").alias("source_row_id"), F.col("id").alias("opportunity_id"), F.lit("").alias("merge_reason"), F.lit(0.0).alias("merge_confidence"))
    out = dedupe.apply_merges(opps, sources, merges, now())
    assert {r["id"]: (r["merged_into"], r["version"]) for r in out["opportunity"].collect()} == {0: (None, 1), 1: (0, 2), 2: (0, 2), 3: (None, 1)}
    assert sorted(r["opportunity_id"] for r in out["opportunity_source"].collect()) == [0, 0, 0, 3]
    back = dedupe.undo_merge(out["opportunity"], out["opportunity_source"], out["opportunity_merge"], 2, now())
    assert sorted(r["opportunity_id"] for r in back["opportunity_source"].collect()) == [0, 0, 2, 3]
    assert back["opportunity"].filter("merged_into IS NOT NULL").count() == 1 and dedupe.merge_cycles(out["opportunity"]).count() == 0


def test_feed_pages_cover_each_row_once(spark):
    rows = [(i, "c", "ready", None, None, "f", "remote", "US", None, NOW - timedelta(days=i // 2), 0) for i in range(11)]
    opps = spark.createDataFrame(rows, "id int, company_id string, pipeline_state string, closed_at timestamp, merged_into int, role_family string, work_mode string, location_country string, remote_geo_scope string, first_seen_at timestamp, repost_count int")
    companies = spark.createDataFrame([("c", "C")], "id string, display_name string")
    sources = spark.createDataFrame([(1, 3, "u", NOW)], "source_row_id int, opportunity_id int, apply_url string, created_at timestamp")
    seen, after = [], None
    while page := feed.page(opps, companies, sources, {"page_size": 4}, after, now()).collect():
        seen += [r["id"] for r in page]
        after = (page[-1]["first_seen_at"], page[-1]["id"])
    assert sorted(seen) == list(range(11)) and len(seen) == 11
    stamp, key = feed.decode_cursor(feed.encode_cursor(NOW, "k"))
    assert (stamp, key) == (NOW, "k")
    for bad in ("", "???", "bm9iYXI"):
        with pytest.raises(ValueError):
            feed.decode_cursor(bad)
    with pytest.raises(ValueError):
        feed.check_filters({"colour": "red"})
    with pytest.raises(ValueError):
        feed.check_filters({"page_size": -1})


def test_queue(spark):
    rows = spark.createDataFrame([(i, "parsed", None, 1, 0, NOW - timedelta(hours=i), None, NOW - timedelta(hours=2), None, None) for i in range(12)], "id int, pipeline_state string, merged_into int, version int, attempts int, next_attempt_at timestamp, lease_until timestamp, state_entered_at timestamp, swept_at timestamp, last_error string")
    swept = set()
    for _ in range(4):
        ids = queue.stranded(rows, 3, now())
        swept |= {r["id"] for r in ids.collect()}
        rows = spark.createDataFrame(queue.requeue(rows, ids, now()).collect(), rows.schema)
    assert swept == set(range(12))
    claimed = queue.claim(rows, "parsed", 5, now(), 600)
    assert claimed.filter("lease_until IS NOT NULL AND attempts = 1").count() == 5
    assert queue.claimable(claimed, "parsed", 50, now()).count() == 7
    after, conflicts = queue.advance(rows, spark.createDataFrame([(1, 1, "parsed"), (2, 9, "parsed")], "id int, version int, state string"), now())
    assert after.filter("pipeline_state = 'normalized'").count() == 1 and conflicts.count() == 1
    assert queue.release(claimed, claimed.select("id")).filter("lease_until IS NULL AND attempts = 0").count() == 12
    waits = spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 9)], "n int").select(P.backoff_seconds(F.col("n"))).collect()
    assert [w[0] for w in waits] == [30, 30, 60, 120, 3600]


def test_identity(spark):
    entries = spark.createDataFrame([(c, i, "login", "u", f"{{\"n\": {i}}}") for c in (1, 2) for i in range(1, 6)], "chain_id int, id int, action string, subject string, metadata string")
    chain = identity.link_chain(entries)
    assert {r["first_bad"] for r in identity.verify_chain(chain).collect()} == {0}
    forged = chain.withColumn("metadata", F.when((F.col("chain_id") == 2) & (F.col("id") == 3), "x").otherwise(F.col("metadata")))
    assert {r["chain_id"]: r["first_bad"] for r in identity.verify_chain(forged).collect()} == {1: 0, 2: 3}
    tokens = spark.createDataFrame([("t1", "f", "u", 1, NOW, None, NOW + timedelta(days=1)), ("t2", "f", "u", 2, None, None, NOW + timedelta(days=1))], "token_hash string, family_id string, user_id string, session_id int, used_at timestamp, revoked_at timestamp, expires_at timestamp")
    sessions = spark.createDataFrame([(1, "u", None, NOW + timedelta(days=1)), (3, "v", None, NOW + timedelta(days=1))], "id int, user_id string, revoked_at timestamp, expires_at timestamp")
    kinds = identity.classify_refresh(spark.createDataFrame([("t1",), ("t2",), ("t9",)], "token_hash string"), tokens, now())
    assert {r["token_hash"]: r["kind"] for r in kinds.collect()} == {"t1": "replayed", "t2": "ok", "t9": "invalid"}
    gone, left = identity.revoke_families(tokens, sessions, kinds.filter("kind = 'replayed'"), now())
    assert gone.filter("revoked_at IS NULL").count() == 0 and identity.live_sessions(left, now()).count() == 1


def test_profiles(spark):
    skills = "user_id string, skill_id int, origin string, proficiency int, years double"
    out = profiles.put_skills(spark.createDataFrame([("u", 1, "manual", 3, 2.0)], skills), spark.createDataFrame([("u", 1, "parsed", None, 5.0), ("u", 2, "parsed", 1, None)], skills))
    assert {r["skill_id"]: (r["origin"], r["proficiency"], r["years"]) for r in out.collect()} == {1: ("manual", 3, 5.0), 2: ("parsed", 1, None)}
    tables = {"app_user": spark.createDataFrame([("u",), ("v",)], "id string"), "profile": spark.createDataFrame([("u",), ("v",)], "user_id string"), "resume": spark.createDataFrame([("u",), ("u",)], "user_id string"), "tenant": spark.createDataFrame([("u",)], "owner_id string")}
    users = spark.createDataFrame([("u",)], "user_id string")
    assert profiles.user_traces(tables, users).first()["traces"] == 5
    assert profiles.user_traces(profiles.erase(tables, users), users).first()["traces"] == 0
    steps = profiles.erasure_steps(tables, users, spark.createDataFrame([("u", 2)], "user_id string, n long"))
    assert steps.count() == len(profiles.LOCATIONS) and steps.filter("location = 'object_storage'").first()["items"] == 2
    resumes = spark.createDataFrame([("r", "u", "text/plain", bytearray(b"a\x01 \n b")), ("p", "u", "application/pdf", bytearray(b"%PDF"))], "id string, user_id string, content_type string, body binary")
    got = {r["id"]: (r["parse_state"], r["extracted"]) for r in profiles.extract_resumes(resumes).collect()}
    assert got == {"r": ("text_extracted", "a b"), "p": ("failed", None)}


def test_stores(spark, tmp_path):
    blobs = BlobStore(spark, str(tmp_path / "blobs"))
    blobs.put("users/u/a.txt", b"one")
    assert blobs.get("users/u/a.txt") == b"one" and blobs.count_prefix("users/u/") == 1
    blobs.delete("users/u/none.txt")
    assert blobs.delete_prefix("users/u/") == 1 and blobs.count_prefix("users/u/") == 0
    with pytest.raises(ValueError):
        blobs.delete_prefix("")


def test_constraints(spark):
    rows = spark.createDataFrame([(1, "ready", 5, 3, "EUR", None, None, None), (2, "odd", None, None, None, NOW, None, 2)], "id int, pipeline_state string, salary_min_minor int, salary_max_minor int, salary_currency string, closed_at timestamp, close_reason string, merged_into int")
    assert sorted((r["id"], r["rule"]) for r in violations(rows, "opportunity").collect()) == [(1, "salary_range"), (2, "close_reason"), (2, "merge_self"), (2, "state")]
    assert repeated_keys(rows.unionAll(rows), "opportunity").count() == 2
    assert orphans(rows, "merged_into", rows.filter("id = 1")).count() == 1


def test_runs_and_precision(spark):
    rows = spark.createDataFrame([("s", i, NOW + timedelta(days=i), x) for i, x in enumerate(["degraded", "unknown", "degraded", "healthy", "degraded"])], "source_id string, evaluation_id int, polled_at timestamp, status string")
    assert [r["consecutive"] for r in stats.runs_of_degraded(rows).orderBy("evaluation_id").collect()] == [1, 1, 2, 0, 1]
    judged = spark.createDataFrame([(True, True), (True, False), (False, True)], "predicted boolean, truth boolean")
    assert tuple(stats.precision_recall(judged).first()) == (1, 1, 1, 0.5, 0.5)


def strip_walk(text):
    depth, out = 0, []
    for c in text:
        if c == "<":
            depth += 1
        elif c == ">":
            if depth:
                depth -= 1
                out.append(" ")
        elif not depth:
            out.append(c)
    return "".join(out)


def test_strip_tags_at_any_depth(spark):
    texts = ["<" * 12 + "x" + ">" * 12 + " after", "a <b <c> d> e", "a < b < c", "x > y <i>z</i>", "<<a>> <b", "", ">><", "plain\n<p>\ntext"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.strip_tags(F.col("t"))).collect()
    assert [r[0] for r in got] == [strip_walk(t) for t in texts]


def test_large_payload_fails_its_poll(spark, tmp_path, monkeypatch):
    from vacantia.sources import boards

    monkeypatch.setattr(boards, "MAX_BODY", 100)
    (tmp_path / "small.json").write_text('{"jobs": []}')
    (tmp_path / "large.json").write_text('{"jobs": [' + " " * 100 + "]}")
    got = {r["path"].rsplit("/", 1)[1]: r["ok"] for r in boards.decode(boards.read_documents(spark, str(tmp_path))).collect()}
    assert got == {"small.json": True, "large.json": False}


def test_manifests_stay_and_old_batches_are_known(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    one = spark.range(1)
    for i in range(3):
        store.commit({"t": one}, batch_id=f"b{i}")
    assert sorted(p.name for p in (tmp_path / "s").glob("manifest.*.json")) == [f"manifest.{i}.json" for i in (1, 2, 3)]
    assert store.commit({"t": spark.range(5)}, batch_id="b0") == 3 and store.read("t").count() == 1
    # a reader between the steps of a commit sees the version before
    (tmp_path / "s" / "manifest.4.abc.tmp").write_text("{")
    assert store.manifest()["version"] == 3


def test_board_identity_links(spark):
    from vacantia.operators import ingest

    schema = "source_id string, source_job_id string, content_hash string, ats_type string, ats_job_id string"
    known = spark.createDataFrame([("a", "1", "h", "gh", "7", "o1")], schema + ", opportunity_id string")
    posts = spark.createDataFrame([("b", "x", "h", "gh", "7"), ("b", "y", "h", "gh", "8"), ("c", "z", "h", "gh", "8"), ("c", "w", "h", None, "7"), ("a", "1", "h", "gh", "7")], schema)
    got = {(r["source_id"], r["source_job_id"]): (r["outcome"], r["opportunity_id"]) for r in ingest.classify(posts, known).collect()}
    made = posts.filter("source_job_id = 'y'").select(ingest.new_id()).first()[0]
    assert got == {("a", "1"): ("unchanged", "o1"), ("b", "x"): ("linked", "o1"), ("b", "y"): ("created", None), ("c", "z"): ("linked", made), ("c", "w"): ("created", None)}
    rows = ingest.reconcile_sources(known.withColumns({"last_seen_at": F.current_timestamp(), "created_at": F.current_timestamp(), "merge_reason": F.lit(None).cast("string")}), ingest.classify(posts, known), F.current_timestamp())
    assert {(r["source_job_id"], r["opportunity_id"], r["merge_reason"]) for r in rows.collect() if r["merge_reason"]} == {("x", "o1", "exact_ats"), ("z", made, "exact_ats")}


def test_leader_clusters(spark):
    """The registered query against a plain walk over each block's members, oldest first."""
    from vacantia.plans import queries as plans

    folder = "/root/testdata/sf0.001"
    decided = dedupe.pairs(plans._members(spark, folder)).withColumn("auto", P.auto_apply(F.col("verdict"))).select("block_key", "a_ord", "b_ord", "a.id", F.col("b.id").alias("other"), "auto").collect()
    merges = {(r["block_key"], r["id"], r["other"]) for r in decided if r["auto"]}
    order = {}
    for r in decided:
        order[r["block_key"], r["id"]], order[r["block_key"], r["other"]] = r["a_ord"], r["b_ord"]
    gone, want = set(), set()
    for block, a in sorted(order, key=order.get):
        for other_block, b in sorted(order, key=order.get):
            if block == other_block and order[block, a] < order[block, b] and (block, a) not in gone and (block, b) not in gone and (block, a, b) in merges:
                gone.add((block, b))
                want.add((block, b, a))
    got = {(r["block_key"], r["from_id"], r["into_id"]) for r in plans.leader_clusters(spark, folder).collect()}
    assert got == want and want


def test_refreshes_one_by_one(spark):
    """A batch is judged as requests that come one after the other."""
    import random

    rng = random.Random(7)
    later = NOW + timedelta(days=1)
    for _ in range(3):
        tokens = [(f"t{k}", f"f{k % 12}", k % 12, f"s{k}", f"h{k}", NOW if rng.random() < 0.1 else None, NOW if rng.random() < 0.1 else None, None, NOW if rng.random() < 0.1 else later) for k in range(60)]
        users = [(u, "suspended" if u in (3, 5) else "active") for u in range(11)]  # user 11 is gone
        requests = [(i, f"h{rng.randrange(64)}", "agent", f"ns{i}", f"nr{i}") for i in range(50)]
        status, state = dict(users), {t[4]: dict(family=t[1], user=t[2], session=t[3], used=t[5] is not None, revoked=t[6] is not None, over=t[8] <= NOW) for t in tokens}
        live = {t[3] for t in tokens}
        want = {}
        for i, h, _agent, session, refresh in requests:
            t = state.get(h)
            if t is None:
                want[i] = "invalid"
            elif t["used"]:
                want[i] = "replayed"
                for x in state.values():
                    if x["family"] == t["family"]:
                        x["revoked"] = True
                        live.discard(x["session"])
            elif t["revoked"] or t["over"] or t["user"] not in status:
                want[i] = "invalid"
            elif status[t["user"]] != "active":
                want[i] = "suspended"
            else:
                want[i] = "ok"
                t["used"] = True
                live.discard(t["session"])
                live.add(session)
                state[refresh] = dict(family=t["family"], user=t["user"], session=session, used=False, revoked=False, over=False)
        shape = "id string, family_id string, user_id int, session_id string, token_hash string, used_at timestamp, revoked_at timestamp, replaced_by string, expires_at timestamp"
        stored = spark.createDataFrame(tokens, shape)
        sessions = stored.selectExpr("session_id AS id", "user_id", "session_id AS token_hash", "'agent' AS user_agent", "CAST(NULL AS TIMESTAMP) AS revoked_at", "expires_at")
        presented = spark.createDataFrame(requests, "request_id int, token_hash string, user_agent string, session_hash string, refresh_hash string")
        got = identity.rotate(sessions, stored, presented, spark.createDataFrame(users, "id int, status string"), now())
        assert {r["request_id"]: r["kind"] for r in got["judged"].collect()} == want
        after = {r["token_hash"]: (r["used_at"] is not None, r["revoked_at"] is not None) for r in got["refresh_token"].collect()}
        assert after == {h: (t["used"], t["revoked"]) for h, t in state.items()}
        assert {r["token_hash"] for r in got["user_session"].filter("revoked_at IS NULL").collect()} == live


def test_issue_and_account_updates(spark):
    logins = spark.createDataFrame([("u", "agent", "sh", "rh"), ("u", "agent", "sh2", "rh2")], "user_id string, user_agent string, session_hash string, refresh_hash string")
    none = spark.createDataFrame([], "id string, user_id string, token_hash string, user_agent string, revoked_at timestamp, expires_at timestamp")
    bare = spark.createDataFrame([], "id string, family_id string, user_id string, session_id string, token_hash string, used_at timestamp, revoked_at timestamp, replaced_by string, expires_at timestamp")
    sessions, tokens = (x.collect() for x in identity.issue(none, bare, logins, now()))
    assert {r["id"] for r in sessions} == {r["session_id"] for r in tokens} and len({r["family_id"] for r in tokens}) == 2
    assert {r["expires_at"] for r in sessions} == {NOW + timedelta(days=1)} and {r["expires_at"] for r in tokens} == {NOW + timedelta(days=30)}
    users = spark.createDataFrame([("a", "p", None), ("b", "q", None)], "id string, password_hash string, email_verified_at timestamp")
    assert {tuple(r) for r in identity.set_passwords(users, spark.createDataFrame([("a", "n")], "id string, password_hash string")).collect()} == {("a", "n", None), ("b", "q", None)}
    assert {tuple(r) for r in identity.verify_emails(users, spark.createDataFrame([("b",)], "id string"), now()).collect()} == {("a", "p", None), ("b", "q", NOW)}
    opps = spark.createDataFrame([(1, "c"), (2, "d"), (3, None)], "id int, company_id string")
    assert {r["id"] for r in ingest.drop_companies(opps, spark.createDataFrame([("c",)], "company_id string")).collect()} == {2, 3}


def test_skills_go_and_profiles_are_touched(spark):
    claims = spark.createDataFrame([("manual", "u", 1), ("parsed", "u", 2), ("parsed", "v", 1)], "origin string, user_id string, skill_id int")
    gone = spark.createDataFrame([("u", 1), ("w", 9)], "user_id string, skill_id int")
    assert {tuple(r) for r in profiles.drop_skills(claims, gone).collect()} == {("parsed", "u", 2), ("parsed", "v", 1)}
    stored = spark.createDataFrame([("u", 3, None), ("v", 1, None)], "user_id string, profile_version int, updated_at timestamp")
    assert {tuple(r) for r in profiles.touch_profiles(stored, gone, now()).collect()} == {("u", 4, NOW), ("v", 1, None)}
    uploads = spark.createDataFrame([("a", "text/plain", bytearray(b"")), ("b", "image/png", bytearray(b"x")), ("c", "text/plain", None), ("d", "text/plain", bytearray(b"x"))], "id string, content_type string, body binary")
    assert {r["id"]: r["refused"] for r in profiles.refused_uploads(uploads).collect()} == {"a": "empty upload", "b": "unsupported content type", "c": "empty upload", "d": None}
