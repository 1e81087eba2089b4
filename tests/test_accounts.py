"""Accounts, session activity and erasure requests, case by case."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vacantia.operators import identity, profiles

NOW = datetime(2026, 8, 21, 12)
USER = "id string, tenant_id string, email string, password_hash string, failed_logins int, locked_until timestamp, created_at timestamp"
TENANT = "id string, kind string, display_name string, owner_id string"


def test_registering(spark):
    users = spark.createDataFrame([("u0", "t0", "Known@x.org", "h", 3, None, NOW)], USER)
    tenants = spark.createDataFrame([("t0", "individual", "Known@x.org", "u0")], TENANT)
    asked = spark.createDataFrame([(" new@x.org ", "h2"), ("NEW@x.org", "h1"), ("known@X.org", "h"), ("  ", "h"), (None, "h"), ("other@x.org", "h3")], "email string, password_hash string")
    got = identity.register(users, tenants, asked, F.lit(NOW))
    made = {r["email"]: r for r in got["app_user"].collect()}
    assert set(made) == {"Known@x.org", "NEW@x.org", "other@x.org"} and made["NEW@x.org"]["password_hash"] == "h1"
    assert made["Known@x.org"] == users.first() and (made["other@x.org"]["failed_logins"], made["other@x.org"]["created_at"]) == (0, NOW)
    owned = {r["owner_id"]: (r["id"], r["kind"], r["display_name"]) for r in got["tenant"].collect()}
    assert owned["u0"] == ("t0", "individual", "Known@x.org")
    for mail in ("NEW@x.org", "other@x.org"):
        assert owned[made[mail]["id"]] == (made[mail]["tenant_id"], "individual", mail)
    assert {(r["email"], r["n"]) for r in got["refused"].collect()} == {("NEW@x.org", 1), ("known@X.org", 1), ("", 2)}
    # the same batch again makes the same accounts; asked once more, all are known
    again = identity.register(users, tenants, asked.repartition(3), F.lit(NOW))
    assert {tuple(r) for r in again["app_user"].collect()} == {tuple(r) for r in got["app_user"].collect()}
    later = identity.register(got["app_user"], got["tenant"], asked, F.lit(NOW + timedelta(days=1)))
    assert later["app_user"].count() == 3 and later["refused"].agg(F.sum("n")).first()[0] == 6
    none = identity.register(users, tenants, asked.limit(0), F.lit(NOW))
    assert none["app_user"].count() == 1 and none["refused"].count() == 0


def test_sessions_are_touched_and_revoked(spark):
    later = NOW + timedelta(days=1)
    sessions = spark.createDataFrame([("s1", "u1", None, later, None), ("s2", "u1", NOW, later, None), ("s3", "u2", None, later, None)], "id string, user_id string, revoked_at timestamp, expires_at timestamp, last_seen_at timestamp")
    seen = spark.createDataFrame([("s1",), ("s1",), ("none",)], "session_id string")
    touched = identity.touch_sessions(sessions, seen, F.lit(later))
    assert {(r["id"], r["last_seen_at"]) for r in touched.collect()} == {("s1", later), ("s2", None), ("s3", None)} and touched.count() == 3
    ended = identity.revoke_all_sessions(touched, spark.createDataFrame([("u1",), ("u1",), (None,)], "user_id string"), F.lit(later))
    assert {(r["id"], r["revoked_at"]) for r in ended.collect()} == {("s1", later), ("s2", NOW), ("s3", None)} and ended.columns == sessions.columns


def test_erasure_requests(spark):
    requests = spark.createDataFrame([("r1", "u1", NOW, None), ("r2", "u2", NOW, NOW)], "request_id string, user_id string, requested_at timestamp, completed_at timestamp")
    asked = spark.createDataFrame([("u1",), ("u2",), ("u2",), ("u3",), (None,)], "user_id string")
    later = F.lit(NOW + timedelta(days=1))
    got = profiles.request_erasures(requests, asked, later)
    assert sorted(r["user_id"] for r in got.collect()) == ["u1", "u2", "u2", "u3"]
    assert profiles.request_erasures(got, asked, later).count() == 4  # all have an open one
    steps = spark.createDataFrame([("r1", "profile", "failed", 1, "x", NOW)], "request_id string, location string, status string, items int, detail string, completed_at timestamp")
    new = spark.createDataFrame([("r1", "profile", "done", 2, None), ("r1", "sessions", "done", 0, None)], "request_id string, location string, status string, items int, detail string")
    told = profiles.record_steps(steps, new, later)
    assert {(r["location"], r["status"], r["items"], r["detail"]) for r in told.collect()} == {("profile", "done", 2, None), ("sessions", "done", 0, None)}
    assert profiles.complete_requests(got, steps, later).filter("request_id = 'r1'").first()["completed_at"] is None
    assert profiles.complete_requests(got, told, later).filter("request_id = 'r1'").first()["completed_at"] == NOW + timedelta(days=1)
