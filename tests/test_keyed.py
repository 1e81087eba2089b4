"""Keyed state: split and replayed streams give the rows of the batch operators, and timers follow the clock."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from vacantia.streaming import keyed

T0 = datetime(2026, 1, 1)
SHOWN = "source_id string, polled_at timestamp, source_job_id string, content_hash string, claim timestamp"
EVENTS = "id string, ts timestamp, event string, state string"


def history():
    """20 polls of two sources: jobs come, change, refresh, vanish and come back."""
    rng, polls, shown = random.Random(2), [], []
    for s in ("a", "b"):
        for k in range(20):
            at = T0 + timedelta(hours=k)
            polls.append((s, at))
            for job in range(12):
                if rng.random() < 0.6:
                    shown.append((s, at, f"j{job}", rng.choice("xxxy"), None if rng.random() < 0.2 else at + timedelta(minutes=rng.randrange(-90, 90))))
    return polls, shown


def walked(polls, shown):
    state = {}
    for s, at in sorted(polls, key=lambda p: p[1]):
        now = {j: (h, c) for x, t, j, h, c in shown if (x, t) == (s, at)}
        for j, (h, c) in now.items():
            e = state.setdefault((s, j), {"hash": None, "version": 0, "refreshes": 0, "closures": 0})
            if e["hash"] != h:
                e |= {"hash": h, "base": c, "version": e["version"] + 1}
            elif c and e["base"] and c > e["base"]:
                e["refreshes"] += 1
            e |= {"misses": 0, "closed": None, "last": at}
        for (x, j), e in state.items():
            if x == s and j not in now and e["closed"] is None:
                e["misses"] += 1
                if e["misses"] == 2:
                    e |= {"closed": at, "closures": e["closures"] + 1}
    return {(s, j, e["hash"], e["version"], e["refreshes"], e["misses"], e["closures"], e["last"], e["closed"]) for (s, j), e in state.items()}


def test_lifecycles_of_a_split_and_replayed_stream(spark, tmp_path):
    polls, shown = history()
    for name, cuts in (("one", [T0 + timedelta(days=9)]), ("split", [T0 + timedelta(hours=7), T0 + timedelta(hours=8), T0 + timedelta(days=9)])):
        at, since = tmp_path / name, T0 - timedelta(1)
        stream = lambda kind, schema: spark.readStream.schema(schema).parquet(str(at / kind))  # noqa: B023, E731
        for cut in [*cuts, cuts[-1]]:  # the last turn finds nothing new
            for kind, rows, schema in (("polls", polls, SHOWN.split(", source_job")[0]), ("shown", shown, SHOWN)):
                some = [r for r in rows if since <= r[1] < cut]
                if some:
                    spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(at / kind))
            since = cut
            changes = keyed.run_to_table(keyed.job_lifecycles(stream("polls", SHOWN.split(", source_job")[0]), stream("shown", SHOWN), 3), str(at / "out"), str(at / "cp"), "update")
        got = keyed.present(changes.unionByName(changes)).select("source_id", "source_job_id", "content_hash", "version", "refreshes", "misses", "closures", "last_seen_at", "closed_at")
        assert {tuple(r) for r in got.collect()} == walked(polls, shown)


def due(rows, lease, strand, sweep, until):
    out = set()
    for i in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == i)
        state = lease_at = sweep_at = None
        for k, (at, event, new) in enumerate(own):
            if event == "enter":
                state, lease_at, sweep_at = new, None, at + strand
            elif event == "done":
                state, lease_at, sweep_at = new, None, None
            elif sweep_at:
                lease_at = at + lease
            end = own[k + 1][0] if k + 1 < len(own) else until + timedelta(microseconds=1)
            while True:
                if lease_at and lease_at < end and (not sweep_at or lease_at <= sweep_at):
                    out.add((i, lease_at, "lease_expired", state))
                    lease_at = None
                elif sweep_at and sweep_at < end:
                    if not lease_at:
                        out.add((i, sweep_at, "swept", state))
                    sweep_at += sweep
                else:
                    break
    return out


def test_timers_follow_the_clock(spark, tmp_path):
    rng, rows = random.Random(5), []
    for k in range(12):
        at = T0
        for _ in range(rng.randrange(1, 7)):
            at += timedelta(minutes=rng.randrange(1, 70))
            rows.append((f"r{k}", at, *rng.choice([("enter", "parsed"), ("claim", None), ("claim", None), ("done", "ready"), ("enter", "deduped")])))
    clock = T0 + timedelta(hours=10)
    rows += [("clock", clock, "done", "ready")]  # moves the clock far beyond the others
    want = due(rows, timedelta(minutes=5), timedelta(minutes=30), timedelta(minutes=45), clock)
    for name, cuts in (("one", [clock]), ("split", [T0 + timedelta(hours=1), T0 + timedelta(hours=3), clock])):
        since = T0
        for cut in cuts:
            some = [r for r in rows if since < r[1] <= cut]
            since = cut
            spark.createDataFrame(some, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / name / "in"))
            found = keyed.run_to_table(keyed.deadlines(stream, 300, 1800, 2700), str(tmp_path / name / "out"), str(tmp_path / name / "cp"), "append")
        got = [tuple(r) for r in found.select("id", "at", "what", "state").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_repeated_polls_become_one_before_they_are_dealt():
    batch = pa.RecordBatch.from_pydict({"source_id": ["a", "a", "b", None] * 500, "at": [1, 1, 2, 3] * 500})
    got = [r for b in keyed._told_once(iter([batch, batch])) for r in b.to_pylist()]
    assert sorted(map(str, got)) == sorted(map(str, [{"source_id": "a", "at": 1}, {"source_id": "b", "at": 2}, {"source_id": None, "at": 3}]))
    assert list(keyed._told_once(iter([]))) == []
