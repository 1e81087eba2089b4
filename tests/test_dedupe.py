"""Duplicate search by keys, leaders in rounds, probes and merge chains against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from vacantia.functions import policy as P
from vacantia.operators import dedupe

MEMBER = "id long, block_key string, company_id string, ats_type string, ats_job_id string, apply_url string, geo_scope string, title string, content_hash string, simhash long, text_len int, first_seen_at long"


def candidates(n=260):
    """A third of all rows in one block, most of them near one another; copies, missing values, chains of distances."""
    rng, rows, near = random.Random(31), [], {}
    for i in range(n):
        block = "hot" if i % 3 == 0 else f"b{i % 12}"
        base = near.setdefault((block, rng.randrange(4)), rng.getrandbits(64))
        bits = base
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6, 9, 12])):
            bits ^= 1 << rng.randrange(64)
        near[block, rng.randrange(4)] = bits if rng.random() < 0.3 else base
        signed = bits - (1 << 64) if bits >> 63 else bits
        title = rng.choice(["senior data platform engineer", "data platform engineer", "engineer", "senior site reliability engineer"])
        rows.append((
            i, block, None if rng.random() < 0.03 else "c", rng.choice([None, None, None, "gh"]), rng.choice([None, "1", "2"]), rng.choice([None, None, "", f"https://x.io/{rng.randrange(30)}"]), rng.choice([None, None, None, "US", "DE"]),
            title, rng.choice([None, "", f"h{rng.randrange(60)}"]), rng.choice([signed, signed, signed, 0]), rng.choice([300, 500, 500]), rng.randrange(50),
        ))
        if rng.random() < 0.25:  # exact copies of all that decides
            rows += [(n + 10 * i + k, *rows[-1][1:-1], rng.randrange(50)) for k in range(rng.randrange(1, 4))]
    return rows


@pytest.fixture(scope="module")
def members(spark):
    return dedupe.block_members(spark.createDataFrame(candidates(), MEMBER).repartition(4)).cache()


@pytest.fixture(scope="module")
def judged(members):
    rows = dedupe.pairs(members).select("block_key", "a_ord", "b_ord", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "verdict.same", "verdict.reason", P.auto_apply(F.col("verdict")).alias("auto")).collect()
    return [r for r in rows if r["same"]]


def walk(judged, order, start=()):
    """Oldest first: each survivor takes in its later survivors."""
    auto = {(r["a"], r["b"]): r["reason"] for r in judged if r["auto"]}
    gone, out = set(), set()
    for a in order:
        for b in order:
            if order[a] < order[b] and (a, b) in auto and a not in gone and b not in gone and b not in start:
                gone.add(b)
                out.add((b, a, auto[a, b]))
    return out


def test_keys_find_the_pairs_of_the_whole_block(members, judged):
    got = dedupe.similar_pairs(members).select("block_key", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "verdict.reason", P.auto_apply(F.col("verdict")).alias("auto")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(r["block_key"], r["a"], r["b"], r["reason"], r["auto"]) for r in judged}
    assert {r["reason"] for r in judged} == {"exact_ats", "content_hash", "apply_url", "simhash"} and any(not r["auto"] for r in judged)


def test_rounds_give_the_greedy_clusters(spark, members, judged):
    order = {r["id"]: (r["block_key"], r["ord"]) for r in members.select("id", "block_key", "ord").collect()}
    want = walk(judged, order)
    assert len(want) > 60
    assert {tuple(r) for r in dedupe.leaders(dedupe.pairs(members)).select("from_id", "into_id", "reason").collect()} == want
    assert {tuple(r) for r in dedupe.clusters(members).select("from_id", "into_id", "reason").collect()} == want
    assert dedupe.clusters(members.limit(0)).count() == 0


def test_long_runs_of_neighbours(spark):
    """Each member is near the next only, so every other one goes, whatever the length."""
    rows = [(k, "b", "c", None, None, None, None, "senior data engineer", None, (1 << 3 * k) - 1, 500, k) for k in range(1, 21)]
    got = dedupe.clusters(dedupe.block_members(spark.createDataFrame(rows, MEMBER))).select("from_id", "into_id").collect()
    assert {tuple(r) for r in got} == {(k + 1, k) for k in range(1, 20, 2)}


def test_probes_of_batches_give_the_merges_of_a_sweep(spark, members, judged):
    """Members that come oldest first, in three batches, each held against the stored index."""
    index = dedupe.block_index(members).cache()
    order = {r["id"]: (r["block_key"], r["ord"]) for r in members.select("id", "block_key", "ord").collect()}
    got, weak, gone = set(), set(), set()
    cuts = (0, 4, 15, 10_000)
    for low, high in zip(cuts, cuts[1:], strict=False):
        here = members.filter((F.col("ord") > low) & (F.col("ord") <= high))
        stored = index.filter((F.col("ord") <= high) & ~F.col("m.id").isin(sorted(gone) or [-1]))
        out = dedupe.probe(here, stored)
        new = {tuple(r) for r in out["merges"].select("from_id", "into_id", "reason").collect()}
        weak |= {tuple(r) for r in out["review"].select("left_id", "right_id").collect()}
        got |= new
        gone |= {m[0] for m in new}
    want = walk(judged, order)
    into = {b: a for b, a, _ in want}
    assert got == want
    assert weak == {(r["b"], r["a"]) for r in judged if not r["auto"] and r["a"] not in into and (r["b"] not in into or order[r["a"]] < order[into[r["b"]]])}


def test_survivors_of_random_chains(spark):
    rng = random.Random(3)
    into = {k: (k - rng.randrange(1, 4) if k > 3 and rng.random() < 0.8 else None) for k in range(300)}
    into |= {1000 + k: 1001 + k for k in range(40)} | {1040: None}  # a long chain
    into |= {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2000, 2004: 2004, 2005: 9999}
    got = {r["id"]: (r["survivor"], r["cycle"]) for r in dedupe.survivors(spark.createDataFrame(list(into.items()), "id long, merged_into long")).collect()}

    def end(k):
        seen = set()
        while into.get(k) is not None:
            if k in seen:
                return None, True
            seen.add(k)
            k = into[k]
        return k, False

    assert got == {k: end(k) for k, v in into.items() if v is not None}
