"""All pairs of a block."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.test_dedupe import MEMBER, candidates
from vacantia.functions import policy as P
from vacantia.operators import dedupe


def test_titles_and_addresses_are_taken_apart_before_pairs_are_made(spark):
    rows = [(k, "b", k, "c", None, None, f"https://x.example/{k % 3}?q", None, "Senior Backend Engineer", f"h{k % 4}", 5 + k % 2, 500) for k in range(12)]
    shape = "id long, block_key string, first_seen_at long, company_id string, ats_type string, ats_job_id string, apply_url string, geo_scope string, title string, content_hash string, simhash long, text_len int"
    found = dedupe.pairs(dedupe.block_members(spark.createDataFrame(rows, shape)))
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["a"]["id"], r["b"]["id"]): r["verdict"]["reason"] for r in found.collect()}
    assert len(got) == 66
    assert all(why == ("content_hash" if (b - a) % 4 == 0 else "apply_url" if (b - a) % 3 == 0 else "simhash") for (a, b), why in got.items())


@pytest.mark.parametrize("chunk", [1, 7, 2048])
def test_a_block_is_dealt_to_tasks_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(dedupe, "CHUNK", chunk, raising=False)
    monkeypatch.setattr(dedupe, "PAIRS_A_TASK", 200, raising=False)
    members = dedupe.block_members(spark.createDataFrame(candidates(120), MEMBER))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = dedupe.pairs(members).select("block_key", "a_ord", "a", "b_ord", "b", "verdict", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = lambda s: members.select("block_key", F.col("ord").alias(f"{s}_ord"), F.struct("id", *dedupe.FIELDS).alias(s))
    both = side("a").join(side("b"), "block_key").filter("a_ord < b_ord")
    want = both.withColumn("verdict", P.decide(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))).select("block_key", "a_ord", "a", "b_ord", "b", "verdict").collect()
    key = lambda r: (r["block_key"], r["a_ord"], r["b_ord"])
    assert [tuple(r)[:-1] for r in sorted(rows, key=key)] == [tuple(r) for r in sorted(want, key=key)]
    assert {r["verdict"]["reason"] for r in rows} == {"", "exact_ats", "content_hash", "apply_url", "simhash"}
    if chunk < 2048:
        assert len({r["task"] for r in rows if r["block_key"] == "hot"}) > 2


def test_no_texts_and_no_rounding_for_each_pair(spark):
    found = __spark_entry__.queries()["dedupe_decide"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f"{side}_{c}" in plan for side in "ab" for c in ("content_hash", "title", "apply_url"))
    assert plan.count("round(") == plan.count("THEN round(") == 1
