"""The payload data source: cursors, restarts, odd cursors and payloads."""

import json

import pytest
from pyspark.sql import functions as F

from vacantia.sources import boards, payloads


@pytest.fixture
def landing(tmp_path):
    for source, names in (("greenhouse:x", ["001", "002"]), ("greenhouse:y", ["001"])):
        (tmp_path / "in" / source).mkdir(parents=True)
        for name in names:
            (tmp_path / "in" / source / f"{name}.json").write_text(json.dumps({"jobs": [{"id": int(name), "title": source}]}))
    return tmp_path / "in"


def test_batches_from_a_cursor(spark, landing, monkeypatch):
    payloads.register(spark)
    reader = lambda **o: spark.read.format("board_payloads").options(path=str(landing), **o).load()
    rows = reader().collect()
    assert sorted((r["source_id"], json.loads(r["cursor"])["etag"]) for r in rows) == [("greenhouse:x", "001.json"), ("greenhouse:x", "002.json"), ("greenhouse:y", "001.json")]
    after = json.dumps({"greenhouse:x": {"etag": "001.json"}})
    assert reader(cursor=after).count() == 2 and reader(cursor=after, source="greenhouse:x").count() == 1
    for odd in ("{", "[]", '{"greenhouse:x": 7}', '{"greenhouse:x": {"etag": 5}}', ""):
        assert reader(cursor=odd).count() == 3, odd
    posts = boards.postings(boards.decode(reader().withColumn("company_id", F.lit("c"))))
    assert {(r["source_id"], r["source_job_id"]) for r in posts.select("source_id", "source_job_id").collect()} == {("greenhouse:x", "1"), ("greenhouse:x", "2"), ("greenhouse:y", "1")}


def test_odd_payloads_are_failed_polls(landing, monkeypatch):
    monkeypatch.setattr(payloads, "MAX_BODY", 50)
    (landing / "greenhouse:y" / "002.json").write_bytes(b"\xff\xfe")
    (landing / "greenhouse:y" / "003.json").write_text("x" * 51)
    part = payloads.Part("greenhouse:y", [(n, "2026-01-01T00:00:00+00:00") for n in ("002.json", "003.json", "none.json")])
    assert [(r[1], r[3], r[5]) for r in payloads.fetch(f"file://{landing}", part)] == [("failed", None, "fetch: UnicodeDecodeError"), ("failed", None, "payload too large"), ("failed", None, "fetch: FileNotFoundError")]
    assert payloads.parts(f"file://{landing}/nothing", {}) == []


def test_a_restarted_stream_reads_each_payload_once(spark, landing, tmp_path):
    payloads.register(spark)

    def turn():
        stream = spark.readStream.format("board_payloads").option("path", str(landing)).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["source_id"], json.loads(r["cursor"])["etag"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert len(turn()) == 3
    assert len(turn()) == 3
    (landing / "greenhouse:y" / "002.json").write_text("{}")
    (landing / "greenhouse:z").mkdir()
    (landing / "greenhouse:z" / "001.json").write_text("{}")
    got = turn()
    assert len(got) == len(set(got)) == 5
