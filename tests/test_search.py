"""The inverted file against all vectors, and chains that are appended to."""

import numpy as np
import pytest

from vacantia.operators import identity, search


def brute(rows, asked, k):
    def cosine(a, b):
        a, b = np.array(a, float), np.array(b, float)
        size = np.sqrt((a * a).sum() * (b * b).sum())
        return float(a @ b / size) if size else 0.0

    out = set()
    for q, v in asked:
        out |= {(q, i) for _, i in sorted((-cosine(v, w), i) for i, w in rows if i != q)[:k]}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    center = rng.normal(size=(6, 16)) * 3
    return [(k, (center[0 if k % 3 else k % 6] + rng.normal(size=16)).tolist()) for k in range(500)]  # two thirds around one center


@pytest.mark.parametrize("queries,vectors", [(256, 4096), (4, 30)])
def test_exact_and_inverted_search(spark, monkeypatch, rows, queries, vectors):
    monkeypatch.setattr(search, "QUERY_BLOCK", queries)
    monkeypatch.setattr(search, "VECTOR_BLOCK", vectors)
    df = spark.createDataFrame([*rows, (None, [1.0] * 16), (1000, None), (1001, [0.0] * 16)], "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 25 = 0")
    exact = search.nearest_to_each(df, asked, 5)
    want = brute([*rows, (1001, [0.0] * 16)], [r for r in rows if r[0] % 25 == 0], 5)
    assert {(r["query_id"], r["vec_id"]) for r in exact.collect()} == want
    index = search.VectorIndex.build(df, 6, sample=200)
    assert index.lists.count() == 501
    assert {(r["query_id"], r["vec_id"]) for r in index.nearest_to_each(asked, 5, 6).collect()} == want
    assert search.recall(index.nearest_to_each(asked, 5, 2), exact).first()["recall"] >= 0.9
    assert search.nearest_to_each(df, df.limit(0), 5).count() == 0


def test_audit_appends(spark):
    """Two batches equal one; a chain longer than an Arrow batch; an entry before the end is refused."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(c, i, "a", None if i % 5 == 0 else "s", f"m{i}") for c in (1, 2) for i in range(1, 60 if c == 1 else 4)]
        entries = spark.createDataFrame(rows, "chain_id int, id long, action string, subject string, metadata string")
        whole = {(r["chain_id"], r["id"]): r["entry_hash"] for r in identity.link_chain(entries).collect()}
        stored = spark.createDataFrame(identity.link_chain(entries.filter("id <= 20")).collect())
        new = identity.link_chain(entries.filter("id > 20"), stored)
        both = stored.unionByName(new)
        assert {(r["chain_id"], r["id"]): r["entry_hash"] for r in both.collect()} == whole
        assert {tuple(r) for r in identity.verify_chain(both).collect()} == {(1, 0), (2, 0)}
        with pytest.raises(Exception, match="before the end of its chain"):
            identity.link_chain(entries.filter("id = 3"), stored).collect()
        other = identity.link_chain(spark.createDataFrame([(9, 1, "a", "s", "m")], entries.schema), stored).first()
        assert other["prev_hash"] == ""
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
