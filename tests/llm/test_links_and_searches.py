"""Spelling variants, hard negatives and MinHash classes against brute force, on odd rows too."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from vacantia.llm import hard_negatives, minhash, spelling
from vacantia.llm.jaccard_join import shingles
from tests.llm.test_small import SCHEMA, as_key, brute_components, odd_docs, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_docs():
    """Groups around the threshold, short texts among them, and exact copies."""
    rng = random.Random(17)
    rows, k = [], 100
    for size in (4, 7, 8, 12, 25, 60, 150, 600):
        base = words(rng, size).split()
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(50)}"
            rows.append((k, " ".join(copy)))
            k += 1
    return rows


def test_minhash_against_all_pairs(spark, docs, empty):
    got = minhash.near_duplicates(spark.createDataFrame(near_docs(), "doc_id long, text string").repartition(5)).collect()
    assert as_key([tuple(r)[:3] for r in got]) == as_key(brute_components(near_docs(), 85))
    got = minhash.near_duplicates(docs).collect()
    assert as_key([tuple(r)[:3] for r in got]) == as_key(brute_components([(r[0], r[1]) for r in odd_docs()], 85))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(empty).count() == 0
    assert len(minhash.near_duplicates(docs.select("doc_id", "text", docs.text.alias("node"), docs.lang.alias("sigs"))).columns) == 4


def test_signature_places_agree_as_often_as_sets_do():
    """The share of equal places estimates the similarity, for sets of a few tokens too; equal sets agree everywhere."""
    rng = np.random.default_rng(4)
    for size, common in ((8, 6), (40, 30), (3000, 2400)):
        shares = []
        for _ in range(120):
            pool = rng.integers(0, 1 << 63, 2 * size - common, np.uint64) * np.uint64(2)
            a, b = np.sort(pool[:size]), np.sort(pool[size - common :])
            x, y = minhash.places([a, b])
            assert (minhash.places([a])[0] == x).all() and np.isin(x, a).all()
            shares.append((x == y).mean())
        assert abs(np.mean(shares) - common / (2 * size - common)) < 0.04


def test_buckets_miss_almost_nothing():
    rng, missed = np.random.default_rng(8), 0
    for size in [7, 8, 10, 13, 20, 50, 200] * 60:
        out = max(1, int(size * 0.075))  # just above the threshold
        pool = np.sort(rng.integers(0, 1 << 63, size + out, np.uint64) * np.uint64(2))
        gone = rng.permutation(size + out)
        a, b = np.delete(pool, gone[:out]), np.delete(pool, gone[out : 2 * out])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            x, y = minhash.buckets([a, b])
            missed += not (x == y).any()
    assert missed == 0


def brute_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    known = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    shorter = {w: {w[:k] + w[k + 1 :] for k in range(len(w))} for w in known}

    def near(v, w):
        if len(v) == len(w):
            return sum(a != b for a, b in zip(v, w, strict=True)) == 1
        return w in shorter[v] or v in shorter[w]

    form, near_n = {}, {}
    for v, n in known.items():
        found = sorted((-known[w], w) for w in known if abs(len(v) - len(w)) <= 1 and near(v, w))
        near_n[v] = len(found)
        form[v] = found[0][1] if found and -found[0][0] >= 10 * n else None
    out = []
    for v, n in known.items():
        root = v
        while form[root]:
            root = form[root]
        out.append((v, form[v], root, n, near_n[v], known.get(form[v])))
    return out


def variant_docs():
    rng = random.Random(23)
    stems = ["harbour", "harbours", "settlement", "settlements", "élèvent", "ÀÉîöÿabc", "aaaaaaa", "aaaaaaaa", "aaaaaaab", "abcdefgh", "abcdefg", "x" * 300, "×÷×÷×÷×÷"]
    rows = []
    for k in range(400):
        text = []
        for _ in range(30):
            w = stems[min(int(rng.expovariate(0.6)), len(stems) - 1)]
            if rng.random() < 0.06:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "e" + w[at:], w[:at] + "q" + w[at + 1 :]])
            text.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((None if k % 50 == 7 else k // 2, rng.choice([" ", "-", "1", "\n"]).join(text)))
    rows += [(1000 + k, " ".join(["lantern"] * 70 + ["lanterns"] * (7 if k < 10 else 0) + ["lanternss"] * (k == 0) * 4)) for k in range(15)]  # a chain of forms
    return [*rows, (1, None), (2, ""), (None, None), (3, "short"), (4, "ｆｕｌｌｗｉｄｔｈ ħħħħħħħħ")]


@pytest.mark.parametrize("shard,pairs,width", [(16384, 1 << 20, 1 << 25), (5, 3, 400)])
def test_variants_against_all_pairs(spark, monkeypatch, shard, pairs, width):
    """Also with blocks of a few words, and a few pairs at a time."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    rows = variant_docs()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, word int").repartition(4)
    want = brute_variants(rows)
    assert any(w[2] not in (w[0], w[1]) for w in want)
    assert as_key(map(tuple, spelling.variants(df).collect())) == as_key(want)
    known = {w[0]: w[3] for w in want}
    texts, n = list(known), np.array(list(known.values()))
    everyone = np.arange(len(texts))
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    monkeypatch.setattr(spelling, "BYTES", width)
    found = Counter()
    for side in (0, 1):
        for r in spelling.near_words(texts, n, everyone, everyone, side).itertuples():
            found[r.word] += r.n_near
    assert found == Counter({w[0]: w[4] for w in want if w[4]})


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(18)] + [("a", "b")]
    got = dict(map(tuple, spelling.rooted(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {f"w{k}": "w18" for k in range(18)} | {"a": "b"}


def test_variants_of_nothing(empty):
    assert spelling.variants(empty).count() == 0


def brute_negatives(rows):
    fine = [r for r in dict.fromkeys((i, y, None if v is None else tuple(v)) for i, v, y in rows) if None not in r[:2] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    whole = [(i, y, [int(np.floor(256.0 * x)) for x in v]) for i, y, v in fine]
    out = []
    for i, y, v in whole:
        if i % 50:
            continue
        listed = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j, z) for j, z, w in whole if j != i))
        for s, j, _ in [x for x in listed if x[2] == y][:5]:
            found = [x for x in listed if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(found)]
    return out


def vectors():
    rng = np.random.default_rng(6)
    center = rng.normal(size=(4, 8)) / 3
    rows = [(k, (center[k % 4] + rng.normal(size=8) / 3).astype(np.float32).tolist(), int(rng.integers(0, 4))) for k in range(600)]
    rows += [(700 + k, [0.5] * 8, k % 3) for k in range(60)]  # ties
    rows += rows[:60]  # repeated rows, anchors among them
    rows += [(50, [0.25] * 8, 1), (None, [0.1] * 8, 1), (800, None, 1), (850, [0.1, None], 1), (900, [float("nan")] * 8, 1), (950, [float("inf")] * 8, 2), (1000, [0.1] * 8, None), (1050, [], 1), (1100, [1.0], 2), (1150, [-0.5] * 8, 3)]
    return rows


@pytest.mark.parametrize("anchor_block,row_block", [(256, 4096), (3, 40)])
def test_hard_negatives_against_full_lists(spark, monkeypatch, anchor_block, row_block):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", anchor_block)
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", row_block)
    rows = vectors()
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, block int, ids string").repartition(3)
    got = [tuple(r) for r in hard_negatives.mine(df).collect()]
    assert len(got) > 100 and as_key(got) == as_key(brute_negatives(rows))
    assert hard_negatives.mine(df.limit(0)).count() == 0
    assert hard_negatives.mine(df.filter("vec_id % 50 <> 0")).count() == 0


def test_large_components(spark):
    """Scores beyond 2**53 are exact, and beyond 64 bits they stop at the limit."""
    rows = [(0, [1e6, 3e6], 1), (1, [2e6, 1e6], 1), (2, [1e6, 1e6], 2), (3, [1.2e6, 1.1e6], 2)]
    got = [tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()]
    assert got and as_key(got) == as_key(brute_negatives([(i, v, y) for i, v, y in rows]))
    assert hard_negatives.scores(np.array([[1e19, 1.0]]), np.array([[1e19, 1.0], [-1e19, 0.0]])).tolist() == [[2**63 - 1, -(2**63)]]


def test_hard_negatives_equal_their_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    got = hard_negatives.op12_hard_negatives(spark, at)
    found = con.execute(hard_negatives.ORACLE)
    assert [d[0] for d in found.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())


def test_shingle_sets_feed_the_signatures():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["A b C d", "a B c D"])], ["text"])
    x, y = shingles(batch, 0, minhash.SIZE)
    assert (x == y).all()


def test_blocks_of_anchors_and_rows_are_never_broadcast(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(k, rng.integers(-9, 9, 4).astype(float).tolist(), k % 3) for k in range(400)], "vec_id long, embedding array<double>, label int")
    v = hard_negatives.usable(rows, "vec_id", "embedding", "label")
    met = hard_negatives._met(hard_negatives.pack(v.filter("id % 50 = 0"), 2), hard_negatives.pack(v, 5), 2, 5)
    assert "Broadcast" not in met._jdf.queryExecution().sparkPlan().toString()
    assert met.count() == 10
