"""The pipeline as a whole against its decisions worked out in plain Python."""

import re
from collections import Counter

import duckdb

from vacantia.llm import mixing, quality_rules

DIR = "/root/testdata/sf0.001"


def five_word_components(rows):
    """Near copies as the stage takes them: five words, 0.8."""
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = frozenset(zip(*(w[j:] for j in range(5)), strict=False)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return [(i, len(sets[i]), root[i]) for i in sets]


def frequent_lines(docs):
    """Of every host the normalised lines that are in too many of its distinct texts."""
    texts = {(d[2] or "", d[1] or "") for d in docs}
    hosts = Counter(h for h, _ in texts)
    seen, words = Counter(), {}
    for h, t in texts:
        own = Counter()
        for line in t.split("\n"):
            if w := re.findall(r"[^\x20\x09-\x0D]+", line):
                own[h, " ".join(w).lower()] += len(w)
        seen.update(own.keys())
        for k, n in own.items():
            words[k] = min(n, words.get(k, n))
    q = quality_rules
    return {k for k, n in seen.items() if n > q.LEAST_DOCS and (100 * n > q.MOST_SHARE * hosts[k[0]] or n > q.MOST_DOCS and words[k] >= q.LINE_WORDS)}


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DIR).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
    rows = con.sql("SELECT doc_id, text, source, lang FROM documents").fetchall()
    often = frequent_lines(rows)
    docs = {}
    for i, t, h, lang in rows:
        if i in good:
            lines = [x for x in t.split("\n") if (h or "", " ".join(re.findall(r"[^\x20\x09-\x0D]+", x)).lower()) not in often]
            docs[i] = (i, "\n".join(lines), h, lang)
    best = {}
    for i, t, *_ in docs.values():
        norm = re.sub(r"[ \t-\r]", "", t)
        best[norm] = min(best.get(norm, (1, 0)), (-len(t), i))
    docs = {i: docs[i] for _, i in best.values()}
    least = {i: c for i, _, c in five_word_components([(i, d[1]) for i, d in docs.items()])}
    docs = {i: d for i, d in docs.items() if least[i] == i}
    known = mixing.described(spark.createDataFrame(list(docs.values()), "doc_id long, text string, source string, lang string")).drop("text").collect()
    cells = Counter()
    for r in known:
        cells[r["mix_source"], r["mix_lang"], r["mix_topic"]] += r["mix_tokens"]
    chance = {(s, la, t): w for s, la, t, w in mixing.calibrate([(*k, v) for k, v in cells.items()], mixing.TARGETS, mixing.FRACTION).chances}
    want = {r["doc_id"] for r in known if r["mix_u"] < chance.get((r["mix_source"], r["mix_lang"], r["mix_topic"]), 0)}
    assert {r["doc_id"] for r in got} == want
    full = Counter()
    for r in got:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 2048


def test_stages_on_odd_rows(spark):
    """Nulls, empties, ties, repeated rows, clashing names and an empty table go through every stage."""
    import corpus_pipeline
    from tests.llm.test_small import SCHEMA, odd_docs

    plain = spark.createDataFrame(odd_docs(), SCHEMA)
    clash = plain.selectExpr("*", "1 AS host", "2 AS print", "3 AS best", "4 AS mix_u", "5 AS node", "6 AS gone_id", "7 AS piece")
    for start in (plain, clash, plain.limit(0)):
        docs, sizes = start, [start.count()]
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, DIR)
            sizes.append(docs.count())
            if k < 4:
                assert docs.columns == start.columns
                assert sizes[-1] <= sizes[-2]
        assert sizes[0] == 0 or 0 < sizes[3] < sizes[1]
