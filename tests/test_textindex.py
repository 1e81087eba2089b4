"""Stems, and the inverted index against a plain walk over the texts."""

import math
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacantia.functions import text as X
from vacantia.functions.stem import STOP_WORDS, stem
from vacantia.operators import textindex

#: Pairs of the algorithm's published sample vocabulary.
STEMS = {
    "consistency": "consist", "consisting": "consist", "consolations": "consol", "knightly": "knight", "knocked": "knock", "relational": "relat", "hopping": "hop",
    "hoping": "hope", "generously": "generous", "communication": "communic", "happiness": "happi", "cries": "cri", "ties": "tie", "gas": "gas", "this": "this",
    "kiwis": "kiwi", "agreed": "agre", "feed": "feed", "by": "by", "say": "say", "news": "news", "inning": "inning", "adoption": "adopt", "replacement": "replac",
    "probate": "probat", "rate": "rate", "controlling": "control", "digitizer": "digit", "hopefulness": "hope", "engineers": "engin", "engineering": "engin", "c++": "c++", "": "",
}


@pytest.mark.parametrize("word", STEMS)
def test_stem(word):
    assert stem(word) == STEMS[word]


TEXTS = {
    1: "Engineers who are engineering an engine", 2: "the engineer of <b>platforms</b>", 3: None, 4: "", 5: "sales only", 6: "platform engineering " * 400,
    7: "engineering the platform", 8: "the of and", 9: "engineering the platform",
}


def brute(must, may):
    words = {k: plain_tokens(t) for k, t in TEXTS.items() if t and plain_tokens(t)}
    average = sum(map(len, words.values())) / len(words)
    stems = {k: [None if w in STOP_WORDS else stem(w) for w in v] for k, v in words.items()}
    need = {stem(w) for w in must if w not in STOP_WORDS}
    terms = need | {stem(w) for w in may if w not in STOP_WORDS}
    out = {}
    for k, s in stems.items():
        if need <= set(s) and terms & set(s):
            score = 0.0
            for t in terms & set(s):
                df, tf = sum(t in o for o in stems.values()), s.count(t)
                score += math.log(1 + (len(stems) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(s) / average))
            out[k] = (sum(s.count(t) for t in terms), round(score, 6))
    return out


def plain_tokens(text):
    return re.findall("[a-z0-9+#]+", re.sub("<[^<>]*>", " ", text.lower()))


@pytest.fixture(scope="module")
def index(spark):
    return textindex.TextIndex.build(spark.createDataFrame(list(TEXTS.items()), "id long, text string"))


@pytest.mark.parametrize("must,may", [(["engineer"], []), (["Engineers", "platform"], ["sales"]), ([], ["sales", "engine"]), (["the"], []), (["nowhere"], ["sales"]), (["engineer", "engineering"], [])])
def test_search(index, must, may):
    found = {r["id"]: (r["hits"], r["score"]) for r in index.search(must, may).collect()}
    want = brute([w.lower() for w in must], may)
    assert found.keys() == want.keys()
    for k, (hits, score) in want.items():
        assert found[k][0] == hits and abs(found[k][1] - score) < 2e-6


@pytest.mark.parametrize("words,want", [(["platforms", "engineer"], {6: 400}), (["engineering", "of", "platform"], {2: 1, 7: 1, 9: 1}), (["the"], {}), (["engineer", "who", "are", "engineers"], {1: 1})])
def test_phrase(index, words, want):
    assert {r["id"]: r["n"] for r in index.phrase(words).collect()} == want


def test_a_search_reads_the_folders_of_its_terms(index):
    plan = index._of([stem("engineer")])._jdf.queryExecution().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "term" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_an_empty_table(spark):
    empty = textindex.TextIndex.build(spark.createDataFrame([(1, None)], "id long, text string"))
    assert empty.search(["engineer"]).isEmpty() and empty.phrase(["engineer"]).isEmpty()


def test_tags_in_tags_take_time_in_proportion(spark):
    """Thirty-two thousand tags within tags; a walk that copies its output for every piece takes some twenty seconds."""
    text = "<a <b>> word " * 32_000
    df = spark.createDataFrame([(text,), ("x < y <b>z</b>",)], "t string").select(X.strip_tags(F.col("t")).alias("s"))
    df.collect()
    began = time.perf_counter()
    got = [r["s"] for r in df.collect()]
    assert got == ["   word " * 32_000, "x   "]
    assert time.perf_counter() - began < 8


def test_texts_are_split_and_words_stemmed_once(spark, index, monkeypatch):
    """The number of words comes from the index, and a task stems each different word once, however often it stands there."""
    assert textindex.WHOLE in {r["term"] for r in index.rows.select("term").distinct().collect()}
    assert tuple(index.size.first()) == (7, sum(len(plain_tokens(t)) for t in TEXTS.values() if t))
    asked = []
    monkeypatch.setattr(textindex, "stem", lambda w: asked.append(w) or stem(w))
    tokens = pa.array([["the", "engines", "engine", "engines"], ["engines", "of"], ["the"]])
    got = textindex._posted(pa.array([7, 8, 9]), tokens, False).to_pylist()
    assert asked == ["engines", "engine"]
    want = {(7, "engin", (1, 2, 3), 4), (8, "engin", (0,), 2)}
    assert {(r["id"], r["term"], tuple(r["positions"]), r["n_words"]) for r in got} == want and len(got) == 2
