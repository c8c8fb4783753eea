"""The learned text encoder against dense arithmetic, and the comparison of models on real tables."""

import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import scoring
from lorewell.operators.word_vectors import WordVectors, cooccurrence, shifted_pmi
from lorewell.plans.app import search_by_meaning

TOPICS = [("ring", "bracelet"), ("bolt", "screw")], [("gold", "silver", "polished", "jewel"), ("steel", "thread", "metric", "zinc")]


def texts(n=400, seed=3):
    """Texts of one topic each; ring and bracelet (bolt and screw) never stand in the same one."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        t = k % 2
        words = [rng.choice(TOPICS[0][t]), *rng.choice(TOPICS[1][t], 3)]
        rng.shuffle(words)
        out.append(" ".join(words))
    return out


def dense(texts, window=5):
    """Words, unit word vectors (all dimensions) and idf by numpy."""
    lists = [re.findall(r"\w\w+", t) for t in texts]
    words = sorted({w for x in lists for w in x})
    at = {w: k for k, w in enumerate(words)}
    n = np.zeros((len(words), len(words)))
    for x in lists:
        for a in range(len(x)):
            for b in range(a + 1, min(len(x), a + window + 1)):
                n[at[x[a]], at[x[b]]] += 1
                n[at[x[b]], at[x[a]]] += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.maximum(np.nan_to_num(np.log(n * n.sum() / np.outer(n.sum(1), n.sum(0))), neginf=0), 0)
    u, s, _ = np.linalg.svd(pmi)
    v = u * np.sqrt(s)
    df = Counter(w for x in lists for w in set(x))
    idf = np.array([np.log((1 + len(texts)) / (1 + df[w])) + 1 for w in words])
    return words, v / np.linalg.norm(v, axis=1, keepdims=True), idf


def test_cooccurrence_counts_both_ways(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "c"],), (["b"],), ([],)], "words array<string>")
    got = {(r["a"], r["b"]): r["n"] for r in cooccurrence(rows, 2).collect()}
    assert got == {("a", "b"): 2, ("b", "a"): 2, ("a", "a"): 2, ("a", "c"): 1, ("c", "a"): 1, ("b", "c"): 1, ("c", "b"): 1}
    pmi = {(r["a"], r["b"]): r["x"] for r in shifted_pmi(spark.createDataFrame([(a, b, n) for (a, b), n in got.items()], "a string, b string, n long")).collect()}
    assert pmi["a", "b"] == pytest.approx(np.log(2 * 10 / (5 * 3))) and ("a", "a") not in pmi


def test_search_by_learned_words_against_numpy(spark):
    all_texts = texts()
    items = spark.createDataFrame(list(enumerate(all_texts)), "i long, text string")
    model = WordVectors.fit(items, F.col("text"), dimensions=12)
    words, v, idf = dense(all_texts)
    terms = {r["term"]: (r["idf"], np.array(r["v"])) for r in model.terms.collect()}
    assert sorted(terms) == words
    got = np.stack([terms[w][1] for w in words])
    assert np.abs(got @ got.T - v @ v.T).max() < 1e-6 and np.allclose([terms[w][0] for w in words], idf)
    # words that never meet, but have the same neighbours, are near
    place = {w: k for k, w in enumerate(words)}
    cos = lambda a, b: float(got[place[a]] @ got[place[b]])
    assert cos("ring", "bracelet") > cos("ring", "bolt") + 0.2 and cos("bolt", "screw") > cos("screw", "bracelet") + 0.2
    assert model.nearest_words("ring", 1).first()["term"] in ("bracelet", *TOPICS[1][0])

    def vector(t):
        e = sum(idf[place[w]] * v[place[w]] for w in re.findall(r"\w\w+", t.lower()) if w in place)
        return e / np.linalg.norm(e)

    found = search_by_meaning(items, F.col("text"), "A shiny RING, silver", 10, model=model).collect()
    scores = np.round([vector(t) @ vector("ring silver") for t in all_texts], 6)
    want = sorted(range(len(all_texts)), key=lambda k: (-scores[k], k))[:10]
    assert [r["score"] for r in found] == pytest.approx([scores[k] for k in want], abs=2e-6)
    assert search_by_meaning(items, F.col("text"), "unknown words", model=model).count() == 0
    assert search_by_meaning(items, F.col("text"), " ", model=model).count() == 0


def test_encoder_edges(spark):
    items = spark.createDataFrame([(1, "red ring"), (2, None), (3, "red ring"), (4, "nowhere else")], "i long, text string")
    model = WordVectors.fit(items, F.col("text"))
    e = {r["i"]: r["e"] for r in model.encode(items, F.col("text")).collect()}
    assert e[1] == e[3] and sum(x * x for x in e[1]) == pytest.approx(1.0) and not any(e[2]) and not any(e[4]) and len(e[2]) == len(e[1])
    empty = WordVectors.fit(items.limit(0), F.col("text"))
    assert [r["e"] for r in empty.encode(items, F.col("text")).collect()] == [[]] * 4


def test_items_are_encoded_where_they_are_read(spark, monkeypatch):
    items = spark.createDataFrame([(k, t) for k, t in enumerate([*texts(30), None, "nowhere", ""])], "i long, text string")
    model = WordVectors.fit(items, F.col("text"), dimensions=6)
    near = model.encode(items, F.col("text"))
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: r["e"] for r in near.collect()}
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 0)
    joined = {r["i"]: r["e"] for r in model.encode(items, F.col("text")).collect()}
    assert len(got) == 33 and got == {i: pytest.approx(e, abs=1e-12) for i, e in joined.items()}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_experiments_run_without_an_error(spark):
    from lorewell.plans import models, queries

    rows = queries.experiments(spark, "/root/testdata/sf0.001").collect()
    assert {r["model"] for r in rows} == set(models.MODELS) and not [r for r in rows if r["status"].startswith("error")]
    assert models.MODELS["coupled_semantic"]().weights == [0.7, 0.3]
