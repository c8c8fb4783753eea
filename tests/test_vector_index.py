"""The stored vector index against a whole scan."""

import numpy as np
import pytest

from lorewell.operators.vector_index import VectorIndex


def brute(e, q, k, without=None):
    scores = np.round(e @ q, 6)
    order = sorted((j for j in range(len(e)) if j != without), key=lambda j: (-scores[j], j))[:k]
    return [(j, r, scores[j]) for r, j in enumerate(order, 1)]


def clustered(n=3000, d=16, topics=40, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((topics, d))
    e = centres[rng.integers(0, topics, n)] + 0.15 * rng.standard_normal((n, d))
    e[5] = e[6] = e[7]  # ties
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    e[9] = 0.0
    return e


@pytest.mark.parametrize("spread", [False, True])
def test_index_finds_what_a_scan_finds(spark, tmp_path, spread):
    e = clustered() if not spread else clustered(600, 8, 600)
    vectors = spark.createDataFrame([(j, x.tolist()) for j, x in enumerate(e)] + [(None, e[0].tolist()), (99_999, None)], "i long, e array<double>")
    VectorIndex.build(vectors, str(tmp_path / "index"), wished=60)
    index = VectorIndex.open(spark, str(tmp_path / "index"))
    rng = np.random.default_rng(2)
    queries = np.vstack([e[[5, 7, 100, 200]], rng.standard_normal((4, e.shape[1]))])
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    table = spark.createDataFrame([(n, q.tolist()) for n, q in enumerate(queries)], "q_id long, q array<double>")
    for k in (1, 10, 5000):
        found, read = index.search(table, k)
        got = {}
        for r in found.orderBy("q_id", "rank").collect():
            got.setdefault(r["q_id"], []).append((r["i"], r["rank"], r["score"]))
        for n, q in enumerate(queries):
            want = brute(e, q, k)
            assert [x[2] for x in got[n]] == pytest.approx([x[2] for x in want], abs=1.1e-6) and (k > 10 or [x[:2] for x in got[n]] == [x[:2] for x in want])
        shares = {r["q_id"]: r["read"] / r["parts"] for r in read.collect()}
        assert len(shares) == 8 and (k > 10 or spread or max(shares[n] for n in range(4)) < 0.35)


def test_own_item_is_left_out_and_empty_tables(spark, tmp_path):
    e = clustered(300)
    vectors = spark.createDataFrame([(j, x.tolist()) for j, x in enumerate(e)], "i long, e array<double>")
    index = VectorIndex.build(vectors, str(tmp_path / "a"), wished=50)
    shelf = vectors.where("i IN (5, 50)").selectExpr("i AS q_id", "e AS q", "i AS own")
    found = index.search(shelf, 3, without="own")[0].orderBy("q_id", "rank").collect()
    assert [(r["i"], r["rank"]) for r in found if r["q_id"] == 5] == [x[:2] for x in brute(e, e[5], 3, 5)] and found[0]["i"] == 6
    assert index.search(shelf.limit(0), 3, without="own")[0].count() == 0
    empty = VectorIndex.build(vectors.limit(0), str(tmp_path / "b"))
    assert empty.search(shelf, 3)[0].count() == 0


def test_queries_are_sent_once_and_give_their_best_only(spark, tmp_path):
    e = clustered(400)
    vectors = spark.createDataFrame([(j, x.tolist()) for j, x in enumerate(e)], "i long, e array<double>")
    index = VectorIndex.build(vectors, str(tmp_path / "index"), wished=200)
    queries = vectors.where("i < 20").selectExpr("i AS q_id", "e AS q")
    scored = index._scored(queries, index.bounds(queries), 3)
    assert "Join" not in scored._jdf.queryExecution().toString() and 60 <= scored.count() < 20 * 400


def test_files_follow_the_vectors_and_the_driver_sees_no_query(spark, tmp_path, monkeypatch):
    e = clustered(1500)
    vectors = spark.createDataFrame([(j, x.tolist()) for j, x in enumerate(e)], "i long, e array<double>")
    index = VectorIndex.build(vectors, str(tmp_path / "index"), wished=4)  # 375 partitions
    assert len(index.vectors.inputFiles()) < 20 and index.parts.count() > 200
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)
    shelf = vectors.where("i % 10 = 5").selectExpr("i AS q_id", "e AS q", "i AS own")
    found = index.search(shelf, 3, without="own")[0]
    rows = found.orderBy("q_id", "rank").collect()
    for own in (5, 15, 995):
        assert [(r["i"], r["rank"]) for r in rows if r["q_id"] == own] == [x[:2] for x in brute(e, e[own], 3, own)]
