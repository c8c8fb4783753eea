"""Pair sums, EASE by blocks and block Lanczos against dense arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import latent, pairs, scoring
from lorewell.plans import models


def table(spark, users=60, items=50, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(u, 3 * int(i), float(rng.random())) for u in range(users) for i in rng.choice(items, rng.integers(1, items // 2), replace=False)]
    ids = np.arange(0, 3 * items + 9, 3)  # the last items have no user
    x = np.zeros((users, len(ids)))
    for u, i, w in rows:
        x[u, i // 3] = w
    return spark.createDataFrame(rows, "u long, i long, x double"), ids, x


@pytest.mark.parametrize("cell", [1, 3, 1024])
def test_pair_sums_are_the_gram_matrix(spark, cell):
    values, ids, x = table(spark)
    values = values.unionByName(spark.createDataFrame([(None, 3, 5.0)], "u long, i long, x double"))
    got = {(r["i"], r["j"]): r["g"] for r in pairs.pair_sums(values, cell=cell).collect()}
    g = x.T @ x
    assert got.keys() == {(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero((x != 0).T.astype(int) @ (x != 0).astype(int)), strict=True)}
    assert all(got[a, b] == pytest.approx(g[a // 3, b // 3]) for a, b in got)
    assert pairs.pair_sums(values.limit(0)).count() == 0


def test_heavy_user_is_dealt_over_cells(spark):
    """A user with a tenth of the rows: its cells are as large as others', and no row is copied more than once for each of its blocks."""
    rows = [(0, i, 1.0) for i in range(2000)] + [(u, (7 * u + k) % 2000, 1.0) for u in range(1, 1801) for k in range(10)]
    values = spark.createDataFrame(rows, "u long, i long, x double")
    left, right = pairs.cell_sides(values, cell=100)
    size = lambda side: {(r["key"], r["lo"], r["hi"]): r["count"] for r in side.groupBy("key", "lo", "hi").count().collect()}
    a, b = size(left), size(right)
    assert a.keys() == b.keys() and len([c for c in a if c[0] == 0]) == 20 * 21 // 2
    assert max(*a.values(), *b.values()) < 160
    assert left.where("key = 0").count() + right.where("key = 0").count() == 2000 * 21
    sums = pairs.pair_sums(values, cell=100)
    want = values.alias("a").join(values.alias("b"), "u").groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.lit(1.0)).alias("g"))
    assert sums.exceptAll(want).isEmpty() and sums.count() == want.count()


@pytest.mark.parametrize("size", [7, 20, 1024])
def test_ease_by_blocks(spark, size):
    values, ids, x = table(spark)
    e = latent.ease(values, ids, 3.0, size)
    p = np.linalg.inv(x.T @ x + 3.0 * np.eye(len(ids)))
    want = -p / np.diag(p)
    np.fill_diagonal(want, 0.0)
    assert np.abs(e.columns(0, len(ids)) - want).max() < 1e-10 and np.abs(e.columns(5, 23) - want[:, 5:23]).max() < 1e-10
    assert np.abs(latent.ease_weights(x.T @ x, 3.0) - want).max() < 1e-10
    assert e.residual() < 1e-10 and e.largest() == pytest.approx(np.abs(want).max())


def test_ease_in_arrays_and_by_item_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    ix = spark.createDataFrame([(int(u), int(i), float(t)) for u, i, t in zip(rng.integers(0, 20, 300), rng.integers(0, 30, 300), rng.integers(0, 4_000_000, 300), strict=True)], "u long, i long, t double").distinct()
    data = models.Data(ix, ix.select("u").union(spark.createDataFrame([(99,)], "u long")), ix)
    want = sorted(map(tuple, models.EASERecommender(5.0).fit(data).predict(4).collect()))
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 5000)
    blocks = models.EASERecommender(5.0).fit(data).predict(4)
    assert sorted(map(tuple, blocks.collect())) == want and len(want) == 21 * 4


def test_svd_of_a_flat_spectrum_with_restarts(spark):
    values, ids, x = table(spark, users=300, items=260)
    exact, vt = np.linalg.svd(x)[1:]
    met = []

    def times(q):
        met.append(q.shape[1])
        return x.T @ (x @ q)

    theta, v, residual = latent.largest_eigenpairs(times, len(ids), 12, 6)
    assert max(met) == 6 and len(met) > 8 and residual <= 1e-9
    assert np.abs(np.sqrt(theta) - exact[:12]).max() < 1e-6
    assert np.abs(v @ v.T - vt[:12].T @ vt[:12]).max() < 1e-5
    v, s = latent.truncated_svd(values, ids, 12, 300)
    assert np.abs(s - exact[:12]).max() < 1e-6 and np.abs(v.T @ v - np.eye(12)).max() < 1e-9
    assert np.abs(v @ v.T - vt[:12].T @ vt[:12]).max() < 1e-5


def test_eigenpairs_of_small_and_singular_matrices():
    rng = np.random.default_rng(2)
    for n, rank, k, width in ((1, 1, 1, 4), (5, 5, 3, 2), (40, 3, 5, 4), (30, 0, 2, 3), (64, 64, 64, 10)):
        f = rng.standard_normal((n, rank))
        a = f @ f.T
        theta, v, _ = latent.largest_eigenpairs(lambda q, a=a: a @ q, n, k, width)
        assert np.allclose(theta, np.sort(np.linalg.eigvalsh(a))[::-1][: len(theta)], atol=1e-8) and len(theta) >= min(k, max(rank, 1))
        assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-8)


def test_inverse_by_halves():
    rng = np.random.default_rng(1)
    for n in (1, 2, 64, 65, 300):
        f = rng.standard_normal((n, n + 5))
        a = f @ f.T + np.eye(n)
        assert np.abs(latent.inverse(a) @ a - np.eye(n)).max() < 1e-8


def test_gram_product_in_pieces(spark, monkeypatch):
    values, ids, x = table(spark)
    by_user = values.groupBy("u").agg(F.collect_list(F.struct("i", "x")).alias("row"))
    q = np.random.default_rng(3).standard_normal((len(ids), 5))
    for piece, part in ((1, 4), (1 << 21, 1 << 14)):
        monkeypatch.setattr(latent, "PIECE", piece)
        monkeypatch.setattr(latent, "SLICE", part)
        assert np.allclose(latent.gram_times(by_user, ids, q), x.T @ (x @ q))


def test_pieces_of_the_item_side_count_together(spark, monkeypatch):
    rng = np.random.default_rng(4)
    ix = spark.createDataFrame([(int(u), int(i), float(t)) for u, i, t in zip(rng.integers(0, 20, 300), rng.integers(0, 30, 300), rng.integers(0, 4_000_000, 300), strict=True)], "u long, i long, t double").distinct()
    data = models.Data(ix, ix, ix)
    model = models.EnsembleRecommender(keyword=0, svd=0).fit(data)
    assert model.side.nbytes > 10_000
    want = {(r["u"], r["rank"]): r["score"] for r in model.predict(3).collect()}
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", model.side.nbytes - 1)  # each piece fits, all together do not
    joined = models.EnsembleRecommender(keyword=0, svd=0).fit(data)
    assert joined.side is None
    assert {(r["u"], r["rank"]): pytest.approx(r["score"], abs=3e-6) for r in joined.predict(3).collect()} == want


def test_pair_sums_by_bands(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a = np.where(rng.random((60, 40)) < 0.3, rng.standard_normal((60, 40)), 0)
    a[3] = 1.0  # a heavy key
    a[:, 7] += 1.0  # and an item of all
    values = spark.createDataFrame([(int(u), int(i) * 5, float(a[u, i])) for u, i in zip(*np.nonzero(a), strict=True)], "u long, i long, x double")
    held = (a != 0).astype(float)
    want = {(int(i) * 5, int(j) * 5): (a.T @ a)[i, j] for i, j in zip(*np.nonzero(held.T @ held), strict=True)}
    for cell, band, split in ((1000, 10**6, 10**6), (1000, 300, 10**6), (16, 300, 10**6), (16, 100, 150)):
        got = pairs.band_sums(values, 5000, cell=cell, band=band, split=split).collect()
        assert len(got) == len(want) and {(r["i"], r["j"]): pytest.approx(r["g"], abs=1e-9) for r in got} == want
    # many pairs of many items take this way, and no row of a pair is shuffled
    monkeypatch.setattr(pairs, "MANY", 100)
    spread = spark.range(400).selectExpr("id div 4 AS u", "id AS i", "1.0D AS x")
    plan = pairs.pair_sums(spread)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "least(" not in plan
    assert pairs.pair_sums(spread).count() == 1600


def test_a_band_gets_a_list_once():
    import pyarrow as pa

    ids, values = pa.list_(pa.int64()), pa.list_(pa.float64())
    light = {"i": pa.array([[]], ids), "x": pa.array([[]], values), "n": pa.array([2], pa.int32()), "j": pa.array([[1, 2, 3]], ids), "y": pa.array([[1.0, 2.0, 3.0]], values)}
    heavy = {"i": pa.array([[2]], ids), "x": pa.array([[5.0]], values), "n": pa.array([0], pa.int32()), "j": pa.array([[1, 3]], ids), "y": pa.array([[7.0, 11.0]], values)}
    got = pairs._band_pairs(pa.concat_tables([pa.table(light), pa.table(heavy)])).to_pylist()
    assert [(r["i"], r["j"], r["g"]) for r in got] == [(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0), (2, 2, 4.0), (2, 3, 6.0 + 55.0)]
