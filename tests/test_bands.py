"""Item columns by bands against the block scorer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import bands, scoring
from lorewell.plans import models


def data_of(spark, n_users=60, n_items=90, rows=900, seed=3):
    rng = np.random.default_rng(seed)
    ix = spark.createDataFrame([(int(u), int(i), float(t)) for u, i, t in zip(rng.integers(0, n_users, rows), rng.integers(0, n_items, rows) ** 2, rng.integers(0, 4_000_000, rows), strict=True)], "u long, i long, t double").distinct()
    alone = spark.createDataFrame([(900, 5), (901, 7)], "u long, i long")  # without a row to train on
    return models.Data(ix, ix.select("u").union(alone.select("u")), ix.select("i").union(alone.select("i")))


def listed(df):
    return sorted((r["u"], r["rank"], r["i"], r["score"]) for r in df.collect())


@pytest.mark.parametrize(("model", "k"), [("CosineRecommender", 5), ("HistoryFilterRecommender", 5), ("HistoryFilterRecommender", 100)])
def test_bands_give_what_blocks_give_and_shuffle_no_scores(spark, monkeypatch, model, k):
    m = getattr(models, model)().fit(data_of(spark))
    want = listed(m.predict(k))
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(bands, "BAND_BYTES", 4000)
    monkeypatch.setattr(bands, "NEAR", 300)
    monkeypatch.setattr(scoring, "join_scores", None)  # no row for each user, item and link
    got = listed(m.predict(k))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1.1e-6)
    assert sum(a[2] == b[2] for a, b in zip(got, want, strict=True)) >= 0.98 * len(want)


def test_a_few_users_need_only_their_neighbours(spark, monkeypatch):
    data = data_of(spark, n_users=400, n_items=4000, rows=3000)
    m = models.CosineRecommender().fit(data)
    want = [r for r in listed(m.predict(5)) if r[0] == 7]
    columns = scoring.near_columns(m.columns, m.x.where("u = 7"))
    assert 0 < columns.count() * 10 < m.columns.count()
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", m.columns.count() * 24 - 1)
    monkeypatch.setattr(scoring, "banded_top_k", None)
    m.data.users = m.data.users.where(F.col("u") == 7)
    assert listed(m.predict(5)) == want and len(want) == 5


def test_few_items_of_many_users_are_scored_by_item_pairs(spark):
    m = models.CosineRecommender().fit(data_of(spark, n_users=300, n_items=12, rows=6000))
    side = scoring.cosine_side(m.data.items, m.columns)
    assert not side.cosine and side.matrix["x"][0][1].shape == (14, 14)
    joins = scoring.padded(scoring.top_k(scoring.join_scores(m.x, scoring.pair_sums(m.columns, x="c").withColumnRenamed("g", "s")), 4), m.data.users, m.data.items, 4)
    assert listed(scoring.block_top_k(m.data.users, {"x": m.x}, side, 4)) == listed(joins)


def test_grid_of_few_items_is_as_each_setting_by_itself(spark, monkeypatch):
    from lorewell.plans import tuning

    data = data_of(spark, n_users=40, n_items=8, rows=900)
    far = spark.createDataFrame([(10_000 + k, [1.0, 0.0]) for k in range(50)] + [(k * k, [float(k % 2), float((k + 1) % 2)]) for k in range(8)], "i long, e array<double>")
    data.vectors = far
    truth = data.train.where("i % 2 = 0")
    grid = {"alphas": (0.4,), "weights": ((0.6, 0.4),), "rebuys": (0.5,), "pops": (0.1,), "svd": 0, "keyword": 0}
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 3000)  # too little for the vectors of items that are never recommended
    one = tuning.grid_search(data, truth, k=3, **grid).first()["map_at_k"]
    model = models.EnsembleRecommender(alpha=0.4, weights=(0.6, 0.4), rebuy=0.5, pop=0.1, svd=0, keyword=0).fit(data)
    assert model.side is not None and model.side.matrix["x0"] and not model.side.cosine
    assert one == pytest.approx(tuning.map_at_k(model.predict(3), truth, 3).first()["map_at_k"]) and one > 0


def test_bands_do_not_pass_through_the_driver(spark, monkeypatch):
    m = models.CosineRecommender().fit(data_of(spark))
    want = [r[:2] for r in listed(m.predict(5))]
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(bands, "BAND_BYTES", 1000)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", None)
    columns = m.columns.persist()
    packed, found = bands.bands_of(columns, "i", "u", columns.count())
    assert len(found) > 3 and len({f for _, _, f in found}) == packed.count() == len(found)
    assert sum(len(values) for *_, values in bands._loaded(found, 0, 1 << 40)) == columns.count()
    assert [r[:2] for r in listed(m.predict(5))] == want
