"""Models that are saved give the same predictions where they are loaded."""

import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from lorewell.operators import scoring
from lorewell.plans import models, persist


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    ix = spark.createDataFrame([(int(u), int(i), float(t)) for u, i, t in zip(rng.integers(0, 15, 200), rng.integers(0, 20, 200), rng.integers(0, 4_000_000, 200), strict=True)], "u long, i long, t double").distinct().persist()
    items = spark.createDataFrame([(k, f"red ring {k % 3}", f"A{k % 5}", "tools", "P") for k in range(20)], "i long, Title string, Author string, Subjects string, Publisher string")
    e = rng.standard_normal((20, 6))
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    return models.Data(ix, ix, ix, items, spark.createDataFrame([(k, v) for k, v in enumerate(e.tolist())], "i long, e array<double>"))


@pytest.mark.parametrize("name", ["semantic_hybrid", "ensemble_hybrid", "diversified", "history_filter", "sequential", "popularity", "svd", "ease"])
def test_saved_models_predict_the_same(spark, data, tmp_path, monkeypatch, name):
    fitted = models.MODELS[name]().fit(data)
    persist.save(fitted, str(tmp_path / name))
    want = sorted(map(tuple, fitted.predict(5).collect()))
    monkeypatch.setattr(type(fitted), "fit", lambda *a: pytest.fail("fitted again"))
    loaded = persist.load(spark, str(tmp_path / name))
    assert type(loaded) is type(fitted) and sorted(map(tuple, loaded.predict(5).collect())) == want and len(want) == 75


def test_saved_model_by_joins(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(scoring, "BROADCAST_BYTES", 600)
    fitted = models.coupled_semantic().fit(data)
    assert fitted.side is None
    persist.save(fitted, str(tmp_path / "m"))
    assert sorted(map(tuple, persist.load(spark, str(tmp_path / "m")).predict(3).collect())) == sorted(map(tuple, fitted.predict(3).collect()))


def test_estimator_and_model_in_a_new_session(spark, data, tmp_path):
    path = str(tmp_path / "ranking")
    model = persist.RankingEstimator("bm25", 4).fit(data.train)
    model.write().overwrite().save(path)
    want = sorted(map(tuple, model.transform(data.users).collect()))
    assert len(want) == 60 and model.transform(data.users.where("u = 3")).count() == 4
    persist.RankingEstimator("svd", 7).write().overwrite().save(str(tmp_path / "estimator"))
    again = persist.RankingEstimator.load(str(tmp_path / "estimator"))
    assert (again.getOrDefault("name"), again.getOrDefault("k")) == ("svd", 7)
    code = (
        "import sys\nfrom pyspark.sql import SparkSession\nfrom lorewell.plans.persist import RankingModel\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.driver.host', '127.0.0.1').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        f"m = RankingModel.load({path!r})\n"
        "print('ROWS', sorted(map(tuple, m.transform(spark.range(100).withColumnRenamed('id', 'u')).collect())))\n"
    )
    done = subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, cwd=Path(__file__).parents[1], env=os.environ | {"PYTHONPATH": str(Path(__file__).parents[1])}, timeout=180)
    assert eval(done.stdout.split("ROWS ")[1]) == want


def test_unknown_contents_are_refused(spark, data, tmp_path):
    fitted = models.CosineRecommender().fit(data)
    fitted.other = object()
    with pytest.raises(TypeError):
        persist.save(fitted, str(tmp_path / "x"))
