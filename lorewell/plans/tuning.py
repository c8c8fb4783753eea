"""Grid search and the comparison of models."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.operators.evaluation import map_at_k, map_at_k_by
from lorewell.operators.scoring import ItemSide, mixed_top_k
from lorewell.plans.models import Data, EnsembleRecommender, Recommender

# The grid that is searched by default.
ALPHAS, WEIGHTS = (0.4, 0.5, 0.6, 0.7), ((0.5, 0.5), (0.6, 0.4), (0.8, 0.2))
REBUYS, POPS = (0.5, 1.0, 1.5, 2.0), (0.0, 0.05, 0.1, 0.2)


def grid_search(data: Data, truth: DataFrame, alphas: Iterable[float] = ALPHAS, weights: Iterable[tuple] = WEIGHTS, rebuys: Iterable[float] = REBUYS, pops: Iterable[float] = POPS, k: int = 10, **fixed) -> DataFrame:
    """(alpha, weights, rebuy, pop, map_at_k, best): every setting; of equal ones the first is best, map_at_k is null where no user has truth.

    The score is linear in all of these: where the item side fits the workers, one fit
    and one pass over the users with truth score its terms once and rank every mix of
    them.  Otherwise, and for models with EASE, a soup or a diagonal term, each setting
    is a model of its own."""
    settings = list(product(alphas, weights, rebuys, pops))
    if not settings or truth.isEmpty():
        scores = [None] * len(settings)
    else:
        scores = _mixed_scores(data, truth, settings, k, fixed)
        if scores is None:
            scores = [map_at_k(EnsembleRecommender(alpha=alpha, weights=w, rebuy=rebuy, pop=pop, **fixed).fit(data).predict(k), truth, k).first()["map_at_k"] for alpha, w, rebuy, pop in settings]
    top = max(range(len(settings)), key=lambda n: (scores[n] or 0.0, -n), default=-1)
    rows = [(alpha, str(list(w)), rebuy, pop, scores[n], n == top) for n, (alpha, w, rebuy, pop) in enumerate(settings)]
    return data.train.sparkSession.createDataFrame(rows, "alpha double, weights string, rebuy double, pop double, map_at_k double, best boolean")


def _mixed_scores(data: Data, truth: DataFrame, settings: list[tuple], k: int, fixed: dict) -> list[float] | None:
    """The settings' MAP from one pass; None where the model is not a mix of fixed terms on the workers."""
    model = EnsembleRecommender(alpha=0.5, weights=None, rebuy=1.0, pop=1.0, **fixed)
    if model.ease_lambda is not None or model.content != "vectors" or model.diagonal:
        return None
    side = model.fit(data).side
    if side is None:
        return None
    inner, names = getattr(side, "side", side), [f"x{n}" for n in range(len(model.half_lives))]
    constant = model.svd / 2 if model.svd else 0.0
    sides, columns = [], []

    def add(part, column) -> None:
        sides.append(part)
        columns.append([column(*setting) for setting in settings])

    def share(w: tuple, n: int) -> float:
        return w[n] if len(w) == len(names) else 1 / len(names)

    for n, name in enumerate(names):
        if inner.matrix.get(name):  # few items: the item cosine is a matrix
            own = {"matrix": {name: [(1.0, inner.matrix[name][0][1])]}}
        else:
            own = {"cosine": {name: [(1.0, *inner.cosine[name][0][1:])]}}
        add(ItemSide(inner.ids, **own), lambda alpha, w, rebuy, pop, n=n: share(w, n) * alpha)
        if name in inner.dense:
            add(ItemSide(inner.ids, dense={name: [(1.0, inner.dense[name][0][1])]}), lambda alpha, w, rebuy, pop, n=n: share(w, n) * (1 - alpha))
    add(ItemSide(inner.ids, own={model.longest: 1.0}), lambda alpha, w, rebuy, pop: rebuy)
    add(ItemSide(inner.ids, plus=inner.plus - constant), lambda alpha, w, rebuy, pop: pop)
    rest = ItemSide(inner.ids, cosine={name: inner.cosine.get(name, [])[0 if inner.matrix.get(name) else 1 :] for name in names}, links=inner.links, plus=np.full(len(inner.ids), constant))
    add(rest if side is inner else replace(side, side=rest), lambda *setting: 1.0)
    asked = data.users.join(truth.select("u").distinct(), "u", "left_semi")
    found = map_at_k_by(mixed_top_k(asked, model.profiles, sides, np.array(columns).T, k, truth), truth, "mix", k)
    by_mix = {r["mix"]: r["map_at_k"] for r in found.collect()}  # a row for each setting
    return [by_mix.get(n, 0.0) for n in range(len(settings))]


def run_experiments(models: dict[str, Callable[[], Recommender]], data: Data, truth: DataFrame, k: int = 10, threshold: float = 0.207, own: dict[str, Data] | None = None) -> DataFrame:
    """(model, map_at_k, status), best first; `own` has the data of models that do not run on `data`; a model that fails counts as 0 and its status says so."""
    rows = []
    for name, make in models.items():
        try:
            score = map_at_k(make().fit((own or {}).get(name, data)).predict(k), truth, k).first()["map_at_k"] or 0.0
            rows.append((name, float(score), "above threshold" if score > threshold else "below threshold"))
        except Exception as e:
            rows.append((name, 0.0, f"error: {type(e).__name__}"))
    return data.train.sparkSession.createDataFrame(rows, "model string, map_at_k double, status string").orderBy(F.desc("map_at_k"), "model")
