"""Exact quantiles and running shares against numpy."""

import math

import numpy as np
import pytest

from lorewell.operators import statistics as S
from lorewell.operators.quantiles import exact_quantiles, order_statistics

SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0]


@pytest.mark.parametrize(("kind", "bins"), [*((kind, bins) for kind in ("normal", "ties", "one", "long") for bins in (2, 1024)), ("wide", 1024)])
def test_quantiles_are_numpys(spark, kind, bins):
    rng = np.random.default_rng(3)
    x = {
        "normal": rng.standard_normal(1003), "ties": rng.integers(0, 4, 1000).astype(float), "wide": np.concatenate([rng.standard_normal(300) * 10.0 ** rng.integers(-300, 300, 300), [1.7e308, -1.7e308, 5e-324, 0.0]]),
        "one": np.array([7.5]), "long": rng.integers(0, 10**15, 500).astype(float),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "v double")
    order = sorted(x)
    ranks = {0, len(x) // 3, len(x) // 2, len(x) - 1}
    assert order_statistics(df, "v", ranks, bins) == {r: order[r] for r in ranks}
    if kind != "wide":
        assert exact_quantiles(df, "v", SHARES, bins) == pytest.approx(list(np.quantile(x, SHARES)), rel=1e-12)


def test_quantiles_of_infinities_and_nothing(spark):
    df = spark.createDataFrame([(float(v),) for v in (-math.inf, 1, 2, 3, math.inf, math.inf)], "v double")
    assert exact_quantiles(df, "v", [0.0, 0.2, 0.4, 1.0]) == [-math.inf, 1.0, 2.0, math.inf]
    assert exact_quantiles(df.limit(0), "v", [0.5]) == [None] and exact_quantiles(df.where("v = 2"), "v", [0.3]) == [2.0]


def test_running_share_with_one_frequent_count(spark):
    """Most keys have the count 1: they are cut into parts and keep their order."""
    rng = np.random.default_rng(1)
    keys = rng.permutation(5000)
    counts = [(int(k), 1 if n < 4500 else int(rng.integers(2, 40))) for n, k in enumerate(keys)]
    df = spark.createDataFrame(counts, "i long, count long")
    want = sorted(counts, key=lambda x: (-x[1], x[0]))
    total, run = sum(c for _, c in counts), 0
    got = {r["i"]: (r["position"], r["cum_share"], r["cdf"]) for r in S.cumulative_share(df, "i", together=500).collect()}
    for n, (k, c) in enumerate(want, 1):
        run += c
        assert got[k] == (n, pytest.approx(run / total), pytest.approx(n / 5000))
    names = df.selectExpr("CAST(i AS STRING) AS i", "count")
    assert S.cumulative_share(names, "i", together=500).agg({"position": "max"}).first()[0] == 5000
