"""Exact quantiles by rounds of histogram refinement."""

from __future__ import annotations

from collections.abc import Iterable
from math import ceil, floor, inf, nan

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of an interval in a round.
BINS = 1024


def order_statistics(values: DataFrame, column: str, ranks: Iterable[int], bins: int = BINS) -> dict[int, float]:
    """The values at some ranks (from 0) among the sorted values of a numeric column, compared as doubles; nulls and NaN are left out.

    A round counts the values of each open interval by bins and keeps, for each rank,
    the bin that it falls in, cut down to the least and largest value there.  Every row
    is read once a round, a row for each bin comes back, and an interval ends where it
    holds one value or the rank is its first or last."""
    x = F.col("x")
    own = values.select(F.col(column).cast("double").alias("x")).where(x.isNotNull() & ~F.isnan(x))
    finite = (x > -inf) & (x < inf)
    low, n, lo, hi = own.agg(F.count_if(x == -inf), F.count_if(finite), F.min(F.when(finite, x)), F.max(F.when(finite, x))).first()
    found, todo = {}, {}
    for r in set(ranks):
        if r < low:
            found[r] = -inf
        elif r >= low + n:
            found[r] = inf
        else:
            todo[r] = (lo, hi, low)  # the interval that holds it, and how many values are before that
    while todo:
        for r, (a, b, _) in list(todo.items()):
            if a == b:
                found[r] = a
                del todo[r]
        if not todo:
            break
        intervals = sorted({(a, b) for a, b, _ in todo.values()})
        # halves, so that the width of all doubles does not overflow
        place = [F.when(x.between(a, b), F.struct(F.lit(k).alias("k"), F.least(F.floor((x / 2 - a / 2) / (b / 2 - a / 2) * bins), F.lit(bins - 1)).alias("bin"))) for k, (a, b) in enumerate(intervals)]
        counts = own.select("x", F.explode(F.array_compact(F.array(*place))).alias("p")).groupBy("p.k", "p.bin").agg(F.count("*").alias("c"), F.min("x").alias("least"), F.max("x").alias("most")).collect()
        table: dict[int, list] = {}
        for row in sorted(counts, key=lambda row: (row["k"], row["bin"])):
            table.setdefault(row["k"], []).append(row)
        for r, (a, b, before) in list(todo.items()):
            for row in table[intervals.index((a, b))]:
                if r < before + row["c"]:
                    if r in (before, before + row["c"] - 1):
                        found[r] = row["least"] if r == before else row["most"]
                        del todo[r]
                    else:
                        todo[r] = (row["least"], row["most"], before)
                    break
                before += row["c"]
    return found


def exact_quantiles(values: DataFrame, column: str, shares: Iterable[float], bins: int = BINS) -> list[float | None]:
    """The quantiles of a numeric column with linear interpolation between neighbours; None where there is no value."""
    shares = list(shares)
    n = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return [None] * len(shares)
    at = [p * (n - 1) for p in shares]
    found = order_statistics(values, column, {f(x) for x in at for f in (floor, ceil)}, bins)
    mixed = lambda a, b, t: a if a == b or not t else nan if {a, b} == {-inf, inf} else a + (b - a) * t
    return [mixed(found[floor(x)], found[ceil(x)], x - floor(x)) for x in at]
