"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400.0


def decay(last: Column, t: Column, half_life: float) -> Column:
    """exp(-ln 2 / half-life x days before the user's last interaction)."""
    return F.exp(-F.log(F.lit(2.0)) / F.lit(float(half_life)) * (last - t) / F.lit(DAY))


def over(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 (weights underflow to 0, and zero rows stay zero)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def smooth_idf(n: Column, df: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays zero.  (The length is bound once, not worked out for each component.)"""
    one = F.array(F.struct(v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)).alias("n")))
    return F.transform(one, lambda s: F.transform(s["v"], lambda x: over(x, s["n"])))[0]


def cut(text: Column, n: int, always: bool = False) -> Column:
    """The first n characters and '...', by default only where something is cut off."""
    short = F.concat(F.substring(text, 1, n), F.lit("..."))
    return short if always else F.when(F.length(text) > n, short).otherwise(text)


def epoch_timestamp(t: Column, largest: Column) -> Column:
    """Epoch numbers as timestamps: over 1e12 (by the largest) microseconds, over 1e10 milliseconds, else seconds."""
    return F.when(largest > 1e12, F.timestamp_micros(t.cast("long"))).when(largest > 1e10, F.timestamp_millis(t.cast("long"))).otherwise(F.timestamp_seconds(t))
