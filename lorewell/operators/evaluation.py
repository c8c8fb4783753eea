"""Ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _gained(predictions: DataFrame, wanted: DataFrame, *by: str) -> DataFrame:
    """(by, u, g): sum of hits so far / rank at each hit, of users with hits."""
    hits = predictions.select(*by, "u", "i", "rank").join(wanted, ["u", "i"], "left_semi")
    so_far = F.row_number().over(Window.partitionBy(*by, "u").orderBy("rank"))
    return hits.withColumn("g", so_far / F.col("rank")).groupBy(*by, "u").agg(F.sum("g").alias("g"))


def average_precision(predictions: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(u, ap) of users with truth: sum of hits so far / rank at each hit, over min(truth, k).

    predictions: (u, i, rank); truth: (u, i), repeats counted once."""
    wanted = truth.select("u", "i").distinct()
    sizes = wanted.groupBy("u").agg(F.count("*").alias("n"))
    return sizes.join(_gained(predictions, wanted), "u", "left").select("u", (F.coalesce("g", F.lit(0.0)) / F.least(F.col("n"), F.lit(k))).alias("ap"))


def map_at_k(predictions: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """(map_at_k, n_users): null where no user has truth."""
    return average_precision(predictions, truth, k).agg(F.avg("ap").alias("map_at_k"), F.count("*").alias("n_users"))


def map_at_k_by(predictions: DataFrame, truth: DataFrame, by: str, k: int = 10) -> DataFrame:
    """(by, map_at_k) of many predictions at once, as map_at_k for each value of `by` that has hits; the others' is 0 and they have no row."""
    wanted = truth.select("u", "i").distinct()
    sizes = wanted.groupBy("u").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    users = sizes.agg(F.count("*").alias("users"))
    total = _gained(predictions, wanted, by).join(sizes, "u").groupBy(by).agg(F.sum(F.col("g") / F.col("n")).alias("total"))
    return total.join(F.broadcast(users)).select(by, (F.col("total") / F.col("users")).alias("map_at_k"))
