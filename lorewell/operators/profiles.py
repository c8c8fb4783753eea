"""User profiles: decayed weights, TF-IDF, BM25, item columns, popularity, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.scalar import bm25_idf, decay, over, smooth_idf
from lorewell.operators.pairs import pair_sums


def decayed(train: DataFrame, half_life: float) -> DataFrame:
    """(u, i, w): decay before the user's last interaction, summed over repeats; zero weights stay."""
    last = F.max("t").over(Window.partitionBy("u"))
    return train.withColumn("w", decay(last, F.col("t"), half_life)).groupBy("u", "i").agg(F.sum("w").alias("w"))


def item_frequency(weights: DataFrame) -> DataFrame:
    """(i, df): users of each item."""
    return weights.groupBy("i").agg(F.count("*").alias("df"))


def tfidf(weights: DataFrame, n_users: int) -> DataFrame:
    """(u, i, x): weights by smooth idf, unit length for each user; n_users counts users without weights too.

    The weights are kept, as they are read for the items' frequencies and again for the values."""
    weights = weights.persist()
    v = weights.join(item_frequency(weights), "i").select("u", "i", (F.col("w") * smooth_idf(F.lit(float(n_users)), F.col("df"))).alias("v"))
    return v.withColumn("x", over(F.col("v"), F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("u"))))).select("u", "i", "x")


def bm25(weights: DataFrame, n_users: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(u, i, x): BM25 of the user-by-item weights; the mean length is over all users."""
    weights = weights.persist()
    total = weights.agg(F.sum("w").alias("total"))
    length = F.sum("w").over(Window.partitionBy("u"))
    w = F.col("w")
    val = w * (k1 + 1) / (w + k1 * (1 - b + b * over(F.col("dl"), F.col("total") / n_users))) * bm25_idf(F.lit(float(n_users)), F.col("df"))
    return weights.withColumn("dl", length).join(item_frequency(weights), "i").join(F.broadcast(total)).select("u", "i", val.alias("x"))


def item_columns(profile: DataFrame) -> DataFrame:
    """(u, i, c): each item's column of the profile at unit length."""
    norm = profile.groupBy("i").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return profile.join(norm, "i").select("u", "i", over(F.col("x"), F.col("n")).alias("c"))


def item_similarity(profile: DataFrame) -> DataFrame:
    """(i, j, s): cosine of item columns, the diagonal kept; only pairs with a common user."""
    return pair_sums(item_columns(profile), x="c").withColumnRenamed("g", "s")


def popularity(profile: DataFrame) -> DataFrame:
    """(i, pop): column sums over their largest (0 where that is 0); the sums, a row for each item, are kept."""
    sums = profile.groupBy("i").agg(F.sum("x").alias("s")).persist()
    return sums.join(F.broadcast(sums.agg(F.max("s").alias("m")))).select("i", over(F.col("s"), F.col("m")).alias("pop"))


def transitions(train: DataFrame, score: Column | None = None) -> DataFrame:
    """(i, next_i, n, score): ordered neighbours in each user's history (by t, then i), log1p of their count."""
    pairs = train.withColumn("next_i", F.lead("i").over(Window.partitionBy("u").orderBy("t", "i"))).where("next_i IS NOT NULL")
    return pairs.groupBy("i", "next_i").agg(F.count("*").alias("n")).withColumn("score", F.log1p("n") if score is None else score)
