"""Deduplication, dense ids, item restriction, the temporal split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def id_map(interactions: DataFrame, key: str) -> DataFrame:
    """(key, idx): position among the sorted distinct ids.

    Ranks run within ranges of the ids and are shifted by the ranges' sizes, so no task sorts them all."""
    ids = interactions.select(key).where(F.col(key).isNotNull()).distinct()
    ranged = ids.repartitionByRange(key).withColumn("p", F.spark_partition_id())
    own = ranged.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(key)))
    sizes = ranged.groupBy("p").agg(F.count("*").alias("c"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.p") < F.col("a.p"), "left").groupBy("a.p").agg(F.coalesce(F.sum("b.c"), F.lit(0)).alias("before"))
    return own.join(F.broadcast(before), "p").select(key, (F.col("before") + F.col("r") - 1).alias("idx"))


def dense_ids(interactions: DataFrame) -> DataFrame:
    """Interactions with u_idx and i_idx."""
    users, items = id_map(interactions, "u").withColumnRenamed("idx", "u_idx"), id_map(interactions, "i").withColumnRenamed("idx", "i_idx")
    return interactions.join(users, "u", "left").join(items, "i", "left")


def restrict_items(items: DataFrame, interactions: DataFrame) -> DataFrame:
    """Items that occur in interactions, one row each; an occurring item without metadata has empty text."""
    return interactions.select("i").distinct().join(items.dropDuplicates(["i"]), "i", "left").na.fill("")


def time_split(interactions: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Interactions with r (dense rank of t over its largest, for each user) and is_train (r < ratio)."""
    ranked = interactions.withColumn("dr", F.dense_rank().over(Window.partitionBy("u").orderBy("t")))
    r = F.col("dr") / F.max("dr").over(Window.partitionBy("u"))
    return ranked.withColumn("r", r).withColumn("is_train", F.col("r") < ratio).drop("dr")


def train_part(interactions: DataFrame, ratio: float = 0.8) -> DataFrame:
    return time_split(interactions, ratio).where("is_train").select("u", "i", "t")


def validation_part(interactions: DataFrame, ratio: float = 0.8) -> DataFrame:
    return time_split(interactions, ratio).where("not is_train").select("u", "i", "t")


def at_least(interactions: DataFrame, n: int = 3) -> DataFrame:
    """Interactions of items with at least n rows."""
    common = interactions.groupBy("i").count().where(F.col("count") >= n).select("i")
    return interactions.join(common, "i", "left_semi").select("u", "i", "t")
