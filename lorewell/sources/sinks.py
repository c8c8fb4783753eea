"""Writing results: submissions, exports, feedback, enriched items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators.statistics import days, value_counts

FEEDBACK_SCHEMA = "timestamp timestamp, user_id long, item_id long, liked boolean"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_eda(interactions: DataFrame, folder: str) -> list[str]:
    """The three exports of the exploration: rows by user, rows by item, rows by day (times in seconds, milliseconds or microseconds)."""
    tables = {
        "user_interaction_counts": value_counts(interactions, "u").orderBy(F.desc("count"), "u"),
        "item_popularity_counts": value_counts(interactions, "i").orderBy(F.desc("count"), "i"),
        "interactions_by_day": days(interactions).orderBy("_t_dt"),
    }
    for name, table in tables.items():
        write_csv(table, f"{folder}/{name}.csv")
    return list(tables)


def write_submission(submission: DataFrame, path: str) -> None:
    """user_id, recommendation in target order (range-sorted part files keep it without one task taking all)."""
    submission.orderBy("ordinal").select("user_id", "recommendation").write.mode("overwrite").option("header", True).csv(path)


def append_feedback(spark: SparkSession, path: str, user_id: int, item_id: int, liked: bool) -> bool:
    """Appends one judgement; False where it could not be written."""
    try:
        row = spark.range(1).select(F.current_timestamp().alias("timestamp"), F.lit(user_id).cast("long").alias("user_id"), F.lit(item_id).cast("long").alias("item_id"), F.lit(liked).alias("liked"))
        row.write.mode("append").option("header", True).csv(path)
        return True
    except Exception:
        return False
