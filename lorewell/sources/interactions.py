"""Reading interactions, item metadata, targets and feedback; the views of the bundled test tables."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions.scalar import unit

TEXT_COLUMNS = ("Title", "Author", "Subjects", "Publisher")
ENRICHED_COLUMNS = ("description", "clean_author", "category")


def read_csv_safely(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A CSV table with header, or None where it is missing or cannot be read."""
    try:
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    except AnalysisException:
        return None


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Interactions (u, i, t) of a CSV table with these columns, in any order and beside others.

    Exact duplicates go before the cast, as text; a value that is no number of its
    kind fails the read, an empty one is null."""
    rows = spark.read.option("header", True).csv(path).select("u", "i", "t").distinct()
    return rows.select(*[strict(c, kind).alias(c) for c, kind in (("u", "bigint"), ("i", "bigint"), ("t", "double"))])


def strict(column: str, kind: str) -> Column:
    """A text column cast to a kind; text that cannot be cast is an error, in any SQL mode."""
    value = F.expr(f"try_cast({column} AS {kind})")
    return F.when(F.col(column).isNotNull() & value.isNull(), F.raise_error(F.concat(F.lit(f"{column} is no {kind}: "), F.col(column))).cast(kind)).otherwise(value)


def with_columns(items: DataFrame, columns=TEXT_COLUMNS) -> DataFrame:
    """Missing text columns added, null text empty."""
    return items.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in items.columns else F.lit("") for c in columns})


def read_items(spark: SparkSession, path: str, columns=TEXT_COLUMNS) -> DataFrame:
    return with_columns(spark.read.option("header", True).csv(path), columns).withColumn("i", F.col("i").cast("long"))


def read_targets(spark: SparkSession, path: str, interactions: DataFrame) -> DataFrame:
    """Target users (user_id, ordinal) in file order, first places of repeated ids; all known users where the file is missing."""
    found = read_csv_safely(spark, path, "user_id long")
    if found is None:
        return interactions.select(F.col("u").alias("user_id")).distinct().withColumn("ordinal", F.col("user_id"))
    return found.withColumn("ordinal", F.monotonically_increasing_id()).groupBy("user_id").agg(F.min("ordinal").alias("ordinal"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of shuffled rows, and rows of the table that is read, for each task.
TASK_BYTES, TASK_ROWS = 8 << 20, 500_000


def small_tasks(table: DataFrame) -> DataFrame:
    """The table; sorts and aggregates after it hold no more in a task where it is larger.

    Adaptive execution merges shuffled parts up to a size that a few tasks of a large
    table reach: the session's size for that is lowered to TASK_BYTES, and its number
    of shuffle parts raised to one for each TASK_ROWS rows."""
    conf, size, parts = table.sparkSession.conf, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    if (wished := -(-table.count() // TASK_ROWS)) > int(conf.get(parts)):
        conf.set(parts, str(wished))
    now = re.fullmatch(r"(\d+)([a-z]*)", conf.get(size, "64m").strip().lower())
    scale = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20}.get(now[2], 30) if now else 30
    if now is None or int(now[1]) << scale > TASK_BYTES:
        conf.set(size, str(TASK_BYTES))
    return table


def order_interactions(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """(u, i, t): who ordered which part when, in epoch seconds, without exact duplicates; `by_user` brings a user's rows together for steps that need them so."""
    lines = small_tasks(_table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_partkey")
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("u"), F.col("l_partkey").alias("i"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("t"))
    return (rows.repartition("u") if by_user else rows).distinct()


def event_interactions(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    """(u, i, t) of the event stream: many repeats of an item, no ties in time; `by_user` as in `order_interactions`."""
    rows = small_tasks(_table(spark, sf_dir, "events")).select(F.col("user_id").alias("u"), F.get_json_object("props", "$.k").cast("long").alias("i"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"))
    return (rows.repartition("u") if by_user else rows).distinct()


def part_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, Title, Author, Subjects, Publisher) from the parts table."""
    return with_columns(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_name").alias("Title"), F.col("p_brand").alias("Author"), F.col("p_type").alias("Subjects")))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, e): each item's embedding, unit length in double precision (the table's vectors are used in turn)."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = vectors.agg(F.count("*").alias("n"))
    items = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i")).join(F.broadcast(n)).select("i", (F.col("i") % F.col("n")).alias("vec_id"))
    return items.join(vectors.select("vec_id", unit(F.col("v")).alias("e")), "vec_id").select("i", "e")
