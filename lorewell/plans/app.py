"""Queries behind an interactive recommender: history, search, recommendations, similar items, submissions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.encoder import encode
from lorewell.functions.scalar import dot
from lorewell.functions.text import reasons
from lorewell.operators.word_vectors import WordVectors

# Words in an item's subjects, and what they are taken to show.
GENRES = ((("fiction",), "Matches your taste for fiction"), (("science",), "A science subject you like"), (("history", "histoire"), "A historical subject you follow"))


def user_history(interactions: DataFrame, items: DataFrame, u: int, n: int = 10) -> DataFrame:
    """(rank, i, t, Title, Author): the user's latest rows, ties by item."""
    own = interactions.where(F.col("u") == u).orderBy(F.desc("t"), "i").limit(n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("t"), "i")))
    return F.broadcast(own).join(items, "i", "left").select("rank", "i", "t", "Title", "Author")


def search_items(items: DataFrame, query: str, n: int = 20, literal: bool = False, columns=("Title", "Author", "Subjects")) -> DataFrame:
    """Items that match a case-insensitive pattern (or literal text) in any column, null never; first n by id."""
    q = query.lower()
    test = [F.coalesce(F.lower(F.col(c)).contains(q) if literal else F.lower(F.col(c)).rlike(q), F.lit(False)) for c in columns if c in items.columns]
    hit = test[0]
    for x in test[1:]:
        hit = hit | x
    return items.where(hit).orderBy("i").limit(n)


def search_users(interactions: DataFrame, query: str, n: int = 100) -> DataFrame:
    """Users whose id as text holds the query."""
    return interactions.select("u").distinct().where(F.col("u").cast("string").contains(query)).orderBy("u").limit(n)


def catalogue_tail(items: DataFrame, n: int = 10) -> DataFrame:
    """The newest items, by id (a file's last lines have no order in a table)."""
    return items.orderBy(F.desc("i")).limit(n)


def nearest(vectors: DataFrame, query: list[float], k: int = 10, without: int | None = None) -> DataFrame:
    """(i, rank, score): the k items whose unit vectors have the largest cosine with the query."""
    length = sum(float(x) ** 2 for x in query) ** 0.5
    q = F.array(*[F.lit(float(x) / length if length else 0.0) for x in query])
    rows = vectors if without is None else vectors.where(F.col("i") != without)
    best = rows.select("i", (F.round(dot(F.col("e"), q), 6) + F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "i").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "i")))


def search_by_meaning(items: DataFrame, text: Column, query: str, k: int = 10, vectors: DataFrame | None = None, model: Callable | WordVectors | None = None) -> DataFrame:
    """(i, rank, score): the k items nearest to a free text, which goes through the encoder that made (or makes) the items' vectors; nothing for a blank one, or one without a known word."""
    spark = items.sparkSession
    made = model.encode if isinstance(model, WordVectors) else lambda rows, column: encode(rows, column, model)
    own = made(spark.createDataFrame([(0, query)], "i long, query string").where("trim(query) <> ''"), F.col("query")).select(F.col("e").alias("q")).where(F.exists("q", lambda x: x != 0))
    vectors = made(items, text) if vectors is None else vectors
    best = vectors.join(F.broadcast(own)).select("i", (F.round(dot(F.col("e"), F.col("q")), 6) + F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "i").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "i"))).select("i", "rank", "score")


def similar_items(vectors: DataFrame, i: int, k: int = 10) -> DataFrame:
    """The items nearest to one item, itself left out; its vector joins as a single row."""
    own = vectors.where(F.col("i") == i).select(F.col("e").alias("q")).limit(1)
    best = vectors.where(F.col("i") != i).join(F.broadcast(own)).select("i", (F.round(dot(F.col("e"), F.col("q")), 6) + F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "i").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "i")))


def cap_authors(ranked: DataFrame, n: int) -> DataFrame:
    """At most n items of an author, rank order kept, items without author left out."""
    return ranked.where("Author IS NOT NULL").withColumn("_nth", F.row_number().over(Window.partitionBy("Author").orderBy("rank"))).where(F.col("_nth") <= n).drop("_nth")


def recommend(predictions: DataFrame, interactions: DataFrame, items: DataFrame, u: int, k: int = 10, hide_read: bool = True, per_author: int | None = 2) -> DataFrame:
    """(rank, i, score, Title, Author, reason) for one user, from 2 k predictions: read items out, authors capped, the first k, explained by the titles of the history."""
    own = predictions.where((F.col("u") == u) & (F.col("rank") <= 2 * k)).join(items, "i", "left")
    read = interactions.where(F.col("u") == u).select("i").distinct()
    titles = read.join(items.select("i", F.col("Title").alias("read_title")), "i").agg(F.collect_set("read_title").alias("titles"))
    if hide_read:
        own = own.join(read, "i", "left_anti")
    if per_author:
        own = cap_authors(own, per_author)
    out = own.join(F.broadcast(titles)).withColumn("reason", reasons(F.col("Author"), F.col("Subjects"), F.col("titles"), GENRES, "Recommended for you"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy("rank"))).where(F.col("rank") <= k).select("rank", "i", "score", "Title", "Author", "reason")


def popular_items(interactions: DataFrame, k: int = 10) -> DataFrame:
    """(i, count): most rows first, then id."""
    return interactions.groupBy("i").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "i").limit(k)


def submission(predictions: DataFrame, targets: DataFrame, interactions: DataFrame, k: int = 10) -> DataFrame:
    """(user_id, ordinal, recommendation): space-joined ids in rank order; users unknown to the model get the most popular items."""
    join_ids = lambda pairs: F.array_join(F.transform(F.array_sort(pairs), lambda x: x["i"].cast("string")), " ")
    lists = predictions.where(F.col("rank") <= k).groupBy("u").agg(join_ids(F.collect_list(F.struct("rank", "i"))).alias("own"))
    popular = popular_items(interactions, k).agg(join_ids(F.collect_list(F.struct((-F.col("count")).alias("c"), "i"))).alias("fallback"))
    return targets.join(lists, F.col("user_id") == F.col("u"), "left").join(F.broadcast(popular)).select("user_id", "ordinal", F.coalesce("own", "fallback").alias("recommendation"))
