"""What a step reads several times is worked out once."""

from pyspark.sql import functions as F

from lorewell.operators import profiles
from lorewell.operators import statistics as S


def counted(spark, n=200):
    """A table whose rows are counted as they are read."""
    seen = spark.sparkContext.accumulator(0)

    def add(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return spark.range(n).selectExpr("id % 10 AS u", "id % 37 AS i", "id AS t").mapInPandas(add, "u long, i long, t long"), seen


def test_counts_are_made_once(spark):
    for step in (S.describe_counts, S.histogram, lambda c: S.cumulative_share(c, "i"), lambda c: S.top_coverage(c, "i")):
        rows, seen = counted(spark)
        step(S.value_counts(rows, "i")).collect()
        assert seen.value == 200
        spark.catalog.clearCache()


def test_weights_and_sums_are_made_once(spark):
    for step in (lambda w: profiles.popularity(profiles.tfidf(w, 10)), lambda w: profiles.bm25(w, 10)):
        rows, seen = counted(spark)
        step(rows.groupBy("u", "i").agg(F.sum("t").cast("double").alias("w"))).collect()
        assert seen.value == 200
        spark.catalog.clearCache()
