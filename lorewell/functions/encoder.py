"""Text encoders: a table of vectors, or hashed words where no model is at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.scalar import unit
from lorewell.functions.text import tokens

DIMENSIONS = 384


def hashed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A unit vector of signed word counts in hashed places: deterministic, JVM-side, no model."""
    words = tokens(F.coalesce(text, F.lit("")))
    places = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int").alias("p"), F.when(F.crc32(w) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    dense = lambda own: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(F.filter(own, lambda x: x["p"] == d), F.lit(0.0), lambda a, x: a + x["s"]))
    return unit(F.transform(F.array(places), dense)[0])  # the words are bound once, not found again for each dimension


def encode(items: DataFrame, text: Column, model: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """(i, e): unit vectors of the texts, by `model` in Arrow batches or by hashed words."""
    if model is None:
        return items.select("i", hashed(text).alias("e"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"i": f["i"], "v": [list(map(float, v)) for v in model(f["text"].tolist())]})

    return items.select("i", text.alias("text")).mapInPandas(run, "i long, v array<double>").select("i", unit(F.col("v")).alias("e"))
