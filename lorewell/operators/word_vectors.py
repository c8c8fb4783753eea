"""A text encoder that is learned from a catalogue: word vectors from co-occurrence, texts as their weighted means."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions.scalar import unit
from lorewell.functions.text import stop_words, tokens
from lorewell.operators import latent, scoring
from lorewell.operators.scoring import collected

#: Items that are encoded together.
ROWS = 1024


def cooccurrence(words: DataFrame, window: int = 5) -> DataFrame:
    """(a, b, n): how often b stands within `window` words of a, both ways, for rows with a list of words in order."""
    near = words.select("words", F.posexplode("words").alias("at", "a")).select("a", F.explode(F.expr(f"slice(words, at + 2, {window})")).alias("b"))
    once = near.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.count("*").alias("n"))
    both = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"), (2 * F.col("n")).alias("n"))))
    both = both.otherwise(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b"), "n"), F.struct(F.col("y").alias("a"), F.col("x").alias("b"), "n")))
    return once.select(F.explode(both).alias("p")).select("p.a", "p.b", "p.n")


def shifted_pmi(counts: DataFrame, shift: float = 1.0) -> DataFrame:
    """(a, b, x): ln(n N / (n_a n_b)) - ln(shift), where it is positive."""
    each = counts.groupBy("a").agg(F.sum("n").alias("n_a"))
    total = each.agg(F.sum("n_a").alias("total"))
    joined = counts.join(each, "a").join(each.select(F.col("a").alias("b"), F.col("n_a").alias("n_b")), "b").join(F.broadcast(total))
    x = F.log(F.col("n") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b"))) - float(np.log(shift))
    return joined.select("a", "b", x.alias("x")).where("x > 0")


@dataclass
class WordVectors:
    """(term, idf, v) of every known word: v has length 1; `encode` makes unit vectors of texts from them."""

    terms: DataFrame
    dimensions: int

    @classmethod
    def fit(cls, items: DataFrame, text: Column, dimensions: int = 64, window: int = 5, shift: float = 1.0, least: int = 2) -> WordVectors:
        """Learns from the texts of items (i): words in at least `least` of them, their co-occurrence within a window,
        shifted positive PMI, and its best symmetric factors by block Lanczos.

        Counting is a narrow step and one aggregate; the vocabulary's thin matrix is all that the driver sees."""
        spark = items.sparkSession
        words = items.select("i", tokens(F.coalesce(text, F.lit("")), stop_words()).alias("words"))
        df = words.select("i", F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least).persist()
        n = items.count()
        counts = cooccurrence(words, window)
        known = counts.join(df.select(F.col("term").alias("a")), "a", "left_semi").join(df.select(F.col("term").alias("b")), "b", "left_semi")
        pmi = shifted_pmi(known, shift).select(F.xxhash64("a").alias("u"), F.xxhash64("b").alias("i"), "x").persist()
        (ids,) = collected(pmi.select("i").distinct(), "i")
        ids = np.sort(ids)
        if len(ids):
            k = min(dimensions, len(ids))
            v, s = latent.truncated_svd(pmi, ids, k, len(ids) + 1, len(ids) + 1)
            table = spark.createDataFrame(pa.table({"id": ids, "v": pa.array(list(v * np.sqrt(s)), pa.list_(pa.float64()))}))
        else:
            table = spark.createDataFrame([], "id long, v array<double>")
        pmi.unpersist()
        idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
        return cls(df.join(table, F.xxhash64("term") == F.col("id")).select("term", idf.alias("idf"), unit(F.col("v")).alias("v")).persist(), dimensions)

    def encode(self, items: DataFrame, text: Column) -> DataFrame:
        """(i, e): the idf-weighted mean of a text's known words at length 1; zeros where it has none.

        While the words' vectors fit what may be broadcast, each item is encoded where it is read; beyond that, by joins."""
        n, size = self.terms.agg(F.count("*"), F.max(F.size("v"))).first()
        if n and n * 8 * (size + 4) <= scoring.BROADCAST_BYTES:
            return self._encode_rows(items, text, size)
        counts = items.select("i", F.explode(tokens(F.coalesce(text, F.lit("")), stop_words())).alias("term")).groupBy("i", "term").agg(F.count("*").alias("tf"))
        own = counts.join(self.terms, "term").select("i", (F.col("tf") * F.col("idf")).alias("w"), "v")
        d = self.terms.select(F.size("v").alias("d")).first()
        d = d["d"] if d else 0
        sums = own.groupBy("i").agg(F.array(*[F.sum(F.col("w") * F.col("v")[k]) for k in range(d)]).alias("e")) if d else own.select("i", F.array().cast("array<double>").alias("e")).limit(0)
        return items.select("i").join(sums, "i", "left").select("i", unit(F.coalesce("e", F.array_repeat(F.lit(0.0), d))).alias("e"))

    def _encode_rows(self, items: DataFrame, text: Column, d: int) -> DataFrame:
        table = self.terms.select("term", "idf", "v").toArrow().combine_chunks()
        v = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(-1, d) * table.column("idf").to_numpy()[:, None]
        shared = items.sparkSession.sparkContext.broadcast((table.column("term").combine_chunks(), v))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, v = shared.value
            for batch in batches:
                for begin in range(0, len(batch), ROWS):
                    part = batch.slice(begin, ROWS)
                    words = part.column("words")
                    at = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy()
                    rows = np.repeat(np.arange(len(part)), words.value_lengths().to_numpy())[at >= 0]
                    e, first = np.zeros((len(part), d)), np.flatnonzero(np.diff(rows, prepend=-1))
                    if len(first):
                        e[rows[first]] = np.add.reduceat(v[at[at >= 0]], first, axis=0)
                    norm = np.sqrt((e * e).sum(axis=1, keepdims=True))
                    e = np.divide(e, norm, out=np.zeros_like(e), where=norm > 0)
                    yield pa.RecordBatch.from_arrays([part.column("i"), pa.ListArray.from_arrays(pa.array(np.arange(0, e.size + 1, d, dtype=np.int32)), pa.array(e.ravel()))], ["i", "e"])

        words = items.select("i", tokens(F.coalesce(text, F.lit("")), stop_words()).alias("words"))
        return words.mapInArrow(run, f"i {dict(words.dtypes)['i']}, e array<double>")

    def nearest_words(self, word: str, k: int = 10) -> DataFrame:
        """(term, score): the words whose vectors have the largest cosine with a known word's."""
        own = self.terms.where(F.col("term") == word).select(F.col("v").alias("q"))
        score = F.round(F.aggregate(F.zip_with("v", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)
        return self.terms.where(F.col("term") != word).join(F.broadcast(own)).select("term", score.alias("score")).orderBy(F.desc("score"), "term").limit(k)
