"""Recommenders: fit on interactions, predict the top k of every user."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.scalar import over, unit
from lorewell.functions.text import enriched_soup, soup, stop_words, tokens, weighted_soup
from lorewell.operators import latent, scoring
from lorewell.operators.loading import at_least
from lorewell.operators.pairs import pair_sums
from lorewell.operators.profiles import bm25, decayed, item_columns, item_similarity, popularity, tfidf, transitions
from lorewell.operators.scoring import ItemSide, Sparse, TooLarge, block_top_k, collected, cosine_pair
from lorewell.sources.interactions import with_columns


@dataclass
class Data:
    """What a model is fitted on: training interactions, the users and items that must get and may be recommendations, item metadata and unit item vectors (i, e)."""

    train: DataFrame
    users: DataFrame
    items: DataFrame
    metadata: DataFrame | None = None
    vectors: DataFrame | None = None
    n_users: int = field(init=False)

    def __post_init__(self):
        self.users, self.items = self.users.select("u").distinct(), self.items.select("i").distinct()
        self.n_users = self.users.count()


class Recommender(ABC):
    """fit(data) learns; predict(k) gives (u, i, rank, score), k rows for every user."""

    @abstractmethod
    def fit(self, data: Data) -> Recommender: ...

    @abstractmethod
    def predict(self, k: int = 10) -> DataFrame: ...


class CosineRecommender(Recommender):
    """TF-IDF of decayed weights, item-column cosine."""

    def __init__(self, half_life: float = 30):
        self.half_life = half_life

    def profile(self, data: Data) -> DataFrame:
        return tfidf(decayed(data.train, self.half_life), data.n_users)

    def fit(self, data: Data) -> CosineRecommender:
        self.data = data
        self.x = self.profile(data).persist()
        self.columns = item_columns(self.x)
        return self

    def predict(self, k: int = 10) -> DataFrame:
        return scoring.collaborative_top_k(self.data.users, self.data.items, self.x, self.columns, k)


class BM25Recommender(CosineRecommender):
    """BM25 of decayed weights over the user-by-item matrix, item-column cosine."""

    def __init__(self, k1: float = 1.2, b: float = 0.75, half_life: float = 30):
        super().__init__(half_life)
        self.k1, self.b = k1, b

    def profile(self, data: Data) -> DataFrame:
        return bm25(decayed(data.train, self.half_life), data.n_users, self.k1, self.b)


class HistoryFilterRecommender(CosineRecommender):
    """Items of the training history come last."""

    def predict(self, k: int = 10) -> DataFrame:
        return scoring.collaborative_top_k(self.data.users, self.data.items, self.x, self.columns, k, seen=self.data.train)


class LowInteractionRecommender(CosineRecommender):
    """Only items with enough rows; the last time of a user is taken after the filter."""

    def __init__(self, least: int = 3, half_life: float = 30):
        super().__init__(half_life)
        self.least = least

    def profile(self, data: Data) -> DataFrame:
        return tfidf(decayed(at_least(data.train, self.least), self.half_life), data.n_users)


def diversify(candidates: DataFrame, authors: DataFrame, k: int, most: int = 2, exempt: str = "Unknown") -> DataFrame:
    """Of (u, i, rank, score) the first k with at most `most` of an author, filled up with the rejected ones in score order.

    Caps are per author, so a place within (user, author) decides alone; the exempt author is never rejected."""
    with_author = candidates.join(authors.select("i", F.coalesce("Author", F.lit(exempt)).alias("Author")), "i", "left").withColumn("Author", F.coalesce("Author", F.lit(exempt)))
    place = F.row_number().over(Window.partitionBy("u", "Author").orderBy("rank"))
    marked = with_author.withColumn("rejected", (F.col("Author") != exempt) & (place > most))
    order = F.row_number().over(Window.partitionBy("u").orderBy("rejected", "rank"))
    return marked.withColumn("rank", order).where(F.col("rank") <= k).select("u", "i", "rank", "score")


class DiversifiedRecommender(CosineRecommender):
    """3 k candidates, at most two of an author, then the rejected ones."""

    def __init__(self, most: int = 2, half_life: float = 30):
        super().__init__(half_life)
        self.most = most

    def predict(self, k: int = 10) -> DataFrame:
        return diversify(super().predict(3 * k), self.data.metadata, k, self.most)


class SequentialRecommender(Recommender):
    """Raw decayed weights times log1p transition counts."""

    def __init__(self, half_life: float = 1):
        self.half_life = half_life

    def fit(self, data: Data) -> SequentialRecommender:
        self.data, self.x = data, decayed(data.train, self.half_life).withColumnRenamed("w", "x")
        self.links = transitions(data.train).select("i", F.col("next_i").alias("j"), F.col("score").alias("s"))
        return self

    def predict(self, k: int = 10) -> DataFrame:
        return scoring.padded(scoring.top_k(scoring.join_scores(self.x, self.links), k), self.data.users, self.data.items, k)


class PopularityRecommender(Recommender):
    """The same most popular items for everyone."""

    def __init__(self, half_life: float = 250):
        self.half_life = half_life

    def fit(self, data: Data) -> PopularityRecommender:
        self.data, self.pop = data, popularity(tfidf(decayed(data.train, self.half_life), data.n_users))
        return self

    def top(self, k: int = 10) -> DataFrame:
        """(i, rank, score)."""
        best = self.pop.select("i", (F.round("pop", 6) + F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "i").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "i")))

    def predict(self, k: int = 10) -> DataFrame:
        return self.data.users.join(F.broadcast(self.top(k))).select("u", "i", "rank", "score")


def _ids(items: DataFrame) -> np.ndarray:
    return np.sort(collected(items.select("i").distinct(), "i")[0])


def _width(vectors: DataFrame) -> int:
    first = vectors.where("e IS NOT NULL").select(F.size("e").alias("d")).first()
    return first["d"] if first else 0


def _vectors(ids: np.ndarray, vectors: DataFrame) -> np.ndarray:
    """Unit vectors by item position; items without one are zero."""
    vectors = vectors.persist()
    if vectors.count() * 8 * _width(vectors) > scoring.BROADCAST_BYTES:
        raise TooLarge("the items' vectors")
    table = vectors.select("i", "e").toArrow()
    e = table.column("e").combine_chunks()
    m = np.asarray(e.flatten()).reshape(len(e), -1) if len(e) else np.zeros((0, 1))
    vectors.unpersist()
    out = np.zeros((len(ids), m.shape[1]))
    at = np.searchsorted(ids, table.column("i").to_numpy())
    ok = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == table.column("i").to_numpy())
    out[at[ok]] = m[ok]
    return out


def _whole(weights: latent.Ease) -> np.ndarray:
    """All EASE weights as one array for the workers."""
    if 8 * len(weights.ids) ** 2 > scoring.BROADCAST_BYTES:
        raise TooLarge("the items' EASE weights")
    return weights.columns(0, len(weights.ids))


def keyword_tfidf(metadata: DataFrame, text, least: int = 2, bigrams: bool = False, n_items: int | None = None) -> DataFrame:
    """(i, term, x): smooth TF-IDF of words (terms in at least `least` items), unit length for each item."""
    counts = metadata.select("i", F.explode(tokens(text, stop_words(), bigrams)).alias("term")).groupBy("i", "term").agg(F.count("*").alias("tf"))
    n = n_items if n_items is not None else metadata.select("i").distinct().count()
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    v = counts.join(df, "term").withColumn("v", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    return v.withColumn("x", over(F.col("v"), F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("i"))))).select("i", "term", "x")


def _keyword_pair(ids: np.ndarray, terms: DataFrame) -> tuple[Sparse, Sparse]:
    i, t, x = collected(terms.select("i", F.xxhash64("term").alias("t"), "x"), "i", "t", "x")
    return cosine_pair(ids, t, i, x)


def _term_links(terms: DataFrame) -> DataFrame:
    """(i, j, s): keyword cosine of items, by their common terms."""
    return pair_sums(terms, key="term").withColumnRenamed("g", "s")


class EnsembleRecommender(Recommender):
    """Half-lives mixed: for each, alpha x item cosine + (1 - alpha) x content; plus SVD, re-buy, popularity, keyword and sequence terms.

    Content is unit item vectors (semantic), or keyword TF-IDF of a soup.  Nothing
    item by item is formed but for EASE: every similarity stays factored."""

    def __init__(self, alpha=0.5, half_lives=(1, 250), weights=None, rebuy=0.5, pop=0.2, keyword=0.15, svd=0.15, sequence=0.3, factors=100, diagonal=0.0, ease_lambda=None, content="vectors", pop_from="longest"):
        self.half_lives = list(half_lives) if isinstance(half_lives, (list, tuple)) else [half_lives]
        n = len(self.half_lives)
        self.weights = list(weights) if weights is not None and len(weights) == n else [1 / n] * n
        self.alpha, self.rebuy, self.pop, self.keyword, self.svd, self.sequence = alpha, rebuy, pop, keyword, svd, sequence
        self.factors, self.diagonal, self.ease_lambda, self.content, self.pop_from = factors, diagonal, ease_lambda, content, pop_from

    def fit(self, data: Data) -> EnsembleRecommender:
        """Fits in arrays on the workers where the item side is small enough, else for joins and blocks of items."""
        self.data, self.side = data, None
        self.profiles = {f"x{k}": tfidf(decayed(data.train, hl), data.n_users).persist() for k, hl in enumerate(self.half_lives)}
        self.longest, self.shortest = f"x{int(np.argmax(self.half_lives))}", f"x{int(np.argmin(self.half_lives))}"
        self.ease: dict[str, latent.Ease] = {}
        if self.ease_lambda is not None and self.alpha:
            ids = _ids(data.items)
            for name in list(self.profiles):
                found = latent.ease(self.profiles[name], ids, self.ease_lambda)
                found.scale = max(found.largest(), 1e-12)
                self.ease[name] = found
        try:
            return self._fit_arrays(data)
        except TooLarge:
            self.side = None
            return self

    def _metadata(self, data: Data) -> DataFrame | None:
        return None if data.metadata is None else with_columns(data.metadata).join(data.items, "i", "left_semi")

    def _fit_arrays(self, data: Data) -> EnsembleRecommender:
        ids, metadata = _ids(data.items), self._metadata(data)
        side, vectors = ItemSide(ids), None
        if self.content == "vectors" and data.vectors is not None and self.alpha < 1:
            vectors = _vectors(ids, data.vectors.join(data.items, "i", "left_semi"))  # of a catalogue, what may be recommended
        for k, w in enumerate(self.weights):
            name = f"x{k}"
            x = self.profiles[name]
            if self.alpha and self.ease_lambda is None:
                scoring.add_cosine(side, name, w * self.alpha, item_columns(x))
            elif self.alpha:
                side.matrix[name] = [(w * self.alpha, _whole(self.ease[name]))]
            if vectors is not None:
                side.dense[name] = [(w * (1 - self.alpha), vectors)]
            elif self.content == "soup" and self.alpha < 1:
                side.cosine.setdefault(name, []).append((w * (1 - self.alpha), *_keyword_pair(ids, keyword_tfidf(metadata, weighted_soup(), least=1, bigrams=True))))
            if self.diagonal:
                side.own[name] = side.own.get(name, 0.0) + w * self.diagonal
        longest, shortest = self.longest, self.shortest
        if self.rebuy:
            side.own[longest] = side.own.get(longest, 0.0) + self.rebuy
        plus = np.zeros(len(ids))
        if self.pop:
            i, p = collected(popularity(self.profiles[longest if self.pop_from == "longest" else f"x{len(self.half_lives) - 1}"]), "i", "pop")
            plus[np.searchsorted(ids, i)] += self.pop * p
        if self.keyword and metadata is not None:
            side.cosine.setdefault(longest, []).append((self.keyword, *_keyword_pair(ids, keyword_tfidf(metadata, soup(F.col("Title"), F.col("Author"), F.col("Subjects"))))))
        if self.sequence:
            i, j, s = collected(transitions(data.train), "i", "next_i", "score")
            side.links[shortest] = [(self.sequence, Sparse.build(np.searchsorted(ids, i), np.searchsorted(ids, j), s, len(ids)))]
        if self.svd:
            counts = data.train.groupBy("u", "i").agg(F.log1p(F.count("*")).alias("x"))
            v, s = latent.truncated_svd(counts, ids, self.factors, data.n_users)
            q = v * np.sqrt(s)
            norm = np.linalg.norm(q, axis=1, keepdims=True)
            self.profiles["svd"], side.matrix["svd"] = counts, []
            side = SvdSide(side, v / np.sqrt(np.maximum(s, 1e-12)), np.divide(q, norm, out=np.zeros_like(q), where=norm > 0), self.svd / 2)
            plus += self.svd / 2
        (side.side if isinstance(side, SvdSide) else side).plus = plus
        if side.nbytes > scoring.BROADCAST_BYTES:
            raise TooLarge("the pieces of the item side together")
        self.side = side
        return self

    def predict(self, k: int = 10) -> DataFrame:
        return self._joined(k) if self.side is None else block_top_k(self.data.users, self.profiles, self.side, k)

    def _joined(self, k: int) -> DataFrame:
        """The same scores from joins (sparse terms) and blocks of items (dense terms)."""
        data, metadata = self.data, self._metadata(self.data)
        items, sparse, user_parts, item_parts = data.items, [], [], []

        def add(weight: float, scores: DataFrame) -> None:
            sparse.append(scores.select("u", "i", (F.col("score") * weight).alias("score")))

        own = {f"x{n}": w * self.diagonal for n, w in enumerate(self.weights)}
        own[self.longest] += self.rebuy
        d = _width(data.vectors) if self.content == "vectors" and data.vectors is not None and self.alpha < 1 else 0
        for n, w in enumerate(self.weights):
            x = self.profiles[f"x{n}"]
            if self.alpha and self.ease_lambda is None:
                add(w * self.alpha, scoring.join_scores(x, item_similarity(x)))
            if self.content == "soup" and self.alpha < 1:
                add(w * (1 - self.alpha), scoring.join_scores(x, _term_links(keyword_tfidf(metadata, weighted_soup(), least=1, bigrams=True))))
            if own[f"x{n}"]:
                add(own[f"x{n}"], x.withColumnRenamed("x", "score"))
        if d:
            mixed = [self.profiles[f"x{n}"].select("u", "i", (F.col("x") * w * (1 - self.alpha)).alias("x")) for n, w in enumerate(self.weights)]
            user_parts.append((d, _profile_vectors(reduce(DataFrame.unionByName, mixed), data.vectors, d)))
            item_parts.append((d, data.vectors.select("i", "e")))
        if self.keyword and metadata is not None:
            add(self.keyword, scoring.join_scores(self.profiles[self.longest], _term_links(keyword_tfidf(metadata, soup(F.col("Title"), F.col("Author"), F.col("Subjects"))))))
        if self.sequence:
            links = transitions(data.train).select("i", F.col("next_i").alias("j"), F.col("score").alias("s"))
            add(self.sequence, scoring.join_scores(self.profiles[self.shortest], links))
        plus = items.withColumn("plus", F.lit(0.0))
        if self.pop:
            pop = popularity(self.profiles[self.longest if self.pop_from == "longest" else f"x{len(self.half_lives) - 1}"])
            plus = items.join(pop, "i", "left").select("i", (self.pop * F.coalesce("pop", F.lit(0.0))).alias("plus"))
        if self.svd:
            counts = data.train.groupBy("u", "i").agg(F.log1p(F.count("*")).alias("x"))
            found = counts.select("i").distinct().toArrow().column("i").to_numpy()
            ids = np.sort(found)
            v, s = latent.truncated_svd(counts, ids, self.factors, data.n_users, items.count())
            table = items.sparkSession.createDataFrame(pa.table({"i": ids, "v": list(v)}))
            root = F.array(*[F.lit(float(x)) for x in np.sqrt(np.maximum(s, 1e-12))])
            to_user = table.select("i", F.zip_with("v", root, lambda a, b: a / b).alias("e"))
            k_svd = len(s)
            user_parts.append((k_svd, _profile_vectors(counts, to_user, k_svd).select("u", F.transform(unit(F.col("q")), lambda a: a * (self.svd / 2)).alias("q"))))
            item_parts.append((k_svd, table.select("i", unit(F.zip_with("v", root, lambda a, b: a * b)).alias("e"))))
            plus = plus.withColumn("plus", F.col("plus") + self.svd / 2)
        q, e = data.users.withColumn("q", F.array(F.lit(1.0))), plus.select("i", F.array("plus").alias("e"))
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        for (n, users), (_, vectors) in zip(user_parts, item_parts, strict=True):
            q = q.join(users.withColumnRenamed("q", "more"), "u", "left").select("u", F.concat("q", F.coalesce("more", zeros(n))).alias("q"))
            e = e.join(vectors.withColumnRenamed("e", "more"), "i", "left").select("i", F.concat("e", F.coalesce("more", zeros(n))).alias("e"))
        long = reduce(DataFrame.unionByName, sparse) if sparse else data.train.select("u", "i", F.lit(0.0).alias("score"))
        weighted = [(self.profiles[f"x{n}"], w * self.alpha, self.ease[f"x{n}"]) for n, w in enumerate(self.weights) if f"x{n}" in self.ease]
        return scoring.joined_top_k(data.users, long.groupBy("u", "i").agg(F.sum("score").alias("score")), q, e.persist(), 1 + sum(n for n, _ in item_parts), k, weighted)


def _profile_vectors(profile: DataFrame, vectors: DataFrame, d: int) -> DataFrame:
    """(u, q): each user's items' vectors, summed with the profile's weights, component by component with partial sums."""
    own = profile.join(vectors.select("i", "e"), "i")
    return own.groupBy("u").agg(F.array(*[F.sum(F.col("x") * F.col("e")[n]) for n in range(d)]).alias("q"))


@dataclass
class SvdSide:
    """An item side with half the cosine of user and item factors added; the user's factors are R V / sqrt(s)."""

    side: ItemSide
    to_user: np.ndarray
    unit_items: np.ndarray
    weight: float

    @property
    def ids(self) -> np.ndarray:
        return self.side.ids

    @property
    def nbytes(self) -> int:
        return self.side.nbytes + self.to_user.nbytes + self.unit_items.nbytes

    def score(self, profiles) -> np.ndarray:
        items, weights = profiles["svd"]
        total = self.side.score({n: p for n, p in profiles.items() if n != "svd"})
        p = weights @ self.to_user[items] if len(items) else np.zeros(self.to_user.shape[1])
        norm = np.linalg.norm(p)
        return total + self.weight * (self.unit_items @ (p / norm)) if norm > 0 else total


def semantic_hybrid(**changes) -> EnsembleRecommender:
    """The production ensemble."""
    return EnsembleRecommender(**changes)


def ensemble_hybrid(**changes) -> EnsembleRecommender:
    """EASE and a weighted keyword soup, short and long half-lives."""
    return EnsembleRecommender(**({"alpha": 0.8, "half_lives": (7, 90), "weights": (0.6, 0.4), "ease_lambda": 500.0, "content": "soup", "diagonal": 1.5, "rebuy": 0, "pop": 0.1, "pop_from": "last", "keyword": 0, "svd": 0, "sequence": 0} | changes))


def coupled_semantic(**changes) -> EnsembleRecommender:
    return EnsembleRecommender(**({"half_lives": (30, 150), "diagonal": 1.5, "rebuy": 0, "pop": 0.1, "pop_from": "last", "keyword": 0, "svd": 0, "sequence": 0} | changes))


def enriched_semantic(**changes) -> EnsembleRecommender:
    """As coupled, on vectors of the enriched text, with a strong re-buy term."""
    return EnsembleRecommender(**({"half_lives": (30, 150), "rebuy": 1.5, "pop": 0.1, "pop_from": "longest", "keyword": 0, "svd": 0, "sequence": 0} | changes))


class EASERecommender(Recommender):
    """EASE weights times the profile; the inverse stays in blocks, of which the workers get what fits at a time."""

    def __init__(self, lam: float = 500.0, half_life: float = 30):
        self.lam, self.half_life = lam, half_life

    def fit(self, data: Data) -> EASERecommender:
        self.data = data
        self.x = tfidf(decayed(data.train, self.half_life), data.n_users).persist()
        self.weights = latent.ease(self.x, _ids(data.items), self.lam)
        return self

    def predict(self, k: int = 10) -> DataFrame:
        try:
            return block_top_k(self.data.users, {"x": self.x}, ItemSide(self.weights.ids, matrix={"x": [(1.0, _whole(self.weights))]}), k)
        except TooLarge:
            none = self.x.select("u", "i", F.lit(0.0).alias("score")).limit(0)
            flat = self.data.items.select("i", F.array(F.lit(0.0)).alias("e"))
            return scoring.joined_top_k(self.data.users, none, self.data.users.select("u", F.array(F.lit(0.0)).alias("q")), flat, 1, k, [(self.x, 1.0, self.weights)])


class SVDRecommender(Recommender):
    """Counts R projected on the best rank: R V V'."""

    def __init__(self, factors: int = 20):
        self.factors = factors

    def weights(self, data: Data) -> DataFrame:
        return data.train.groupBy("u", "i").agg(F.count("*").cast("double").alias("x"))

    def fit(self, data: Data) -> SVDRecommender:
        self.data, ids = data, _ids(data.items)
        self.x = self.weights(data).persist()
        v, self.singular = latent.truncated_svd(self.x, ids, self.factors, data.n_users)
        self.side = ItemSide(ids, dense={"x": [(1.0, v)]})
        return self

    def predict(self, k: int = 10) -> DataFrame:
        return block_top_k(self.data.users, {"x": self.x}, self.side, k)


class LogSVDRecommender(SVDRecommender):
    """ln(1 + count) in place of counts; user factors U sqrt(s) times item factors V sqrt(s), which is R V V' again."""

    def __init__(self, factors: int = 50):
        super().__init__(factors)

    def weights(self, data: Data) -> DataFrame:
        return data.train.groupBy("u", "i").agg(F.log1p(F.count("*")).alias("x"))


MODELS = {
    "semantic_hybrid": semantic_hybrid, "coupled_semantic": lambda: coupled_semantic(weights=(0.7, 0.3)), "enriched_semantic": enriched_semantic, "ensemble_hybrid": ensemble_hybrid,
    "bm25": lambda: BM25Recommender(k1=1.5), "diversified": DiversifiedRecommender, "low_interaction": LowInteractionRecommender, "history_filter": HistoryFilterRecommender,
    "sequential": SequentialRecommender, "ease": EASERecommender, "svd": lambda: SVDRecommender(30), "cosine": CosineRecommender, "popularity": PopularityRecommender,
}
__all__ = ["MODELS", "Data", "Recommender", "enriched_soup"]
