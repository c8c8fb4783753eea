"""Scores of every user for every item and their top k.

Two ways with the same results.  The block scorer keeps the item side in arrays on
every worker and scores users one after the other with numpy; it is used only while
the measured item side fits BROADCAST_BYTES.  Beyond that, item cosines of one profile
come from bands of the item columns (`bands`), other sparse terms from
joins and aggregates of the long tables, and dense ones (vectors of users and items)
from blocks of items that fit, sent one after the other.  Padding touches only users
with too few candidates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.operators.bands import banded_top_k
from lorewell.operators.pairs import pair_sums
from lorewell.sources.scratch import discard, stored

#: Largest item side, or block of items, that is sent to the workers.
BROADCAST_BYTES = 256 << 20


class TooLarge(ValueError):
    """A table does not fit BROADCAST_BYTES."""


@dataclass
class Sparse:
    """A sparse matrix by rows: row k holds columns[begin[k]:begin[k + 1]] and their values."""

    begin: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def build(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> Sparse:
        order = np.lexsort((columns, rows))
        return cls(np.searchsorted(rows[order], np.arange(n + 1)), columns[order].astype(np.int32), values[order])

    def times(self, rows: np.ndarray, weights: np.ndarray, width: int) -> np.ndarray:
        """The weighted sum of some rows, dense."""
        lengths = self.begin[rows + 1] - self.begin[rows]
        at = np.arange(int(lengths.sum())) + np.repeat(self.begin[rows] - (np.cumsum(lengths) - lengths), lengths)
        return np.bincount(self.columns[at], weights=self.values[at] * np.repeat(weights, lengths), minlength=width)

    @property
    def nbytes(self) -> int:
        return self.begin.nbytes + self.columns.nbytes + self.values.nbytes


@dataclass
class ItemSide:
    """What the block scorer needs of the items.

    For each profile name: `cosine[name]` the item columns by item (item by user) and
    back (user by item) with a weight, `links[name]` an item-by-item matrix with a weight, `dense[name]`
    unit vectors with a weight; `plus` is added to every user's scores."""

    ids: np.ndarray
    cosine: dict[str, list[tuple[float, Sparse, Sparse]]] = field(default_factory=dict)
    links: dict[str, list[tuple[float, Sparse]]] = field(default_factory=dict)
    dense: dict[str, list[tuple[float, np.ndarray]]] = field(default_factory=dict)
    own: dict[str, float] = field(default_factory=dict)
    matrix: dict[str, list[tuple[float, np.ndarray]]] = field(default_factory=dict)
    plus: np.ndarray | None = None

    @property
    def nbytes(self) -> int:
        """Bytes of all arrays, each counted once."""
        own = [self.ids, self.plus] if self.plus is not None else [self.ids]
        for parts in (*self.cosine.values(), *self.links.values(), *self.dense.values(), *self.matrix.values()):
            own += [x for part in parts for x in part[1:]]
        return sum(x.nbytes for x in {id(x): x for x in own}.values())

    def score(self, profiles: dict[str, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One user's scores of all items; a profile is (item positions, weights)."""
        n = len(self.ids)
        total = np.zeros(n) if self.plus is None else self.plus.copy()
        for name, (items, weights) in profiles.items():
            if not len(items):
                continue
            for f, by_item, by_user in self.cosine.get(name, ()):
                near = by_item.times(items, weights, len(by_user.begin) - 1)
                some = np.flatnonzero(near)
                total += f * by_user.times(some, near[some], n)
            for f, m in self.links.get(name, ()):
                total += f * m.times(items, weights, n)
            for f, v in self.dense.get(name, ()):
                total += f * (v @ (weights @ v[items]))
            for f, m in self.matrix.get(name, ()):
                total += f * (weights @ m[items])
            if name in self.own:
                total[items] += self.own[name] * weights
        return total


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best items by (score rounded to six places descending, id); all of them where k is larger."""
    rounded = np.round(scores, 6) + 0.0
    if k < len(ids):
        edge = np.partition(rounded, len(ids) - k)[len(ids) - k]
        some = np.flatnonzero(rounded >= edge)
    else:
        some = np.arange(len(ids))
    order = some[np.lexsort((ids[some], -rounded[some]))][:k]
    return ids[order], rounded[order]


def collected(df: DataFrame, *columns: str, limit: int | None = None) -> list[np.ndarray]:
    """The columns of a long table as arrays; TooLarge where it holds more than `limit` (BROADCAST_BYTES) bytes."""
    limit, df = BROADCAST_BYTES if limit is None else limit, df.select(*columns).persist()
    try:
        if (n := df.count()) * 8 * len(columns) > limit:
            raise TooLarge(f"{n} rows of {len(columns)} columns are more than {limit} bytes")
        table = df.toArrow()
    finally:
        df.unpersist()
    return [table.column(c).to_numpy() for c in columns]


def dense_blocks(vectors: DataFrame, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All items' ids and vectors of d components, in blocks by hash of the id that each fit BROADCAST_BYTES."""
    n = max(1, vectors.count())
    blocks = -(-n * 8 * (d + 1) // max(1, BROADCAST_BYTES // 2))  # half full in the mean, so that no block is too large
    for b in range(blocks):
        table = vectors.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).select("i", "e").toArrow()
        ids = table.column("i").to_numpy()
        order = np.argsort(ids)
        if len(ids):
            yield ids[order], np.asarray(table.column("e").combine_chunks().flatten(), np.float64).reshape(len(ids), d)[order]


def matrix_blocks(vectors: DataFrame, d: int, ids: np.ndarray, matrices: list) -> Iterator[tuple]:
    """As `dense_blocks`, by ranges of the sorted ids, with these columns of each matrix (all items x block)."""
    width = max(1, BROADCAST_BYTES // 2 // (8 * (d + 1 + len(ids) * len(matrices))))
    for lo in range(0, len(ids), width):
        hi = min(lo + width, len(ids))
        table = vectors.where(F.col("i").between(int(ids[lo]), int(ids[hi - 1]))).select("i", "e").orderBy("i").toArrow()
        yield ids[lo:hi], np.asarray(table.column("e").combine_chunks().flatten(), np.float64).reshape(hi - lo, d), [m.columns(lo, hi) for m in matrices]


def joined_top_k(users: DataFrame, sparse: DataFrame, user_vectors: DataFrame, item_vectors: DataFrame, d: int, k: int, weighted: list[tuple] = ()) -> DataFrame:
    """(u, i, rank, score): top k of every user by the sum of long sparse scores (u, i, score) and dense ones.

    `user_vectors` (u, q) and `item_vectors` (i, e, every item) have d components; a
    user without one has zeros.  `weighted` are (profile (u, i, x), factor, matrix), whose
    scores are the profile times the matrix's columns.  Item blocks go to the workers one after the other,
    each gives the users' best k of it, and the best of those are the result."""
    own = sparse.groupBy("u").agg(F.collect_list(F.struct("i", "score")).alias("own"))
    names = [f"p{n}" for n in range(len(weighted))]
    rows = _user_rows(users, {n: x for n, (x, _, _) in zip(names, weighted, strict=True)}).join(user_vectors.select("u", "q"), "u", "left").join(own, "u", "left").persist()
    factors, tops = [f for _, f, _ in weighted], []
    all_ids = weighted[0][2].ids if weighted else None
    blocks = matrix_blocks(item_vectors, d, all_ids, [m for _, _, m in weighted]) if weighted else ((*b, []) for b in dense_blocks(item_vectors, d))
    for block in blocks:
        shared = users.sparkSession.sparkContext.broadcast((all_ids, *block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            all_ids, item_ids, e, columns = shared.value
            for batch in batches:
                out: list[list] = [[], [], []]
                for row in batch.to_pylist():
                    scores = e @ np.asarray(row["q"]) if row["q"] is not None else np.zeros(len(item_ids))
                    if names:
                        for (at, x), f, m in zip(_own(row, names, all_ids).values(), factors, columns, strict=True):
                            scores += f * (x @ m[at])
                    some = row["own"] or []
                    i = np.fromiter((x["i"] for x in some), np.int64, len(some))
                    s = np.fromiter((x["score"] for x in some), np.float64, len(some))
                    at = np.minimum(np.searchsorted(item_ids, i), len(item_ids) - 1)
                    here = item_ids[at] == i
                    np.add.at(scores, at[here], s[here])
                    found, values = best(item_ids, scores, k)
                    out[0] += [row["u"]] * len(found)
                    out[1] += found.tolist()
                    out[2] += values.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["u", "i", "score"])

        tops.append(rows.mapInArrow(run, "u long, i long, score double"))
    return top_k(reduce(DataFrame.unionByName, tops), k) if tops else top_k(sparse.select("u", "i", "score").limit(0), k)


def _user_rows(users: DataFrame, profiles: dict[str, DataFrame]) -> DataFrame:
    """A row for each user, with its (i, x) of each profile as a sorted list."""
    rows = users.select("u").distinct()
    for name, p in profiles.items():
        rows = rows.join(p.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias(name)), "u", "left")
    return rows


def _own(row: dict, names: list[str], ids: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(item positions, weights) of each profile of such a row."""
    own = {}
    for name in names:
        pairs = row[name] or []
        items = np.fromiter((x["i"] for x in pairs), np.int64, len(pairs))
        own[name] = (np.searchsorted(ids, items), np.fromiter((x["x"] for x in pairs), np.float64, len(pairs)))
    return own


def block_top_k(users: DataFrame, profiles: dict[str, DataFrame], side: ItemSide, k: int, seen: DataFrame | None = None) -> DataFrame:
    """(u, i, rank, score): top k of every user; with `seen`, items of (u, i) there come after all others."""
    shared = users.sparkSession.sparkContext.broadcast(side)
    names = list(profiles)
    rows, hidden = _user_rows(users, profiles), seen is not None
    if seen is not None:
        rows = rows.join(seen.groupBy("u").agg(F.collect_set("i").alias("_seen")), "u", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = shared.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row in batch.to_pylist():
                scores = side.score(_own(row, names, side.ids))
                if hidden and row["_seen"]:
                    scores = scores.copy()
                    scores[np.searchsorted(side.ids, np.asarray(row["_seen"]))] = -np.inf
                ids, values = best(side.ids, scores, k)
                out[0] += [row["u"]] * len(ids)
                out[1] += ids.tolist()
                out[2] += range(1, len(ids) + 1)
                out[3] += values.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.float64())], ["u", "i", "rank", "score"])

    return rows.mapInArrow(run, "u long, i long, rank int, score double")


def mixed_top_k(users: DataFrame, profiles: dict[str, DataFrame], sides: list[ItemSide], mixes: np.ndarray, k: int, only: DataFrame | None = None) -> DataFrame:
    """(mix, u, i, rank): top k of every user for each row of `mixes`, by the sum of the sides' scores times its numbers; with `only`, no rows but those with (u, i) there.

    A user's scores of each side are computed once, whatever the number of mixes."""
    shared = users.sparkSession.sparkContext.broadcast((sides, np.asarray(mixes, np.float64)))
    names, rows, hits = list(profiles), _user_rows(users, profiles), only is not None
    if only is not None:
        rows = rows.join(only.groupBy("u").agg(F.collect_set("i").alias("_only")), "u", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, mixes = shared.value
        ids = sides[0].ids
        for batch in batches:
            for row in batch.to_pylist():
                own = _own(row, names, ids)
                terms = np.stack([side.score(own) for side in sides])
                found = [best(ids, mix @ terms, k)[0] for mix in mixes]
                n = len(found[0]) if found else 0
                columns = [np.repeat(np.arange(len(found), dtype=np.int32), n), np.full(len(found) * n, row["u"], np.int64), np.concatenate([*found, ids[:0]]), np.tile(np.arange(1, n + 1, dtype=np.int32), len(found))]
                if hits:
                    hit = np.isin(columns[2], np.asarray(row["_only"] or [], np.int64))
                    columns = [c[hit] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mix", "u", "i", "rank"])

    return rows.mapInArrow(run, "mix int, u long, i long, rank int")


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """(u, i, rank, score) of long scores: per user the k best by (rounded score descending, i)."""
    order = Window.partitionBy("u").orderBy(F.desc("score"), "i")
    return scores.withColumn("score", F.round("score", 6) + F.lit(0.0)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("u", "i", "rank", "score")


def padded(top: DataFrame, users: DataFrame, items: DataFrame, k: int, seen: DataFrame | None = None) -> DataFrame:
    """Top lists filled up to k with items that have no score (0), smallest id first; with `seen`, items of (u, i) there come after all others, at -inf.

    Only the first k items and as many more as a user may already have (in the list,
    or in `seen`) can be needed, so a user is filled from the first 2 k items and one
    more for each seen item; zeros outrank negative scores."""
    items = items.select("i").distinct()
    short = users.select("u").distinct().join(top.groupBy("u").agg(F.sum((F.col("score") >= 0).cast("int")).alias("n")), "u", "left").where(F.coalesce("n", F.lit(0)) < k).select("u")
    if seen is None:
        filling = F.broadcast(items.orderBy("i").limit(2 * k))
        zeros = short.join(filling).join(top.select("u", "i"), ["u", "i"], "left_anti").withColumn("score", F.lit(0.0)).select("u", "i", "score")
        return top_k(top.select("u", "i", "score").unionByName(zeros), k)
    own = seen.select("u", "i").distinct().join(items, "i", "left_semi").join(short, "u", "left_semi")
    need = short.join(own.groupBy("u").agg(F.count("*").alias("hidden")), "u", "left").select("u", F.coalesce("hidden", F.lit(0)).alias("hidden"))
    most = need.agg(F.max("hidden")).first()[0] or 0
    first = items.orderBy("i").limit(2 * k + most).withColumn("place", F.row_number().over(Window.orderBy("i")))
    places = need.select("u", F.explode(F.sequence(F.lit(1), (F.col("hidden") + 2 * k).cast("int"))).alias("place"))
    zeros = places.join(first, "place").select("u", "i", F.lit(0.0).alias("score"))
    zeros = zeros.join(top.select("u", "i"), ["u", "i"], "left_anti").join(own, ["u", "i"], "left_anti")
    last = own.join(need.where(F.col("hidden") > items.count() - k), "u", "left_semi").select("u", "i", F.lit(float("-inf")).alias("score"))
    return top_k(top.select("u", "i", "score").unionByName(zeros).unionByName(last), k)


def join_scores(profile: DataFrame, links: DataFrame, score: str = "s") -> DataFrame:
    """(u, i, score): profile by item-to-item links (i, j, s), as a join and an aggregate."""
    return profile.join(links, "i").groupBy("u", "j").agg(F.sum(F.col("x") * F.col(score)).alias("score")).withColumnRenamed("j", "i")


def cosine_side(items: DataFrame, columns: DataFrame, name: str = "x", weight: float = 1.0) -> ItemSide | None:
    """The item side of profile x (item-column cosine), from (u, i, c); None where it is too large."""
    try:
        side = ItemSide(np.sort(collected(items.select("i").distinct(), "i")[0]))
        add_cosine(side, name, weight, columns)
    except TooLarge:
        return None
    return side


def add_cosine(side: ItemSide, name: str, weight: float, columns: DataFrame) -> None:
    """The item-column cosine of (u, i, c) added to a side: as the item-by-item matrix where that has no more numbers than the columns, else as the columns.

    A user's scores then take its items times all items at most, however many users share them."""
    n, columns = len(side.ids), columns.persist()
    try:
        if 8 * n * n <= BROADCAST_BYTES and n * n <= columns.count():
            i, j, s = collected(pair_sums(columns, x="c"), "i", "j", "g")
            matrix = np.zeros((n, n))
            matrix[np.searchsorted(side.ids, i), np.searchsorted(side.ids, j)] = s
            side.matrix.setdefault(name, []).append((weight, matrix))
        else:
            side.cosine.setdefault(name, []).append((weight, *cosine_pair(side.ids, *collected(columns, "u", "i", "c"))))
    finally:
        columns.unpersist()


def cosine_pair(ids: np.ndarray, u: np.ndarray, i: np.ndarray, c: np.ndarray) -> tuple[Sparse, Sparse]:
    users, row = np.unique(u, return_inverse=True)
    at = np.searchsorted(ids, i)
    return Sparse.build(at, row, c, len(ids)), Sparse.build(row, at, c, len(users))


def near_columns(columns: DataFrame, profile: DataFrame) -> DataFrame:
    """The columns' entries (u, i, c) of users that share an item with the profile: all that its scores need."""
    near = columns.join(profile.select("i").distinct(), "i", "left_semi").select("u").distinct()
    return columns.join(near, "u", "left_semi")


def collaborative_top_k(users: DataFrame, items: DataFrame, profile: DataFrame, columns: DataFrame, k: int, seen: DataFrame | None = None) -> DataFrame:
    """Top k by profile x item cosine, padded to k: in blocks where the item side fits (or what of it a few users need), else in bands."""
    side = cosine_side(items, columns)
    if side is None:
        users, whole = users.select("u").distinct(), profile.count()
        profile = profile.join(users, "u", "left_semi")
        if profile.count() * 100 < whole:
            columns = near_columns(columns, profile)
            side = cosine_side(items, columns)
    if side is not None:
        return block_top_k(users, {"x": profile}, side, k, seen)
    columns = stored(columns.where("u IS NOT NULL AND i IS NOT NULL").select("u", "i", "c"), "columns")
    rows = profile.join(columns.groupBy("i").agg(F.count("*").alias("df")), "i").groupBy("u").agg(F.sort_array(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x")))).alias("x"), F.sum("df").alias("cost"))
    if seen is not None:
        rows = rows.join(seen.groupBy("u").agg(F.collect_set("i").alias("seen")), "u", "left")
    else:
        rows = rows.withColumn("seen", F.lit(None).cast("array<bigint>"))
    # ranges of users, of a few thousand rows each: neighbours are often near in the ids
    rows = rows.repartitionByRange(max(1, -(-users.count() // 8192)), "u")
    top = banded_top_k(rows, columns, columns.count(), k)
    discard(columns)
    return padded(top, users, items, k, seen)
