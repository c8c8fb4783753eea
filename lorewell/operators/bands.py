"""Top k by profile x item cosine where the item columns fit no worker whole: tasks take them band by band."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.sources.scratch import discard, stored

#: Bytes of a band (12 for each entry), and entries of (user, neighbour) that a task holds at once.
BAND_BYTES, NEAR = 32 << 20, 2 << 20
#: Bands are written as they are, one to a file.
ALONE = {"compression": "none", "parquet.enable.dictionary": "false", "maxRecordsPerFile": "1"}


def bands_of(columns: DataFrame, rows: str, band: str, n: int) -> tuple[DataFrame, list[tuple[int, int, str]]]:
    """The entries (u, i, c) by ranges of the ids in `band`, stored, and of each band the least and largest id in `rows` and its file.

    Tasks pack the bands and read them from the shared folder; the driver sees only where they are."""
    count = max(1, -(-n * 12 // BAND_BYTES))
    edges = sorted(set(columns.approxQuantile(band, [k / count for k in range(1, count)], 0.2 / count))) if count > 1 else []
    number = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(band))) if edges else F.lit(0)

    def pack(table: pa.Table) -> pa.Table:
        row, col, c = (table.column(x).to_numpy() for x in (rows, band, "c"))
        order = np.lexsort((col, row))
        ids, begin = np.unique(row[order], return_index=True)
        others, place = np.unique(col, return_inverse=True)
        data = pickle.dumps((ids, np.append(begin, len(row)), others, place[order].astype(np.int32), c[order]), protocol=5)
        return pa.table({"band": table.column("band")[:1], "lo": pa.array([ids[0]], pa.int64()), "hi": pa.array([ids[-1]], pa.int64()), "data": pa.array([data], pa.binary())})

    packed = stored(columns.withColumn("band", number).groupBy("band").applyInArrow(pack, "band int, lo long, hi long, data binary"), "bands", **ALONE)
    found = packed.select("band", "lo", "hi", F.input_file_name().alias("file")).orderBy("band").collect()  # a row for each band
    return packed, [(r["lo"], r["hi"], r["file"]) for r in found]


def _loaded(bands: list[tuple[int, int, str]], least: int, most: int) -> Iterator[tuple]:
    """The bands with rows between two ids, one at a time: none stays in the worker."""
    for lo, hi, file in bands:
        if lo <= most and hi >= least:
            system, path = fs.FileSystem.from_uri(file)
            yield pickle.loads(pq.read_table(path, columns=["data"], filesystem=system).column("data")[0].as_buffer())


def _entries(ids: np.ndarray, begin: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the wanted rows the band has, where its entries begin and how many they are."""
    at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
    some = np.flatnonzero(ids[at] == wanted)
    at = at[some]
    return some, begin[at], begin[at + 1] - begin[at]


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _summed(columns: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns and the sum of each one's values."""
    lo = int(columns.min())
    width = int(columns.max()) - lo + 1
    if width <= 16 * len(columns):
        sums = np.bincount(columns - lo, weights=values, minlength=width)
        some = np.flatnonzero(sums)
        return some + lo, sums[some]
    found, place = np.unique(columns, return_inverse=True)
    return found, np.bincount(place, weights=values)


def _neighbours(users: np.ndarray, items: np.ndarray, weights: np.ndarray, n: int, bands: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(user position, other user, weight) of users that share an item, by user position."""
    parts: list[tuple] = []
    for ids, begin, others, columns, values in _loaded(bands, items.min(), items.max()):
        some, starts, lengths = _entries(ids, begin, items)
        at = _ragged(starts, lengths)
        who, near, w = np.repeat(users[some], lengths), columns[at], values[at] * np.repeat(weights[some], lengths)
        if len(at) > n * len(others):  # more entries than pairs: a sum for each pair is less
            pairs = np.bincount(who * len(others) + near, weights=w, minlength=n * len(others))
            both = np.flatnonzero(pairs)
            who, near, w = both // len(others), both % len(others), pairs[both]
        parts.append((who, others[near], w))
    if not parts:
        return users[:0], items[:0], weights[:0]
    who, near, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(who, kind="stable")
    return who[order], near[order], w[order]


def _top(n: int, own: tuple, seen: list, k: int, by_item: list, by_user: list) -> tuple[np.ndarray, ...]:
    """(user position, item, rank, score): the k best items with a score of n users."""
    users, items, weights = own
    found: list[tuple] = []
    who, near, w = _neighbours(users, items, weights, n, by_item) if len(items) else own
    for ids, begin, others, columns, values in _loaded(by_user, near.min(), near.max()) if len(near) else ():
        some, starts, lengths = _entries(ids, begin, near)
        edges = np.searchsorted(who[some], np.arange(n + 1))
        for u in np.flatnonzero(np.diff(edges)):
            a, b = edges[u], edges[u + 1]
            at = _ragged(starts[a:b], lengths[a:b])
            place, score = _summed(columns[at], values[at] * np.repeat(w[some[a:b]], lengths[a:b]))
            score = np.round(score, 6) + 0.0
            if seen[u] is not None:
                keep = ~np.isin(others[place], seen[u])
                place, score = place[keep], score[keep]
            if k < len(score):
                best = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                best = best[np.lexsort((place[best], -score[best]))][:k]
                place, score = place[best], score[best]
            found.append((np.full(len(place), u), others[place], score))
    if not found:
        return users[:0], items[:0], users[:0], weights[:0]
    u, i, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((i, -score, u))
    u, i, score = u[order], i[order], score[order]
    rank = np.arange(len(u)) - np.searchsorted(u, u) + 1
    best = rank <= k
    return u[best], i[best], rank[best], score[best]


def banded_top_k(rows: DataFrame, columns: DataFrame, n: int, k: int) -> DataFrame:
    """(u, i, rank, score): the k best items with a score of every row (u, x: its (i, x), seen: items left out or null, cost: its neighbours).

    Scores are x C' C of the item columns C (u, i, c; n entries).  A task takes some
    users, goes through C by ranges of users for their neighbours and by ranges of items
    for the scores, and keeps the k best: only users' rows are shuffled, no scores.
    Bands without any of their items or neighbours are not loaded."""
    (users, by_item), (items, by_user) = bands_of(columns, "i", "u", n), bands_of(columns, "u", "i", n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, cost = batch.column("x"), np.cumsum(batch.column("cost").to_numpy())
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + NEAR, "right")))
                part = lists.slice(a, b - a)
                flat, lengths = part.flatten(), np.diff(part.offsets.to_numpy())
                seen = [None if s is None else np.asarray(s) for s in batch.column("seen").slice(a, b - a).to_pylist()]
                own = np.repeat(np.arange(b - a), lengths), flat.field("i").to_numpy(), flat.field("x").to_numpy()
                u, i, rank, score = _top(b - a, own, seen, k, by_item, by_user)
                ids = batch.column("u").to_numpy()[a:b]
                yield pa.RecordBatch.from_arrays([pa.array(ids[u], pa.int64()), pa.array(i, pa.int64()), pa.array(rank, pa.int32()), pa.array(score, pa.float64())], ["u", "i", "rank", "score"])
                a = b

    top = stored(rows.select("u", "x", "seen", "cost").mapInArrow(run, "u long, i long, rank int, score double"), "top")
    discard(users)
    discard(items)
    return top
