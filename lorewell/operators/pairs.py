"""Sums over all pairs of items that share a user, whatever the largest user holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.sources.scratch import stored

#: Items of a user up to which its pairs are made in one place, and items on a side of a cell beyond that.
CELL = 1024
#: Pairs from which on they are summed by bands of items, pairs of a band in the mean, and pairs from which on a band's users are dealt to several tasks.
MANY, BAND, SPLIT = 1 << 24, 1 << 20, 1 << 22


def cell_sides(values: DataFrame, key: str = "u", x: str = "x", cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """Both sides of the cells of an item-block grid: (key, lo, hi, i, x) of (key, i, x).

    A light key (up to `cell` items) is one block, so one cell.  A heavy key's items are
    dealt to blocks by a hash of the id; block p meets block q >= p in cell (p, q), so a
    row goes to as many cells as its key has blocks: a key of m items is copied m / cell
    times, and its cells of about cell x cell pairs are dealt over all tasks."""
    counted = values.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), "i", F.col(x).alias("x"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    last = (F.ceil(F.col("n") / cell) - 1).cast("int")
    rows = counted.select("key", "i", "x", last.alias("last"), F.pmod(F.xxhash64("i"), last + 1).cast("int").alias("p"))
    left = rows.select("key", F.col("p").alias("lo"), F.explode(F.sequence(F.col("p"), F.col("last"))).alias("hi"), "i", "x")
    right = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("p"))).alias("lo"), F.col("p").alias("hi"), "i", "x")
    return left, right


def pair_sums(values: DataFrame, key: str = "u", x: str = "x", cell: int = CELL) -> DataFrame:
    """(i, j, g): the sum over keys of x_i x_j for all ordered pairs of items with a common key, the diagonal too.

    `values` has one row for a key and an item.  Each pair is made once and mirrored last.
    Few pairs, and those of few items, are made in the cell of their two blocks and summed
    before and after the shuffle; many that mostly differ by bands of items, so that not the pairs are
    shuffled but the users' items."""
    sizes = values.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").cast("double").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n") * (F.col("n") + 1) / 2)).first()[0] or 0
    if pairs > MANY:
        items = values.agg(F.approx_count_distinct("i")).first()[0]
        if pairs > items * items / 2 * int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # each task would add up what it has of a pair
            return cell_sums(values, key, x, cell)
        return band_sums(values, int(pairs), key, x, cell)
    return cell_sums(values, key, x, cell)


def cell_sums(values: DataFrame, key: str = "u", x: str = "x", cell: int = CELL) -> DataFrame:
    """`pair_sums` by the cells of item blocks."""
    left, right = cell_sides(values, key, x, cell)
    pairs = left.join(right.withColumnsRenamed({"i": "j", "x": "y"}), ["key", "lo", "hi"]).where("lo < hi OR i <= j")
    sums = pairs.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    return mirrored(sums)


def _flat(items: pa.ChunkedArray | pa.Array, values: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items, values and lengths of lists of both."""
    items, values = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (items, values))
    return items.flatten().to_numpy(), values.flatten().to_numpy(), items.value_lengths().to_numpy().astype(np.int64)


def _places(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of all ranges, one after the other."""
    return np.arange(int(lengths.sum())) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)


def _lists(i: np.ndarray, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    at, offsets = _places(begin, end - begin), pa.array(np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(v[at])) for v in (i, x)]


def _band_pairs(table: pa.Table) -> pa.Table:
    """(i, j, g) with i <= j of a band's rows: the products of left and right, summed for each pair; left is (i, x) and the first n of right (j, y)."""
    i, x, n_left = _flat(table.column("i"), table.column("x"))
    j, y, n_right = _flat(table.column("j"), table.column("y"))
    n, begin = table.column("n").to_numpy().astype(np.int64), np.cumsum(n_right) - n_right
    own = _places(begin, n)
    rows = np.concatenate([np.repeat(np.arange(len(n_left)), n_left), np.repeat(np.arange(len(n)), n)])
    i, x = np.concatenate([i, j[own]]), np.concatenate([x, y[own]])
    counts = n_right[rows]
    at = _places(begin[rows], counts)
    (a, row), (b, column) = (np.unique(v, return_inverse=True) for v in (i, j))
    row, column, g = np.repeat(row, counts), column[at], np.repeat(x, counts) * y[at]
    upper = a[row] <= b[column]
    code, g = (row * len(b) + column)[upper], g[upper]
    order = np.argsort(code, kind="stable")
    code, g = code[order], g[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    own = code[first]
    return pa.table({"i": a[own // len(b)], "j": b[own % len(b)], "g": np.add.reduceat(g, first) if len(first) else g})


def band_sums(values: DataFrame, pairs: int, key: str = "u", x: str = "x", cell: int = CELL, band: int | None = None, split: int | None = None) -> DataFrame:
    """`pair_sums` by bands: a range of items i meets, for each key that holds some of them, these and what comes after them.

    A key's list goes once to each band that it has items of, from there to its end, with the number of them, so what is shuffled
    follows the keys' items times the bands that they lie in, and is least where a key's items
    are near in their ids.  The rows of a band (about BAND pairs) are summed in one task; a band with
    over SPLIT is dealt to several by its keys, and only its sums are shuffled.  Keys of
    more than `cell` items are never held whole: blocks of them meet block by block."""
    band, split = band or BAND, split or SPLIT
    counted = values.where(F.col(key).isNotNull() & F.col("i").isNotNull()).select(F.col(key).alias("key"), F.col("i").cast("long").alias("i"), F.col(x).cast("double").alias("x"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    pair = F.struct("i", "x")
    flat = (F.col("row.i").alias("j"), F.col("row.x").alias("y"))
    lists = stored(counted.withColumn("p", F.when(F.col("n") > cell, F.pmod(F.xxhash64("i"), F.ceil(F.col("n") / cell))).otherwise(-1)).groupBy("key", "p").agg(F.sort_array(F.collect_list(pair)).alias("row")).select("key", "p", *flat), "pair-lists")
    n = max(1, -(-pairs // band))
    found = lists.select(F.explode("j").alias("i")).agg(F.percentile_approx("i", [k / n for k in range(1, n)] or [0.5], 10 * n)).first()[0]
    edges = np.unique(np.asarray(found or [], np.int64))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, p, band, n, j, y): a list from its first item of each band to its end, of which n are the band's."""
        for batch in batches:
            i, x, lengths = _flat(batch.column("j"), batch.column("y"))
            rows, own = np.repeat(np.arange(len(lengths)), lengths), np.searchsorted(edges, i, side="right")
            first = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
            end, last = np.append(first[1:], len(i)), np.cumsum(lengths)[rows[first]]
            # of a heavy key's block only the band's items go: they meet every block of the key
            last = np.where(batch.column("p").to_numpy()[rows[first]] < 0, last, end)
            columns = [batch.column(c).take(pa.array(rows[first])) for c in ("key", "p")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own[first].astype(np.int32)), pa.array((end - first).astype(np.int32)), *_lists(i, x, first, last)], ["key", "p", "band", "n", "j", "y"])

    kind = dict(lists.dtypes)["key"]
    sides = lists.mapInArrow(dealt, f"key {kind}, p bigint, band int, n int, j array<bigint>, y array<double>")
    none = F.array().cast("array<bigint>").alias("i"), F.array().cast("array<double>").alias("x")
    light = sides.where("p < 0").select("key", "band", *none, "n", "j", "y")
    blocks = lists.where("p >= 0")
    heavy = sides.where("p >= 0").select("key", "band", F.col("j").alias("i"), F.col("y").alias("x"), F.lit(0).alias("n")).join(blocks.select("key", "j", "y"), "key")
    every = light.unionByName(heavy) if not blocks.isEmpty() else light
    large = {r["band"]: -(-int(r["cost"]) // band) for r in every.groupBy("band").agg(F.sum((F.size("i") + F.col("n")).cast("double") * F.size("j")).alias("cost")).where(F.col("cost") > split).collect()}
    schema = "i bigint, j bigint, g double"
    sums = lambda rows, part: rows.select("band", part.cast("int").alias("part"), "i", "x", "n", "j", "y").groupBy("band", "part").applyInArrow(_band_pairs, schema)
    whole = sums(every.where(~F.col("band").isin(list(large))) if large else every, F.lit(0))
    if large:
        parts = values.sparkSession.createDataFrame(list(large.items()), "band int, parts int")
        dealt_rows = every.join(F.broadcast(parts), "band")
        whole = whole.unionByName(sums(dealt_rows, F.pmod(F.xxhash64("key", "j"), F.col("parts"))).groupBy("i", "j").agg(F.sum("g").alias("g")))
    return mirrored(whole)


def mirrored(sums: DataFrame) -> DataFrame:
    """(i, j, g) both ways, of i <= j."""
    both = sums.withColumn("turned", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    return both.select(F.when(F.col("turned"), F.col("j")).otherwise(F.col("i")).alias("i"), F.when(F.col("turned"), F.col("i")).otherwise(F.col("j")).alias("j"), "g")
