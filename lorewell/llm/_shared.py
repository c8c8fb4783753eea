"""What several operators of this subpackage need: the shared folder, written
intermediate tables, vectorised word splitting over UTF-8 bytes, and connected
components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are split and hashed at a time (a longer text is taken alone).
SLICE_BYTES = 2 << 20
#: One odd multiplier for each word of a shingle.
GRAM = np.random.default_rng(20260101).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, which only a local session may leave unset (its one machine shares everything)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):  # not local-cluster, whose executors have folders of their own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "lorewell-checkpoints")
    return at.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/lorewell/{tag}-{uuid.uuid4().hex}"


#: Row group of intermediate tables: what a task holds of one while it writes or reads (rows may be large).
ROW_GROUP = 16 << 20


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files of a table made by `written`, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/lorewell/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of an Arrow batch between Spark and Python while whole texts or sets travel in it.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on the session sends at most BATCH_ROWS rows and BATCH_BYTES (or one row) to Python at once, which bounds a worker's memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all intermediate tables and files of this subpackage, once no result that reads them is needed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/lorewell")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system: workers are used again by other stages and would hold on to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) of a string array with their UTF-8 bytes and, relative to these, the row offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    give_back()


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


def spans(inside: np.ndarray, offsets: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of `inside` bytes, and for each row the index of its first run.

    Runs end at row ends and, where `cut` is given, before each position that it marks."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.logical_not(inside[:-1], out=fresh[1:])
    if cut is not None:
        fresh |= cut
    fresh[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(fresh & inside)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_or(fresh[1:], ~inside[1:], out=last[:-1])
    ends = np.flatnonzero(last & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (murmur's finaliser)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def distinct_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct byte strings of ascending, disjoint spans, compared byte by byte, and for each span the place of its own."""
    if not len(starts):
        return [], np.zeros(0, np.int32)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    data = raw[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    own = coded.dictionary
    bounds, held = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1).tolist(), own.buffers()[2].to_pybytes()
    return [held[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], coded.indices.to_numpy()


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The xxh3 of each span's bytes (64 bits): equal bytes, equal hash, wherever they stand."""
    words, at = distinct_spans(raw, starts, ends)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[at]


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words; fewer words than n (but some) give one gram of them all."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    out = words[: len(words) - k + 1] * GRAM[0]
    for i in range(1, k):
        out = out + words[i : len(words) - k + 1 + i] * GRAM[i]
    return mixed(out + np.uint64(k))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


#: Counters of a slice of an array that is summed over tasks.
SLICE = 1 << 16


def sum_arrays(rows: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], length: int) -> np.ndarray:
    """The sum over all tasks of int64 arrays of a fixed length, to which `add` adds each batch; slices are summed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, np.int64)
        for batch in batches:
            add(batch, total)
        for k in range(0, length, SLICE):
            if total[k : k + SLICE].any():
                yield pa.RecordBatch.from_pydict({"slice": [k], "counts": [total[k : k + SLICE].tobytes()]})

    def summed(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()], axis=0)
        return pa.table({"slice": table["slice"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(length, np.int64)
    for r in rows.mapInArrow(run, "slice long, counts binary").groupBy("slice").applyInArrow(summed, "slice long, counts binary").collect():
        own = np.frombuffer(r["counts"], np.int64)
        out[r["slice"] : r["slice"] + len(own)] = own
    return out


#: A key is frequent where it holds more than one in FREQUENT rows: there are fewer than FREQUENT such keys, so a list of them may be broadcast.
FREQUENT = 1000


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], spread: str, how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """`rows` (any number for a key) joined with `values` (one row for a key), frequent keys split.

    The rows of a frequent key are dealt by a hash of column `spread` to parts of at
    most one in FREQUENT rows in the mean, and its value goes to each of them; all
    values together are copied fewer than 2 FREQUENT times.  `counts` (keys, n) may
    give the rows of each key, `total` those of all, where they are known."""
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = max(1, rows.count() if total is None else total)
    many = F.broadcast(counts.where(F.col("n") * FREQUENT > total).select(*keys, F.ceil(F.col("n") * FREQUENT / total).cast("long").alias("_lorewell_parts")))
    left = rows.join(many, keys, "left").withColumn("_lorewell_part", F.pmod(F.xxhash64(spread), F.coalesce("_lorewell_parts", F.lit(1).cast("long")))).drop("_lorewell_parts")
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce("_lorewell_parts", F.lit(1).cast("long")) - 1)
    right = values.join(many, keys, "left").withColumn("_lorewell_part", F.explode(parts)).drop("_lorewell_parts")
    return left.join(right, [*keys, "_lorewell_part"], how).drop("_lorewell_part")


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    `edges` has long columns a and b.  Returns (id, component): for each vertex of
    an edge the smallest vertex reachable from it.  Each round is two shuffles of
    the edges with partial aggregation, a hub's edges split; the edge table is written to the shared
    folder between rounds, and no vertex list ever reaches the driver."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-edges")
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = spread_join(both.where("v > u"), least.drop("n"), ["u"], "v", counts=least, total=2 * e.count()).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, f"{tag}-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, least.drop("n"), ["u"], "v", counts=least).select(F.greatest("v", "m").alias("x"), "m").union(least.select(F.col("u").alias("x"), "m"))
        new = written(small.where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct(), f"{tag}-edges")
        drop_written(large)
        drop_written(e)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = new
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


#: Buckets that ids are hashed to before wide rows are shuffled: the broadcast side holds a number for each at most.
ID_BUCKETS = 1 << 20


def _buckets(ids: DataFrame, key: str) -> tuple[Column, DataFrame]:
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(ID_BUCKETS))
    return bucket, F.broadcast(ids.select(bucket.alias("_lorewell_bucket")).distinct())


def with_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among `ids`; only rows that share a bucket with one of them are shuffled."""
    bucket, some = _buckets(ids, key)
    near = rows.withColumn("_lorewell_bucket", bucket).join(some, "_lorewell_bucket", "left_semi").drop("_lorewell_bucket")
    return near.join(ids, key, "left_semi").select(rows.columns)


def without_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among `ids` (a null key never is); rows in buckets without any of these stay where they are."""
    bucket, some = _buckets(ids, key)
    marked = rows.withColumn("_lorewell_bucket", bucket)
    far = marked.join(some, "_lorewell_bucket", "left_anti").select(rows.columns)
    near = marked.join(some, "_lorewell_bucket", "left_semi").select(rows.columns)
    return far.unionByName(near.join(ids, key, "left_anti").select(rows.columns))
