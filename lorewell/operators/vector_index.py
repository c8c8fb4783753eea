"""A stored vector index by partitions of unit vectors, searched exactly: partitions that cannot hold a result are not read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions.scalar import dot
from lorewell.sources.scratch import stored as kept

#: Vectors wished for in a partition, and vectors for each centre in the sample that the centres are fitted on.
WISHED, SAMPLED = 4096, 32
#: Components of the vectors in a file, and numbers of a product of two sets of vectors at once.
FILE, CELLS = 1 << 22, 4 << 20
#: Scores are ranked after rounding to six places: a partition is read if it may come this near to the last place.
MARGIN = 1e-6
STORED = "i long, e array<double>, angle double, part int"


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre of the largest cosine for each row of x, and that cosine; no product holds more than CELLS numbers or one row."""
    own, most = np.zeros(len(x), np.int32), np.zeros(len(x))
    step = max(1, CELLS // max(1, len(centres)))
    for a in range(0, len(x), step):
        cos = x[a : a + step] @ centres.T
        own[a : a + step], most[a : a + step] = np.argmax(cos, axis=1), cos.max(axis=1)
    return own, most


def centres_of(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """At most n unit centres of unit vectors by spherical k-means."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    centres = sample[rng.permutation(len(sample))[:n]]
    for _ in range(rounds):
        own, _ = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


@dataclass
class VectorIndex:
    """Vectors (i, e, part) written in the order of partitions, and the partitions (part, centre, radius, n): radius is the largest angle to the centre."""

    vectors: DataFrame
    parts: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, path: str, wished: int = WISHED, seed: int = 11) -> VectorIndex:
        """Writes the index of (i, e), e of length 1 (or zero: those are a partition of their own) and of one dimension, and opens it.

        The centres are fitted on a sample of SAMPLED vectors each, drawn by a hash of
        the id; where they lie changes what is read, never what is found.  Every vector
        goes to its nearest centre in one pass and one shuffle."""
        spark = vectors.sparkSession
        rows = vectors.where("e IS NOT NULL AND i IS NOT NULL").select(F.col("i").cast("long").alias("i"), "e")
        n = rows.count()
        count = max(1, -(-n // wished))
        share = min(1.0, 2.0 * SAMPLED * count / max(1, n))
        sample = rows.where(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).where(F.exists("e", lambda x: x != 0)).select("e").limit(4 * SAMPLED * count).distinct().toArrow()
        e = sample.column("e").combine_chunks()
        fitted = centres_of(np.asarray(e.flatten(), np.float64).reshape(len(e), -1), count, seed=seed) if len(e) else np.zeros((0, 0))
        shared = spark.sparkContext.broadcast(fitted)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.asarray(b.column("e").flatten(), np.float64).reshape(b.num_rows, -1)
                some = np.abs(x).max(axis=1, initial=0) > 0
                part, angle = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
                if len(shared.value) and some.any():
                    part[some], cos = nearest(x[some], shared.value)
                    angle[some] = np.arccos(np.clip(cos, -1, 1))
                yield pa.RecordBatch.from_arrays([b.column("i"), b.column("e"), pa.array(part), pa.array(angle)], ["i", "e", "part", "angle"])

        placed = rows.mapInArrow(place, "i long, e array<double>, part int, angle double")
        # files hold ranges of partitions, so their number follows the vectors; a large partition may be several files
        files = max(1, -(-n * max(1, fitted.shape[1]) // FILE))
        spread = placed.repartitionByRange(files, "part", F.xxhash64("i")).sortWithinPartitions("part")
        spread.write.option("parquet.block.size", 4 << 20).parquet(f"{path}/vectors")
        stored = spark.read.schema(STORED).parquet(f"{path}/vectors")
        table = spark.createDataFrame(pa.table({"part": pa.array(range(-1, len(fitted)), pa.int32()), "centre": pa.array([[0.0] * fitted.shape[1], *fitted.tolist()], pa.list_(pa.float64()))}))
        stored.groupBy("part").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).join(F.broadcast(table), "part").select("part", "centre", "radius", "n").write.parquet(f"{path}/parts")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        return cls(spark.read.schema(STORED).parquet(f"{path}/vectors").select("i", "e", "part"), spark.read.parquet(f"{path}/parts"))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(q_id, part, most, n): the largest cosine with a query (q_id, q) that a vector of the partition may have, by the triangle inequality of angles."""
        to_centre = F.acos(F.least(F.greatest(dot(F.col("q"), F.col("centre")), F.lit(-1.0)), F.lit(1.0)))
        most = F.when(F.col("part") < 0, 0.0).otherwise(F.cos(F.greatest(to_centre - F.col("radius"), F.lit(0.0))))
        return queries.join(F.broadcast(self.parts)).select("q_id", "part", most.alias("most"), "n")

    def _scored(self, queries: DataFrame, wanted: DataFrame, keep: int) -> DataFrame:
        """(q_id, i, score) of the wanted (q_id, part), of each task the best `keep` of a query."""
        lists = wanted.groupBy("q_id").agg(F.collect_list("part").alias("first"))
        return self._best(_Asked.of(queries.join(lists, "q_id").select("q_id", "q", "first", F.lit(0.0).alias("least"))), keep)

    def _best(self, asked: _Asked, keep: int, bounded: _Bounds | None = None) -> DataFrame:
        """(q_id, i, score), of each task the best `keep` of a query: from the partitions listed for it, or with `bounded` from all others whose bound reaches its `least`.

        Tasks read the queries from the shared folder, so that the driver sees none; a
        partition's vectors meet them in matrix products, and what is below a query's best so far is dropped at once."""
        if bounded is None:
            parts = asked.table.select(F.explode("first").alias("part"))
        else:

            def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                found = np.zeros(len(bounded.part), bool)
                for a in map(_arrays, batches):
                    for rows in bounded.steps(len(a.ids)):
                        found |= bounded.late(a, rows).any(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(bounded.part[found], pa.int32())], ["part"])

            parts = asked.table.mapInArrow(reached, "part int")
        wanted, files = [r["part"] for r in parts.distinct().collect()], asked.files  # a number for each partition

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = _Asked.read(files)
            least = np.full(len(a.ids), -np.inf) if bounded is None else a.least.copy()
            best, seen, some = [], 0, np.zeros(0, np.int64)
            last = None

            def cut() -> tuple[np.ndarray, ...]:
                q, i, score = (np.concatenate(x) for x in zip(*best, strict=True))
                order = np.lexsort((i, -score, q))
                q, i, score = q[order], i[order], score[order]
                nth = np.arange(len(q)) - np.searchsorted(q, q)
                full = nth == keep - 1
                least[q[full]] = np.maximum(least[q[full]], score[full])
                best[:] = [tuple(x[nth < keep] for x in (q, i, score))]
                return best[0]

            for batch in batches:
                own, i = batch.column("part").to_numpy(), batch.column("i").to_numpy()
                e = np.asarray(batch.column("e").flatten(), np.float64).reshape(batch.num_rows, -1)
                for p in np.unique(own).tolist():
                    rows = np.flatnonzero(own == p)
                    if p != last:
                        last, some = p, a.by_part.get(p, a.ids[:0]) if bounded is None else bounded.queries(a, p)
                    step = max(1, CELLS // len(rows))
                    for at in range(0, len(some), step):
                        asks = some[at : at + step]
                        scores = np.round(a.q[asks] @ e[rows].T, 6) + 0.0
                        edge = least[asks]
                        hit = scores >= edge[:, None]
                        if keep < len(rows) and hit.sum() > 2 * keep * len(asks):
                            hit = scores >= np.maximum(edge, np.partition(scores, len(rows) - keep, axis=1)[:, len(rows) - keep])[:, None]
                        x, y = np.nonzero(hit)
                        best.append((asks[x], i[rows[y]], scores[x, y]))
                        seen += len(x)
                        if seen > CELLS // 4:
                            seen = -len(cut()[0])
            if best:
                q, i, score = cut()
                yield pa.RecordBatch.from_arrays([pa.array(a.ids[q], pa.int64()), pa.array(i, pa.int64()), pa.array(score, pa.float64())], ["q_id", "i", "score"])

        return self.vectors.where(F.col("part").isin(wanted)).mapInArrow(run, "q_id long, i long, score double")

    def search(self, queries: DataFrame, k: int = 10, without: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(q_id, i, rank, score): the k vectors of the largest cosine with each query (q_id, q of length 1), ties by i; and (q_id, read, parts): partitions read.

        First the partitions of the best bounds with k vectors together are read; then
        those whose bound reaches the k-th score found so far.  `without` names a
        column of queries with the id that is left out.  A task holds all queries, the driver the partitions' centres."""
        extra = [without] if without else []
        own = queries.where("q IS NOT NULL").select(F.col("q_id").cast("long").alias("q_id"), "q", *extra)
        bounded, need = _Bounds.of(self.parts), k + len(extra)

        def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, first = _matrix(batch.column("q")), []
                for rows in bounded.steps(len(q)):
                    most = bounded.most(q[rows])
                    order = np.lexsort((np.broadcast_to(bounded.part, most.shape), -most), axis=1)
                    before = np.cumsum(bounded.n[order], axis=1) - bounded.n[order]
                    first += [bounded.part[o[b < need]] for o, b in zip(order, before, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("q_id"), batch.column("q"), pa.array([x.tolist() for x in first], pa.list_(pa.int32()))], ["q_id", "q", "first"])

        asked = _Asked.of(own.select("q_id", "q").mapInArrow(ahead, "q_id long, q array<double>, first array<int>").withColumn("least", F.lit(0.0)))

        def top(scored: DataFrame) -> DataFrame:
            if without:
                scored = scored.join(own.select("q_id", without), "q_id").where(F.col("i") != F.col(without)).drop(without)
            place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "i"))
            return scored.withColumn("rank", place).where(F.col("rank") <= k)

        early = kept(top(self._best(asked, need)).select("q_id", "i", "score"), "early")
        least = early.groupBy("q_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        late = _Asked.of(asked.table.drop("least").join(least, "q_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))))
        found = top(early.unionByName(self._best(late, need, bounded)))

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a = _arrays(batch)
                for rows in bounded.steps(len(a.ids)):
                    read = bounded.late(a, rows).sum(axis=1) + np.array([len(x) for x in a.first[rows]], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a.ids[rows]), pa.array(read), pa.array(np.full(len(read), len(bounded.part)))], ["q_id", "read", "parts"])

        return found.select("q_id", "i", "rank", "score"), late.table.mapInArrow(counted, "q_id long, read long, parts long")


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)


@dataclass
class _Queries:
    """Ids, vectors, partitions read first and k-th score so far of some queries."""

    ids: np.ndarray
    q: np.ndarray
    first: list[np.ndarray]
    least: np.ndarray

    @cached_property
    def by_part(self) -> dict[int, np.ndarray]:
        """Which queries have a partition among those read first."""
        part, place = np.concatenate([*self.first, np.zeros(0, np.int32)]), np.repeat(np.arange(len(self.ids)), [len(x) for x in self.first])
        order = np.argsort(part, kind="stable")
        parts, begin = np.unique(part[order], return_index=True)
        return dict(zip(parts.astype(int).tolist(), np.split(place[order], begin[1:]), strict=True)) if len(parts) else {}


def _arrays(batch: pa.RecordBatch) -> _Queries:
    ends, flat = np.cumsum(batch.column("first").value_lengths().to_numpy()), batch.column("first").flatten().to_numpy()
    return _Queries(batch.column("q_id").to_numpy(), _matrix(batch.column("q")), np.split(flat, ends[:-1]) if len(ends) else [], batch.column("least").to_numpy())


@dataclass
class _Asked:
    """Queries (q_id, q, first, least) stored in the shared folder."""

    table: DataFrame
    files: list[str]

    @classmethod
    def of(cls, rows: DataFrame) -> _Asked:
        table = kept(rows.select("q_id", "q", "first", "least"), "queries")
        return cls(table, table.inputFiles())

    @staticmethod
    def read(files: list[str]) -> _Queries:
        """All of them, in a task."""
        parts = [_arrays(b) for f in files for system, path in [fs.FileSystem.from_uri(f)] for b in pq.read_table(path, filesystem=system, partitioning=None).combine_chunks().to_batches()]
        if not parts:
            return _Queries(np.zeros(0, np.int64), np.zeros((0, 0)), [], np.zeros(0))
        return _Queries(np.concatenate([x.ids for x in parts]), np.concatenate([x.q for x in parts]), [f for x in parts for f in x.first], np.concatenate([x.least for x in parts]))


@dataclass
class _Bounds:
    """The partitions: the largest cosine that a vector of one may have with a query, by the triangle inequality of angles."""

    part: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, parts: DataFrame) -> _Bounds:
        table = parts.orderBy("part").toArrow().combine_chunks()
        centre = table.column("centre").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
        return cls(table.column("part").to_numpy(), np.asarray(centre.flatten(), np.float64).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0)), table.column("radius").to_numpy(), table.column("n").to_numpy())

    def steps(self, n: int) -> Iterator[slice]:
        """n queries in slices whose bounds are at most CELLS numbers."""
        step = max(1, CELLS // max(1, len(self.part)))
        return (slice(a, min(a + step, n)) for a in range(0, n, step))

    def most(self, q: np.ndarray, at: slice = slice(None)) -> np.ndarray:
        if not len(self.part):
            return np.zeros((len(q), 0))
        angle = np.arccos(np.clip(q @ self.centre[at].T, -1, 1)) if self.centre.shape[1] else np.zeros((len(q), len(self.part[at])))
        most = np.cos(np.maximum(angle - self.radius[at], 0))
        most[:, self.part[at] < 0] = 0
        return most

    def late(self, a: _Queries, rows: slice) -> np.ndarray:
        """Which partitions are left to read, for some queries."""
        wanted = self.most(a.q[rows]) >= a.least[rows, None] - MARGIN
        for w, first in zip(wanted, a.first[rows], strict=True):
            w[np.searchsorted(self.part, first)] = False
        return wanted

    def queries(self, a: _Queries, p: int) -> np.ndarray:
        """The queries that have this partition left to read."""
        at = int(np.searchsorted(self.part, p))
        wanted = self.most(a.q, slice(at, at + 1))[:, 0] >= a.least - MARGIN
        wanted[a.by_part.get(p, a.ids[:0])] = False
        return np.flatnonzero(wanted)
