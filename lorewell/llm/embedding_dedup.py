"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm._shared import components, spread_join, written

#: Production threshold, and the chance to miss a pair just at it (a closer pair is missed more rarely still).
COSINE, MISS = 0.93, 1e-4
#: Vectors wished for in a bucket, rows of a tile, and rows of a task group.
BUCKET, TILE, GROUP = 512, 1024, 8192


def tables_for(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key so that n vectors fill buckets of about BUCKET, and tables so that a pair at the threshold is missed with chance `miss`."""
    bits = max(4, min(48, ceil(log2(max(n, 1) / BUCKET)))) if n > BUCKET else 4
    meet = (1 - acos(cosine) / pi) ** bits
    return bits, ceil(log(miss) / log(1 - meet))


def _coded(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """The classes with the sign code of each vector in every table, packed."""
    kind = code_type(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("embedding")))
            packed = np.zeros((batch.num_rows, tables), kind)
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                x = np.asarray(batch.column("embedding").take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), d)
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, bits * tables))
                signs = (x @ planes[d] > 0).reshape(len(rows), tables, bits)
                packed[rows] = (signs @ (1 << np.arange(bits, dtype=np.int64))).astype(kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in packed], pa.binary())], ["rep", "label", "embedding", "m", "codes"])

    types = dict(classes.dtypes)
    return classes.select("rep", "label", "embedding", "m").mapInArrow(run, f"rep long, label {types['label']}, embedding {types['embedding']}, m long, codes binary")


def code_type(bits: int) -> type:
    """The narrowest unsigned type that holds a code."""
    return np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64


def _keys(coded: DataFrame, bits: int, tables: int) -> DataFrame:
    """(tab, label, d, code, rep): a row for each vector and table."""
    kind = code_type(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), kind).astype(np.int64)
                again = lambda c: pa.array(np.repeat(batch.column(c).to_numpy().astype(np.int64), tables))
                label = batch.column("label").take(pa.array(np.repeat(np.arange(batch.num_rows), tables)))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables), batch.num_rows)), label, again("d"), pa.array(codes), again("rep")], ["tab", "label", "d", "code", "rep"])

    label = dict(coded.dtypes)["label"]
    return coded.select("rep", "label", F.size("embedding").cast("long").alias("d"), "codes").mapInArrow(run, f"tab long, label {label}, d long, code long, rep long")


def near_pairs(unit: np.ndarray, second: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose cosine reaches the threshold: pairs within `unit`, or with `second` marking the other side, across."""
    if second is None:
        return np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
    a, b = np.flatnonzero(~second), np.flatnonzero(second)
    i, j = np.nonzero(unit[a] @ unit[b].T >= cosine)
    return a[i], b[j]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n vertices the smallest one that edges a-b connect it with."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            break
    return label


def embedding_dedup(embeddings: DataFrame, cosine: float = COSINE, miss: float = MISS, seed: int = 20260101) -> DataFrame:
    """Links of vectors of equal label with cosine >= `cosine`, and their connected components.

    Equal vectors of a label are one class with a count, so copies never multiply.
    Each class is hashed by the signs of random projections in several tables (bits
    and tables follow from the largest label and the allowed chance of a miss);
    classes that share a key are compared exactly in double precision, tile against
    tile where a bucket is large, so no task holds an unbounded bucket.  A pair counts
    in the first table where it meets, so tasks return sums of links and a spanning
    forest (a row for each vector at most), never the pairs themselves.

    Labels of any type that can be grouped are compared as they are (of floating ones, 0.0
    equals -0.0 and NaN itself).  A null label, and a vector that is null, empty, zero or holds null or non-finite
    components, links with nothing; vectors of different dimension do not link;
    repeated rows are linked copies; an empty table gives no rows.  Returns vec_id,
    n_links, component_id, kept.
    """
    kept = "array<float>" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "array<double>"  # compared in double precision either way
    own = embeddings["label"] + F.lit(0.0).cast(dict(embeddings.dtypes)["label"]) if dict(embeddings.dtypes)["label"] in ("float", "double") else embeddings["label"]
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast(kept).alias("embedding"), own.alias("label"))
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0.0)
    # -0.0 equals 0.0, and so must its hash
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0).cast(kept[6:-1])).otherwise(x))
    name = {"k1": F.xxhash64("label", plain), "k2": F.xxhash64(F.lit(7919), plain, "label")}
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fit, F.lit(False))
    classes = rows.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    classes = written(classes, "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, cosine, miss)
    kind = code_type(bits)
    coded = written(_coded(classes, bits, tables, seed), "sign-codes")
    keyed = _keys(coded, bits, tables)
    sizes = keyed.groupBy("tab", "label", "d", "code").agg(F.count("*").alias("c")).where("c > 1")
    groups = max(1, -(-coded.count() * tables // GROUP))
    low, high = F.least("t", "other"), F.greatest("t", "other")
    placed = (
        keyed.join(sizes, ["tab", "label", "d", "code"])
        .withColumn("g", F.ceil(F.col("c") / TILE))
        .withColumn("t", F.pmod(F.xxhash64("rep"), F.col("g")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        .select("rep", "tab", "t", low.alias("lo"), F.xxhash64("tab", "label", "d", "code", low, high).alias("key"))
        .withColumn("part", F.pmod("key", F.lit(groups)))
    )

    def test(table: pa.Table) -> pa.Table:
        key, tab, weight = table["key"].to_numpy(), table["tab"].to_numpy(), table["m"].to_numpy()
        names, own = np.unique(table["rep"].to_numpy(), return_inverse=True)
        second = table["t"].to_numpy() != table["lo"].to_numpy()
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), kind).reshape(-1, tables)
        vectors = table["embedding"].combine_chunks()
        order = np.argsort(key, kind="stable")
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(rows) < 2:
                continue
            x = np.asarray(vectors.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            i, j = near_pairs(x, second[rows] if second[rows].any() and not second[rows].all() else None, cosine)
            i, j, first = rows[i], rows[j], tab[rows[0]]
            # a pair counts in the first table where it meets
            fresh = ~(codes[i, :first] == codes[j, :first]).any(axis=1)
            left.append(i[fresh])
            right.append(j[fresh])
        i, j = np.concatenate(left), np.concatenate(right)
        linked = np.bincount(own[i], weights=weight[j], minlength=len(names)) + np.bincount(own[j], weights=weight[i], minlength=len(names))
        label = forest(len(names), own[i], own[j])
        some = linked > 0
        return pa.table({"a": names[some], "b": names[label[some]], "linked": linked[some].astype(np.int64)})

    links = written(placed.join(coded.select("rep", "embedding", "m", "codes"), "rep").groupBy("part").applyInArrow(test, "a long, b long, linked long"), "cosine-links")
    others = links.groupBy("a").agg(F.sum("linked").alias("others"))
    groups_of = components(links.select("a", "b"), "vectors")
    classed = classes.withColumns(name).select("k1", "k2", "rep", F.col("m").alias("n"))
    found = (
        classed.join(others, F.col("rep") == F.col("a"), "left")
        .join(groups_of, F.col("rep") == F.col("id"), "left")
        .select("k1", "k2", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    # copies of a frequent vector are split, rows that link with nothing are not joined at all
    linked = spread_join(rows.where(usable).withColumns(name).select("vec_id", "k1", "k2"), found, ["k1", "k2"], "vec_id", counts=classed, total=classed.agg(F.sum("n")).first()[0] or 0)
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id")).unionByName(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT DISTINCT a AS v, a AS r FROM links
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.v WHERE reach.r < l.b
), comp AS (SELECT v, min(r) AS m FROM reach GROUP BY v
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(coalesce(comp.m, e.vec_id), e.vec_id) AS component_id, least(coalesce(comp.m, e.vec_id), e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp ON comp.v = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
