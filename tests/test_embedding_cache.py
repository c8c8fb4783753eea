"""The embedding cache encodes what changed, and a failed update leaves the state before."""

import pytest
from pyspark.sql import functions as F

from lorewell.sources.embedding_cache import EmbeddingCache, item_digests, leaf_digests, tree_hash


def table(spark, rows):
    return spark.createDataFrame(rows, "i long, text string")


def vectors(items, text):
    return items.select("i", F.array(F.length(F.coalesce(text, F.lit(""))).cast("double"), F.col("i").cast("double")).alias("e"))


def test_only_changes_are_encoded(spark, tmp_path):
    rows = {k: f"text {k}" for k in [*range(0, 5000, 2), 1 << 40]}
    cache = EmbeddingCache(spark, str(tmp_path), "m")
    assert cache.content_hash() is None and cache.read().count() == 0
    read = lambda: {r["i"]: r["e"] for r in EmbeddingCache(spark, str(tmp_path), "m").read().collect()}
    asked = []

    def encode(items, text):
        asked.append(sorted(r["i"] for r in items.select("i").collect()))
        return vectors(items, text)

    assert cache.update(table(spark, list(rows.items())), F.col("text"), encode) == len(rows)
    first = cache.content_hash()
    assert cache.update(table(spark, list(rows.items())), F.col("text"), encode) == 0 and len(asked) == 1
    rows[2000] = "another text"
    rows[1] = None
    del rows[4998]
    assert cache.update(table(spark, list(rows.items())), F.col("text"), encode) == 2 and asked[1] == [1, 2000]
    assert read() == {i: [float(len(t or "")), float(i)] for i, t in rows.items()} and cache.content_hash() != first
    runs = {r["leaf"]: r["run"] for r in cache.manifest().collect()}
    assert runs[3] == runs[1 << 30] != runs[1] == runs[0] == runs[4]  # leaves without a change stay in the first run
    assert cache.content_hash() == tree_hash(leaf_digests(item_digests(table(spark, list(rows.items())), F.col("text")))).first()["content_hash"]
    # a failed update changes nothing, nor does a manifest that was not written to its end
    before = read()

    def broken(items, text):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        cache.update(table(spark, [(9, "x")]), F.col("text"), broken)
    (tmp_path / "m" / "manifest" / "v=99").mkdir()
    assert read() == before
    assert cache.update(table(spark, [(9, "x")]), F.col("text"), encode) == 1 and read() == {9: [1.0, 9.0]}
    assert cache.update(table(spark, []), F.col("text"), encode) == 0 and read() == {}


def test_hash_sees_order_and_place(spark):
    root = lambda rows: tree_hash(leaf_digests(item_digests(table(spark, rows), F.col("text")))).first()["content_hash"]
    assert root([(1, "a"), (2, "b")]) == root([(2, "b"), (1, "a")]) != root([(1, "b"), (2, "a")])
    assert len({root([(1, "a")]), root([(1025, "a")]), root([(1 << 30, "a")]), root([(-1, "a")]), root([])}) == 5
