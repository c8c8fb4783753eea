"""A content-addressed cache of item vectors: a tree of hashes tells what changed, only that is encoded again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of an id that a level of the tree takes together: a leaf covers 1,024 ids, a node 1,024 leaves, and so on.
BITS, LEVELS = 10, 6
MANIFEST = "leaf long, digest string, n long, run string"


def item_digests(items: DataFrame, text: Column) -> DataFrame:
    """(i, leaf, h): md5 of each item's text; a null one is no text."""
    return items.select("i", F.shiftright("i", BITS).alias("leaf"), F.md5(F.coalesce(text, F.lit(""))).alias("h"))


def leaf_digests(digests: DataFrame) -> DataFrame:
    """(leaf, digest, n): md5 over the (id, md5) of a range of ids, in order: at most 1,024 of them in a group."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: F.concat_ws(":", x["i"].cast("string"), x["h"]))
    return digests.groupBy("leaf").agg(F.md5(F.array_join(one, ",")).alias("digest"), F.count("*").alias("n"))


def tree_hash(leaves: DataFrame) -> DataFrame:
    """(content_hash): the root over (leaf, digest); a node's digest is the md5 over its at most 1,024 children's, so no group holds all."""
    level = leaves.select("leaf", "digest")
    for last in [False] * (LEVELS - 1) + [True]:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("leaf", "digest"))), lambda x: F.concat_ws(":", x["leaf"].cast("string"), x["digest"]))
        digest = F.md5(F.array_join(parts, ",")).alias("digest")
        level = level.agg(digest) if last else level.groupBy(F.shiftright("leaf", BITS).alias("leaf")).agg(digest)
    return level.select(F.col("digest").alias("content_hash"))


class EmbeddingCache:
    """Vectors (i, h, e) of one encoder in a folder, by run and leaf, and numbered manifests that name each leaf's digest and run.

    An update writes the leaves that changed under a run of its own and then one new
    manifest; the newest manifest that was written to its end counts, so a reader sees
    the state before an update or after it, and an update that fails leaves the one
    before."""

    def __init__(self, spark: SparkSession, folder: str, model: str):
        self.spark, self.at = spark, f"{folder}/{model}"

    def _versions(self) -> list[int]:
        """Numbers of the manifests that are whole."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/manifest/v=*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(s.getPath().getParent().getName()[2:]) for s in found or [])

    def manifest(self) -> DataFrame:
        """(leaf, digest, n, run) of the newest state; empty where there is none."""
        versions = self._versions()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.at}/manifest/v={versions[-1]}") if versions else self.spark.createDataFrame([], MANIFEST)

    def _vectors(self, manifest: DataFrame) -> DataFrame:
        """(i, leaf, h, e) of the manifest's leaves: files of other runs' leaves are not read."""
        runs = [r["run"] for r in manifest.select("run").distinct().collect()]  # one for each update that still holds a leaf
        schema = "i long, h string, e array<double>, run string, leaf long"
        try:
            stored = self.spark.read.schema(schema).parquet(f"{self.at}/vectors")
        except AnalysisException:
            stored = self.spark.createDataFrame([], schema)
        return stored.where(F.col("run").isin(runs)).join(manifest.select("run", "leaf"), ["run", "leaf"], "left_semi").select("i", "leaf", "h", "e")

    def read(self) -> DataFrame:
        """(i, e) of the newest state."""
        return self._vectors(self.manifest()).select("i", "e")

    def content_hash(self) -> str | None:
        """The root of the newest state's tree; None where there is none."""
        return tree_hash(self.manifest()).first()["content_hash"] if self._versions() else None

    def update(self, items: DataFrame, text: Column, encode: Callable[[DataFrame, Column], DataFrame]) -> int:
        """Brings the cache to the state of `items` (i once each) and returns how many items were encoded: new ones and those with another text.

        `encode(items, text)` gives (i, e).  Equal roots end it at once; else leaves with
        other digests are written anew, from the old vectors where the text is the same."""
        digests = item_digests(items, text)
        leaves = leaf_digests(digests).persist()
        old = self.manifest()
        try:
            if self._versions() and tree_hash(leaves).first() == tree_hash(old).first():
                return 0
            same = leaves.join(old.select("leaf", "digest", "run"), ["leaf", "digest"])
            stale = leaves.join(same.select("leaf"), "leaf", "left_anti")
            wanted = digests.join(stale.select("leaf"), "leaf", "left_semi")
            before = self._vectors(old.join(stale.select("leaf"), "leaf", "left_semi"))
            kept = wanted.join(before.select("i", "h", "e"), ["i", "h"], "left")
            missing = kept.where("e IS NULL").select("i", "leaf", "h").persist()
            encoded = missing.count()
            fresh = encode(items.join(missing.select("i"), "i", "left_semi"), text)
            run = uuid.uuid4().hex
            new = kept.where("e IS NOT NULL").select("i", "leaf", "h", "e").unionByName(missing.join(fresh, "i").select("i", "leaf", "h", "e"))
            new.repartition("leaf").write.partitionBy("leaf").parquet(f"{self.at}/vectors/run={run}")
            number = (self._versions() or [0])[-1] + 1
            named = same.select("leaf", "digest", "n", "run").unionByName(stale.select("leaf", "digest", "n", F.lit(run).alias("run")))
            named.write.mode("error").parquet(f"{self.at}/manifest/v={number}")
            missing.unpersist()
            return encoded
        finally:
            leaves.unpersist()
