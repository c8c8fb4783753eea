"""A corpus pipeline of four operators: language ID, Jaccard join, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorewell.llm._shared import with_ids, without_ids, written
from lorewell.llm.best_fit_packing import best_fit_packing
from lorewell.llm.decontamination import decontaminate
from lorewell.llm.jaccard_join import jaccard_join
from lorewell.llm.language_id import UNKNOWN, keep_languages


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those with no text or no letter go.  Repeated rows stay repeated; without a labelled row nothing stays; an empty table stays empty."""
    return keep_languages(docs, lambda language, score: language != UNKNOWN)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest doc_id, once where its row is repeated (rows without a doc_id stay)."""
    found = written(jaccard_join(docs).select("doc_id", "component_id"), "jaccard-groups")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    once = without_ids(docs, gone.union(again).distinct(), "doc_id")
    return once.unionByName(with_ids(docs, again, "doc_id").dropDuplicates(["doc_id"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.  Texts without words and rows without a doc_id stay, all rows of a doc_id go with one of them; an empty benchmark removes nothing."""
    hit = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    return without_ids(docs, written(hit.select("doc_id").distinct(), "contaminated"), "doc_id")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all documents that are left: a piece of the end id alone for an empty text, repeated rows packed as often; no rows for an empty table."""
    return best_fit_packing(docs)


STAGES = [("language ID", identified), ("n-gram Jaccard join", deduplicated), ("benchmark decontamination", decontaminated), ("best-fit packing", packed)]

#: SQL can express neither the network of the first stage nor the packing of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
