"""The queries of this subpackage's operators, over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.chat_format import chat_format

    return chat_format(_read(spark, sf_dir, "conversations"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.license_scan import license_scan

    return license_scan(_read(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.html_extraction import html_extraction

    return html_extraction(_read(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.best_fit_packing import best_fit_packing

    return best_fit_packing(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.decontamination import decontaminate

    return decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.jaccard_join import jaccard_join

    return jaccard_join(_read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.language_id import language_id

    return language_id(_read(spark, sf_dir, "documents"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.token_count import token_count

    return token_count(_read(spark, sf_dir, "documents"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.token_output import token_output

    return token_output(_read(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(_read(spark, sf_dir, "embeddings"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.bpe_codec import round_trip

    return round_trip(_read(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.periodic_runs import digests, periodic_runs, planted

    return digests(periodic_runs(_read(spark, sf_dir, "documents"), places=planted))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lorewell.llm.filter_audit import filter_audit

    return filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_license_scan, op3_html_extraction, op4_best_fit_packing, op5_decontamination, op6_jaccard_join, op7_language_id, op8_token_count, op9_token_output, op10_embedding_dedup, op11_bpe_codec, op12_periodic_runs, op13_filter_audit, pipeline)}


def oracle_sql() -> dict[str, str]:
    from lorewell.llm import chat_format, decontamination, embedding_dedup, filter_audit, jaccard_join, license_scan

    return {
        "op1_chat_format": chat_format.ORACLE_SQL,
        "op2_license_scan": license_scan.oracle_sql(),
        "op5_decontamination": decontamination.ORACLE_SQL,
        "op6_jaccard_join": jaccard_join.ORACLE_SQL,
        "op10_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op13_filter_audit": filter_audit.ORACLE_SQL,
    }
