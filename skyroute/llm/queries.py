"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroute.llm.decontaminate import contamination
from skyroute.llm.divergence import source_divergence
from skyroute.llm.hash_forest import nearest
from skyroute.llm.jaccard_join import jaccard_join
from skyroute.llm.main_text import extract_main_text
from skyroute.llm.mixing import mixed
from skyroute.llm.oracles import oracle_sql
from skyroute.llm.quality import judged
from skyroute.llm.quotations import linked_conversations
from skyroute.llm.ranked_search import ranked_search
from skyroute.llm.sharding import sharded
from skyroute.llm.substring_dedup import remove_repeats
from skyroute.llm.tables import table
from skyroute.llm.url_filter import url_filter
from skyroute.llm.warc import archived_pages

__all__ = ["oracle_sql", "queries"]


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_conversations(table(spark, sf_dir, "conversations"))


def op5_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("hash")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_url_filter": op3_url_filter,
        "op4_quotation_linking": op4_quotation_linking,
        "op5_hash_forest": op5_hash_forest,
        "op6_decontaminate": op6_decontaminate,
        "op7_warc": op7_warc,
        "op8_quality": op8_quality,
        "op9_mixing": op9_mixing,
        "op10_main_text": op10_main_text,
        "op11_ranked_search": op11_ranked_search,
        "op12_divergence": op12_divergence,
        "op13_sharding": op13_sharding,
    }
