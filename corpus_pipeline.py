"""The corpus pipeline: documents in, a mixture for training out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroute.llm.decontaminate import benchmark_hits
from skyroute.llm.jaccard_join import jaccard_join
from skyroute.llm.mixing import mixed
from skyroute.llm.quality import judged
from skyroute.llm.substring_dedup import remove_repeats
from skyroute.llm.tables import staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps.

    Rows that share an id are one document: they stay or go together, each with its own row.  Rows with a null id go, and so do
    documents without words (null, empty or blank texts).  Ties do not occur: a document is judged by itself and its site.
    A null source or lang is a site of its own.  An empty table gives an empty one; columns besides those of ``documents`` are dropped.
    """
    verdict = judged(docs, table(spark, sf_dir, "labels")).where("keep").select("doc_id").distinct()
    return docs.join(verdict, "doc_id", "left_semi").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents.

    Rows that share an id are one document and must share the text; those of the document that stays all stay.  Rows with a null id go.
    Documents without words link with nothing and stay.  An empty table gives an empty one; columns besides those of ``documents`` are dropped.
    """
    first = jaccard_join(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; what has no word left goes.

    Each row gives at most one row with its own lang and source; rows that share an id are one document and must share the text, so none of
    them loses a passage to another.  Rows with a null id and documents without words (null, empty or blank texts) go.
    An empty table gives an empty one; columns besides those of ``documents`` are dropped, whatever their names.
    """
    cut = remove_repeats(docs, carried=("lang", "source")).where("n_words > n_removed")
    return cut.withColumnRenamed("kept_text", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any occurrence of a benchmark window.

    Rows that share an id are one document: all go if one has an occurrence.  Rows with a null id go.  Documents without words have no
    occurrence and stay.  An empty table, of documents or benchmark, is fine; columns besides those of ``documents`` are dropped.
    """
    hit = benchmark_hits(docs, table(spark, sf_dir, "benchmark")).where(F.size("starts") > 0).select("doc_id").distinct()
    return docs.where("doc_id is not null").join(hit, "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time that a document occurs, with its text, pass and random order.

    Repeated rows take part each, so a row that stands k times occurs as often as k documents would; of rows that share id and text
    but not the language, one language is given.  Rows with a null id and documents without words are in no mixture.  A null source is a source.
    An empty table gives an empty one; columns besides those of ``documents`` are dropped.
    """
    chosen = mixed(docs.where("doc_id is not null")).select(F.col("id").alias("doc_id"), "hash", "source", "weight", "block", "pass", "order")
    texts = docs.select("doc_id", "text", "lang", "n_chars", F.xxhash64("text").alias("hash")).dropDuplicates(["doc_id", "hash"])
    return texts.join(chosen, ["doc_id", "hash"]).select(*COLUMNS, "weight", "block", "pass", "order")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeats),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
]

#: SQL can't express the fitted classifier; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
