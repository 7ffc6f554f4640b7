"""A pipeline over ``documents``: what toxicity scoring rejects goes, site boilerplate lines go, one
document of each group of near duplicates stays, documents that hold benchmark items go, and the rest is
packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but the last
return the columns of ``documents``.  SQL cannot express the stages, so there is no ``ORACLE_SQL``; the
tests hold each of them against brute force.  Stages set how many rows of their session go to workers at
once, so that a batch of texts stays small beside an executor's heap.

Defined cases: rows that share an id, or have none, are rows of their own throughout, and of equal ones the
join keeps one; null and empty texts are clean, have no lines and no copies, and are packed as an end alone;
an empty table gives an empty result; further columns are passed on up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonemark.llm.decontaminate import clean
from zonemark.llm.line_dedup import drop_boilerplate
from zonemark.llm.ngram_join import link_documents
from zonemark.llm.packing import pack_documents
from zonemark.llm.storage import BATCH_ROWS, batches, stored
from zonemark.llm.toxicity import score_documents

#: Rows that go to the tokenizer at once: it meets fewer distinct words in more of them.
PACKED_ROWS = 10_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half."""
    batches(spark, BATCH_ROWS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, labels, with_row=True)
    return scored.filter("predicted = 0").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sites' boilerplate lines; ``n_chars`` follows the text. Copies are the
    next stage's: equal texts of a site are one page here where lines are counted."""
    chars = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return drop_boilerplate(docs, copies_once=True).withColumn("n_chars", chars)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of 0.8 or more connect: the one with the smallest id, or any of
    those that share it; a row without an id if none of the group has one."""
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    linked = link_documents(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    linked = stored(linked.join(rows.select("_row", "doc_id"), "_row"), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))
    keep = linked.groupBy("_group").agg(first["_row"].alias("_row"))
    others = linked.select("_row").join(keep, "_row", "left_anti")
    return rows.join(others, "_row", "left_anti").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    batches(spark, BATCH_ROWS)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids in sequences of at most 4096 tokens."""
    batches(spark, PACKED_ROWS)
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
