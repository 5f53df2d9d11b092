"""A corpus pipeline over the table ``documents``: filter, clean, deduplicate, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Its result is written before the next stage reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.llm.common import Scratch, broadcast_if_few, materialise
from atomloom.llm.jaccard_join import link_documents
from atomloom.llm.line_dedup import dedup_lines
from atomloom.llm.packing import pack_documents
from atomloom.llm.quality_rules import judge
from atomloom.llm.toxicity import fit, grade

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: word n-grams, and hundredths of their union that two documents share.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def without(docs: DataFrame, rejected: Callable[[], DataFrame]) -> DataFrame:
    """``docs`` without the rows whose doc_id (null too) ``rejected`` returns; what it writes on its way is removed.

    The rejected ids are broadcast if they are few; texts are shuffled only beyond that.
    """
    with Scratch() as scratch:
        ids = broadcast_if_few(rejected().select(F.col("doc_id").alias("gone")).distinct(), "rejected")
        scratch.keep(ids)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["gone"]), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail a base rule, or that their host's verdict rejects; null and empty texts do. Others stay as they are."""
    return without(docs, lambda: judge(docs).filter("NOT kept")).select(COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of severity grade 1 or more go, under a model fitted to the labelled documents of ``sf_dir`` among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without(docs, lambda: grade(docs, fit(docs, labels)).filter("grade > 0")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds too are cut, and n_chars counts what is left. No document goes, even if emptied."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of near duplicates connect, the document of the smallest doc_id stays. Rows without a doc_id stay."""
    return without(docs, lambda: link_documents(docs, n=NEAR_WORDS, percent=NEAR_PERCENT).filter("component_id <> doc_id")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("packing", packing),
]
#: SQL can fit neither the toxicity model nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        with Scratch() as scratch:
            docs = materialise(stage(spark, docs, sf_dir), name)
            scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
