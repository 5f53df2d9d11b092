"""Matrices and fitted models as tables on disk: Parquet for numbers, a JSON record for what they are.

Matrices are kept in blocks, each a row with the lists of its non-zero entries, so that a part of
a matrix reads only the blocks that it meets.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns of a block by default.
BLOCK = 1024
#: Blocks of rows, or of columns, that a filter on a scan names; more than these are joined.
NAMED_BLOCKS = 1000


def save_table(df: DataFrame, where: str, metadata: dict) -> None:
    """Write ``df`` and its description; the description is written last, so a table that has one is whole."""
    df.write.mode("overwrite").parquet(f"{where}/data")
    record = df.sparkSession.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string")
    record.coalesce(1).write.mode("overwrite").text(f"{where}/metadata")


def load_table(spark: SparkSession, where: str) -> tuple[DataFrame, dict]:
    """The table, read lazily and only in the columns used, and its description."""
    return spark.read.parquet(f"{where}/data"), json.loads(spark.read.text(f"{where}/metadata").first()["value"])


def save_model(alpha: DataFrame, active: DataFrame, params: dict, where: str) -> None:
    """A fitted kernel model: weights (id, alpha), the environments they belong to (env_id, features), and its parameters."""
    save_table(alpha.join(active.withColumnRenamed("env_id", "id"), "id"), where, params)


def load_model(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame, dict]:
    """(alpha, active, params) of save_model."""
    table, params = load_table(spark, where)
    return table.select("id", "alpha"), table.selectExpr("id AS env_id", "features"), params


def save_blocks(matrix: DataFrame, where: str, metadata: dict, *, block: int = BLOCK, least: float = 0.0) -> None:
    """Keep ``matrix`` (i, j, k; ids from 0) in blocks of ``block`` ids each way, without entries of ``least`` size or less, and its description.

    A block is a row (bi, bj, n, i, j, k) with lists in order of (i, j). Rows lie in order of (bi,
    bj), in small row groups, so that a scan for some blocks skips the others by their statistics.
    """
    cells = matrix.filter(F.abs("k") > least).select(F.floor(F.col("i") / block).alias("bi"), F.floor(F.col("j") / block).alias("bj"), F.struct("i", "j", "k").alias("e"))
    packed = cells.groupBy("bi", "bj").agg(F.array_sort(F.collect_list("e")).alias("e"))
    rows = packed.select("bi", "bj", F.size("e").alias("n"), F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.k").alias("k"))
    rows.repartitionByRange("bi", "bj").sortWithinPartitions("bi", "bj").write.mode("overwrite").option("parquet.block.size", str(2**20)).parquet(f"{where}/data")
    record = rows.sparkSession.createDataFrame([(json.dumps(metadata | {"block": block}, sort_keys=True),)], "value string")
    record.coalesce(1).write.mode("overwrite").text(f"{where}/metadata")


def load_blocks(spark: SparkSession, where: str, *, rows: DataFrame | None = None, columns: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """The blocks of a matrix that ``rows`` and ``columns`` (id) meet, or all, and its description.

    Up to NAMED_BLOCKS blocks each way are named in the scan's filter; more are joined.
    """
    blocks, metadata = load_table(spark, where)
    for ids, name in ((rows, "bi"), (columns, "bj")):
        if ids is not None:
            met = ids.select(F.floor(F.col("id") / metadata["block"]).alias(name)).distinct()
            few = [r[name] for r in met.limit(NAMED_BLOCKS + 1).collect()]
            blocks = blocks.filter(F.col(name).isin(few)) if len(few) <= NAMED_BLOCKS else blocks.join(met, name, "left_semi")
    return blocks, metadata


def sub_matrix(spark: SparkSession, where: str, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(i, j, k): the entries of a kept matrix whose i is in ``rows`` (id) and whose j is in ``columns`` (id); only their blocks are read."""
    blocks, _ = load_blocks(spark, where, rows=rows, columns=columns)
    entries = blocks.select(F.explode(F.arrays_zip("i", "j", "k")).alias("e")).select("e.*")
    return entries.join(rows.select(F.col("id").alias("i")), "i", "left_semi").join(columns.select(F.col("id").alias("j")), "j", "left_semi")
