"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest number of rows that any operator broadcasts of a table that can grow; it counts first and takes another way beyond.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session in local mode gets a temporary folder; on a cluster that would
    be local to one machine, so an error is raised instead.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = worker_cache().setdefault("shared_dir", None) or tempfile.mkdtemp(prefix="spark-")
        worker_cache()["shared_dir"] = where
    return where.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/atomloom-{label}-{uuid.uuid4().hex}"


#: The scratch scopes that are open, the innermost last.
_SCOPES: list[Scratch] = []


class Scratch:
    """A scope whose tables, as ``materialise`` writes them, are removed at its end, but for those to keep.

    What is kept goes over to the scope around it, if there is one. Only what no result still to
    be computed reads may be left to go.
    """

    def __init__(self):
        self.tables: list[tuple[SparkSession, str]] = []
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {t._written_to for t in tables}

    def __enter__(self) -> Scratch:
        _SCOPES.append(self)
        return self

    def __exit__(self, *error: object) -> None:
        _SCOPES.remove(self)
        for spark, where in self.tables:
            if where in self.kept:
                if _SCOPES:
                    _SCOPES[-1].tables.append((spark, where))
                continue
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage, survives the loss of an executor, and stops Spark from running expensive
    Python work again for each use.
    """
    where = new_folder(df.sparkSession, label)
    if _SCOPES:
        _SCOPES[-1].tables.append((df.sparkSession, where))
    df.write.option("compression", "zstd").parquet(where)
    table = df.sparkSession.read.schema(df.schema).parquet(where)
    table._written_to = where
    return table


def broadcast_if_few(df: DataFrame, label: str) -> DataFrame:
    """``df`` written out, and marked for broadcast if it has at most BROADCAST_ROWS rows; beyond that Spark joins it by a shuffle."""
    table = materialise(df, label)
    if table.count() > BROADCAST_ROWS:
        return table
    small = F.broadcast(table)
    small._written_to = table._written_to
    return small


def numbered(rows: DataFrame, groups: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with ``place``, how many rows of the same ``groups`` (columns without nulls) come before each by ``order``, and ``n``, how many there are.

    Nulls in ``order`` come first, and rows that tie follow each other in any order. Rows are dealt
    by ranges and written, so that a group of any size is numbered in parts; one total a range of
    each group is all that meets. A Scratch around it must keep the table until the result is written.
    """
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*groups, *order, "_tie").withColumn("_range", F.spark_partition_id())
    table, keys = materialise(dealt, label), ["_range", *groups]
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy(*keys).agg(F.count("*").alias("_total"))
    before = totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"), F.sum("_total").over(Window.partitionBy(*groups)).alias("n"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "_tie")) - 1
    return table.withColumn("_within", within).join(before, keys).select(*rows.columns, (F.col("_before") + F.col("_within")).alias("place"), "n")


def valid_text(column: str = "text") -> Column:
    """The texts of ``column``, where bytes that are no UTF-8 count as U+FFFD."""
    return F.make_valid_utf8(column).alias(column)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def worker_cache() -> dict:
    """What a Python process keeps from one call or task to the next, such as loaded tokenizers."""
    return sys.__dict__.setdefault("_atomloom_cache", {})
