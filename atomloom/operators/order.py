"""Places of rows in an order over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.operators.cholesky import shared_folder

_BEFORE = (Window.unboundedPreceding, -1)


#: Rows up to which a table whose size is known is ranked in one task, without being written.
FEW = 10_000


def running(rows: DataFrame, order: list[Column], *, weight: str | None = None, size: int | None = None) -> DataFrame:
    """``rows`` with ``before``: how many rows come before each by ``order``, or the sum of their ``weight``.

    Rows are dealt by ranges of ``order`` and written to the shared folder with the number of
    their range, so that they are dealt once. Each range is ranked for itself; only one total a
    range meets in one task. No two rows should tie. Where the number of rows is given as ``size``
    and at most FEW, they are ranked as they are.
    """
    if size is not None and size <= FEW:
        own = F.lit(1).cast("long") if weight is None else F.col(weight)
        return rows.withColumn("before", F.coalesce(F.sum(own).over(Window.orderBy(*order).rowsBetween(*_BEFORE)), F.lit(0)))
    folder = shared_folder(rows.sparkSession, "order")
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(folder)
    table = rows.sparkSession.read.schema(dealt.schema).parquet(folder)
    own = F.lit(1).cast("long") if weight is None else F.col(weight)
    totals = table.groupBy("_range").agg(F.sum(own).alias("_total"))
    starts = totals.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(*_BEFORE)), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum(own).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(*_BEFORE)), F.lit(0))
    return table.withColumn("_within", within).join(starts, "_range").select(*rows.columns, (F.col("_start") + F.col("_within")).alias("before"))
