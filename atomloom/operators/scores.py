"""Scores of predictions: rows with y_pred and y, over all or by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.operators.order import running


def scores(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """mae, rmse, sup and r2 of ``rows`` (y_pred, y), in one aggregation; of each group where ``by`` names columns.

    r2 compares squared errors with the variance of ``y``: sums of y and its square give that
    without a second pass. Where y does not vary, r2 is null.
    """
    error = F.col("y_pred") - F.col("y")
    spread = F.var_pop("y")
    return rows.groupBy(*(by or [])).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.max(F.abs(error)).alias("sup"),
        F.when(spread > 0, 1 - F.avg(error * error) / spread).alias("r2"),
    )


def spearman(rows: DataFrame) -> DataFrame:
    """The rank correlation of ``rows`` (y_pred, y), equal values with their mean rank.

    Ranks come from counts of distinct values, so rows that tie are summed before they are ranked, by ranges.
    """

    def ranked(name: str) -> DataFrame:
        counts = rows.groupBy(name).agg(F.count("*").alias("c"))
        return running(counts, [F.col(name)], weight="c").select(name, (F.col("before") + (F.col("c") + 1) / 2).alias(f"rank_{name}"))

    both = rows.join(ranked("y_pred"), "y_pred").join(ranked("y"), "y")
    return both.agg(F.corr("rank_y_pred", "rank_y").alias("spearman"))


def mean_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """The mean of each score over folds or repeats, for each combination of ``by``."""
    names = [c for c in ("mae", "rmse", "sup", "r2") if c in scored.columns]
    return scored.groupBy(*by).agg(*(F.avg(c).alias(c) for c in names))


def outlier_frames(rows: DataFrame, *, factor: float = 3.0) -> DataFrame:
    """Frames with an environment whose predictions spread over ``factor`` times the mean spread.

    ``rows`` (frame_id, env_id, y_pred), one for each model. Spread: population standard deviation.
    """
    spread = rows.groupBy("frame_id", "env_id").agg(F.stddev_pop("y_pred").alias("s"))
    limit = spread.agg((factor * F.avg("s")).alias("limit"))
    return spread.join(F.broadcast(limit), F.col("s") > F.col("limit")).select("frame_id").distinct()
