"""Predictions for environments as they arrive.

A fitted model is its active environments and their weights, so predicting is a function of each
row: it runs on a stream as on a table, without state.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predict(rows: DataFrame, active: DataFrame, alpha: DataFrame, *, zeta: float, delta: float = 1.0) -> DataFrame:
    """(env_id, y_pred) for ``rows`` (env_id, features), streaming or not: delta**2 sum_j alpha_j (x . x_j) ** zeta.

    ``active`` (env_id, features) and ``alpha`` (id, alpha) are those of a fit, few by its design.
    """
    model = active.join(alpha.select(F.col("id").alias("env_id"), "alpha"), "env_id").orderBy("env_id").collect()
    basis, weight = np.array([r["features"] for r in model], float), np.array([r["alpha"] for r in model], float)

    def run(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            y = delta**2 * ((x @ basis.T) ** zeta) @ weight if batch.num_rows else np.zeros(0)
            yield pa.record_batch([batch.column("env_id"), pa.array(y)], names=["env_id", "y_pred"])

    return rows.select("env_id", "features").mapInArrow(run, "env_id long, y_pred double")
