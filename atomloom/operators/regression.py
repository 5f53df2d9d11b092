"""Kernel regression: exact, low-rank and by conjugate gradients; validation without refitting.

Kernels are long tables (i, j, k). Models are solved in Spark by block Cholesky, without a bound on rows; only the
splits of learning curves are solved in a task each, which is refused beyond MAX_DENSE rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.functions.vectors import dot
from atomloom.operators import feature_map, matrix_free
from atomloom.operators.cholesky import BLOCK_ROWS, Factor, shared_folder
from atomloom.operators.kernels import weighted_kernel

MAX_DENSE = 5000
#: Blocks up to which an exact fit factors its matrix.
DIRECT_BLOCKS = 4


def dense(kernel: DataFrame, ids: list[int]) -> np.ndarray:
    """The square matrix of ``kernel`` over ``ids`` on the driver."""
    if len(ids) > MAX_DENSE:
        raise ValueError(f"{len(ids)} rows are too many for a dense system; at most {MAX_DENSE}")
    at = {v: n for n, v in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    table = kernel.toArrow()
    rows = [at[v] for v in table.column("i").to_pylist()]
    cols = [at[v] for v in table.column("j").to_pylist()]
    out[rows, cols] = table.column("k").to_numpy()
    return out


def krr_fit(kernel: DataFrame, targets: DataFrame, *, jitter: float, delta: float = 1.0) -> DataFrame:
    """(id, alpha) with (delta**2 K + jitter I) alpha = y, by block Cholesky; ``targets`` (id, y) name the rows."""
    return Factor(kernel, targets, jitter=jitter, delta=delta).solve()


def krr_fit_rows(rows: DataFrame, targets: DataFrame, zeta: float, *, jitter: float, delta: float = 1.0) -> DataFrame:
    """krr_fit with the power kernel of ``rows`` (env_id, features), of which no entry becomes a row of a table.

    Up to DIRECT_BLOCKS blocks the matrix is factored. Beyond, it is not kept at all: conjugate
    gradients multiply by it, and only if those do not end is it factored after all.
    """
    if targets.count() > DIRECT_BLOCKS * BLOCK_ROWS:
        found = matrix_free.solve(rows, targets, zeta, jitter=jitter, delta=delta)
        if found is not None:
            return found
    return Factor(_points(rows), targets, jitter=jitter, delta=delta, zeta=zeta).solve()


def _points(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("env_id").alias("id"), "features")


def krr_predict(kernel: DataFrame, alpha: DataFrame, *, delta: float = 1.0) -> DataFrame:
    """(id, y_pred): delta**2 times the sum of k alpha over the training rows, for each i of ``kernel``."""
    joined = kernel.join(alpha.select(F.col("id").alias("j"), "alpha"), "j")
    return joined.groupBy(F.col("i").alias("id")).agg((delta**2 * F.sum(F.col("k") * F.col("alpha"))).alias("y_pred"))


def krr_predict_rows(rows: DataFrame, train: DataFrame, zeta: float, *, delta: float = 1.0) -> DataFrame:
    """krr_predict for ``rows`` (env_id, features) and ``train`` (env_id, features, alpha), without a kernel between them being made."""
    return weighted_kernel(rows, train, zeta).select(F.col("i").alias("id"), (delta**2 * F.col("s")).alias("y_pred"))


def krr_fast_cv(kernel: DataFrame, targets: DataFrame, folds: DataFrame, *, jitter: float, delta: float = 1.0) -> DataFrame:
    """(id, fold, y_pred): what each row is predicted by a model without its fold. ``folds`` (id, fold).

    Each fold's rows follow the matrix of all others through one block Cholesky, which predicts
    them without a model being fitted; folds are few, their names are all the driver holds.
    """

    def left_out(own: DataFrame) -> Factor:
        rows = kernel.join(own.select(F.col("id").alias("i")), "i", "left_semi")
        return Factor(kernel, targets.join(own, "id", "left_anti"), jitter=jitter, delta=delta, extra=rows)

    return _by_fold(left_out, folds)


def krr_fast_cv_rows(rows: DataFrame, targets: DataFrame, folds: DataFrame, zeta: float, *, jitter: float, delta: float = 1.0) -> DataFrame:
    """krr_fast_cv with the power kernel of ``rows`` (env_id, features), of which no entry becomes a row of a table."""
    return krr_fast_cv_deltas(rows, targets, folds, zeta, jitter=jitter, deltas=[delta]).drop("delta")


def krr_fast_cv_deltas(rows: DataFrame, targets: DataFrame, folds: DataFrame, zeta: float, *, jitter: float, deltas: list[float]) -> DataFrame:
    """krr_fast_cv_rows (id, fold, y_pred, delta) for several strengths of the kernel.

    Where the products of features that make up the kernel are fewer than the rows (``feature_map``),
    one pass sums their products by fold, from which the models without each fold follow, of any
    strength. Elsewhere, or with many folds, a matrix is factored for each.
    """
    points, short = _points(rows), feature_map.length(rows, zeta)
    found = None
    if jitter > 0 and short is not None and short <= targets.count() and 1 < folds.select("fold").distinct().count() <= feature_map.FAN_IN:
        held = points.join(folds.select("id", "fold"), "id")
        moments = feature_map.Moments(held.join(targets.select("id", "y"), "id"), zeta)
        weights = moments.without_fold([jitter / delta**2 for delta in deltas])
        for delta in deltas:
            own = {fold: weights[fold, jitter / delta**2] for fold in moments.folds()}
            own = feature_map.predicted_by_fold(held, own, zeta).withColumn("delta", F.lit(float(delta)))
            found = own if found is None else found.unionByName(own)
        moments.remove()
        return found
    for delta in deltas:

        def left_out(own: DataFrame, delta: float = delta) -> Factor:
            return Factor(points, targets.join(own, "id", "left_anti"), jitter=jitter, delta=delta, extra=points.join(own, "id", "left_semi"), zeta=zeta)

        own = _by_fold(left_out, folds).withColumn("delta", F.lit(float(delta)))
        found = own if found is None else found.unionByName(own)
    return found


def _by_fold(left_out: Callable[[DataFrame], Factor], folds: DataFrame) -> DataFrame:
    found, folds = None, folds.persist()
    for fold in [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]:
        left = left_out(folds.filter(F.col("fold") == fold).select("id")).predict()
        left = left.select("id", F.lit(fold).cast("long").alias("fold"), "y_pred")
        found = left if found is None else found.unionByName(left)
    folds.unpersist()  # what is predicted from has been written
    return found


def sor_fit(gram: DataFrame, rhs: DataFrame, *, jitter: float = 1e-8) -> DataFrame:
    """(id, alpha) of the low-rank system (gram + jitter I) alpha = rhs, given entry by entry; ``low_rank.fit`` needs no entries."""
    return krr_fit(gram, rhs.select(F.col("i").alias("id"), F.col("b").alias("y")), jitter=jitter)


def gaussian_process(kernel: DataFrame, cross: DataFrame, own: DataFrame, targets: DataFrame, *, noise: float) -> DataFrame:
    """(id, y_pred, variance): kernel (training), cross (i test, j training), own (id, k of a test row with itself).

    The regularisation is noise**2 times the mean of the diagonal over the variance of y. With
    the Cholesky factor L of the regularised kernel, the variance is k** - |L^-1 k*|**2.
    """
    diagonal = kernel.filter("i = j").join(targets.select(F.col("id").alias("i")), "i", "left_semi").agg(F.sum("k")).first()[0]
    n, spread = targets.agg(F.count("*"), F.var_pop("y")).first()
    found = Factor(kernel, targets, jitter=noise**2 * diagonal / n / max(spread, 1e-300), extra=cross).predict()
    return found.join(own.select("id", F.col("k").alias("k_own")), "id").select("id", "y_pred", (F.col("k_own") - F.col("explained")).alias("variance"))


def gaussian_process_rows(train: DataFrame, test: DataFrame, targets: DataFrame, zeta: float, *, noise: float) -> DataFrame:
    """gaussian_process with the power kernel of ``train`` and ``test`` (env_id, features), of which no entry becomes a row of a table.

    Where the products of features that make up the kernel are fewer than the training rows (``feature_map``), only
    sums of those are solved: with their matrix G and jitter s, the variance is s phi (G + s I)^-1 phi.
    """
    own = F.pow(dot(F.col("features"), F.col("features")), zeta)
    n, spread = targets.agg(F.count("*"), F.var_pop("y")).first()
    diagonal = train.join(targets.select(F.col("id").alias("env_id")), "env_id", "left_semi").agg(F.sum(own)).first()[0]
    jitter, short = noise**2 * (diagonal or 0.0) / max(n, 1) / max(spread or 0.0, 1e-300), feature_map.length(train, zeta)
    if jitter > 0 and short is not None and short <= n:
        moments = feature_map.Moments(_points(train).join(targets.select("id", "y"), "id").withColumn("fold", F.lit(0)), zeta)
        root, w = moments.inverse_root(jitter)
        moments.remove()
        return feature_map.predicted(_points(test), root, w, jitter, zeta)
    found = Factor(_points(train), targets, jitter=jitter, extra=_points(test), zeta=zeta).predict()
    return found.join(test.select(F.col("env_id").alias("id"), own.alias("k_own")), "id").select("id", "y_pred", (F.col("k_own") - F.col("explained")).alias("variance"))


def conjugate_gradients(kernel: DataFrame, targets: DataFrame, *, jitter: float, max_steps: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(id, x) with (K + jitter I) x = y for K given entry by entry, without a dense matrix anywhere.

    Vectors are columns of a table over ``targets`` (id, y). Each step multiplies the kernel by the
    current direction, writes the table to the shared folder and removes the one before; the
    driver holds inner products. ``matrix_free.solve`` needs no entries.
    """
    spark, folder = kernel.sparkSession, shared_folder(kernel.sparkSession, "gradients")
    kernel = kernel.select("i", "j", "k").persist()
    state = targets.select("id", F.lit(0.0).alias("x"), F.col("y").cast("double").alias("r"), F.col("y").cast("double").alias("p"))
    size = targets.agg(F.sum(F.col("y") * F.col("y"))).first()[0] or 0.0
    least = tolerance * max(size, 1e-300)
    for k in range(max_steps):
        if size <= least:
            break
        sums = kernel.join(state.select(F.col("id").alias("j"), "p"), "j").groupBy(F.col("i").alias("id")).agg(F.sum(F.col("k") * F.col("p")).alias("q"))
        held = state.join(sums, "id", "left").withColumn("q", F.coalesce("q", F.lit(0.0)) + jitter * F.col("p"))
        held.write.parquet(f"{folder}/{k}")
        held = spark.read.schema(held.schema).parquet(f"{folder}/{k}")
        if k:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        step = size / held.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        left = F.col("r") - step * F.col("q")
        size, before = held.agg(F.sum(left * left)).first()[0], size
        state = held.select("id", (F.col("x") + step * F.col("p")).alias("x"), left.alias("r"), (left + size / before * F.col("p")).alias("p"))
    kernel.unpersist()
    return state.select("id", "x")


def conjugate_gradients_features(rows: DataFrame, *, ridge: float, max_steps: int = 1000, tolerance: float = 1e-25) -> DataFrame:
    """(id, x) with (X X^T + ridge I) x = y for ``rows`` (id, y, features), X having the features by rows.

    Every vector of the iteration is a multiple of y plus X times a vector as short as the
    features, so one pass sums X^T X, X^T y and y y, the steps are taken on those numbers, and x
    is a function of each row. Neither X X^T nor a vector of all rows is ever in one place.
    """

    def partial(batches):
        total = None
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            own = np.concatenate((x, batch.column("y").to_numpy()[:, None]), axis=1)
            total = own.T @ own if total is None else total + own.T @ own
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    sums = rows.select("features", "y").mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    v = sums.column("v").to_numpy()
    if not len(v):
        return rows.select("id", F.col("y").alias("x"))
    both = v.reshape(int(np.sqrt(len(v))), -1)
    gram, xy, yy = both[:-1, :-1], both[:-1, -1], both[-1, -1]

    # A vector b y + X w is (b, w).
    def inner(p: np.ndarray, q: np.ndarray) -> float:
        return float(p[0] * q[0] * yy + (p[0] * q[1:] + q[0] * p[1:]) @ xy + p[1:] @ gram @ q[1:])

    def times(p: np.ndarray) -> np.ndarray:
        return ridge * p + np.concatenate(([0.0], p[0] * xy + gram @ p[1:]))

    x, residual = np.zeros(len(both)), np.eye(1, len(both))[0]
    direction, size = residual, yy
    for _ in range(max_steps):
        if size <= tolerance:
            break
        product = times(direction)
        step = size / inner(direction, product)
        x, residual = x + step * direction, residual - step * product
        size, before = max(inner(residual, residual), 0.0), size
        direction = residual + size / before * direction
    dot = F.aggregate(F.zip_with("features", F.array(*(F.lit(float(w)) for w in x[1:])), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    return rows.select("id", (F.col("y") * F.lit(float(x[0])) + dot).alias("x"))
