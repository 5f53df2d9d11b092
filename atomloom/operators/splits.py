"""Splits for validation: plain and grouped folds, shuffle splits, learning curves.

Shuffles order rows by a digest of the seed and the id, so any engine gives the same split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomloom.operators.order import running


def shuffle_key(seed: Column | int, key: str) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), F.col(key).cast("string")))


def _order(key: str, seed: int | None) -> list[Column]:
    return [F.col(key)] if seed is None else [shuffle_key(seed, key), F.col(key)]


def k_fold(ids: DataFrame, n_splits: int, *, key: str = "id", seed: int | None = None) -> DataFrame:
    """(key, fold): ``n_splits`` folds of consecutive rows, the first ones larger by one where they do not divide.

    Ids are ranked by ranges, so no task sees all of them unless they are few.
    """
    n = ids.count()
    ranked = running(ids.select(key), _order(key, seed), size=n)
    size, larger = divmod(n, n_splits)
    at, cut = F.col("before"), larger * (size + 1)
    fold = F.when(at < cut, F.floor(at / (size + 1))).otherwise(larger + F.floor((at - cut) / max(size, 1)))
    return ranked.select(key, fold.cast("long").alias("fold"))


def fold_roles(folds: DataFrame, n_splits: int, *, key: str = "id") -> DataFrame:
    """(split, key, role): in split s the rows of fold s are for testing, all others for training."""
    split = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long")))
    roles = folds.withColumn("split", split)
    return roles.select("split", key, F.when(F.col("fold") == F.col("split"), "test").otherwise("train").alias("role"))


def group_k_fold(mapping: DataFrame, n_splits: int, *, seed: int | None = None) -> DataFrame:
    """(split, env_id, role) from folds over frames, of ``mapping`` (frame_id, env_id)."""
    folds = k_fold(mapping.select("frame_id").distinct(), n_splits, key="frame_id", seed=seed)
    return fold_roles(folds, n_splits, key="frame_id").join(mapping, "frame_id").select("split", "env_id", "role")


def shuffle_split(ids: DataFrame, n_splits: int, n_train: int, n_test: int, seed: int, *, key: str = "id") -> DataFrame:
    """(split, key, role): in each split, of a fresh shuffle, the first ``n_test`` rows test and the next ``n_train`` train."""
    split = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_splits - 1).cast("long")))
    dealt = ids.select(key).withColumn("split", split)
    at = F.row_number().over(Window.partitionBy("split").orderBy(shuffle_key(F.col("split") + seed, key), key))
    dealt = dealt.withColumn("at", at).filter(F.col("at") <= n_test + n_train)
    return dealt.select("split", key, F.when(F.col("at") <= n_test, "test").otherwise("train").alias("role"))


def group_shuffle_split(mapping: DataFrame, n_splits: int, n_train: int, n_test: int, seed: int) -> DataFrame:
    """shuffle_split over frames, expanded to the environments of ``mapping`` (frame_id, env_id)."""
    frames = shuffle_split(mapping.select("frame_id").distinct(), n_splits, n_train, n_test, seed, key="frame_id")
    return frames.join(mapping, "frame_id").select("split", "env_id", "role")


def learning_curve_split(ids: DataFrame, train_sizes: list[int], n_repeats: list[int], n_test: int, seed: int, *, key: str = "id") -> DataFrame:
    """(n_train, repeat, key, role): for each training size, as many shuffles as asked for."""
    if len(train_sizes) != len(n_repeats):
        raise ValueError("one number of repeats for each training size")
    plan = F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("n_train"), F.lit(r).cast("long").alias("repeat")) for n, k in zip(train_sizes, n_repeats) for r in range(k))))
    dealt = ids.select(key, plan.alias("p")).select(key, "p.n_train", "p.repeat")
    order = shuffle_key(F.concat_ws(":", F.lit(seed).cast("string"), F.col("n_train").cast("string"), F.col("repeat").cast("string")), key)
    at = F.row_number().over(Window.partitionBy("n_train", "repeat").orderBy(order, key))
    # The first filter, on a constant, lets each task drop what comes too late before it moves.
    dealt = dealt.withColumn("at", at).filter(F.col("at") <= n_test + max(train_sizes, default=0)).filter(F.col("at") <= n_test + F.col("n_train"))
    return dealt.select("n_train", "repeat", key, F.when(F.col("at") <= n_test, "test").otherwise("train").alias("role"))


def param_grid(spark, steps: list[tuple[str, dict[str, list]]]) -> DataFrame:
    """All combinations of the parameters of ``steps``, numbered; the first step's vary fastest, within a step the last parameter's.

    Values that are no lists count as single ones. Columns: point, then step_parameter as strings.
    """
    grid = spark.range(1).select(F.array(F.lit("")).alias("_"))
    names, order = [], []
    for step, params in steps:
        own = []
        for name, values in params.items():
            values = values if isinstance(values, (list, tuple)) else [values]
            names.append(f"{step}_{name}")
            grid = grid.select("*", F.posexplode(F.array(*(F.lit(str(v)) for v in values))).alias(f"_p{len(names)}", names[-1]))
            own.append(F.col(f"_p{len(names)}"))
        order = own + order
    return grid.select((F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("point"), *names)
