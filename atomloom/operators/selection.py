"""Selection of samples and features: farthest points, and one of each symmetry class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.operators.cholesky import shared_folder
from atomloom.operators.order import running

#: Points that a pass may settle: so many of the farthest rows come to the driver, with their features.
BATCH = 256
#: Points after which the running distances are written out instead of being derived again.
WRITE_EVERY = 25


def _distances(points: np.ndarray, zeta: float):
    """For rows x: the squared distances to each of ``points`` in the power kernel."""
    own = (points**2).sum(axis=1) ** zeta

    def run(x: np.ndarray) -> np.ndarray:
        return ((x**2).sum(axis=1) ** zeta)[:, None] + own[None, :] - 2 * (x @ points.T) ** zeta

    return run


def _settled(ids: np.ndarray, d: np.ndarray, x: np.ndarray, beyond: float, most: int, zeta: float) -> list[tuple[int, float]]:
    """Which of the candidates are picked next, one by one, and at which distance: those that no row but them can be farther than.

    Candidates are in order of (distance, -id), the farthest first; all other rows are at
    ``beyond`` at most, and come nearer as points are picked. The first candidate is always settled.
    """
    picked: list[tuple[int, float]] = []
    d = d.copy()
    while len(picked) < most and len(ids):
        n = int(np.lexsort((ids, -d))[0])
        if picked and d[n] <= beyond or d[n] == -np.inf:
            break
        picked.append((n, float(d[n])))
        d = np.minimum(d, _distances(x[n : n + 1], zeta)(x)[:, 0])
        d[[k for k, _ in picked]] = -np.inf
    return picked


def _pass(rows: DataFrame, state: DataFrame, wanted: int, batch: int, zeta: float) -> list[tuple[int, float, list[float]]]:
    """One pass over ``state`` (env_id, d): the next points (id, distance, features) that it settles, at least one if a row is left."""
    top = state.filter(F.col("d") > F.lit(float("-inf"))).select("env_id", "d").orderBy(F.desc("d"), "env_id").limit(batch + 1).collect()
    if not top:
        return []
    beyond = top[batch]["d"] if len(top) > batch else -np.inf
    own = {r["env_id"]: r["d"] for r in top[:batch]}
    found = {r["env_id"]: r["features"] for r in rows.filter(F.col("env_id").isin(list(own))).select("env_id", "features").collect()}
    ids, x = np.array(list(own), np.int64), np.array([found[i] for i in own], float)
    return [(int(ids[n]), d, found[int(ids[n])]) for n, d in _settled(ids, np.array(list(own.values())), x, beyond, wanted, zeta)]


def farthest_points(rows: DataFrame, n_select: int, *, zeta: float = 1.0, start: int | None = None, folder: str | None = None, batch: int = BATCH) -> DataFrame:
    """(rank, id, distance): environments picked one by one, each farthest in the power kernel from those before.

    Squared distance: k_ii + k_jj - 2 k_ij. The first is ``start`` (the smallest id if not given);
    ties go to the smaller id, and distance is the one at which the next point was picked (0 at
    the last). A pass over ``rows`` (env_id, features) finds the ``batch`` farthest rows and how
    far any other one is. Among those candidates points are picked for as long as none of the
    others can be farther, as distances only shrink; so a pass settles many points, and the result
    is that of single steps. Running distances are written every WRITE_EVERY points to ``folder``
    (if none is given, to a shared one that is removed at the end), and what they replace is removed.
    """
    spark = rows.sparkSession
    first = rows.agg(F.min("env_id").alias("i")).first()["i"] if start is None else start
    if first is None:
        return spark.createDataFrame([], "rank long, id long, distance double")
    point = rows.filter(F.col("env_id") == first).select("features").first()["features"]
    picked, trace, fresh = [first], [], [(first, point)]
    where, written, held = folder or shared_folder(spark, "farthest"), 0, None
    state = rows.select("env_id", "features", F.lit(float("inf")).alias("d"))

    def updated(fresh: list[tuple[int, list[float]]]):
        ids, distances = np.array([i for i, _ in fresh], np.int64), _distances(np.array([x for _, x in fresh], float), zeta)

        def run(batches):
            for own in batches:
                d = np.minimum(own.column("d").to_numpy(), distances(own.column("features").flatten().to_numpy().reshape(own.num_rows, -1)).min(axis=1))
                d[np.isin(own.column("env_id").to_numpy(), ids)] = -np.inf  # a point is picked once
                yield pa.record_batch([own.column("env_id"), own.column("features"), pa.array(d)], names=["env_id", "features", "d"])

        return run

    def drop(place: str | None) -> None:
        if place is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    while len(picked) < n_select:
        now = state.mapInArrow(updated(fresh), "env_id long, features array<double>, d double")
        if len(fresh) >= WRITE_EVERY:
            place, written = f"{where}/{written}", written + 1
            now.write.parquet(place)
            drop(held)
            state, fresh, held = spark.read.schema(now.schema).parquet(place), [], place
            now = state
        settled = _pass(rows, now, n_select - len(picked), batch, zeta)
        if not settled:
            break
        for i, d, x in settled:
            picked.append(i)
            trace.append(d)
            fresh.append((i, x))
    drop(held if folder else where)
    return spark.createDataFrame([(r, i, float(d)) for r, (i, d) in enumerate(zip(picked, [*trace, 0.0]))], "rank long, id long, distance double")


def feature_products(rows: DataFrame) -> np.ndarray:
    """X^T X of ``rows`` (features): d x d numbers, summed on each task before they move."""

    def partial(batches):
        total = 0.0
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            total = total + x.T @ x
        if np.ndim(total):
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    sums = rows.select("features").mapInArrow(partial, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    v = sums.column("v").to_numpy()
    d = int(np.sqrt(len(v)))
    return v.reshape(d, d)


def farthest_features(rows: DataFrame, n_select: int, *, start: int = 0) -> list[int]:
    """Features picked one by one, each farthest, over all ``rows`` (features), from those before; ties go to the smaller.

    Squared distances of columns follow from the products of features, so one pass is all that reads the rows.
    """
    g = feature_products(rows)
    if not len(g):
        return []
    picked, d = [start], np.full(len(g), np.inf)
    while len(picked) < min(n_select, len(g)):
        p = picked[-1]
        d = np.minimum(d, np.diag(g) + g[p, p] - 2 * g[p])
        d[picked] = -np.inf
        picked.append(int(d.argmax()))
    return picked


def select_samples(rows: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """The rows of the first ``n`` environments of ``chosen`` (rank, id), with their rank; frames keep their ids."""
    few = chosen.filter(F.col("rank") < n).select(F.col("id").alias("env_id"), "rank")
    return rows.join(few, "env_id")


def symmetry_filter(atoms: DataFrame) -> DataFrame:
    """The atoms (frame_id, class_id, atom_idx) that stand for their class: the smallest atom_idx of each frame and class.

    Taken by an aggregation and a join rather than a window, so a large class is summed on each task.
    """
    least = atoms.groupBy("frame_id", "class_id").agg(F.min("atom_idx").alias("atom_idx"))
    return atoms.join(least, ["frame_id", "class_id", "atom_idx"], "left_semi")


def symmetry_inverse(atoms: DataFrame, values: DataFrame) -> DataFrame:
    """(frame_id, atom_idx, value) for all atoms, each with the value (frame_id, class_id, value) of its class."""
    return atoms.join(values.select("frame_id", "class_id", "value"), ["frame_id", "class_id"]).select("frame_id", "atom_idx", "value")


def env_mapping(atoms: DataFrame, species: int) -> DataFrame:
    """(frame_id, env_id): atoms of a species numbered from 0 by frame and position; a large frame is ranked in parts too."""
    kept = atoms.filter(F.col("species") == species).select("frame_id", "atom_idx")
    return running(kept, [F.col("frame_id"), F.col("atom_idx")]).select("frame_id", F.col("before").alias("env_id"))


def frame_offsets(atoms: DataFrame) -> DataFrame:
    """(frame_id, n, start): centres of each frame, and those of all frames before."""
    counts = atoms.groupBy("frame_id").agg(F.count("*").alias("n"))
    return running(counts, [F.col("frame_id")], weight="n").withColumnRenamed("before", "start")
