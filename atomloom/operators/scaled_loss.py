"""The cross-validated loss of low-rank models as a function of noise scale and feature weights, with its whole gradient.

A value takes one pass over the environments, which adds up K_MN K_NM and K_MN y by fold; the
gradient takes one more, whatever the number of parameters. With A alpha = b the model of a fold
and g the slope of the loss by alpha, A lambda = g is its adjoint: the slope by each row of K
is then a sum of alphas and lambdas, with two numbers a fold that say how much of each. So what a
row has to know are those few numbers, and tasks go on to the slope by the weights themselves.

Rows are single environments, or frames whose row of K is the mean over their environments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.operators.cholesky import shared_folder
from atomloom.operators.compression import Shape, scaled_size

#: Active frames at most, as their systems are solved on the driver, and environments of theirs on average.
MAX_ACTIVE, MAX_EACH = 2048, 16
#: Kernel entries that are made at a time.
STRIP = 2**20


def leg_index(shape: Shape, kind: str) -> np.ndarray:
    """For each component of a spectrum of ``shape``, the factors that multiply it: numbers of ``scale_features``' factors without ``full``.

    As many columns as a component has factors: both legs of the type, and what comes before them.
    Types whose legs join species and radial functions reorder components and have none.
    """
    if "*" in kind:
        raise ValueError(f"scaling of the type {kind} reorders components")
    s, t, n, m, l = np.indices(shape.axes).reshape(5, -1)  # noqa: E741
    lead = shape.angular if kind.startswith("angular+") else shape.species if kind.startswith("species+") else 0
    legs = {"species": (s, t), "radial": (n, m)}
    first, second = legs[kind.split("+")[-1]]
    columns = [first + lead, second + lead]
    if kind.startswith("angular+"):
        columns.append(l)
    elif kind.startswith("species+"):
        columns += [s, t]
    index = np.stack(columns, axis=1)
    assert len(index) == scaled_size(shape, kind, len(np.unique(first)))
    return index


def angular_index(components: int, angular: int) -> np.ndarray:
    """One factor for each l, the last axis of the spectrum."""
    return (np.arange(components) % angular)[:, None]


@dataclass
class Scaling:
    """Weights of features as products of factors: component c has those that row c of ``index`` names. Then vectors may be normalised."""

    index: np.ndarray
    normalise: bool = True

    def weights(self, factors: np.ndarray) -> np.ndarray:
        return np.asarray(factors, float)[self.index].prod(axis=1)

    def slopes(self, factors: np.ndarray, by_weight: np.ndarray) -> np.ndarray:
        """The slope by each factor, from that by each weight."""
        out, f = np.zeros(len(factors)), np.asarray(factors, float)[self.index]
        for k in range(f.shape[1]):
            np.add.at(out, self.index[:, k], by_weight * np.delete(f, k, axis=1).prod(axis=1))
        return out

    def forward(self, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = x * w
        sizes = np.sqrt((s * s).sum(axis=1, keepdims=True)) if self.normalise else np.ones((len(x), 1))
        sizes[sizes == 0] = 1.0
        return s / sizes, sizes

    def backward(self, x: np.ndarray, z: np.ndarray, sizes: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """The slope by each weight, summed over the rows, from that by z."""
        if self.normalise:
            slope = slope - z * (z * slope).sum(axis=1, keepdims=True)
        return (slope / sizes * x).sum(axis=0)


@dataclass
class _Frames:
    """Active environments, in order of their frames: where each frame begins, the frame of each, and the sizes."""

    first: np.ndarray
    of: np.ndarray
    sizes: np.ndarray

    def mean(self, k: np.ndarray) -> np.ndarray:
        """Columns by environment to means by frame."""
        return np.add.reduceat(k, self.first, axis=1) / self.sizes if len(self.first) else np.zeros((len(k), 0))

    def share(self, v: np.ndarray) -> np.ndarray:
        """Columns by frame to each environment's share."""
        return (v / self.sizes)[..., self.of]

    def strips(self, rows: int) -> Iterator[slice]:
        step = max(1, STRIP // max(1, len(self.of)))
        for at in range(0, rows, step):
            yield slice(at, at + step)


class ScaledLoss:
    """The mean squared error of rows predicted without their fold, as a function of (scale, factors...).

    ``environments`` (frame_id, features) and ``targets`` (frame_id, y, fold): with an environment
    a frame, single ones; ``active`` (frame_id, features) are those of the active frames, few as
    their systems are dense. The kernel is the power kernel of weighted features, averaged over
    the environments of either frame. ``passes`` counts the passes over the environments.
    """

    def __init__(self, environments: DataFrame, targets: DataFrame, active: DataFrame, scaling: Scaling, *, zeta: float, jitter: float = 1e-8):
        self.spark, self.scaling, self.zeta, self.jitter, self.passes = environments.sparkSession, scaling, zeta, jitter, 0
        self.folder, self.written = shared_folder(self.spark, "loss"), 0
        held = active.select("frame_id", "features").orderBy("frame_id").limit(MAX_EACH * MAX_ACTIVE + 1).toArrow().sort_by("frame_id")
        self.basis = np.array(held.column("features").combine_chunks().flatten(), float).reshape(len(held), -1)
        ids, first, of, sizes = np.unique(held.column("frame_id").to_numpy(), return_index=True, return_inverse=True, return_counts=True)
        if len(ids) > MAX_ACTIVE or len(held) > MAX_EACH * MAX_ACTIVE:
            raise ValueError(f"{len(ids)} active frames with {len(held)} environments; at most {MAX_ACTIVE} and {MAX_EACH} times as many")
        self.frames = _Frames(first, of, sizes)
        targets = targets.select("frame_id", F.col("y").cast("double").alias("y"), F.col("fold").cast("long").alias("fold"))
        environments = environments.select("frame_id", F.col("features").cast("array<double>").alias("features"))
        self.environments = self._write(environments.join(targets, "frame_id"))
        self.single = self.environments.count() == self.environments.select("frame_id").distinct().count()

    def _write(self, df: DataFrame) -> DataFrame:
        where, self.written = f"{self.folder}/{self.written}", self.written + 1
        df.write.parquet(where)
        table = self.spark.read.schema(df.schema).parquet(where)
        table._where = where
        return table

    def _drop(self, where: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def remove(self) -> None:
        self._drop(self.folder)

    def _rows(self, w: np.ndarray) -> DataFrame:
        """(k, y, fold, n, frame_id): each frame's row of K and the number of its environments. Sums of a frame are formed on each task first."""
        basis, active, zeta, scaling = self.scaling.forward(self.basis, w)[0], self.frames, self.zeta, self.scaling
        self.passes += 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
                k = np.concatenate([active.mean((scaling.forward(x[own], w)[0] @ basis.T) ** zeta) for own in active.strips(len(x))] or [np.zeros((0, len(active.sizes)))])
                frames, first, at = np.unique(batch.column("frame_id").to_numpy(), return_index=True, return_inverse=True)
                sums = np.zeros((len(frames), k.shape[1]))
                np.add.at(sums, at, k)
                own = batch.select(["frame_id", "y", "fold"]).take(pa.array(first))
                yield pa.record_batch([*own.columns, pa.array(np.bincount(at, minlength=len(frames))), pa.array([s.tobytes() for s in sums], pa.binary())], names=["frame_id", "y", "fold", "n", "k"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py()) for v in table.column("k"))
            return table.slice(0, 1).select(["frame_id", "y", "fold"]).append_column("n", pa.array([sum(table.column("n").to_pylist())])).append_column("k", pa.array([total.tobytes()], pa.binary()))

        schema = "frame_id long, y double, fold long, n long, k binary"
        parts = self.environments.mapInArrow(run, schema)
        if not self.single:  # a frame in many batches is added up in parts first
            salt = F.pmod(F.spark_partition_id(), F.lit(32))
            parts = parts.withColumn("salt", salt).groupBy("frame_id", "salt").applyInArrow(add, schema).groupBy("frame_id").applyInArrow(add, schema)
        return parts

    def _sums(self, rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, float, int]]:
        """By fold: K_MN K_NM, K_MN y, y y and the number of rows."""
        m = len(self.frames.sizes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                k = np.array([np.frombuffer(v.as_py()) for v in batch.column("k")]).reshape(batch.num_rows, m) / batch.column("n").to_numpy()[:, None]
                y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
                own = np.concatenate((k, y[:, None], np.ones((len(y), 1))), axis=1)
                for f in np.unique(fold).tolist():
                    sums[f] = sums.get(f, 0.0) + own[fold == f].T @ own[fold == f]
            for f, s in sums.items():
                yield pa.record_batch([pa.array([f], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["fold", "m"])

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py()) for v in table.column("m"))
            return pa.table({"fold": pa.array([key[0].as_py()], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

        schema, salt = "fold long, m binary", F.pmod(F.spark_partition_id(), F.lit(32))
        parts = rows.select("k", "n", "y", "fold").mapInArrow(run, schema).withColumn("salt", salt).groupBy("fold", "salt").applyInArrow(add, schema).groupBy("fold").applyInArrow(add, schema)
        out = {}
        for r in parts.collect():  # a square of active frames each
            s = np.frombuffer(r["m"]).reshape(m + 2, m + 2)
            out[r["fold"]] = s[:m, :m], s[:m, m], float(s[m, m]), int(s[-1, -1])
        return out

    def _solved(self, sums: dict, own: np.ndarray, scale: float) -> tuple[float, float, dict[int, np.ndarray], dict[int, np.ndarray]]:
        """The loss, its slope by the scale, and alpha and lambda of each fold."""
        total = sum(s for s, *_ in sums.values()), sum(b for _, b, *_ in sums.values())
        rows = max(1, sum(n for *_, n in sums.values()))
        loss, by_scale, alphas, lambdas = 0.0, 0.0, {}, {}
        for f, (s, b, yy, _) in sums.items():
            rest, right = (total[0] - s) / scale**2, (total[1] - b) / scale**2
            system = own + rest + self.jitter * np.eye(len(own))
            alpha = np.linalg.solve(system, right)
            slope = 2 / rows * (s @ alpha - b)
            adjoint = np.linalg.solve(system, slope)
            loss += float(alpha @ s @ alpha - 2 * alpha @ b + yy) / rows
            by_scale += 2 / scale * float(adjoint @ rest @ alpha - adjoint @ right)
            alphas[f], lambdas[f] = alpha, adjoint
        return loss, by_scale, alphas, lambdas

    def value(self, at: np.ndarray) -> float:
        w = self.scaling.weights(at[1:])
        own = self._own(self.scaling.forward(self.basis, w)[0])
        return self._solved(self._sums(self._rows(w)), own, float(at[0]))[0]

    def _own(self, z: np.ndarray) -> np.ndarray:
        """The kernel of the active frames with themselves, a strip at a time."""
        by_frame = np.concatenate([self.frames.mean((z[own] @ z.T) ** self.zeta) for own in self.frames.strips(len(z))] or [np.zeros((0, 0))])
        return self.frames.mean(by_frame.T)

    def value_and_slope(self, at: np.ndarray) -> tuple[float, np.ndarray]:
        """The loss at (scale, factors...) and its slope by each of them, from two passes over the environments."""
        scale, factors = float(at[0]), np.asarray(at[1:], float)
        scaling, zeta, active = self.scaling, self.zeta, self.frames
        w = scaling.weights(factors)
        z, sizes = scaling.forward(self.basis, w)
        rows = self._rows(w)
        if not self.single:
            rows = self._write(rows)
        sums = self._sums(rows)
        loss, by_scale, alphas, lambdas = self._solved(sums, self._own(z), scale)
        if not len(factors):
            return loss, np.array([by_scale])
        folds, n_rows = sorted(alphas), max(1, sum(n for *_, n in sums.values()))
        a, b = np.array([alphas[f] for f in folds]), np.array([lambdas[f] for f in folds])

        def shares(k: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
            """By row: how much of each alpha, then of each lambda, its slope by k holds."""
            errors, other = k @ a.T - y[:, None], k @ b.T
            own = fold[:, None] == np.array(folds)[None, :]
            return np.concatenate((np.where(own, 2 / n_rows * errors, -other / scale**2), np.where(own, 0.0, -errors / scale**2)), axis=1)

        both = active.share(np.concatenate((a, b)))  # by environment of the active frames

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The slope by the weights, and by the vectors of the active environments, of each task's rows."""
            by_weight, by_basis = np.zeros(len(w)), np.zeros(z.shape)
            for batch in batches:
                every = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
                for strip in active.strips(batch.num_rows):
                    x = every[strip]
                    own, own_sizes = scaling.forward(x, w)
                    products = own @ z.T
                    if "share" in batch.schema.names:
                        share = np.array([np.frombuffer(v.as_py()) for v in batch.column("share")[strip]]).reshape(len(x), -1)
                    else:
                        share = shares(active.mean(products**zeta), batch.column("y").to_numpy()[strip], batch.column("fold").to_numpy()[strip])
                    slope = share @ both * zeta * products ** (zeta - 1)
                    by_weight += scaling.backward(x, own, own_sizes, slope @ z)
                    by_basis += slope.T @ own
            yield pa.record_batch([pa.array([0], pa.int64()), pa.array([np.concatenate((by_weight, by_basis.ravel())).tobytes()], pa.binary())], names=["part", "m"])

        def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column("n").to_numpy()
                k = np.array([np.frombuffer(v.as_py()) for v in batch.column("k")]).reshape(batch.num_rows, a.shape[1]) / n[:, None]
                own = shares(k, batch.column("y").to_numpy(), batch.column("fold").to_numpy()) / n[:, None]
                yield pa.record_batch([batch.column("frame_id"), pa.array([v.tobytes() for v in own], pa.binary())], names=["frame_id", "share"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py()) for v in table.column("m"))
            return pa.table({"part": pa.array([0], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

        self.passes += 1
        environments = self.environments if self.single else self.environments.select("frame_id", "features").join(rows.mapInArrow(shared, "frame_id long, share binary"), "frame_id")
        parts = environments.mapInArrow(spread, "part long, m binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
        found = parts.groupBy("salt").applyInArrow(add, "part long, m binary").groupBy("part").applyInArrow(add, "part long, m binary").first()
        flat = np.frombuffer(found["m"]) if found else np.zeros(len(w) + z.size)
        by_weight, by_basis = flat[: len(w)], flat[len(w) :].reshape(z.shape)
        by_own = -sum(np.outer(lambdas[f], alphas[f]) for f in folds)
        pairs = (by_own + by_own.T) / active.sizes[:, None]
        by_basis = by_basis + np.concatenate([active.share(pairs[active.of[own]]) * zeta * (z[own] @ z.T) ** (zeta - 1) @ z for own in active.strips(len(z))])
        by_weight = by_weight + scaling.backward(self.basis, z, sizes, by_basis)
        if not self.single:
            self._drop(rows._where)
        return loss, np.append(by_scale, scaling.slopes(factors, by_weight))
