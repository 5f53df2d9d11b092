"""Estimators with fitted state: steps that learn from a table, a pipeline of them, and its storage.

Rows are (env_id, features, ...), further columns such as frame_id stay with them; targets are
(id, y). A step keeps its parameters as fields and what it has learnt as a JSON record and
tables; a stored pipeline is a folder with one record and the tables of each step, which another
session reads lazily. Classes are restored by name from STEPS.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.functions import vectors
from atomloom.operators import compression, descriptors, low_rank, regression, selection
from atomloom.operators.cholesky import shared_folder
from atomloom.sources.matrix import load_table, save_table

STEPS: dict[str, type] = {}


def step(cls: type) -> type:
    STEPS[cls.__name__] = cls
    return cls


def _held(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder once: what is learnt is not learnt again for each use."""
    where = shared_folder(df.sparkSession, label)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


@dataclass
class Step:
    """Fields are parameters; ``state`` is a record and ``tables`` are what fitting has made."""

    state: dict = field(default_factory=dict, init=False, repr=False)
    tables: dict[str, DataFrame] = field(default_factory=dict, init=False, repr=False)

    @property
    def params(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.init}

    def fit(self, rows: DataFrame, targets: DataFrame | None = None) -> Step:
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows

    def fit_transform(self, rows: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        """What the next step is fitted to."""
        return self.fit(rows, targets).transform(rows)

    def predict(self, rows: DataFrame) -> DataFrame:
        raise TypeError(f"{type(self).__name__} does not predict")


@step
@dataclass
class Spectra(Step):
    """Atoms (frame_id, atom_idx, species, x, y, z) to the spectra of those that are centres; env_id is frame_id * 2**24 + atom_idx."""

    species: list[int] = field(default_factory=list)
    rc: float = 3.5
    nmax: int = 6
    lmax: int = 6
    width: float = 0.4
    centres: list[int] | None = None

    def transform(self, rows: DataFrame) -> DataFrame:
        found = descriptors.describe(rows, self.species, rc=self.rc, nmax=self.nmax, lmax=self.lmax, sigma=self.width, centres=self.centres)
        return found.select((F.shiftleft("frame_id", 24) + F.col("atom_idx")).alias("env_id"), "frame_id", "features")


@step
@dataclass
class Compress(Step):
    """Spectra reduced to leading eigenvectors of the covariance of their mean, scaled by ``factors`` if given."""

    shape: list[int] = field(default_factory=list)
    kind: str = "species"
    keep: int = 1
    factors: list[float] | None = None

    def fit(self, rows: DataFrame, targets: DataFrame | None = None) -> Compress:
        self.state = compression.Compressor.fit(rows, compression.Shape(*self.shape), self.kind, self.keep, factors=self.factors).pack()
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        return compression.Compressor.unpack(self.state).transform(rows)


@step
@dataclass
class Farthest(Step):
    """Selection of ``n`` samples or features far apart.

    ``act_on``: ``sample`` thins out what later steps are fitted to, and leaves rows to be predicted as
    they are; rows of frames (``frames``) are chosen by frame, by their mean, and stay whole. ``feature``
    keeps the chosen components; ``feature map`` also maps them so that norms are those of all
    components. ``dry_run`` ranks everything; ``n`` may be lowered afterwards.
    """

    n: int = 0
    act_on: str = "sample"
    zeta: float = 1.0
    frames: bool = False

    def fit(self, rows: DataFrame, targets: DataFrame | None = None, *, dry_run: bool = False) -> Farthest:
        if self.act_on == "sample":
            points = rows.select("env_id", "features")
            if self.frames:
                means = descriptors.frame_means(rows).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p"))
                points = means.select(F.col("frame_id").alias("env_id"), F.col("p.v").alias("features"))
            self.tables = {"ranked": _held(selection.farthest_points(points, points.count() if dry_run else self.n, zeta=self.zeta), "ranked")}
        elif self.act_on in ("feature", "feature map"):
            width = len(rows.first()["features"])
            self.state = {"ids": selection.farthest_features(rows, width if dry_run else self.n)}
            if self.act_on == "feature map":
                self.state["map"] = compression.back_map(rows, self.state["ids"][: self.n]).tolist()
        else:
            raise ValueError(f"unknown kind of selection: {self.act_on}")
        return self

    def ranked(self) -> DataFrame | list[int]:
        """(rank, id, distance) of samples, or the features in order."""
        return self.tables["ranked"] if self.act_on == "sample" else self.state["ids"]

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.act_on == "sample":
            return rows
        picked = rows.withColumn("features", vectors.pick(F.col("features"), self.state["ids"][: self.n]))
        if self.act_on == "feature":
            return picked
        a = np.array(self.state["map"])

        def run(batches):
            for batch in batches:
                y = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1) @ a
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))
                yield pa.record_batch([flat if c == "features" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

        return picked.mapInArrow(run, picked.schema)

    def fit_transform(self, rows: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        self.fit(rows, targets)
        if self.act_on != "sample":
            return self.transform(rows)
        key = "frame_id" if self.frames else "env_id"
        return rows.join(self.tables["ranked"].filter(F.col("rank") < self.n).select(F.col("id").alias(key)), key, "left_semi")


class _Weighted(Step):
    """A model that is a weight for each of some environments, and the power kernel."""

    def predict(self, rows: DataFrame) -> DataFrame:
        """(id, y_pred), one for each of ``rows``."""
        return regression.krr_predict_rows(rows, self.tables["weights"], self.zeta, delta=self.delta)

    def _keep(self, alpha: DataFrame, points: DataFrame) -> None:
        self.tables = {"weights": _held(points.select("env_id", "features").join(alpha.withColumnRenamed("id", "env_id"), "env_id"), "weights")}


@step
@dataclass
class KernelRidge(_Weighted):
    """The exact model of all rows that have a target."""

    zeta: float = 1.0
    jitter: float = 1e-8
    delta: float = 1.0

    def fit(self, rows: DataFrame, targets: DataFrame | None = None) -> KernelRidge:
        own = targets.join(rows.select(F.col("env_id").alias("id")), "id", "left_semi")
        self._keep(regression.krr_fit_rows(rows, own, self.zeta, jitter=self.jitter, delta=self.delta), rows)
        return self


@step
@dataclass
class LowRank(_Weighted):
    """The low-rank model of all rows that have a target, over ``active`` of them picked far apart."""

    active: int = 100
    scale: float = 1.0
    zeta: float = 1.0
    jitter: float = 1e-8
    delta: float = 1.0

    def fit(self, rows: DataFrame, targets: DataFrame | None = None) -> LowRank:
        points = rows.select("env_id", "features")
        picked = selection.farthest_points(points, self.active, zeta=self.zeta).select(F.col("id").alias("env_id"))
        active = _held(points.join(picked, "env_id", "left_semi"), "active")
        own = points.join(targets.select(F.col("id").alias("env_id"), "y"), "env_id")
        self._keep(low_rank.fit(own, active, self.zeta, scale=self.scale, jitter=self.jitter, delta=self.delta), active)
        return self


class Model:
    """Steps by name, the last of which predicts."""

    def __init__(self, steps: list[tuple[str, Step]]):
        self.steps = steps

    def fit(self, rows: DataFrame, targets: DataFrame) -> Model:
        for _, one in self.steps[:-1]:
            rows = one.fit_transform(rows, targets)
        self.steps[-1][1].fit(rows, targets)
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        for _, one in self.steps[:-1]:
            rows = one.transform(rows)
        return rows

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.steps[-1][1].predict(self.transform(rows))

    @property
    def params(self) -> list[tuple[str, dict]]:
        return [(name, one.params) for name, one in self.steps]

    def save(self, spark: SparkSession, where: str) -> None:
        """Tables first, then the record, so that a model with a record is whole."""
        record = []
        for n, (name, one) in enumerate(self.steps):
            for label, table in one.tables.items():
                save_table(table, f"{where}/{n}-{label}", {"step": name, "table": label})
            record.append({"name": name, "class": type(one).__name__, "params": one.params, "state": one.state, "tables": sorted(one.tables)})
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{where}/steps")

    @classmethod
    def load(cls, spark: SparkSession, where: str) -> Model:
        steps = []
        for n, r in enumerate(json.loads(spark.read.text(f"{where}/steps").first()["value"])):
            one = STEPS[r["class"]](**r["params"])
            one.state = r["state"]
            one.tables = {label: load_table(spark, f"{where}/{n}-{label}")[0] for label in r["tables"]}
            steps.append((r["name"], one))
        return cls(steps)
