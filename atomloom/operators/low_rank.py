"""Low-rank ("subset of regressors") models with active sets of any size: sums over all rows in binary tiles, solved in Spark.

The active environments are placed in tiles of about BLOCK_ROWS. With one tile, each task adds up
its rows where it reads them, and sends on a tile a fold. With more, rows are packed into blocks
that meet each pair of tiles, and a task multiplies two dense matrices. Tiles are added up in
Arrow, a bounded number at a time; systems of one tile are solved in a task each, larger ones by
block Cholesky. No entry of a matrix is a row of a table, and none passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.operators import cholesky
from atomloom.operators.cholesky import Factor, shared_folder

#: Bytes of features in a block of rows.
PACK_BYTES = 4 * 2**20
#: Tiles that are added up at a time.
FAN_IN = 16

_PACK = "fold long, x binary, y binary"
_TILE = "fold long, bi long, bj long, m binary"


def _power(x: np.ndarray, y: np.ndarray, zeta: float, delta: float) -> np.ndarray:
    return delta**2 * (x @ y.T) ** zeta


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fold, x, y): rows (fold, features, y) in blocks of one fold, of about PACK_BYTES each."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[int, int] = {}
    for batch in batches:
        x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
        y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
        for f in np.unique(fold).tolist():
            own = fold == f
            step = max(1, PACK_BYTES // (8 * max(1, x.shape[1])))
            xs, ys = x[own], y[own]
            for at in range(0, len(xs), step):
                held.setdefault(f, []).append((xs[at : at + step], ys[at : at + step]))
                sizes[f] = sizes.get(f, 0) + xs[at : at + step].nbytes
                if sizes[f] >= PACK_BYTES:
                    yield (f, *(np.concatenate(c) for c in zip(*held.pop(f))))
                    sizes[f] = 0
    for f, parts in held.items():
        yield (f, *(np.concatenate(c) for c in zip(*parts)))


def _tile(fold: int, bi: int, bj: int, m: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([*(pa.array([v], pa.int64()) for v in (fold, bi, bj)), pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())], names=["fold", "bi", "bj", "m"])


class Sums:
    """K_MN K_NM, K_MN y and the like of ``rows`` (env_id, features, y[, fold]) over ``active`` (env_id, features), by fold.

    K is delta**2 times the power kernel. ``tiles`` (fold, bi, bj, m) holds the lower triangle of
    K_MN K_NM, and K_MN y as the block below it (bi = n). Without ``fold`` all rows are fold 0.
    All tables lie in one folder of the shared one; ``remove`` takes it away.
    """

    def __init__(self, rows: DataFrame, active: DataFrame, zeta: float, *, delta: float = 1.0, tile_rows: int | None = None):
        self.spark, self.zeta, self.delta = rows.sparkSession, zeta, delta
        self.folder = shared_folder(self.spark, "low-rank")
        points = active.select(F.col("env_id").alias("id"), "features")
        placed, self.n = cholesky._places(points.select("id"), tile_rows or cholesky.BLOCK_ROWS)
        self.places = self._write(placed, "places")
        self.features = self._write(cholesky._packed(points, self.places), "features")
        fold = F.col("fold").cast("long") if "fold" in rows.columns else F.lit(0).cast("long")
        rows = rows.select(fold.alias("fold"), "features", F.col("y").cast("double").alias("y"))
        parts = self._one_tile(rows) if self.n == 1 else self._many_tiles(rows)
        self.tiles = self._add_up(self._write(parts, "parts"))

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def remove(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _one_tile(self, rows: DataFrame) -> DataFrame:
        """Summed where the rows are read: the only tile, at most a block, goes to every task."""
        held = self.features.first()
        basis, zeta, delta = np.frombuffer(held["x"]) if held else np.zeros(0), self.zeta, self.delta
        m = self.places.count()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for fold, x, y in _packs(batches):
                k = _power(x, basis.reshape(m, x.shape[1]), zeta, delta)
                sums[fold] = sums.get(fold, 0.0) + np.concatenate((k.T @ k, (k.T @ y)[None, :]))
            for fold, s in sums.items():
                yield _tile(fold, 0, 0, s[:m])
                yield _tile(fold, 1, 0, s[m:])

        return rows.mapInArrow(run, _TILE)

    def _many_tiles(self, rows: DataFrame) -> DataFrame:
        """Blocks of rows meet pairs of tiles by equi-joins; each cell gives one product."""
        zeta, delta, n = self.zeta, self.delta, self.n

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for fold, x, y in _packs(batches):
                yield pa.record_batch([pa.array([fold], pa.int64()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["fold", "x", "y"])

        packed = self._write(rows.mapInArrow(pack, _PACK), "rows")
        one = lambda v: F.lit(v).cast("long")
        cells = packed.withColumn("bi", F.explode(F.sequence(one(0), one(n - 1)))).withColumn("bj", F.explode(F.sequence(one(0), F.col("bi"))))
        cells = cells.join(self.features.select(F.col("block").alias("bi"), F.col("x").alias("xi")), "bi").join(self.features.select(F.col("block").alias("bj"), F.col("x").alias("xj")), "bj")
        cells = cells.repartition(max(1, -(-packed.count() * n * (n + 1) // (2 * cholesky.TASK_BLOCKS))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    fold, bi, bj, x, y, xi, xj = (batch.column(c)[at].as_py() for c in ("fold", "bi", "bj", "x", "y", "xi", "xj"))
                    y = np.frombuffer(y)
                    x = np.frombuffer(x).reshape(len(y), -1)
                    ki = _power(x, np.frombuffer(xi).reshape(-1, x.shape[1]), zeta, delta)
                    kj = ki if bi == bj else _power(x, np.frombuffer(xj).reshape(-1, x.shape[1]), zeta, delta)
                    yield _tile(fold, bi, bj, ki.T @ kj)
                    if bi == bj:
                        yield _tile(fold, n, bi, (ki.T @ y)[None, :])

        return cells.mapInArrow(run, _TILE)

    def _add_up(self, parts: DataFrame) -> DataFrame:
        """One tile a key (fold, bi, bj); groups of about FAN_IN tiles at a time, so that none is large."""

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(m) for m in (c.as_py() for c in table.column("m")))
            return table.slice(0, 1).select(["fold", "bi", "bj"]).append_column("m", pa.array([total.tobytes()], pa.binary()))

        most, level = parts.groupBy("fold", "bi", "bj").count().agg(F.max("count")).first()[0] or 1, 0
        while True:
            groups = -(-most // FAN_IN)
            salt = F.lit(0) if groups == 1 else F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int")
            parts = self._write(parts.withColumn("salt", salt).groupBy("fold", "bi", "bj", "salt").applyInArrow(add, _TILE), f"sums-{level}")
            if groups == 1:
                return parts
            most, level = groups, level + 1

    def folds(self) -> list[int]:
        return [r["fold"] for r in self.tiles.select("fold").distinct().orderBy("fold").collect()]

    def systems(self, scale: float, jitter: float, *, leave_out: bool = False) -> DataFrame:
        """(fold, bi, bj, m) of K_MM + K_MN K_NM / scale**2 + jitter I, and K_MN y / scale**2 below it; with ``leave_out``, one for each fold, summed over all the others."""
        zeta, delta, n = self.zeta, self.delta, self.n
        keys = ["bi", "bj"]
        if leave_out:
            summed = self._total().select(*keys, F.col("m").alias("total")).join(self.tiles, keys)
        else:
            summed = self._total().select(F.lit(0).cast("long").alias("fold"), *keys, F.col("m").alias("total")).withColumn("m", F.lit(None).cast("binary"))
        sizes = self.places.groupBy(F.col("block").alias("bj")).agg(F.first("n").alias("columns"))
        held = summed.join(self.features.select(F.col("block").alias("bi"), F.col("x").alias("xi")), "bi", "left").join(self.features.select(F.col("block").alias("bj"), F.col("x").alias("xj")), "bj").join(sizes, "bj")
        held = held.repartition(max(1, -(-self.tiles.count() // cholesky.TASK_BLOCKS)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    fold, bi, bj, total, own, xi, xj, columns = (batch.column(c)[at].as_py() for c in ("fold", "bi", "bj", "total", "m", "xi", "xj", "columns"))
                    m = np.frombuffer(total) / scale**2
                    if own is not None:
                        m = m - np.frombuffer(own) / scale**2
                    m = m.reshape(-1, columns)
                    if bi < n:
                        y = np.frombuffer(xj).reshape(columns, -1)
                        m = m + _power(np.frombuffer(xi).reshape(-1, y.shape[1]), y, zeta, delta)
                        if bi == bj:
                            m = m + jitter * np.eye(columns)
                    yield _tile(fold, bi, bj, m)

        return held.mapInArrow(run, _TILE)

    def _total(self) -> DataFrame:
        """(bi, bj, m): the tiles summed over the folds, a few at a time."""

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(m) for m in (c.as_py() for c in table.column("m")))
            return table.slice(0, 1).select(["bi", "bj"]).append_column("m", pa.array([total.tobytes()], pa.binary()))

        parts, folds = self.tiles.select("fold", "bi", "bj", "m"), max(1, self.tiles.select("fold").distinct().count())
        while folds > 1:
            groups = -(-folds // FAN_IN)
            parts = parts.withColumn("fold", F.pmod("fold", F.lit(groups))) if groups > 1 else parts.withColumn("fold", F.lit(0).cast("long"))
            summed = parts.groupBy("fold", "bi", "bj").applyInArrow(lambda key, table: add(table).append_column("fold", pa.array([key[0].as_py()], pa.int64())).select(["fold", "bi", "bj", "m"]), _TILE)
            parts, folds = summed, groups
        return parts.select("bi", "bj", "m")

    def solve(self, scale: float, jitter: float, *, leave_out: bool = False) -> DataFrame:
        """(fold, id, alpha) of the systems."""
        systems = self.systems(scale, jitter, leave_out=leave_out)
        if self.n == 1:
            return self._solved_in_tasks(systems)
        found, systems = None, self._write(systems, f"systems-{scale!r}-{jitter!r}-{leave_out}")
        for fold in self.folds() if leave_out else [0]:
            own = Factor.of_blocks(systems.filter(F.col("fold") == fold).select("bi", "bj", "m"), self.places, self.n).solve()
            own = own.select(F.lit(fold).cast("long").alias("fold"), "id", "alpha")
            found = own if found is None else found.unionByName(own)
        return found

    def _solved_in_tasks(self, systems: DataFrame) -> DataFrame:
        def run(key: tuple, table: pa.Table) -> pa.Table:
            by = dict(zip(table.column("bi").to_pylist(), table.column("m").to_pylist()))
            right = np.frombuffer(by[1])
            alpha = np.linalg.solve(np.frombuffer(by[0]).reshape(len(right), -1), right)
            return pa.table({"fold": pa.array([key[0].as_py()] * len(alpha), pa.int64()), "at": pa.array(np.arange(len(alpha))), "alpha": alpha})

        solved = systems.groupBy("fold").applyInArrow(run, "fold long, at long, alpha double")
        return solved.join(self.places.select("id", "at"), "at").select("fold", "id", "alpha")

    def entries(self, scale: float, jitter: float = 0.0) -> tuple[DataFrame, DataFrame]:
        """The system as long tables: (i, j, k) and (i, b)."""
        m, ids = self.systems(scale, jitter), self._ids()
        named = m.join(ids.select(F.col("block").alias("bj"), F.col("ids").alias("js")), "bj").join(ids.select(F.col("block").alias("bi"), F.col("ids").alias("is")), "bi", "left")
        named = named.repartition(max(1, -(-self.tiles.count() // cholesky.TASK_BLOCKS)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    bi, bj, own, i, j = (batch.column(c)[at].as_py() for c in ("bi", "bj", "m", "is", "js"))
                    j = np.frombuffer(j, np.int64)
                    v = np.frombuffer(own).reshape(-1, len(j))
                    if i is None:
                        yield pa.record_batch([pa.array(j), pa.nulls(len(j), pa.int64()), pa.array(v[0])], names=["i", "j", "k"])
                        continue
                    i = np.frombuffer(i, np.int64)
                    yield pa.record_batch([pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(v.ravel())], names=["i", "j", "k"])
                    if bi != bj:
                        yield pa.record_batch([pa.array(np.tile(j, len(i))), pa.array(np.repeat(i, len(j))), pa.array(v.ravel())], names=["i", "j", "k"])

        long = named.mapInArrow(run, "i long, j long, k double")
        return long.filter("j IS NOT NULL"), long.filter("j IS NULL").select("i", F.col("k").alias("b"))

    def _ids(self) -> DataFrame:
        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            return pa.table({"block": table.column("block").slice(0, 1), "ids": pa.array([table.column("id").to_numpy().astype(np.int64).tobytes()], pa.binary())})

        return self.places.select("block", "at", "id").groupBy("block").applyInArrow(pack, "block long, ids binary")

    def likelihood(self, scale: float, jitter: float, yy: float, rows: int) -> float:
        """The Gaussian log-likelihood of ``rows`` targets with sum of squares ``yy``; by the determinant and inversion lemmas the N x N covariance never appears."""
        below, own = (Factor.of_blocks(self.systems(v, jitter).select("bi", "bj", "m"), self.places, self.n) for v in (scale, np.inf))
        log_det = below.log_determinant() - own.log_determinant() + 2 * rows * np.log(scale)
        found = float(-0.5 * (yy / scale**2 - below.square() + log_det + rows * np.log(2 * np.pi)))
        below.remove()
        own.remove()
        return found


def fit(rows: DataFrame, active: DataFrame, zeta: float, *, scale: float, jitter: float = 1e-8, delta: float = 1.0, tile_rows: int | None = None) -> DataFrame:
    """(id, alpha) of the low-rank model of ``rows`` (env_id, features, y) over ``active`` (env_id, features), of any size."""
    return Sums(rows, active, zeta, delta=delta, tile_rows=tile_rows).solve(scale, jitter).select("id", "alpha")


def predict(rows: DataFrame, active: DataFrame, alphas: DataFrame, zeta: float, *, by: list[str], delta: float = 1.0) -> DataFrame:
    """(``by``, y, y_pred) for each row of ``rows`` (fold, features, y) and each model of ``alphas`` (fold, ``by``, id, alpha) of its fold.

    ``by`` are numbers that tell the models of a fold. Rows are packed into blocks, which meet the
    active environments of each tile with the weights of all models; predictions are summed over
    tiles inside a block, so no pair of row and active environment leaves a task.
    """
    points = active.select(F.col("env_id").alias("id"), "features")
    placed, n = cholesky._places(points.select("id"), cholesky.BLOCK_ROWS)
    keys = ["fold", *by]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, x, y in _packs(batches):
            yield pa.record_batch([pa.array([fold], pa.int64()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["fold", "x", "y"])

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        """The features of a tile, and the weights of each model as a row; a missing weight is 0."""
        ids, first, at = np.unique(table.column("id").to_numpy(), return_index=True, return_inverse=True)
        model = np.stack([table.column(k).to_numpy().astype(float) for k in by], axis=1)
        models, which = np.unique(model, axis=0, return_inverse=True)
        weights = np.zeros((len(models), len(ids)))
        weights[which.ravel(), at] = table.column("alpha").to_numpy()
        x = np.array(table.column("features").combine_chunks().take(pa.array(first)).flatten(), float)
        return pa.table({"fold": [key[0].as_py()], "xi": pa.array([x.tobytes()], pa.binary()), "models": pa.array([models.tobytes()], pa.binary()), "w": pa.array([weights.tobytes()], pa.binary())})

    tiles = alphas.select(*keys, "id", "alpha").join(points.join(placed.select("id", "block"), "id"), "id").groupBy("fold", "block").applyInArrow(gather, "fold long, xi binary, models binary, w binary")
    packed = rows.select(F.col("fold").cast("long").alias("fold"), "features", F.col("y").cast("double").alias("y")).mapInArrow(pack, _PACK).withColumn("pack", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                pack, x, y, xi, models, w = (batch.column(c)[at].as_py() for c in ("pack", "x", "y", "xi", "models", "w"))
                models = np.frombuffer(models).reshape(-1, len(by))
                x = np.frombuffer(x).reshape(len(y) // 8, -1)
                found = np.frombuffer(w).reshape(len(models), -1) @ _power(np.frombuffer(xi).reshape(-1, x.shape[1]), x, zeta, delta)
                for model, p in zip(models, found):
                    yield pa.record_batch([pa.array([pack], pa.int64()), *(pa.array([v]) for v in model), pa.array([y], pa.binary()), pa.array([p.tobytes()], pa.binary())], names=["pack", *by, "y", "p"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py()) for p in table.column("p"))
        return table.slice(0, 1).drop_columns("p").append_column("p", pa.array([total.tobytes()], pa.binary()))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                y, p = (np.frombuffer(batch.column(c)[at].as_py()) for c in ("y", "p"))
                yield pa.record_batch([*(pa.array(np.full(len(y), batch.column(k)[at].as_py())) for k in by), pa.array(y), pa.array(p)], names=[*by, "y", "y_pred"])

    numbers = ", ".join(f"{k} double" for k in by)
    if n > 1:  # partial sums of one block must be of the same rows, so blocks are written
        where = shared_folder(rows.sparkSession, "packed")
        packed.write.parquet(where)
        packed = rows.sparkSession.read.schema(packed.schema).parquet(where)
    parts = packed.join(tiles, "fold").mapInArrow(run, f"pack long, {numbers}, y binary, p binary")
    if n > 1:
        parts = parts.groupBy("pack", *by).applyInArrow(add, f"pack long, {numbers}, y binary, p binary")
    return parts.mapInArrow(flat, f"{numbers}, y double, y_pred double")
