"""Pairwise kernels over environments.

Pairs are the work here, so vectors travel in blocks: each block of one side meets each block of
the other once, and a task multiplies dense matrices strip by strip. What is read back is long tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.operators import feature_map, low_rank
from atomloom.operators.cholesky import shared_folder

#: Blocks of a side while blocks hold LEAST_ROWS to MOST_ROWS rows: as every row goes to as many cells, what is shuffled grows with the rows up to BLOCKS * MOST_ROWS of them.
BLOCKS, LEAST_ROWS, MOST_ROWS = 16, 512, 65536
#: Pairs that a cell holds at once.
STRIP_PAIRS = 1 << 18
#: Columns that a row of pairs goes through before the next row does: as one id then stays and the other comes around soon, tables that are written of pairs hold little of ids.
TILE = 96
#: Members of a group that are joined at once: one of PACKS parts of all, or fewer.
PACK_ROWS, PACKS = 4096, 64
#: Packs are dealt out to so many stripes a side at least, and to one for each STRIPE_ROWS members: a task has the pairs of two stripes, so that its ids are few enough to be written as a dictionary.
STRIPES, STRIPE_ROWS = 10, 32768


def _blocks(rows: DataFrame, block_rows: int | None, salt: int) -> tuple[DataFrame, int]:
    n = rows.count()
    block_rows = block_rows or min(MOST_ROWS, max(LEAST_ROWS, -(-n // BLOCKS)))
    count = max(1, -(-n // block_rows))
    return rows.withColumn("block", F.pmod(F.xxhash64("env_id", F.lit(salt)), F.lit(count)).cast("int")), count


def _meet(a: DataFrame, b: DataFrame, n_a: int, n_b: int, cell: Callable[[pa.Table, pa.Table, int | None], Iterator[pa.Table]], schema: str, *, triangle: bool = False) -> DataFrame:
    """What ``cell`` yields for a strip of rows of a block of ``a`` and a whole block of ``b``, for each pair of blocks.

    With ``triangle``, both are one table, and one pair of each two blocks meets. A strip has at most STRIP_PAIRS
    pairs, or one row. ``cell`` is also told where in the block of ``b`` the strip begins, if both are one block.
    """
    a = a.withColumnRenamed("block", "bi").withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("bi") if triangle else F.lit(n_b - 1))))
    b = b.withColumnRenamed("block", "bj").withColumn("bi", F.explode(F.sequence(F.col("bj") if triangle else F.lit(0), F.lit(n_a - 1))))
    both = (a.filter("bi > bj") if triangle else a).withColumn("first", F.lit(True)).unionByName(b.withColumn("first", F.lit(False)), allowMissingColumns=True)
    cells = n_a * (n_a + 1) // 2 if triangle else n_a * n_b

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        x, y = rows.filter(rows.column("first")), rows.filter(pc.invert(rows.column("first")))
        same = triangle and key[0].as_py() == key[1].as_py()
        x, step = y if same else x, max(1, STRIP_PAIRS // max(1, len(y)))
        for at in range(0, len(x), step) if len(y) else ():
            for found in cell(x.slice(at, step), y, at if same else None):
                yield from found.combine_chunks().to_batches()

    # as many tasks as cells, since Spark would make few of them for the little that is moved
    return both.repartition(cells, "bi", "bj").groupBy("bi", "bj").applyInArrow(run, schema)


def _stack(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def entries(i: np.ndarray, j: np.ndarray, k: np.ndarray, mirrored: bool, among: np.ndarray | None = None) -> Iterator[pa.Table]:
    """(i, j, k) of all ``i`` and ``j``, from ``k`` (i, j), or of those that are ``among`` (i, j), TILE columns at a time.

    With ``mirrored``, each run of a row is followed by (j, i, k) of the same pairs. So the numbers of a run stand twice close to each other, and what is written of the second is a reference to the first.
    """
    for width in (len(j) - len(j) % TILE, len(j) % TILE):
        if width:
            tile, shape = min(width, TILE), (-(-width // TILE), len(i), 2 if mirrored else 1, min(width, TILE))
            down, across, values = np.empty(shape, i.dtype), np.empty(shape, j.dtype), np.empty(shape)
            values[:] = k[:, :width].reshape(len(i), -1, tile).swapaxes(0, 1)[:, :, None]
            for ours, others, at in ((down, across, 0), (across, down, 1))[: shape[2]]:
                ours[:, :, at], others[:, :, at] = i[None, :, None], j[:width].reshape(-1, 1, tile)
            if among is None:
                yield pa.table({"i": down.ravel(), "j": across.ravel(), "k": values.ravel()})
            else:
                kept = np.broadcast_to(among[:, :width].reshape(len(i), -1, tile).swapaxes(0, 1)[:, :, None], shape)
                yield pa.table({"i": down[kept], "j": across[kept], "k": values[kept]})
                among = among[:, width:]
        j, k = j[width:], k[:, width:]


def power_kernel(left: DataFrame, right: DataFrame, zeta: float, *, block_rows: int | None = None, places: int | None = None) -> DataFrame:
    """(i, j, k) with k = (x_i . y_j) ** zeta for all environments of ``left`` and ``right`` (env_id, features); of one table with itself, from one triangle.

    With ``places``, k is rounded where it is made, which costs far less than rounding rows.
    """
    return power_kernel_symmetric(left, zeta, block_rows=block_rows, places=places) if left is right else _cells(left, right, zeta, block_rows, None, places)


def _power(x: pa.Table, y: pa.Table, zeta: float, places: int | None) -> np.ndarray:
    k = (_stack(x.column("features")) @ _stack(y.column("features")).T) ** zeta
    return k if places is None else np.round(k, places) + 0.0  # -0.0 as 0.0


def group_kernel(left: DataFrame, right: DataFrame, zeta: float, *, block_rows: int | None = None) -> DataFrame:
    """(frame_i, frame_j, k): the mean power kernel of the environments (env_id, frame_id, features) of two frames.

    Where the products of features that make up the kernel are few (``feature_map``), a frame's mean of them is
    all that is needed of it. Elsewhere each cell sums by frame before anything is shuffled, so what moves grows
    with frames, not pairs.
    """
    means = [_frame_means(rows, zeta) for rows in ([left] if right is left else [left, right])]
    if None not in means:
        return power_kernel(means[0], means[-1], 1.0).select(F.col("i").alias("frame_i"), F.col("j").alias("frame_j"), "k")
    sums = _cells(left, right, zeta, block_rows, "frame_id")
    return sums.groupBy("frame_i", "frame_j").agg((F.sum("s") / F.sum("n")).alias("k"))


def _frame_means(rows: DataFrame, zeta: float) -> DataFrame | None:
    """(env_id, features): each frame's mean of products of ``zeta`` features, written out; None where these would be more numbers than the features are."""
    n = feature_map.length(rows, zeta)
    if n is None:
        return None
    width, count, frames = rows.agg(F.max(F.size("features")), F.count("*"), F.count_distinct("frame_id")).first()
    if frames * n > count * width:
        return None

    def mean(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m) for m in (c.as_py() for c in table.column("m"))) / sum(table.column("n").to_pylist())
        return pa.table({"env_id": table.column("frame_id").slice(0, 1), "features": pa.array([total], pa.list_(pa.float64()))})

    means, where = feature_map.group_sums(rows, zeta).groupBy("frame_id").applyInArrow(mean, "env_id long, features array<double>"), shared_folder(rows.sparkSession, "frame-means")
    means.write.parquet(where)
    return rows.sparkSession.read.schema(means.schema).parquet(where)


def _cells(left: DataFrame, right: DataFrame, zeta: float, block_rows: int | None, group: str | None, places: int | None = None) -> DataFrame:
    names = ["env_id", "features"] + ([group] if group else [])
    (a, n_a), (b, n_b) = _blocks(left.select(*names), block_rows, 0), _blocks(right.select(*names), block_rows, 1)

    def pairs(x: pa.Table, y: pa.Table, at: int | None) -> Iterator[pa.Table]:
        k = _power(x, y, zeta, places)
        if group is None:
            yield from entries(x.column("env_id").to_numpy(), y.column("env_id").to_numpy(), k, False)
            return
        (fi, at_i), (fj, at_j) = (np.unique(t.column(group).to_numpy(), return_inverse=True) for t in (x, y))
        sums = np.zeros((len(fi), len(fj)))
        np.add.at(sums, (at_i[:, None], at_j[None, :]), k)
        counts = np.bincount(at_i, minlength=len(fi))[:, None] * np.bincount(at_j, minlength=len(fj))[None, :]
        yield pa.table({"frame_i": np.repeat(fi, len(fj)), "frame_j": np.tile(fj, len(fi)), "s": sums.ravel(), "n": counts.ravel()})

    return _meet(a, b, n_a, n_b, pairs, "i long, j long, k double" if group is None else "frame_i long, frame_j long, s double, n long")


def weighted_kernel(left: DataFrame, right: DataFrame, zeta: float, *, block_rows: int | None = None) -> DataFrame:
    """(i, s): the sum of (x_i . y_j) ** zeta * alpha_j over ``right`` (env_id, features, alpha), for each of ``left`` (env_id, features).

    Where the products of features that make up the kernel are fewer than the rows (``feature_map``), their weighted
    sum takes the place of ``right``. Elsewhere each cell sums over its j before anything is shuffled, so no pair
    leaves a task.
    """
    n = feature_map.length(right, zeta)
    if n is not None and n <= right.count():
        return feature_map.applied(left, feature_map.weighted_sum(right, zeta), zeta)
    (a, n_a), (b, n_b) = _blocks(left.select("env_id", "features"), block_rows, 0), _blocks(right.select("env_id", "features", "alpha"), block_rows, 1)

    def sums(x: pa.Table, y: pa.Table, at: int | None) -> Iterator[pa.Table]:
        s = (_stack(x.column("features")) @ _stack(y.column("features")).T) ** zeta @ y.column("alpha").to_numpy()
        yield pa.table({"i": x.column("env_id"), "s": s})

    return _meet(a, b, n_a, n_b, sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))


def power_kernel_symmetric(rows: DataFrame, zeta: float, *, block_rows: int | None = None, places: int | None = None) -> DataFrame:
    """power_kernel of ``rows`` with themselves from one triangle: i >= j is computed, the rest mirrored.

    Blocks are ranges of a hash, so block pairs with bi >= bj hold each pair of blocks once.
    """
    blocked, n = _blocks(rows.select("env_id", "features"), block_rows, 0)

    def pairs(x: pa.Table, y: pa.Table, at: int | None) -> Iterator[pa.Table]:
        own = y if at is None else y.slice(0, at + len(x))
        i, j = x.column("env_id").to_numpy(), own.column("env_id").to_numpy()
        k = _power(x, own, zeta, places)
        before = len(j) if at is None else at
        yield from entries(i, j[:before], k[:, :before], True)
        yield from entries(i, j[before:], k[:, before:], False)

    return _meet(blocked, blocked, n, n, pairs, "i long, j long, k double", triangle=True)


def sub_kernel(kernel: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The entries of ``kernel`` (i, j, k) whose i is in ``rows`` (id) and whose j is in ``columns`` (id)."""
    return kernel.join(rows.select(F.col("id").alias("i")), "i", "left_semi").join(columns.select(F.col("id").alias("j")), "j", "left_semi")


def entry_gradient(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(frame_i, frame_j, g): what each entry of two groups has of the gradient of their mean, g / (n_i n_j).

    ``groups`` (frame_i, frame_j, g), ``members`` (env_id, frame_id).
    """
    sizes = members.groupBy("frame_id").agg(F.count("*").alias("n"))
    scaled = groups.join(sizes.select(F.col("frame_id").alias("frame_i"), F.col("n").alias("n_i")), "frame_i")
    scaled = scaled.join(sizes.select(F.col("frame_id").alias("frame_j"), F.col("n").alias("n_j")), "frame_j")
    return scaled.select("frame_i", "frame_j", (F.col("g") / (F.col("n_i") * F.col("n_j"))).alias("g"))


def spread_entries(entries: DataFrame, members: DataFrame) -> DataFrame:
    """(i, j, g) for each pair of members of two groups, from ``entries`` (frame_i, frame_j, g) and ``members`` (env_id, frame_id).

    Members are joined in packs of up to about PACK_ROWS. Pairs of packs are dealt out before they become
    rows, so neither a large group nor few groups keep tasks idle, and become rows strip by strip.
    """
    sizes = members.groupBy("frame_id").agg(F.count("*").alias("n"))
    n = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pack_rows = max(1, min(PACK_ROWS, -(-n // PACKS)))
    stripes = max(STRIPES, math.isqrt(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n // STRIPE_ROWS))
    packed = members.join(sizes, "frame_id").withColumn("pack", F.pmod(F.xxhash64("env_id"), F.ceil(F.col("n") / pack_rows)))
    packed = packed.groupBy("frame_id", "pack").agg(F.flatten(F.collect_list(F.array("env_id"))).alias("ids")).withColumn("stripe", F.pmod(F.xxhash64("frame_id", "pack"), F.lit(stripes)))
    i, j = (packed.select(F.col("frame_id").alias(f"frame_{k}"), F.col("stripe").alias(f"stripe_{k}"), F.col("ids").alias(f"ids_{k}")) for k in "ij")
    # the number of tasks is given, as Spark would make few of them for the little that is moved
    pairs = entries.join(i, "frame_i").join(j, "frame_j").repartition(stripes * stripes, "stripe_i", "stripe_j")

    def rows(batches):
        for batch in batches:
            for ids_i, ids_j, g in zip(*batch.columns):
                i, j, step = ids_i.values, ids_j.values, max(1, STRIP_PAIRS // len(ids_j.values))
                for at in range(0, len(i), step):  # exploded arrays would all lie in memory first
                    own = i.slice(at, step)
                    down, across = (pa.array(places) for places in _tiles(len(own), len(j)))
                    yield pa.record_batch([own.take(down), j.take(across), pa.array(np.full(len(down), g.as_py(), float), mask=np.full(len(down), not g.is_valid))], names=["i", "j", "g"])

    ids = members.schema["env_id"].dataType.simpleString()
    return pairs.select("ids_i", "ids_j", "g").mapInArrow(rows, f"i {ids}, j {ids}, g double")


def _tiles(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (row, column) of all pairs of ``n`` rows and ``m`` columns, TILE columns at a time."""
    widths = [(at, min(TILE, m - at)) for at in range(0, m, TILE)]
    return np.concatenate([np.repeat(np.arange(n), w) for _, w in widths]), np.concatenate([np.tile(np.arange(at, at + w), n) for at, w in widths])


def spread_gradient(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The gradient of a group mean by its entries: g / (n_i n_j) for each pair of members.

    ``groups`` (frame_i, frame_j, g), ``members`` (env_id, frame_id). Returns (i, j, g).
    """
    return spread_entries(entry_gradient(groups, members), members)


def sor_system(rows: DataFrame, active: DataFrame, targets: DataFrame, zeta: float, scale: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The low-rank ("subset of regressors") normal equations as long tables: (gram, rhs, cross).

    ``rows`` (env_id, features) are all environments, ``active`` those few that represent them,
    ``targets`` (env_id, y). gram (i, j, k) = K_MM + K_MN K_NM / scale**2, rhs (i, b) = K_MN y /
    scale**2, cross (i, j, k) = K_NM. They are added up in tiles (``low_rank.Sums``) and written
    out entry by entry only here; to fit a model, ``low_rank.fit`` needs no entries.
    """
    sums = low_rank.Sums(rows.select("env_id", "features").join(targets.select("env_id", "y"), "env_id"), active, zeta)
    gram, rhs = sums.entries(scale)
    return gram, rhs, power_kernel(rows, active, zeta)
