"""Similarity of chemical elements, and regression that learns a reduced basis of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 0.5


def element_similarity(elements: DataFrame, *, width: float = WIDTH) -> DataFrame:
    """(z1, z2, kappa) over pairs of ``elements`` (z, electronegativity, radius): the product of a Gaussian in either property.

    Elements without properties are left out. The table has about a hundred rows at most, so all its pairs are few.
    """
    elements = elements.filter("electronegativity IS NOT NULL AND radius IS NOT NULL")
    a, b = (elements.select(*(F.col(c).alias(f"{c}{k}") for c in ("z", "electronegativity", "radius"))) for k in (1, 2))

    def bell(name: str):
        d = F.col(f"{name}1") - F.col(f"{name}2")
        return F.exp(-(d * d) / (2 * width * width))

    return a.join(F.broadcast(b)).select("z1", "z2", (bell("electronegativity") * bell("radius")).alias("kappa"))


def leading_vectors(similarity: DataFrame, keep: int) -> tuple[list[int], np.ndarray]:
    """The elements, ascending, and the ``keep`` leading eigenvectors of their similarity as columns, each times the root of its eigenvalue."""
    rows = similarity.collect()  # elements squared
    z = sorted({r["z1"] for r in rows})
    k = np.zeros((len(z), len(z)))
    for r in rows:
        k[z.index(r["z1"]), z.index(r["z2"])] = r["kappa"]
    values, vectors = np.linalg.eigh(k)
    return z, vectors[:, ::-1][:, :keep] * np.sqrt(np.abs(values[::-1][:keep]))


def reduced_features(rows: DataFrame, u: np.ndarray) -> DataFrame:
    """``rows`` (id, y, features over (s, t, rest)) with both species legs contracted with ``u`` (s, a)."""
    s = len(u)

    def run(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, s, s, -1)
            y = np.einsum("sa,tb,zstr->zabr", u, u, x, optimize=True).reshape(batch.num_rows, -1)
            yield pa.record_batch([batch.column("id"), batch.column("y"), pa.array(list(y), pa.list_(pa.float64()))], names=["id", "y", "features"])

    return rows.select("id", "y", "features").mapInArrow(run, "id long, y double, features array<double>")


def half_sums(rows: DataFrame) -> list[np.ndarray]:
    """For each half of ``rows`` (id, y, features), by parity of id: the products of (features, y, 1) with themselves, in one pass."""

    def run(batches):
        totals = [None, None]
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            both = np.concatenate((x, batch.column("y").to_numpy()[:, None], np.ones((batch.num_rows, 1))), axis=1)
            odd = batch.column("id").to_numpy() % 2 != 0
            for half, own in enumerate((both[~odd], both[odd])):
                totals[half] = own.T @ own + (0.0 if totals[half] is None else totals[half])
        for half, total in enumerate(totals):
            if total is not None:
                yield pa.record_batch([pa.array(np.full(total.size, half)), pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["half", "i", "v"])

    table = rows.mapInArrow(run, "half long, i long, v double").groupBy("half", "i").agg(F.sum("v").alias("v")).orderBy("half", "i").toArrow()
    half, v = table.column("half").to_numpy(), table.column("v").to_numpy()
    d = int(np.sqrt(max((half == 0).sum(), (half == 1).sum(), 4)))
    return [v[half == h].reshape(d, d) if (half == h).any() else np.zeros((d, d)) for h in (0, 1)]


def ridge(rows: DataFrame, penalty: float) -> np.ndarray:
    """Weights of a linear fit of y by ``rows`` (y, features); sums of products are formed on each task and added up."""

    def run(batches):
        total = None
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            own = np.concatenate((x.T @ x, (x.T @ batch.column("y").to_numpy())[:, None]), axis=1)
            total = own if total is None else total + own
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    sums = rows.select("y", "features").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    v = sums.column("v").to_numpy()
    d = int((np.sqrt(4 * len(v) + 1) - 1) / 2)
    system = v.reshape(d, d + 1)
    return np.linalg.solve(system[:, :d] + penalty * np.eye(d), system[:, d])


def cross_loss(rows: DataFrame, u: np.ndarray, penalty: float) -> float:
    """The mean squared error of two halves of ``rows`` (by parity of id), each predicted by a fit to the other.

    Fits and errors follow from the sums of products of either half, so a value is one pass.
    """
    halves = half_sums(reduced_features(rows, u))
    total = 0.0
    for own, other in (halves, halves[::-1]):
        w = np.linalg.solve(other[:-2, :-2] + penalty * np.eye(len(other) - 2), other[:-2, -2])
        total += float(w @ own[:-2, :-2] @ w - 2 * w @ own[:-2, -2] + own[-2, -2])
    return total / max(float(halves[0][-1, -1] + halves[1][-1, -1]), 1.0)


class AlchemicalLoss:
    """The two-halves loss of a linear fit to spectra whose species are reduced by u, with its slope by u; w follows u.

    ``rows`` (id, y, features over (s, t, rest)). Each half (by parity of id) is predicted by the
    ridge fit w to the other, with ``sigma_w`` for penalty; the loss is half the squared errors and
    half ``sigma_u`` times the square of u. The slope takes into account how w changes with u: with
    the adjoint of each fit, the slope by a row's reduced features is a sum of both fits and both
    adjoints. A value is one pass over the rows and a slope one more; what is added up are products
    of reduced features, and as many numbers as u has. ``passes`` counts them.
    """

    def __init__(self, rows: DataFrame, *, sigma_w: float, sigma_u: float = 0.0):
        self.rows, self.sigma_w, self.sigma_u, self.passes = rows.select("id", "y", "features"), sigma_w, sigma_u, 0

    def _add_up(self, run) -> dict[int, np.ndarray]:
        """By half: the sums of what ``run`` yields as (half, m), on few tasks at a time."""

        def add(key: tuple, table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py()) for v in table.column("m"))
            return pa.table({"half": pa.array([key[0].as_py()], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

        self.passes += 1
        schema = "half long, m binary"
        parts = self.rows.mapInArrow(run, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
        summed = parts.groupBy("half", "salt").applyInArrow(add, schema).groupBy("half").applyInArrow(add, schema)
        return {r["half"]: np.frombuffer(r["m"]) for r in summed.collect()}

    def _solved(self, u: np.ndarray) -> tuple[float, int, list[np.ndarray], list[np.ndarray]]:
        """The loss without the square of u, the number of rows, and w and its adjoint for each half."""

        def run(batches):
            totals = [None, None]
            for batch in batches:
                x, y = _reduced(batch, u)
                both = np.concatenate((x, y[:, None], np.ones((len(y), 1))), axis=1)
                odd = batch.column("id").to_numpy() % 2 != 0
                for half, own in enumerate((both[~odd], both[odd])):
                    totals[half] = own.T @ own + (0.0 if totals[half] is None else totals[half])
            for half, total in enumerate(totals):
                if total is not None:
                    yield pa.record_batch([pa.array([half], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["half", "m"])

        sums = self._add_up(run)
        size = int(np.sqrt(max((len(v) for v in sums.values()), default=4)))
        halves = [sums[h].reshape(size, size) if h in sums else np.zeros((size, size)) for h in (0, 1)]
        systems = [m[:-2, :-2] + self.sigma_w * np.eye(size - 2) for m in halves]
        w = [np.linalg.solve(s, m[:-2, -2]) for s, m in zip(systems, halves)]
        # The fit to a half is tried on the other.
        slopes = [halves[1 - h][:-2, :-2] @ w[h] - halves[1 - h][:-2, -2] for h in (0, 1)]
        loss = sum(0.5 * float(w[h] @ m[:-2, :-2] @ w[h] - 2 * w[h] @ m[:-2, -2] + m[-2, -2]) for h, m in zip((1, 0), halves))
        return loss, round(float(halves[0][-1, -1] + halves[1][-1, -1])), w, [np.linalg.solve(s, g) for s, g in zip(systems, slopes)]

    def value(self, u: np.ndarray) -> float:
        return self._solved(u)[0] + 0.5 * self.sigma_u * float((u**2).sum())

    def mean_squared_error(self, u: np.ndarray) -> float:
        loss, rows, *_ = self._solved(u)
        return 2 * loss / max(rows, 1)

    def value_and_slope(self, u: np.ndarray) -> tuple[float, np.ndarray]:
        loss, _, w, adjoint = self._solved(u)

        def run(batches):
            total = np.zeros(u.shape)
            for batch in batches:
                x, y = _reduced(batch, u)
                half = (batch.column("id").to_numpy() % 2 != 0).astype(int)
                w_own, a_own, w_other = np.array(w)[half], np.array(adjoint)[half], np.array(w)[1 - half]
                dot = lambda a, b: (a * b).sum(axis=1, keepdims=True)
                slope = (dot(w_other, x) - y[:, None]) * w_other - (dot(w_own, x) - y[:, None]) * a_own - dot(a_own, x) * w_own
                p = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(u), len(u), -1)
                g = slope.reshape(batch.num_rows, u.shape[1], u.shape[1], -1)
                total += np.einsum("zabr,tb,zstr->sa", g, u, p, optimize=True) + np.einsum("zbar,tb,ztsr->sa", g, u, p, optimize=True)
            yield pa.record_batch([pa.array([0], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["half", "m"])

        found = self._add_up(run)
        return loss + 0.5 * self.sigma_u * float((u**2).sum()), (found[0].reshape(u.shape) if found else 0.0) + self.sigma_u * u


def _reduced(batch: pa.RecordBatch, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, len(u), len(u), -1)
    return np.einsum("sa,tb,zstr->zabr", u, u, x, optimize=True).reshape(batch.num_rows, -1), batch.column("y").to_numpy()


def alchemical_descent(rows: DataFrame, start: np.ndarray, *, sigma_w: float, sigma_u: float = 0.0, rounds: int = 5, steps: int = 10, ftol: float = 1e-9) -> tuple[list[tuple[np.ndarray, float]], int]:
    """After each round of at most ``steps`` steps: u and the root mean squared error, the start first; and the passes over the rows."""
    loss, u = AlchemicalLoss(rows, sigma_w=sigma_w, sigma_u=sigma_u), np.asarray(start, float)
    found = [(u, float(np.sqrt(loss.mean_squared_error(u))))]
    for _ in range(rounds):
        new, _ = minimise(None, u, steps=steps, gradient=loss.value_and_slope, ftol=ftol)
        found.append((new, float(np.sqrt(loss.mean_squared_error(new)))))
        if np.array_equal(new, u):
            break
        u = new
    return found, loss.passes


def minimise(loss, start: np.ndarray, *, steps: int = 10, memory: int = 5, width: float = 1e-4, gradient=None, ftol: float = 0.0) -> tuple[np.ndarray, float]:
    """Limited-memory quasi-Newton descent on ``loss`` with a halving line search; ends when a step lowers the loss by less than ``ftol`` of its size (or of 1).

    ``gradient`` gives the loss and its slope at once; without it the slope is taken by central
    differences, where each value of ``loss`` is a pass over data, so for a handful of parameters.
    """
    x = np.asarray(start, float).copy()

    def differences(x: np.ndarray) -> np.ndarray:
        g = np.zeros_like(x)
        for i in np.ndindex(x.shape):
            e = np.zeros_like(x)
            e[i] = width
            g[i] = (loss(x + e) - loss(x - e)) / (2 * width)
        return g

    both = gradient or (lambda x: (loss(x), None))
    value, g = both(x)
    g, pairs = differences(x) if g is None else g, []
    for _ in range(steps):
        q, used = g.ravel().copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(used)):
            q += s * (a - (y @ q) / (s @ y))
        direction, step = -q.reshape(x.shape), 1.0
        while step > 1e-6:
            new = x + step * direction
            new_value, new_g = both(new)
            if new_value <= value - 1e-4 * step * float((g * -direction).sum()):
                break
            step /= 2
        if step <= 1e-6:
            break
        new_g = differences(new) if new_g is None else new_g
        s, y = (new - x).ravel(), (new_g - g).ravel()
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = value - new_value <= ftol * max(abs(value), abs(new_value), 1.0)
        x, g, value = new, new_g, new_value
        if done:
            break
    return x, value


def centred(rows: DataFrame, n_train: int | None = None) -> DataFrame:
    """``rows`` (id, y), or the first ``n_train`` of them, with y less its mean over them."""
    first = rows if n_train is None else rows.orderBy("id").limit(n_train)
    mean = first.agg(F.avg("y").alias("m"))
    return first.join(F.broadcast(mean)).withColumn("y", F.col("y") - F.col("m")).drop("m")


#: Atomic numbers, symbols, Pauling electronegativities and van der Waals radii in angstrom of common elements.
ELEMENTS = [
    (1, "H", 2.20, 1.20), (5, "B", 2.04, 1.92), (6, "C", 2.55, 1.70), (7, "N", 3.04, 1.55), (8, "O", 3.44, 1.52), (9, "F", 3.98, 1.47),
    (14, "Si", 1.90, 2.10), (15, "P", 2.19, 1.80), (16, "S", 2.58, 1.80), (17, "Cl", 3.16, 1.75), (35, "Br", 2.96, 1.85), (53, "I", 2.66, 1.98),
]


#: The symbols of the elements from 1 to 83, in order.
SYMBOLS = """
H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe
Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi
""".split()


def elements(spark: SparkSession) -> DataFrame:
    """(z, symbol, electronegativity, radius), the last two null where ELEMENTS has none."""
    known = {z: (e, r) for z, _, e, r in ELEMENTS}
    return spark.createDataFrame([(z, s, *known.get(z, (None, None))) for z, s in enumerate(SYMBOLS, 1)], "z int, symbol string, electronegativity double, radius double")
