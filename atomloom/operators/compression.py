"""Compression of power spectra by the covariance of their mean, and their layouts.

A power spectrum is a tensor p[s, t, n, m, l] (species, species, radial, radial, angular), kept
flat in that order in ``features``. The dataset's mean is one aggregation; what is diagonalised
is a matrix of species or radial functions, so it goes to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.functions import vectors

#: For each type: how the weighted mean becomes covariances (leading axes number them), and how projections act.
KINDS = {
    "species": ("stnml->st", "as,bt,stnml->abnml"),
    "angular+species": ("stnml->lst", "las,lbt,stnml->abnml"),
    "radial": ("stnml->nm", "an,bm,stnml->stabl"),
    "angular+radial": ("stnml->lnm", "lan,lbm,stnml->stabl"),
    "species+radial": ("stnml->stnm", "stan,stbm,stnml->stabl"),
    "species*radial": ("stnml->sntm", None),
    "angular+species*radial": ("stnml->lsntm", None),
}


@dataclass(frozen=True)
class Shape:
    species: int
    radial: int
    angular: int

    @property
    def size(self) -> int:
        return self.species**2 * self.radial**2 * self.angular

    @property
    def axes(self) -> tuple[int, ...]:
        return (self.species, self.species, self.radial, self.radial, self.angular)


def mean_spectrum(rows: DataFrame) -> DataFrame:
    """(i, mean): each component's mean over ``rows``; summed on each task before the shuffle."""
    return rows.select(F.posexplode("features").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"))


def weighted(means: DataFrame, shape: Shape) -> DataFrame:
    """(s, t, n, m, l, p): the means by index, times sqrt(2 l + 1)."""
    out, rest = {}, F.col("i").cast("long")
    for name, size in reversed(list(zip("stnml", shape.axes))):
        out[name] = rest % size
        rest = F.floor(rest / size)
    return means.select(*(out[c].alias(c) for c in "stnml"), (F.col("mean") * F.sqrt(2 * out["l"] + 1)).alias("p"))


def species_covariance(rows: DataFrame, shape: Shape) -> DataFrame:
    """(s, t, c): the covariance of the type "species" as a table: mean over l, trace over n = m, by the number of radial functions."""
    p = weighted(mean_spectrum(rows), shape).filter("n = m")
    return p.groupBy("s", "t").agg((F.sum("p") / (shape.angular * shape.radial)).alias("c"))


def covariance(rows: DataFrame, shape: Shape, kind: str) -> np.ndarray:
    """The covariance matrices of a type, on the driver: one, or one for each leading index."""
    if kind not in KINDS:
        raise ValueError(f"unknown type of compression: {kind}")
    p = np.zeros(shape.axes)
    for r in weighted(mean_spectrum(rows), shape).collect():  # as many rows as features
        p[r["s"], r["t"], r["n"], r["m"], r["l"]] = r["p"]
    s, n, l = shape.species, shape.radial, shape.angular  # noqa: E741
    if kind == "species":
        return np.einsum("stnnl->st", p) / (l * n)
    if kind == "angular+species":
        return np.einsum("stnnl->lst", p) / n
    if kind == "radial":
        return np.einsum("ssnml->nm", p) / (l * s)
    if kind == "angular+radial":
        return np.einsum("ssnml->lnm", p) / s
    if kind == "species+radial":
        return p.mean(axis=4)
    if kind == "species*radial":
        return p.mean(axis=4).transpose(0, 2, 1, 3).reshape(s * n, s * n)
    return p.transpose(4, 0, 2, 1, 3).reshape(l, s * n, s * n)


def eigenvectors(matrices: np.ndarray, keep: int) -> np.ndarray:
    """The ``keep`` leading eigenvectors of each symmetrised matrix, as rows, the largest eigenvalue first."""
    _, vectors = np.linalg.eigh((matrices + np.swapaxes(matrices, -1, -2)) / 2)
    return np.swapaxes(vectors[..., ::-1], -1, -2)[..., :keep, :]


def project(rows: DataFrame, shape: Shape, kind: str, u: np.ndarray, *, normalise: bool = False) -> DataFrame:
    """``rows`` with ``features`` projected by ``u`` on both legs of the type, batch by batch; other columns stay."""
    rule = KINDS[kind][1]

    def run(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, *shape.axes)
            if rule is not None:
                first, second, tensor = rule.split("->")[0].split(",")
                y = np.einsum(f"{first},{second},z{tensor}->z{rule.split('->')[1]}", u, u, x, optimize=True)
            else:
                z = x.transpose(0, 1, 3, 2, 4, 5).reshape(len(x), shape.species * shape.radial, shape.species * shape.radial, shape.angular)
                y = np.einsum("ax,by,zxyl->zabl" if kind == "species*radial" else "lax,lby,zxyl->zabl", u, u, z, optimize=True)
            y = y.reshape(batch.num_rows, -1)
            if normalise:
                size = np.sqrt((y**2).sum(axis=1, keepdims=True))
                y = y / np.where(size == 0, 1, size)
            width = y.shape[1]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, width, dtype=np.int32)), pa.array(y.ravel()))
            yield pa.record_batch([flat if n == "features" else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def scale_angular(features: Column, weights: list[float]) -> Column:
    """``features`` with each component times the weight of its l (the last axis), over the norm of all."""
    w = F.array(*map(F.lit, weights))
    scaled = F.transform(features, lambda v, i: v * w[F.pmod(i, F.lit(len(weights)))])
    size = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(scaled, lambda v: v / size)


def scale_features(rows: DataFrame, shape: Shape, kind: str, factors: list[float], *, full: bool = False) -> DataFrame:
    """``rows`` with projected ``features`` scaled on both legs of ``kind``; ``shape`` is that of the projected spectra.

    ``factors`` begin with relative ones, where the type has them: one for each l in an "angular+"
    type, which it multiplies, or one for each species in a "species+" type, on both species
    legs. The others are weights of the legs' components, or with ``full`` a square matrix by rows.
    """
    relative = shape.angular if kind.startswith("angular+") else shape.species if kind.startswith("species+") else 0
    lead, rest = np.array(factors[:relative], float), np.array(factors[relative:], float)
    u = rest.reshape(int(round(np.sqrt(rest.size))), -1) if full else np.diag(rest)
    leading = {"angular+": (shape.angular,), "species+": (shape.species, shape.species)}.get(kind.split("+")[0] + "+" if "+" in kind else "", ())
    scaled = project(rows, shape, kind, np.broadcast_to(u, (*leading, *u.shape)))
    if not relative:
        return scaled
    if kind.startswith("angular+"):
        weights = np.tile(lead, scaled_size(shape, kind, len(u)) // shape.angular)
    else:
        weights = np.repeat(np.outer(lead, lead).ravel(), scaled_size(shape, kind, len(u)) // shape.species**2)
    w = F.array(*(F.lit(float(x)) for x in weights))
    return scaled.withColumn("features", F.zip_with("features", w, lambda v, f: v * f))


def scaled_size(shape: Shape, kind: str, legs: int) -> int:
    """Components of a spectrum of ``shape`` when each leg of ``kind`` has ``legs`` components."""
    own = {"species": shape.species, "angular+species": shape.species}.get(kind, shape.radial if "*" not in kind else shape.species * shape.radial)
    return shape.size // own**2 * legs**2


@dataclass
class Compressor:
    """A fitted compression: its type, the leading eigenvectors, and scaling factors if any; ``pack`` and ``unpack`` are for storage."""

    shape: Shape
    kind: str
    u: np.ndarray
    factors: list[float] | None = None
    full: bool = False

    @classmethod
    def fit(cls, rows: DataFrame, shape: Shape, kind: str, keep: int, *, factors: list[float] | None = None, full: bool = False) -> Compressor:
        return cls(shape, kind, eigenvectors(covariance(rows, shape, kind), keep), factors, full)

    @property
    def small(self) -> Shape:
        keep = self.u.shape[-2]
        return Shape(keep, self.shape.radial, self.shape.angular) if self.kind.endswith("species") else Shape(self.shape.species, keep, self.shape.angular)

    def transform(self, rows: DataFrame, *, normalise: bool = True) -> DataFrame:
        small = project(rows, self.shape, self.kind, self.u)
        if self.factors is not None:
            small = scale_features(small, self.small, self.kind, self.factors, full=self.full)
        return small.withColumn("features", vectors.normalise(F.col("features"))) if normalise else small

    def pack(self) -> dict:
        return {"shape": [self.shape.species, self.shape.radial, self.shape.angular], "kind": self.kind, "u": self.u.tolist(), "factors": self.factors, "full": self.full}

    @classmethod
    def unpack(cls, state: dict) -> Compressor:
        return cls(Shape(*state["shape"]), state["kind"], np.array(state["u"]), state["factors"], state["full"])


def pack_symmetric(features: Column, n: int) -> Column:
    """The upper triangle of an n x n matrix, row by row, what lies off the diagonal times sqrt(2); norms stay."""
    return F.array(*(features[i * n + j] * (1.0 if i == j else math.sqrt(2)) for i in range(n) for j in range(i, n)))


def unpack_symmetric(packed: Column, n: int) -> Column:
    """The n x n matrix that pack_symmetric packed."""
    at = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i, n))}
    return F.array(*(packed[at[min(i, j), max(i, j)]] * (1.0 if i == j else math.sqrt(0.5)) for i in range(n) for j in range(n)))


def unlinearise_index(species: int, radial: int, angular: int) -> list[tuple[int, float]]:
    """For each place of the flat tensor: the place in the triangular vector that fills it, and the factor.

    The vector runs over pairs i >= j of composite (species, radial) indices, then l; a pair off
    the diagonal fills two places, each with sqrt(1/2).
    """
    width = species * radial
    out = []
    for s in range(species):
        for t in range(species):
            for n in range(radial):
                for m in range(radial):
                    i, j = s * radial + n, t * radial + m
                    row = max(i, j) * (max(i, j) + 1) // 2 + min(i, j)
                    out += [(row * angular + l, 1.0 if i == j else math.sqrt(0.5)) for l in range(angular)]  # noqa: E741
    assert len(out) == width * width * angular
    return out


def unlinearise(features: Column, species: int, radial: int, angular: int) -> Column:
    return F.array(*(features[i] * f for i, f in unlinearise_index(species, radial, angular)))


def back_map(rows: DataFrame, chosen: list[int]) -> np.ndarray:
    """The matrix A with |A x_chosen| like |x|: the symmetric root of C C^T, C the least-squares map from chosen features to all.

    Needs only the d x d sum of products of the features, which each task adds up for its rows.
    """

    def run(batches):
        total = None
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "v"])

    table = rows.select("features").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    v = table.column("v").to_numpy()
    gram = v.reshape(int(np.sqrt(len(v))), -1)
    c = np.linalg.pinv(gram[np.ix_(chosen, chosen)], rcond=1e-12) @ gram[chosen]
    values, vectors = np.linalg.eigh(c @ c.T)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
