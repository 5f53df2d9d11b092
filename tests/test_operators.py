import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from atomloom.functions import soap_math
from atomloom.functions.soap_math import Densities, density, legendre, power_spectrum, radial_overlap, radial_table
from atomloom.operators import alchemy, cholesky, compression, descriptors, kernels, low_rank, matrix_free, model_selection, neighbours, regression, scaled_loss, selection, splits
from pyspark.sql import functions as F


def vectors(spark, x, frames=None):
    rows = [(i, int(frames[i]) if frames is not None else i, list(map(float, v))) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "env_id long, frame_id long, features array<double>")


def matrix(df, n, m):
    out = np.zeros((n, m))
    for r in df.collect():
        out[r[0], r[1]] = r[2]
    return out


@pytest.fixture(scope="module")
def x():
    return np.random.default_rng(0).normal(size=(40, 8))


def test_kernels_in_small_blocks(spark, x):
    env = vectors(spark, x, np.arange(40) % 7)
    want = (x @ x.T) ** 2
    assert np.allclose(matrix(kernels.power_kernel(env, env, 2.0, block_rows=7), 40, 40), want)
    assert np.allclose(matrix(kernels.power_kernel_symmetric(env, 2.0, block_rows=7), 40, 40), want)
    got = matrix(kernels.group_kernel(env, env, 2.0, block_rows=7), 7, 7)
    assert np.allclose(got, [[want[np.ix_(np.arange(i, 40, 7), np.arange(j, 40, 7))].mean() for j in range(7)] for i in range(7)])


def test_kernel_cells_are_made_in_strips_of_few_blocks(spark, x, monkeypatch):
    monkeypatch.setattr(kernels, "STRIP_PAIRS", 30)
    monkeypatch.setattr(kernels, "LEAST_ROWS", 1)
    env, want = vectors(spark, x, np.arange(40) % 7), (x @ x.T) ** 2
    for n in (40, 80, 400):  # a row goes to as many cells, however many rows there are
        rows = env.union(vectors(spark, np.zeros((n - 40, 8)))) if n > 40 else env
        assert kernels._blocks(rows, None, 0)[1] <= 16
    assert np.allclose(matrix(kernels.power_kernel(env, env, 2.0), 40, 40), want)
    assert np.allclose(matrix(kernels.power_kernel_symmetric(env, 2.0), 40, 40), want)
    assert kernels.power_kernel(env, env, 2.0).count() == kernels.power_kernel_symmetric(env, 2.0).count() == 1600
    assert kernels.power_kernel(env, env.limit(0), 2.0).count() == 0


@pytest.mark.parametrize("tile, strip", [(96, 1 << 18), (7, 100), (16, 1)])
def test_kernel_of_a_table_with_itself_returns_each_pair_once(spark, x, monkeypatch, tile, strip):
    monkeypatch.setattr(kernels, "TILE", tile)
    monkeypatch.setattr(kernels, "STRIP_PAIRS", strip)
    env, want = vectors(spark, x), np.round((x @ x.T) ** 2, 3)
    for found in (kernels.power_kernel(env, env, 2.0, block_rows=11, places=3), kernels.power_kernel_symmetric(env, 2.0, block_rows=11, places=3)):
        rows = found.collect()
        assert len({(r["i"], r["j"]) for r in rows}) == len(rows) == 1600
        assert all(abs(r["k"] - want[r["i"], r["j"]]) < 1e-12 for r in rows)
    part = kernels.power_kernel(env.filter("env_id < 13"), env.filter("env_id >= 13"), 2.0, block_rows=11, places=3).collect()
    assert len({(r["i"], r["j"]) for r in part}) == len(part) == 13 * 27
    assert all(abs(r["k"] - want[r["i"], r["j"]]) < 1e-12 for r in part)
    twice = env.union(env)  # rows that share their id are rows
    assert kernels.power_kernel(twice, twice, 2.0, block_rows=11).groupBy("i", "j").count().filter("count <> 4").count() == 0


def bytes_a_row(found, where):
    found.write.parquet(str(where))
    return sum(f.stat().st_size for f in where.glob("*.parquet")) / found.sparkSession.read.parquet(str(where)).count()


def test_written_kernels_hold_half_of_their_numbers(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(1200, 8))
    env = vectors(spark, x)
    for at, found in enumerate((kernels.power_kernel(env, env, 2.0), kernels.power_kernel_symmetric(env, 2.0))):
        assert bytes_a_row(found, tmp_path / f"square{at}") < 7
    assert bytes_a_row(kernels.power_kernel(env.filter("env_id % 3 = 0"), env.filter("env_id % 3 <> 0"), 2.0), tmp_path / "rect") < 8.3


def test_gradients_of_groups_are_spread_in_packs(spark, monkeypatch):
    monkeypatch.setattr(kernels, "PACK_ROWS", 3)
    frames = [0] * 20 + [1] * 7 + [2, None]
    members = spark.createDataFrame(list(enumerate(frames)), "env_id long, frame_id long")
    groups = spark.createDataFrame([(a, b, a + 2.0 * b) for a in range(4) for b in range(4) if (a, b) != (1, 0)], "frame_i long, frame_j long, g double")
    got = sorted(tuple(r) for r in kernels.spread_gradient(groups, members).collect())
    n = {0: 20, 1: 7, 2: 1}
    want = sorted((i, j, (a + 2.0 * b) / (n[a] * n[b])) for i, a in enumerate(frames) for j, b in enumerate(frames) if a in n and b in n and (a, b) != (1, 0))
    assert got == want
    # Pairs of packs, not pairs of groups, are dealt out to tasks.
    assert kernels.spread_gradient(groups.filter("frame_i = 0 AND frame_j = 0"), members).select(F.spark_partition_id()).distinct().count() > 1


def test_written_gradients_hold_little_of_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kernels, "PACKS", 5, raising=False)
    members = spark.range(2000).selectExpr("id * 1000003 AS env_id", "id % 3 AS frame_id")
    groups = spark.range(9).selectExpr("id % 3 AS frame_i", "id DIV 3 AS frame_j", "id / 7 AS g")
    found = kernels.spread_entries(groups, members)
    assert bytes_a_row(found, tmp_path / "g") < 0.3
    assert found.count() == found.distinct().count() == 4_000_000
    at = found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("i").alias("i"), F.count_distinct("j").alias("j"))
    assert at.count() > 1 and at.filter("i = 2000 AND j = 2000").count() == 0  # a task meets a part of the ids


def test_regression_against_numpy(spark, x):
    env, y = vectors(spark, x), np.sin(np.arange(40.0))
    k = (x @ x.T) ** 2
    kernel = kernels.power_kernel(env, env, 2.0)
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, y double")
    want = np.linalg.solve(k + 0.1 * np.eye(40), y)
    fitted = regression.krr_fit(kernel, targets, jitter=0.1)
    assert np.allclose([r["alpha"] for r in fitted.orderBy("id").collect()], want)
    solved = regression.conjugate_gradients(kernel, targets, jitter=10.0, max_steps=120, tolerance=1e-16)
    assert np.allclose([r["x"] for r in solved.orderBy("id").collect()], np.linalg.solve(k + 10 * np.eye(40), y), atol=1e-6)
    folds = splits.k_fold(targets.select("id"), 3)
    fold = np.array([r["fold"] for r in folds.orderBy("id").collect()])
    got = np.array([r["y_pred"] for r in regression.krr_fast_cv(kernel, targets, folds, jitter=0.1).orderBy("id").collect()])
    for f in range(3):
        t, v = fold != f, fold == f
        assert np.allclose(got[v], k[np.ix_(v, t)] @ np.linalg.solve(k[np.ix_(t, t)] + 0.1 * np.eye(t.sum()), y[t]), atol=1e-6)
    with pytest.raises(ValueError):
        regression.dense(kernel, list(range(6000)))


def test_exact_models_need_no_dense_matrix(spark, x, monkeypatch):
    monkeypatch.setattr(regression, "MAX_DENSE", 5)
    monkeypatch.setattr(cholesky, "BLOCK_ROWS", 15)
    env, y = vectors(spark, x), np.sin(np.arange(40.0))
    k = (x @ x.T) ** 2
    kernel = kernels.power_kernel(env, env, 2.0)
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, y double")
    fitted = regression.krr_fit(kernel, targets, jitter=0.1, delta=2.0).orderBy("id").collect()
    assert np.allclose([r["alpha"] for r in fitted], np.linalg.solve(4 * k + 0.1 * np.eye(40), y))
    again = regression.krr_fit_rows(env, targets, 2.0, jitter=0.1, delta=2.0).orderBy("id").collect()
    assert np.allclose([r["alpha"] for r in again], [r["alpha"] for r in fitted])
    folds = targets.select("id", (F.col("id") % 2).alias("fold"))
    for found in (regression.krr_fast_cv(kernel, targets, folds, jitter=0.1), regression.krr_fast_cv_rows(env, targets, folds, 2.0, jitter=0.1)):
        got = found.orderBy("id").collect()
        for f in range(2):
            t, v = np.arange(40) % 2 != f, np.arange(40) % 2 == f
            assert np.allclose([r["y_pred"] for r in got if r["fold"] == f], k[np.ix_(v, t)] @ np.linalg.solve(k[np.ix_(t, t)] + 0.1 * np.eye(20), y[t]))


def test_gaussian_process_variance(spark, x):
    train, test = x[:30], x[30:]
    a, b = vectors(spark, train), vectors(spark, test)
    y = np.cos(np.arange(30.0))
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, y double")
    k, ks = (train @ train.T) ** 2, (test @ train.T) ** 2
    own = spark.createDataFrame([(i, float((v @ v) ** 2)) for i, v in enumerate(test)], "id long, k double")
    reg = k + 0.09 * np.trace(k) / 30 / np.var(y) * np.eye(30)
    by_kernel = regression.gaussian_process(kernels.power_kernel(a, a, 2.0), kernels.power_kernel(b, a, 2.0), own, targets, noise=0.3)
    for found in (by_kernel, regression.gaussian_process_rows(a, b, targets, 2.0, noise=0.3)):
        found = found.orderBy("id").collect()
        assert np.allclose([r["y_pred"] for r in found], ks @ np.linalg.solve(reg, y))
        assert np.allclose([r["variance"] for r in found], (test**2).sum(1) ** 2 - np.einsum("ij,ji->i", ks, np.linalg.solve(reg, ks.T)))


def test_sor_equals_dense_system(spark, x):
    env, y = vectors(spark, x), np.arange(40.0)
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "env_id long, y double")
    gram, rhs, cross = kernels.sor_system(env, env.filter("env_id < 5"), targets, 2.0, 0.5)
    k = (x[:5] @ x.T) ** 2
    assert np.allclose(matrix(gram, 5, 5), k[:, :5] + k @ k.T / 0.25)
    assert np.allclose([r["b"] for r in rhs.orderBy("i").collect()], k @ y / 0.25)
    assert np.allclose(matrix(cross, 40, 5), k.T)


def test_farthest_points_by_brute_force(spark, x, tmp_path):
    k = (x @ x.T) ** 2
    d = np.diag(k)[:, None] + np.diag(k)[None, :] - 2 * k
    picked, least = [0], d[0].copy()
    trace = []
    while len(picked) < 40:
        least[picked] = -1
        picked.append(int(least.argmax()))
        trace.append(least.max())
        least = np.minimum(least, d[picked[-1]])
    old, selection.WRITE_EVERY = selection.WRITE_EVERY, 3
    try:
        got = selection.farthest_points(vectors(spark, x), 12, zeta=2.0, folder=str(tmp_path)).orderBy("rank").collect()
    finally:
        selection.WRITE_EVERY = old
    assert [r["id"] for r in got] == picked[:12]
    assert np.allclose([r["distance"] for r in got[:-1]], trace[:11])
    assert all(a >= b - 1e-9 for a, b in zip(trace, trace[1:]))
    assert selection.farthest_points(vectors(spark, x).limit(0), 3).count() == 0


def test_group_k_fold_case(spark):
    mapping = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3), (1, 4), (2, 5), (2, 6), (3, 7)], "frame_id long, env_id long")
    found = splits.group_k_fold(mapping, 3).collect()
    test = [sorted(r["env_id"] for r in found if r["split"] == s and r["role"] == "test") for s in range(3)]
    assert test == [[0, 1, 2, 3, 4], [5, 6], [7]]
    assert all(sum(r["split"] == s for r in found) == 8 for s in range(3))


def test_param_grid_varies_first_step_fastest(spark):
    grid = splits.param_grid(spark, [("soap", {"rc": [3, 4]}), ("krr", {"delta": [1, 2, 3], "jitter": 0.1})]).orderBy("point").collect()
    assert [(r["soap_rc"], r["krr_delta"], r["krr_jitter"]) for r in grid] == [(a, b, "0.1") for b in "123" for a in "34"]


@pytest.mark.parametrize("kind", sorted(compression.KINDS))
def test_covariance_and_projection(spark, kind):
    rng = np.random.default_rng(1)
    shape = compression.Shape(2, 3, 2)
    x = rng.normal(size=(6, shape.size))
    env = vectors(spark, x)
    c = compression.covariance(env, shape, kind)
    p = x.mean(axis=0).reshape(shape.axes) * np.sqrt(2 * np.arange(2) + 1)
    if kind == "species":
        assert np.allclose(c, np.trace(p.mean(axis=4), axis1=2, axis2=3) / 3)
    u = compression.eigenvectors(c, c.shape[-1])
    assert np.allclose(np.swapaxes(u, -1, -2) @ u, np.broadcast_to(np.eye(c.shape[-1]), c.shape))
    # A full set of eigenvectors is a rotation: norms stay.
    got = np.array([r["features"] for r in compression.project(env, shape, kind, u).orderBy("env_id").collect()])
    assert np.allclose((got**2).sum(axis=1), (x**2).sum(axis=1))


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 3), st.integers(1, 3), st.integers(1, 3))
def test_unlinearise_keeps_norms(s, n, l):  # noqa: E741
    index = compression.unlinearise_index(s, n, l)
    size = (s * n) * (s * n + 1) // 2 * l
    v = np.random.default_rng(0).normal(size=size)
    assert math.isclose(sum((v[i] * f) ** 2 for i, f in index), (v**2).sum())
    assert {i for i, _ in index} == set(range(size))


def test_pack_round_trip(spark):
    a = np.random.default_rng(2).normal(size=(5, 4, 4))
    a = a + a.transpose(0, 2, 1)
    rows = vectors(spark, a.reshape(5, 16)).withColumn("p", compression.pack_symmetric(F.col("features"), 4))
    rows = rows.withColumn("u", compression.unpack_symmetric(F.col("p"), 4)).collect()
    for r in rows:
        assert np.allclose(r["u"], r["features"]) and math.isclose(sum(v * v for v in r["p"]), sum(v * v for v in r["features"]))


def test_legendre_is_orthonormal():
    z, w = np.polynomial.legendre.leggauss(30)
    p = legendre(5, z)
    for m in range(6):
        gram = 2 * np.pi * np.einsum("ik,jk,k->ij", p[m:, m], p[m:, m], w)
        assert np.allclose(gram, np.eye(6 - m))
    assert np.allclose(p[1, 1], -np.sqrt(3 / (8 * np.pi)) * np.sqrt(1 - z * z))


def test_radial_overlap_against_closed_forms():
    r, rij, sigma = np.linspace(0.5, 3, 7), 1.7, 0.5
    a = rij / sigma**2
    g0 = (np.exp(-((r - rij) ** 2) / (2 * sigma**2)) - np.exp(-((r + rij) ** 2) / (2 * sigma**2))) / (2 * a)
    got = radial_overlap(2, r, np.full(7, rij), sigma)
    keep = np.abs(r - rij) < 5 * sigma
    assert np.allclose(got[0][keep], g0[keep])
    g1 = g0 * (1 / np.tanh(a * r) - 1 / (a * r))
    assert np.allclose(got[1][keep], g1[keep])
    assert np.allclose(got[2][keep], (g0 - 3 * g1 / (a * r))[keep])
    assert np.allclose(radial_overlap(2, r, np.zeros(7), sigma)[1:], 0)

def test_densities_by_table_equal_those_by_pair():
    rng = np.random.default_rng(9)
    for kw in (dict(nmax=3, lmax=3, rc=2.5, sigma=0.4), dict(nmax=5, lmax=6, rc=5.0, sigma=0.3), dict(nmax=1, lmax=0, rc=2.0, sigma=0.5)):
        d = rng.normal(size=(3000, 3))
        d *= kw["rc"] * rng.uniform(size=(3000, 1)) ** (1 / 3) / np.linalg.norm(d, axis=1, keepdims=True)
        d[:6] = [(0, 0, 0), (4e-6, 0, 0), (0, 0, 1.3), (0, 0, -1.3), (0, 1.3, 0), (0, 0, kw["rc"] * (1 - 1e-12))]
        w, at = rng.uniform(size=3000), np.repeat(rng.permutation(np.arange(60) % 7), 50)  # several runs of a segment
        out = np.zeros((9, kw["lmax"] + 1, kw["nmax"], 2 * kw["lmax"] + 2))
        sums = Densities(radial_table(**kw), rc=kw["rc"], sigma=kw["sigma"])
        sums.add(out, at, d, w, batch=1000)
        for k in range(9):
            want = density(d[at == k], w[at == k], **kw).swapaxes(0, 1) if k < 7 else np.zeros((kw["lmax"] + 1, kw["nmax"], kw["lmax"] + 1))
            assert np.allclose(out[k], np.concatenate([want.real, want.imag], axis=2), rtol=0, atol=1e-12)


def test_spectra_cost_no_fraction_a_pair(spark, monkeypatch):
    rng = np.random.default_rng(6)
    atoms = spark.createDataFrame([(0, i, 0, *map(float, rng.normal(size=3))) for i in range(300)], "frame_id long, atom_idx long, species long, x double, y double, z double")
    made = []
    whole = soap_math.radial_overlap
    monkeypatch.setattr(soap_math, "radial_overlap", lambda lmax, r, rij, sigma, **kw: made.append(rij.size) or whole(lmax, r, rij, sigma, **kw))
    found = descriptors.describe(atoms, [0], rc=2.5, nmax=2, lmax=2, sigma=0.4)
    monkeypatch.setattr(soap_math, "radial_overlap", None)  # tasks get the table
    assert found.count() == 300 and sum(made) < 3000


def test_spectra_are_rotation_invariant(spark):
    rng = np.random.default_rng(3)
    xyz = rng.uniform(-1.5, 1.5, size=(8, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    both = []
    for points in (xyz, xyz @ q.T + 5.0):
        rows = [(0, i, i % 2, *map(float, p)) for i, p in enumerate(points)]
        atoms = spark.createDataFrame(rows, "frame_id long, atom_idx long, species long, x double, y double, z double")
        found = descriptors.power_spectra(atoms, neighbours.neighbours_binned(atoms, 3.0), [0, 1], rc=3.0, nmax=3, lmax=3, sigma=0.4)
        both.append(np.array([r["features"] for r in found.orderBy("atom_idx").collect()]))
    assert both[0].shape == (8, descriptors.descriptor_size(2, 3, 3))
    assert np.allclose(both[0], both[1], atol=1e-8) and np.allclose((both[0] ** 2).sum(axis=1), 1)
    f = density(xyz, np.ones(8), nmax=3, lmax=3, rc=3.0, sigma=0.4)
    assert np.allclose(power_spectrum(f, f), power_spectrum(f, f).transpose(1, 0, 2))


def test_periodic_neighbours_by_brute_force(spark):
    cell = np.array([[3.0, 0, 0], [0.8, 2.9, 0], [0.3, 0.5, 3.2]])
    xyz = np.random.default_rng(4).uniform(0, 1, size=(5, 3)) @ cell
    atoms = spark.createDataFrame([(0, i, 1, *map(float, p)) for i, p in enumerate(xyz)], "frame_id long, atom_idx long, species long, x double, y double, z double")
    cells = spark.createDataFrame([(0, cell.tolist(), [True, True, False])], "frame_id long, cell array<array<double>>, pbc array<boolean>")
    want = sorted(
        (i, j, round(float(r), 6))
        for i in range(5) for j in range(5) for a in range(-4, 5) for b in range(-4, 5)
        if (r := np.linalg.norm(xyz[j] + a * cell[0] + b * cell[1] - xyz[i])) < 4.0 and (i, j, a, b) != (i, i, 0, 0)
    )
    got = sorted((r["i"], r["j"], round(r["r"], 6)) for r in neighbours.neighbours_periodic(atoms, cells, 4.0).collect())
    assert got == want


def test_alchemy(spark):
    kappa = alchemy.element_similarity(alchemy.elements(spark).filter("z IN (6, 7, 8)"))
    z, u = alchemy.leading_vectors(kappa, 3)
    assert z == [6, 7, 8] and np.allclose(u @ u.T, matrix(kappa.select(*((F.col(c) - 6).alias(c) for c in ("z1", "z2")), "kappa"), 3, 3))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 4))
    y = x @ [1.0, -2.0, 0.5, 3.0]
    rows = spark.createDataFrame([(i, float(b), list(map(float, a))) for i, (a, b) in enumerate(zip(x, y))], "id long, y double, features array<double>")
    assert np.allclose(alchemy.ridge(rows, 1e-9), [1.0, -2.0, 0.5, 3.0])
    at, low = alchemy.minimise(lambda v: float(((v - [1, 2]) ** 2).sum()), np.zeros(2))
    assert np.allclose(at, [1, 2], atol=1e-3) and low < 1e-5


def test_split_scores_and_sor_cross_validation(spark, x):
    y = np.sin(np.arange(40.0))
    env = vectors(spark, x)
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, y double")
    folds = splits.k_fold(targets.select("id"), 4)
    fold = np.array([r["fold"] for r in folds.orderBy("id").collect()])
    k = (x @ x.T) ** 2
    found = model_selection.split_scores(kernels.power_kernel(env, env, 2.0), targets, splits.fold_roles(folds, 4), ["split"], jitter=0.1, delta=0.5)
    rows = env.select("env_id", "features").join(targets.withColumnRenamed("id", "env_id"), "env_id")
    low = model_selection.sor_cross_validate(rows, env.filter("env_id < 6"), folds.withColumnRenamed("id", "env_id"), zeta=2.0, scales=[0.7], jitter=0.0)
    exact, sparse = {r["split"]: r["rmse"] for r in found.collect()}, {r["fold"]: r["rmse"] for r in low.collect()}
    for f in range(4):
        t, v = fold != f, fold == f
        want = k[np.ix_(v, t)] / 4 @ np.linalg.solve(k[np.ix_(t, t)] / 4 + 0.1 * np.eye(t.sum()), y[t])
        assert math.isclose(exact[f], np.sqrt(((want - y[v]) ** 2).mean()), rel_tol=1e-6)
        c = k[:6][:, t]
        want = k[v][:, :6] @ np.linalg.solve(k[:6, :6] + c @ c.T / 0.49, c @ y[t] / 0.49)
        assert math.isclose(sparse[f], np.sqrt(((want - y[v]) ** 2).mean()), rel_tol=1e-5)


def test_log_likelihood_against_the_dense_one(x):
    k, y, m, s = (x @ x.T) ** 2, np.cos(np.arange(40.0)), 6, 0.8
    c = k[:m]
    full = c.T @ np.linalg.solve(k[:m, :m], c) + s**2 * np.eye(40)
    want = -0.5 * (y @ np.linalg.solve(full, y) + np.linalg.slogdet(full)[1] + 40 * np.log(2 * np.pi))
    assert math.isclose(model_selection.sor_log_likelihood(c @ c.T, k[:m, :m], c @ y, float(y @ y), 40, s), want, rel_tol=1e-6)


def test_back_map_keeps_norms_of_what_it_spans(spark, x):
    low = x[:, :3] @ np.random.default_rng(6).normal(size=(3, 8))
    a = compression.back_map(vectors(spark, low), [0, 1, 2])
    assert np.allclose(np.linalg.norm(low[:, :3] @ a, axis=1), np.linalg.norm(low, axis=1))


def test_conjugate_gradients_on_features(spark, x):
    y = np.sin(np.arange(len(x)))
    rows = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(len(x))], "id long, y double, features array<double>")
    got = {r["id"]: r["x"] for r in regression.conjugate_gradients_features(rows, ridge=0.3).collect()}
    want = np.linalg.solve(x @ x.T + 0.3 * np.eye(len(x)), y)
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-7)
    assert regression.conjugate_gradients_features(rows.limit(0), ridge=0.3).count() == 0


@pytest.mark.parametrize("kind", ["species", "angular+species", "radial", "angular+radial", "species+radial"])
def test_a_compressor_comes_back(spark, kind):
    shape, rng = compression.Shape(2, 3, 2), np.random.default_rng(0)
    rows = spark.createDataFrame([(i, rng.normal(size=shape.size).tolist()) for i in range(9)], "env_id long, features array<double>")
    factors = [1.0, 2.0] if kind.startswith(("angular", "species+")) else []
    fitted = compression.Compressor.fit(rows, shape, kind, 2, factors=[*factors, 0.5, 1.5])
    again = compression.Compressor.unpack(json.loads(json.dumps(fitted.pack())))
    a, b = ({r["env_id"]: r["features"] for r in c.transform(rows).collect()} for c in (fitted, again))
    assert a == b and all(abs(np.linalg.norm(v) - 1) < 1e-12 for v in a.values()) and len(a[0]) == fitted.small.size


def test_scaling_is_optimised(spark):
    """A target that one component alone determines: the other's weight falls, and so does the loss."""
    shape, rng = compression.Shape(2, 1, 1), np.random.default_rng(4)
    v = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i, float(v[i, 0]), v[i].tolist()) for i in range(60)], "env_id long, y double, features array<double>")
    compressor = compression.Compressor(shape, "species", np.eye(2), [1.0, 1.0])
    folds = splits.k_fold(rows.select("env_id"), 3, key="env_id")
    active, start = rows.filter("env_id < 8").select("env_id"), [0.5, 1.0, 1.0]
    small = compressor.transform(rows)
    before = model_selection.sor_loss(small, small.join(active, "env_id", "left_semi").select("env_id", "features"), folds, zeta=1.0, scales=[0.5], jitter=1e-6).first()["mse"]
    found, after = model_selection.optimise_scaling(rows, active, folds, compressor, start, zeta=1.0, steps=1, jitter=1e-6)
    assert after < before and len(found) == 3 and compressor.factors == found[1:]


def test_describe_options(spark):
    rng = np.random.default_rng(2)
    atoms = spark.createDataFrame([(f, i, int(i % 2), *map(float, rng.uniform(0, 3, 3))) for f in range(2) for i in range(5)], "frame_id long, atom_idx long, species long, x double, y double, z double")
    kw = dict(rc=2.0, nmax=2, lmax=1, sigma=0.4)
    each = {(r["frame_id"], r["atom_idx"]): np.array(r["features"]) for r in descriptors.describe(atoms, [0, 1], **kw).collect()}
    mean = {r["frame_id"]: np.array(r["features"]) for r in descriptors.describe(atoms, [0, 1], mean=True, **kw).collect()}
    assert all(np.allclose(mean[f], np.mean([each[f, i] for i in range(5)], axis=0)) for f in range(2))
    sparse = {(r["frame_id"], r["atom_idx"]): {p["i"]: p["v"] for p in r["features"]} for r in descriptors.describe(atoms, [0, 1], sparse=0.05, **kw).collect()}
    assert all(p == {i: x for i, x in enumerate(each[k]) if abs(x) >= 0.05} for k, p in sparse.items())


def test_neighbours_wrapped_finds_what_the_scan_finds(spark):
    x = np.random.default_rng(4).uniform(-9, 9, (60, 3))
    atoms = spark.createDataFrame([(i % 2, i, 0, *map(float, p)) for i, p in enumerate(x)], "frame_id long, atom_idx long, species long, x double, y double, z double")
    for cell in ((8.0, 8.0, 8.0), (4.0, 5.5, 9.0), (2.6, 12.0, 7.0)):
        want, got = (sorted((r["i"], r["j"], round(r["r"], 9)) for r in found.collect()) for found in (neighbours.neighbours_scan(atoms, 2.5, cell=cell), neighbours.neighbours_wrapped(atoms, 2.5, cell)))
        assert want == got and want


def test_distances_of_parts_that_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ATOMS", 20)
    monkeypatch.setattr(kernels, "STRIP_PAIRS", 50)
    monkeypatch.setattr(kernels, "TILE", 7)
    x = np.random.default_rng(4).uniform(-6, 6, (90, 3))
    x[80:] = x[:10]  # atoms in one place
    rows = [(i % 2, i, 0, *map(float, p)) for i, p in enumerate(x)]
    odd = [(0, 3, 0, 0.0, 0.0, 0.0), (0, 200, 0, None, 0.0, 0.0), (0, 201, 0, float("nan"), 0.0, 0.0), (None, 202, 0, 0.0, 0.0, 0.0), (1, 203, 0, 2.5, 2.5, 2.5), (1, 204, 0, 5.0, 2.5, 2.5)]
    atoms = spark.createDataFrame(rows + odd, "frame_id long, atom_idx long, species long, x double, y double, z double")
    of = lambda found: sorted((r["frame_id"], r["i"], r["j"], round(r["r"], 9)) for r in found.collect())
    want = of(neighbours.neighbours_scan(atoms, 2.5))
    assert want and of(neighbours.distances_scan(atoms, 2.5)) == of(neighbours.distances_binned(atoms, 2.5, places=9)) == want
    for cell in ((8.0, 8.0, 8.0), (4.0, 5.5, 9.0), (2.6, 12.0, 7.0)):
        assert of(neighbours.distances_wrapped(atoms, 2.5, cell)) == of(neighbours.neighbours_scan(atoms, 2.5, cell=cell))


def test_written_neighbours_hold_a_distance_once(spark, tmp_path):
    from atomloom.jobs import catalog

    x = np.random.default_rng(5).normal(scale=0.125, size=(1500, 3)).tolist()
    spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("neighbours_cutoff", "neighbours_binned", "neighbours_image"):
        assert bytes_a_row(catalog.QUERIES[name](spark, str(tmp_path)).coalesce(1), tmp_path / name) < 7.5


def test_running_totals_over_several_ranges(spark):
    from atomloom.operators.order import running

    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS id", "id % 3 AS w")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["id"]: (r["w"], r["before"]) for r in running(rows, [F.desc("id")], weight="w").collect()}
        numbers = {r["id"]: r["before"] for r in running(rows, [F.col("id")]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    total = 0
    for i in sorted(got, reverse=True):
        assert got[i][1] == total
        total += got[i][0]
    assert numbers == {i: i for i in range(1000)}
    assert running(rows.limit(0), [F.col("id")]).count() == 0


def test_farthest_features_by_columns(spark):
    x = np.random.default_rng(5).normal(size=(40, 12))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "env_id long, features array<double>")
    picked, d = [0], np.full(12, np.inf)
    while len(picked) < 12:
        d = np.minimum(d, ((x - x[:, [picked[-1]]]) ** 2).sum(axis=0))
        d[picked] = -1
        picked.append(int(d.argmax()))
    assert selection.farthest_features(rows, 20) == picked
    assert selection.farthest_features(rows.limit(0), 3) == []


def test_cross_loss_is_that_of_two_fits(spark):
    rng = np.random.default_rng(6)
    x, y, u = rng.normal(size=(30, 8)), rng.normal(size=30), np.array([[0.5], [1.5]])
    rows = spark.createDataFrame([(i, float(y[i]), [float(v) for v in x[i]]) for i in range(30)], "id long, y double, features array<double>")
    z = np.einsum("sa,tb,zstr->zabr", u, u, x.reshape(30, 2, 2, -1)).reshape(30, -1)
    error = 0.0
    for half in (0, 1):
        fit, test = np.arange(30) % 2 != half, np.arange(30) % 2 == half
        w = np.linalg.solve(z[fit].T @ z[fit] + 0.1 * np.eye(z.shape[1]), z[fit].T @ y[fit])
        error += ((z[test] @ w - y[test]) ** 2).sum()
    assert np.isclose(alchemy.cross_loss(rows, u, 0.1), error / 30)


def test_low_rank_of_many_tiles(spark, x, monkeypatch):
    """Tiles of a few active environments, packs of a few rows and sums in rounds give what one dense system gives."""
    monkeypatch.setattr(low_rank, "FAN_IN", 2)
    monkeypatch.setattr(low_rank, "PACK_BYTES", 300)
    env, y = vectors(spark, x), np.cos(np.arange(40.0))
    rows = env.withColumn("y", F.cos(F.col("env_id").cast("double")))
    active = env.filter("env_id % 4 = 1")
    k = 4 * (x[1::4] @ x.T) ** 2
    want = np.linalg.solve(k[:, 1::4] + k @ k.T / 0.25 + 0.1 * np.eye(10), k @ y / 0.25)
    for tile_rows in (3, 512):
        got = low_rank.fit(rows, active, 2.0, scale=0.5, jitter=0.1, delta=2.0, tile_rows=tile_rows).orderBy("id").collect()
        assert [r["id"] for r in got] == list(range(1, 40, 4)) and np.allclose([r["alpha"] for r in got], want)
        sums = low_rank.Sums(rows, active, 2.0, delta=2.0, tile_rows=tile_rows)
        gram, rhs = sums.entries(0.5, 0.1)
        found = {(r["i"], r["j"]): r["k"] for r in gram.collect()}
        assert len(found) == 100 and np.allclose([[found[i, j] for j in range(1, 40, 4)] for i in range(1, 40, 4)], k[:, 1::4] + k @ k.T / 0.25 + 0.1 * np.eye(10))
        assert np.allclose([r["b"] for r in rhs.orderBy("i").collect()], k @ y / 0.25)
        own = k[:, 1::4] + 0.1 * np.eye(10)
        dense_ = k.T @ np.linalg.solve(own, k) + 0.25 * np.eye(40)
        likelihood = -0.5 * (y @ np.linalg.solve(dense_, y) + np.linalg.slogdet(dense_)[1] + 40 * np.log(2 * np.pi))
        assert math.isclose(sums.likelihood(0.5, 0.1, float(y @ y), 40), likelihood, rel_tol=1e-6)
        sums.remove()


def test_low_rank_validation_of_many_tiles(spark, x, monkeypatch):
    monkeypatch.setattr(cholesky, "BLOCK_ROWS", 3)
    env = vectors(spark, x)
    rows = env.select("env_id", "features", F.sin(F.col("env_id").cast("double")).alias("y"))
    folds, active = rows.select("env_id", (F.col("env_id") % 3).alias("fold")), env.filter("env_id < 10")
    got = {(r["scale"], r["fold"]): r for r in model_selection.sor_cross_validate(rows, active, folds, zeta=2.0, scales=[0.5, 2.0], jitter=0.1).collect()}
    y, k = np.sin(np.arange(40.0)), (x[:10] @ x.T) ** 2
    assert len(got) == 6
    for (scale, fold), r in got.items():
        train = np.arange(40) % 3 != fold
        alpha = np.linalg.solve(k[:, :10] + k[:, train] @ k[:, train].T / scale**2 + 0.1 * np.eye(10), k[:, train] @ y[train] / scale**2)
        error = alpha @ k[:, ~train] - y[~train]
        assert math.isclose(r["mae"], np.abs(error).mean(), rel_tol=1e-6) and math.isclose(r["rmse"], np.sqrt((error**2).mean()), rel_tol=1e-6)


def test_farthest_points_take_few_passes(spark, monkeypatch):
    """Hundreds of points of a few passes, the same as one by one; with copies, and with ties of all distances."""
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(size=(400, 12)), np.eye(12), np.eye(12), np.zeros((3, 12))))
    k = (x @ x.T) ** 2
    d = np.diag(k)[:, None] + np.diag(k)[None, :] - 2 * k
    picked, least = [5], d[5].copy()
    while len(picked) < 150:
        least[picked] = -1
        picked.append(int(least.argmax()))
        least = np.minimum(least, d[picked[-1]])
    passes, one = [], selection._pass
    monkeypatch.setattr(selection, "_pass", lambda *a: passes.append(1) or one(*a))
    got = selection.farthest_points(vectors(spark, x), 150, zeta=2.0, start=5, batch=64).orderBy("rank").collect()
    assert [r["id"] for r in got] == picked and len(passes) < 40
    ties = selection.farthest_points(vectors(spark, np.eye(9)), 20, batch=4).orderBy("rank").collect()
    assert [r["id"] for r in ties] == list(range(9))


def test_describe_makes_no_table_of_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i % 3, i, int(rng.integers(0, 3)), *map(float, rng.normal(size=3))) for i in range(150)]
    atoms = spark.createDataFrame([*rows, (7, 200, 2, 0.0, 0.0, 0.0), (7, 201, 1, 0.5, 0.0, 0.0), (7, 202, 2, 5.0, 0.0, 0.0), (7, 203, 0, None, 0.0, 0.0)], "frame_id long, atom_idx long, species long, x double, y double, z double")
    kw = dict(rc=1.5, nmax=2, lmax=2, sigma=0.4)
    want = {(r["frame_id"], r["atom_idx"]): r["features"] for r in descriptors.power_spectra(atoms, neighbours.neighbours_binned(atoms, 1.5), [0, 1], **kw).collect()}
    monkeypatch.setattr(neighbours, "_pairs", None)  # dense frames have more pairs than can be shuffled
    monkeypatch.setattr(descriptors, "GROUP_CENTRES", 4)
    monkeypatch.setattr(descriptors, "PART_CENTRES", 4)
    monkeypatch.setattr(descriptors, "STRIP_PAIRS", 100)
    got = {(r["frame_id"], r["atom_idx"]): r["features"] for r in descriptors.describe(atoms, [0, 1], **kw).collect()}
    assert got.keys() == want.keys() and (7, 200) in got and (7, 202) not in got and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)


@pytest.mark.parametrize("pbc", [(True, True, True), (True, False, True), (False, False, True), (False, False, False)])
def test_frames_wrapped_by_lattice_vectors_have_the_same_features(spark, pbc):
    rng = np.random.default_rng(4)
    cell = np.array([[4.0, 0.3, 0.0], [-1.5, 3.5, 0.2], [0.4, 0.9, 5.0]])
    at, species = rng.uniform(size=(9, 3)) @ cell, rng.integers(0, 2, 9)
    off = rng.integers(-3, 4, size=(9, 3)) * np.array(pbc)
    rows = [(p, 0, i, int(species[i]), *map(float, q[i])) for p, q in (("a", at), ("b", at + off @ cell)) for i in range(9)]
    atoms = spark.createDataFrame(rows, "path string, frame_id long, atom_idx long, species long, x double, y double, z double")
    given = [[list(map(float, v)) if p or sum(pbc) == 3 else [0.0] * 3 for v, p in zip(cell, pbc)]] if any(pbc) else [None]
    cells = spark.createDataFrame([(p, 0, given[0], list(pbc)) for p in "ab"], "path string, frame_id long, cell array<array<double>>, pbc array<boolean>")
    by = ("path", "frame_id")
    found = {(r["path"], r["atom_idx"]): r["features"] for r in descriptors.describe(atoms, [0, 1], rc=3.0, nmax=2, lmax=2, sigma=0.4, cells=cells, by=by).collect()}
    assert len(found) == 18 and all(np.allclose(found["a", i], found["b", i], atol=1e-8) for i in range(9))
    # All images by trying them, for the same pairs.
    n = np.array([v for v in np.ndindex(9, 9, 9)]) - 4
    n = n[(n * ~np.array(pbc) == 0).all(axis=1)]
    want = sorted((i, j, round(float(r), 6)) for i in range(9) for j in range(9) for r in np.sqrt((((at[j] + n @ cell - at[i])) ** 2).sum(axis=1)) if 1e-9 < r < 3.0)
    pairs = neighbours.neighbours_periodic(atoms, cells, 3.0, by=by).filter("path = 'b'").collect()
    assert sorted((r["i"], r["j"], round(r["r"], 6)) for r in pairs) == want
    means = descriptors.describe(atoms, [0, 1], rc=3.0, nmax=2, lmax=2, sigma=0.4, cells=cells, by=by, mean=True).collect()
    assert sorted(r["path"] for r in means) == ["a", "b"] and np.allclose(means[0]["features"], np.mean([found["a", i] for i in range(9)], axis=0), atol=1e-8)
    few = descriptors.describe(atoms, [0, 1], rc=3.0, nmax=2, lmax=2, sigma=0.4, cells=cells, by=by, centres=[1])
    few = {(r["path"], r["atom_idx"]): r["features"] for r in few.collect()}
    assert set(few) == {k for k in found if species[k[1]] == 1} and all(np.allclose(v, found[k]) for k, v in few.items())


@pytest.mark.parametrize("landmarks, block_rows", [(5, 7), (1, 1000)])
def test_matrix_free_fit(spark, x, landmarks, block_rows):
    few = x[:24, :3]
    env, y = vectors(spark, few), np.sin(np.arange(24.0))
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, y double")
    want = np.linalg.solve(4 * (few @ few.T) ** 2 + 5.0 * np.eye(24), y)
    got = matrix_free.solve(env, targets, 2.0, jitter=5.0, delta=2.0, landmarks=landmarks, block_rows=block_rows).orderBy("id").collect()
    assert np.allclose([r["alpha"] for r in got], want, atol=1e-9)


def test_matrix_free_ends(spark, x, monkeypatch):
    """Of no rows, of targets that are 0, and where steps do not suffice; then the matrix is factored."""
    env = vectors(spark, x)
    targets = spark.createDataFrame([(i, float(i)) for i in range(40)], "id long, y double")
    assert matrix_free.solve(env, targets.limit(0), 2.0, jitter=1.0).count() == 0
    assert {r["alpha"] for r in matrix_free.solve(env, targets.withColumn("y", F.lit(0.0)), 2.0, jitter=1.0).collect()} == {0.0}
    assert matrix_free.solve(env, targets, 2.0, jitter=1e-3, landmarks=1, max_steps=1) is None
    monkeypatch.setattr(regression, "DIRECT_BLOCKS", 0)
    monkeypatch.setattr(matrix_free.solve, "__kwdefaults__", matrix_free.solve.__kwdefaults__ | {"max_steps": 1})
    got = regression.krr_fit_rows(env, targets, 2.0, jitter=1.0).orderBy("id").collect()
    assert np.allclose([r["alpha"] for r in got], np.linalg.solve((x @ x.T) ** 2 + np.eye(40), np.arange(40.0)))


@pytest.mark.parametrize("kind", sorted(k for k in compression.KINDS if "*" not in k))
def test_leg_index_is_what_scaling_does(spark, kind):
    shape, rng = compression.Shape(2, 3, 2), np.random.default_rng(0)
    legs = {"species": 2, "radial": 3}[kind.split("+")[-1]]
    relative = 2 if kind.startswith(("angular+", "species+")) else 0
    factors = rng.uniform(0.5, 2, relative + legs)
    x = rng.normal(size=(2, shape.size))
    got = compression.scale_features(vectors(spark, x), shape, kind, factors.tolist()).orderBy("env_id").collect()
    scaling = scaled_loss.Scaling(scaled_loss.leg_index(shape, kind))
    assert np.allclose([r["features"] for r in got], x * scaling.weights(factors))


@pytest.mark.parametrize("groups, strip", [(False, 2**20), (True, 2**20), (True, 20)])
def test_gradient_of_the_loss_against_differences(spark, monkeypatch, groups, strip):
    """Of the noise scale and of weights that several components share, from two passes; for single environments and for frames, in one strip or many."""
    monkeypatch.setattr(scaled_loss, "STRIP", strip)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(30, 12))
    frame = np.arange(30) % 10 if groups else np.arange(30)
    env = vectors(spark, x, frame).select("frame_id", "features")
    frames = sorted(set(frame.tolist()))
    y = {f: float(np.sin(3.0 * f)) for f in frames}
    targets = spark.createDataFrame([(f, y[f], f % 3) for f in frames], "frame_id long, y double, fold long")
    shape = compression.Shape(2, 1, 3)
    scaling = scaled_loss.Scaling(scaled_loss.leg_index(shape, "angular+species"))
    loss = scaled_loss.ScaledLoss(env, targets, env.filter("frame_id < 4"), scaling, zeta=2.0, jitter=1e-3)
    at = np.array([0.7, *rng.uniform(0.5, 1.5, 5)])

    def value(p):
        z = x * scaling.weights(p[1:])
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        k = (z @ z.T) ** 2
        k = np.array([[k[np.ix_(frame == i, frame == j)].mean() for j in frames] for i in frames])
        out = 0.0
        for fold in range(3):
            t, v = np.array([f % 3 != fold for f in frames]), np.array([f % 3 == fold for f in frames])
            own = np.array([y[f] for f in frames])
            alpha = np.linalg.solve(k[:4, :4] + k[:4, t] @ k[t, :4] / p[0] ** 2 + 1e-3 * np.eye(4), k[:4, t] @ own[t] / p[0] ** 2)
            out += ((k[v, :4] @ alpha - own[v]) ** 2).sum()
        return out / len(frames)

    got, slope = loss.value_and_slope(at)
    assert loss.passes == 2 and math.isclose(got, value(at), rel_tol=1e-9) and math.isclose(loss.value(at), got, rel_tol=1e-9)
    want = [(value(at + 1e-5 * e) - value(at - 1e-5 * e)) / 2e-5 for e in np.eye(6)]
    assert np.allclose(slope, want, rtol=1e-4, atol=1e-8)
    loss.remove()


@pytest.mark.parametrize("keep", [1, 2])
def test_alchemical_gradient_against_differences(spark, keep):
    """With both penalties, where w follows u; and descent by it."""
    rng = np.random.default_rng(3)
    x, y, u = rng.normal(size=(25, 18)), rng.normal(size=25), rng.normal(size=(3, keep))
    rows = vectors(spark, x).select(F.col("env_id").alias("id"), "features").join(spark.createDataFrame(list(enumerate(map(float, y))), "id long, y double"), "id")
    loss = alchemy.AlchemicalLoss(rows, sigma_w=0.3, sigma_u=0.2)

    def value(u):
        z = np.einsum("sa,tb,zstr->zabr", u, u, x.reshape(25, 3, 3, 2)).reshape(25, -1)
        out = 0.1 * (u**2).sum()
        for h in (0, 1):
            t, v = np.arange(25) % 2 == h, np.arange(25) % 2 != h
            out += 0.5 * ((z[v] @ np.linalg.solve(z[t].T @ z[t] + 0.3 * np.eye(z.shape[1]), z[t].T @ y[t]) - y[v]) ** 2).sum()
        return out

    got, slope = loss.value_and_slope(u)
    assert loss.passes == 2 and math.isclose(got, value(u), rel_tol=1e-9) and math.isclose(loss.value(u), got, rel_tol=1e-9)
    e = np.eye(u.size).reshape(-1, *u.shape)
    assert np.allclose(slope.ravel(), [(value(u + 1e-5 * d) - value(u - 1e-5 * d)) / 2e-5 for d in e], rtol=1e-4, atol=1e-7)
    found, _ = alchemy.alchemical_descent(rows, u, sigma_w=0.3, sigma_u=0.2, rounds=1, steps=3)
    assert value(found[-1][0]) < value(u) and math.isclose(found[0][1] ** 2 * 25 / 2 + 0.1 * (u**2).sum(), value(u), rel_tol=1e-9)
    assert np.isfinite(alchemy.AlchemicalLoss(rows.limit(1), sigma_w=0.3).value_and_slope(u)[0])


def test_splits_are_scored_without_a_kernel_table(spark, x, monkeypatch):
    """In tasks, and in Spark where a split is too large for one."""
    env = vectors(spark, x)
    targets = spark.createDataFrame([(i, float(np.sin(i))) for i in range(40)], "id long, y double")
    want = model_selection.learning_curve(kernels.power_kernel(env, env, 2.0), targets, [10, 20], [2, 1], 8, seed=3, jitter=0.1, delta=1.5).orderBy("n_train").collect()
    for dense_rows in (5000, 15):
        monkeypatch.setattr(regression, "MAX_DENSE", dense_rows)
        got = model_selection.learning_curve_rows(env, targets, [10, 20], [2, 1], 8, 2.0, seed=3, jitter=0.1, delta=1.5).orderBy("n_train").collect()
        assert np.allclose(got, want)
