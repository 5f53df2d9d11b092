import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomloom.jobs import estimators, experiments, run
from atomloom.jobs.pipeline import Pipeline, Step, fingerprint
from atomloom.operators import compression
from atomloom.sources import frames, matrix, scf, shielding
from atomloom.streaming.predict import predict

TINY = """3
Lattice="4 0 0 1 4 0 0 0 5" Properties=species:S:1:pos:R:3:CS:R:1 energy=-1.5 note="two words" pbc="T T F"
H 0.0 0.0 0.0 30.1
O 1.0 0.5 -0.25 200.0
H 1.5 1.0 0.0 29.9
1
Properties=species:S:1:pos:R:3
C 1e-1 2 3
"""


def test_extended_xyz_round_trip(spark, tmp_path):
    (tmp_path / "tiny.xyz").write_text(TINY)
    read = frames.read_frames(spark, str(tmp_path / "*.xyz"))
    rows = read.orderBy("frame_id").collect()
    assert [len(r["atoms"]) for r in rows] == [3, 1]
    assert rows[0]["cell"][1] == [1.0, 4.0, 0.0] and rows[0]["pbc"] == [True, True, False]
    assert rows[0]["info"] == {"energy": "-1.5", "note": "two words"} and rows[0]["atoms"][1]["extra"] == {"CS": "200.0"}
    assert rows[1]["cell"] is None and rows[1]["pbc"] == [False] * 3 and rows[1]["atoms"][0]["x"] == 0.1
    assert frames.read_frames(spark, str(tmp_path / "tiny.xyz"), first=1, last=1).count() == 1
    frames.format_frames(read.orderBy("frame_id").coalesce(1)).write.text(str(tmp_path / "out"))
    again = frames.read_frames(spark, str(tmp_path / "out" / "part-*")).orderBy("frame_id").collect()
    assert [(r["cell"], r["pbc"], r["info"]) for r in again] == [(r["cell"], r["pbc"], r["info"]) for r in rows]
    assert frames.atoms_of(read).count() == 4


def log_text() -> tuple[str, dict]:
    rng, lines, total = np.random.default_rng(0), [], {}
    lines += ["  Macroscopic shape contribution in ppm:", "  1.0 0.0 0.1", "  0.0 2.0 0.0", "  0.1 0.0 3.0", ""]
    for name in (*shielding.LOCAL, "Total"):
        for atom in (1, 2, 3):
            t = np.round(rng.normal(size=(3, 3)) * 10, 2)
            if name == "core":
                t = np.eye(3) * round(float(t[0, 0]), 2)
            if name == "Total":
                t = total[atom] + np.array([[1.0, 0, 0.1], [0, 2, 0], [0.1, 0, 3]])
            total[atom] = t if name == "core" else total[atom] + (t if name != "Total" else 0)
            lines.append(f"  Atom {atom}  C   pos: (  0.1  -0.2  0.3 )  {name}  sigma:  {np.trace(t) / 3:.2f}")
            if name != "core":
                lines += ["  " + "  ".join(f"{v:.4f}" for v in row) for row in t] + [""]
    return "\n".join(lines), total


def test_shielding_log(spark):
    text, local = log_text()
    logs = spark.createDataFrame([("a.out", text)], "path string, text string")
    records = shielding.contributions(logs)
    assert {r["name"]: r["count"] for r in records.groupBy("name").count().collect()} == {n: 3 for n in (*shielding.LOCAL, "Total")}
    macro = shielding.macroscopic(logs).first()["tensor"]
    assert macro == [1.0, 0.0, 0.1, 0.0, 2.0, 0.0, 0.1, 0.0, 3.0]
    summed = {r["atom"]: np.array(r["tensor"]) for r in shielding.local_shielding(records).collect()}
    for r in shielding.total_shielding(records).collect():
        assert np.allclose(summed[r["atom"]], local[r["atom"]].ravel(), atol=1e-3)
        assert np.allclose(summed[r["atom"]] + macro, r["tensor"], atol=1e-3)
    iso = records.filter("name <> 'core'").select("value", shielding.isotropic(F.col("tensor")).alias("iso")).collect()
    assert all(abs(r["value"] - r["iso"]) <= 0.0101 for r in iso)


def test_pipeline_restarts_at_the_longest_prefix(spark, tmp_path):
    calls = []

    def times(df, by):
        calls.append(by)
        return df.withColumn("v", F.col("v") * by)

    df = spark.range(5).withColumnRenamed("id", "v")
    steps = lambda b: [Step("a", times, {"by": 2}), Step("b", times, {"by": b})]
    folder = str(tmp_path / "kept")
    first = Pipeline(steps(3), folder).run(df)
    assert sorted(r["v"] for r in first.collect()) == [0, 6, 12, 18, 24] and calls == [2, 3]
    Pipeline(steps(3), folder).run(df)
    assert calls == [2, 3]
    Pipeline(steps(5), folder).run(df)
    assert calls == [2, 3, 5]
    Pipeline(steps(5), folder).run(df, targets=df)  # other targets, other results
    assert calls == [2, 3, 5, 2, 5]
    assert fingerprint(df) == fingerprint(df.orderBy(F.desc("v"))) != fingerprint(df.union(df))


def test_predictions_on_a_stream(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(20, 3))
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "env_id long, features array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    active, alpha = rows.filter("env_id < 4"), spark.createDataFrame([(i, i - 1.5) for i in range(4)], "id long, alpha double")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = predict(stream, active, alpha, zeta=2.0).writeStream.format("memory").queryName("predicted").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = {r["env_id"]: r["y_pred"] for r in spark.table("predicted").collect()}
    assert np.allclose([got[i] for i in range(20)], (x @ x[:4].T) ** 2 @ (np.arange(4) - 1.5))


def test_scf_log(spark):
    text = """
     lattice parameter (alat)  =      10.0000  a.u.
               a(1) = (   1.000000   0.000000   0.000000 )
               a(2) = (   0.000000   2.000000   0.000000 )
               a(3) = (   0.500000   0.000000   1.500000 )
     site n.     atom                  positions (alat units)
         1           C   tau(   1) = (   0.1000000   0.2000000  -0.3000000  )
         2           H   tau(   2) = (   0.0000000   0.5000000   1.0000000  )
"""
    logs = spark.createDataFrame([("a", text)], "path string, text string")
    unit = 10 * scf.BOHR
    assert np.allclose(scf.cells(logs).first()["cell"], np.array([[1, 0, 0], [0, 2, 0], [0.5, 0, 1.5]]) * unit)
    rows = scf.sites(logs).orderBy("atom_idx").collect()
    assert [(r["atom_idx"], r["symbol"]) for r in rows] == [(0, "C"), (1, "H")] and np.allclose([rows[0][c] for c in "xyz"], np.array([0.1, 0.2, -0.3]) * unit)


def test_models_and_matrices_come_back(spark, tmp_path):
    active = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "env_id long, features array<double>")
    alpha = spark.createDataFrame([(0, 0.5), (1, -1.0)], "id long, alpha double")
    matrix.save_model(alpha, active, {"zeta": 2}, str(tmp_path / "m"))
    a, b, params = matrix.load_model(spark, str(tmp_path / "m"))
    assert params == {"zeta": 2} and sorted(map(tuple, a.collect())) == [(0, 0.5), (1, -1.0)]
    assert sorted((r["env_id"], r["features"]) for r in b.collect()) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_queries_run_from_the_command_line(spark, tmp_path):
    run.main(["--tables", "/root/testdata/sf0.001", "--out", str(tmp_path), "kfold", "distinct_species"])
    assert spark.read.parquet(str(tmp_path / "kfold")).count() == 500 and spark.read.parquet(str(tmp_path / "distinct_species")).count() == 4


def test_columns_of_atoms_and_vectors_are_kept(spark, tmp_path):
    (tmp_path / "a.xyz").write_text('2\nLattice="5 0 0 0 6 0 0 0 7" Properties=species:S:1:pos:R:3:charge:R:1:force:R:3 energy=-1.5\nO 0 0 0 0.25 1 2 3\nH 1 0 0 -0.5 4 5 6\n')
    given = frames.read_frames(spark, str(tmp_path / "a.xyz"))
    frames.write_frames(given, str(tmp_path / "out"))
    files = frames.read_frame_files(spark, str(tmp_path / "out" / "*.txt"))
    assert files.schema == given.schema
    assert files.drop("path").collect() == frames.read_frames(spark, str(tmp_path / "out" / "*.txt")).drop("path").collect()
    again = frames.read_frames(spark, str(tmp_path / "out" / "*.txt"))
    keys = lambda f: [(r["symbol"], r["x"], r["extra"]) for r in frames.atoms_of(f).orderBy("atom_idx").collect()]
    assert keys(again) == keys(given) and keys(given)[0][2] == {"charge": "0.25", "force": "1 2 3"}
    (tmp_path / "y.dat").write_text("1.5\n-2\n\n3e1\n")
    assert sorted(map(tuple, frames.read_vector(spark, str(tmp_path / "y.dat")).collect())) == [(0, 1.5), (1, -2.0), (2, 30.0)]


def test_jobs_take_parameters(spark, tmp_path):
    tables, out = "/root/testdata/sf0.001", str(tmp_path)
    config = {"features": f"{tables}/embeddings.parquet", "train_sizes": [40, 80], "n_repeats": [2, 1], "test_size": 50, "zeta": 2.0, "jitter": 1e-2, "delta": 1.0, "seed": 3}
    (tmp_path / "lc.json").write_text(json.dumps(config))
    experiments.main(["learning-curve", "--config", str(tmp_path / "lc.json"), "--out", f"{out}/lc"])
    assert sorted(r["n_train"] for r in spark.read.parquet(f"{out}/lc").collect()) == [40, 80]
    experiments.main(["sparse-sweep", "--features", f"{tables}/embeddings.parquet", "--active", "10", "20", "--scale", "0.5", "2", "--delta", "1", "2", "--folds", "3", "--out", f"{out}/sweep"])
    assert spark.read.parquet(f"{out}/sweep").count() == 8
    experiments.main(["kernel-cv", "--features", f"{tables}/embeddings.parquet", "--delta", "1", "--folds", "2", "--first", "60", "--out", f"{out}/cv"])
    assert spark.read.parquet(f"{out}/cv").count() == 1


def test_texts_without_frames(spark):
    texts = spark.createDataFrame([("a", None), ("b", ""), ("c", "1\n\nC 0 0 1\n\n1\nk=2\nH 1 2 3\n")], "path string, text string")
    rows = frames.parse_texts(texts).orderBy("frame_id").collect()
    assert [(r["path"], r["frame_id"], r["info"], r["atoms"][0]["z"]) for r in rows] == [("c", 0, {}, 1.0), ("c", 1, {"k": "2"}, 3.0)]


@pytest.mark.parametrize("bytes_a_task", [37, 64, 200, 10**6])
def test_one_file_is_read_by_several_tasks(spark, tmp_path, bytes_a_task):
    """Blocks that cut frames anywhere; comments that are blank or a number, frames without atoms, blank lines between frames, a frame longer than blocks."""
    rng = np.random.default_rng(0)
    texts = []
    for i in range(40):
        n = [3, 0, 1, 25][i % 4]
        comment = ["", "7", f'k="a b" i={i}', "12 "][int(rng.integers(4))]
        texts.append(f"{n}\n{comment}\n" + "".join(f"C {i} {j} 0.5\n" for j in range(n)) + "\n" * int(rng.integers(0, 2)))
    (tmp_path / "f").mkdir()
    for name, some in (("a.xyz", texts), ("b.xyz", texts[::-1]), ("c.xyz", [])):
        (tmp_path / "f" / name).write_text("".join(some))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_a_task)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        if bytes_a_task < 1000:
            assert spark.read.text(str(tmp_path / "f" / "a.xyz")).rdd.getNumPartitions() > 5
        key = lambda r: (r["path"].rsplit("/", 1)[1], r["frame_id"])
        got = sorted(((key(r), [tuple(a) for a in r["atoms"]]) for r in frames.read_frame_files(spark, str(tmp_path / "f")).collect()), key=str)
        few = sorted(key(r) for r in frames.read_frame_files(spark, str(tmp_path / "f"), first=7, last=9).collect())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    want = []
    for name, some in (("a.xyz", texts), ("b.xyz", texts[::-1])):
        want += [((name, i), [(j, "C", *map(float, a.split()[1:]), {}) for j, a in enumerate(t.rstrip("\n").split("\n")[2:] if int(t.split()[0]) else [])]) for i, t in enumerate(some)]
    assert got == sorted(want, key=str)
    assert few == [(n, i) for n in ("a.xyz", "b.xyz") for i in (7, 8, 9)]


def test_kept_frames_are_read_by_range(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("".join(f"1\n\nC {i} 0 0\n" for i in range(50)))
    frames.store_frames(frames.read_frame_files(spark, str(tmp_path / "a.xyz")), str(tmp_path / "kept"))
    found = frames.load_frames(spark, str(tmp_path / "kept"), first=10, last=12)
    assert [r["atoms"][0]["x"] for r in found.orderBy("frame_id").collect()] == [10.0, 11.0, 12.0]
    assert "GreaterThanOrEqual(frame_id,10), LessThanOrEqual(frame_id,12)" in found._jdf.queryExecution().toString()


def test_a_cut_file_is_an_error(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("2\n\nC 0 0 0\n")
    with pytest.raises(Exception, match="lacks lines"):
        frames.read_frame_files(spark, str(tmp_path / "a.xyz")).collect()


def test_vectors_of_several_blocks(spark, tmp_path):
    (tmp_path / "y.dat").write_text("".join(f"{i / 4}\n" for i in range(300)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 100)
        assert sorted(map(tuple, frames.read_vector(spark, str(tmp_path / "y.dat")).collect())) == [(i, i / 4) for i in range(300)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_fingerprints_of_periodic_files(spark, tmp_path):
    """Frames of two files stay apart, and atoms that meet across the boundary are neighbours."""
    frame = lambda *rows: f'{len(rows)}\nLattice="5 0 0 0 5 0 0 0 5" pbc="T T T"\n' + "".join(f"{s} {x} 2 2\n" for s, x in rows)
    (tmp_path / "a.xyz").write_text(frame(("C", 0.1), ("O", 4.9)))
    (tmp_path / "b.xyz").write_text(frame(("C", 2.1), ("O", 1.9)) + frame(("C", 0.1), ("O", 2.6)))
    experiments.main(["fingerprints", "--frames", str(tmp_path / "*.xyz"), "--species", "C", "O", "--rc", "2", "--nmax", "2", "--lmax", "1", "--out", str(tmp_path / "out")])
    found = {(r["path"][-5:], r["frame_id"]): np.array(r["features"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(found) == {("a.xyz", 0), ("b.xyz", 0), ("b.xyz", 1)}
    assert np.allclose(found["a.xyz", 0], found["b.xyz", 0]) and not np.allclose(found["a.xyz", 0], found["b.xyz", 1])


def test_optimisation_jobs(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, i % 20, float(np.sin(i % 20)), rng.normal(size=8).tolist()) for i in range(60)]
    spark.createDataFrame(rows, "env_id long, frame_id long, y double, features array<double>").write.parquet(str(tmp_path / "x"))
    common = ["--features", str(tmp_path / "x"), "--steps", "2"]
    for name, more in (("noise", ["--start", "0.5"]), ("frames", ["--angular", "2", "--start", "0.5", "1", "1"])):
        experiments.main(["optimise", *common, "--loss", name, "--active", "6", "--folds", "3", "--jitter", "1e-6", *more, "--out", str(tmp_path / name)])
        found = {r["name"]: (r["start"], r["end"]) for r in spark.read.parquet(str(tmp_path / name)).collect()}
        assert len(found) == 1 + len(more) - (1 if name == "noise" else 3) and found["loss"][1] <= found["loss"][0]
    compressor = compression.Compressor(compression.Shape(2, 1, 2), "species", np.eye(2))
    (tmp_path / "c.json").write_text(json.dumps(compressor.pack()))
    experiments.main(["optimise", *common, "--loss", "legs", "--compressor", str(tmp_path / "c.json"), "--active", "6", "--start", "0.5", "1", "1", "--folds", "3", "--jitter", "1e-6", "--out", str(tmp_path / "legs")])
    found = {r["name"]: (r["start"], r["end"]) for r in spark.read.parquet(str(tmp_path / "legs")).collect()}
    assert set(found) == {"loss", "scale", "weight_0", "weight_1"} and found["loss"][1] < found["loss"][0]
    experiments.main(["species", *common, "--species", "6", "8", "--keep", "1", "--rounds", "1", "--sigma-w", "0.1", "--out", str(tmp_path / "u")])
    found = spark.read.parquet(str(tmp_path / "u")).orderBy("round").collect()
    assert [r["round"] for r in found] == [0, 1] and found[1]["rmse"] < found[0]["rmse"] and np.array(found[0]["kappa"]).shape == (2, 2)


def test_a_part_of_a_matrix_reads_its_blocks_only(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(40, 30)) * (np.random.default_rng(3).uniform(size=(40, 30)) < 0.4)
    entries = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(30)], "i long, j long, k double")
    matrix.save_blocks(entries, str(tmp_path / "m"), {"zeta": 2}, block=8, least=1e-13)
    everything, metadata = matrix.load_blocks(spark, str(tmp_path / "m"))
    assert metadata == {"zeta": 2, "block": 8} and everything.agg(F.sum("n")).first()[0] == (x != 0).sum() and everything.count() == 20
    rows, columns = spark.createDataFrame([(9,), (12,), (15,), (99,)], "id long"), spark.createDataFrame([(3,), (29,)], "id long")
    met, _ = matrix.load_blocks(spark, str(tmp_path / "m"), rows=rows, columns=columns)
    assert {(r["bi"], r["bj"]) for r in met.collect()} == {(1, 0), (1, 3)}
    assert "PushedFilters: [In(bi, [1,12]), In(bj, [0,3])]" in met._jdf.queryExecution().toString()
    got = {(r["i"], r["j"]): r["k"] for r in matrix.sub_matrix(spark, str(tmp_path / "m"), rows, columns).collect()}
    assert got == {(i, j): x[i, j] for i in (9, 12, 15) for j in (3, 29) if x[i, j]}


def test_a_fitted_model_comes_back_in_another_session(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 16))
    rows = spark.createDataFrame([(i, i % 12, v.tolist()) for i, v in enumerate(x)], "env_id long, frame_id long, features array<double>")
    y = spark.createDataFrame([(i, float(np.sin(v[0]))) for i, v in enumerate(x[:50])], "id long, y double")
    for last in (estimators.KernelRidge(zeta=2.0, jitter=1e-2), estimators.LowRank(active=8, scale=0.5, zeta=2.0, jitter=1e-6)):
        steps = [("thin", estimators.Farthest(n=30, zeta=2.0)), ("compress", estimators.Compress(shape=[2, 2, 1], kind="species", keep=2)), ("map", estimators.Farthest(n=9, act_on="feature map")), ("model", last)]
        model = estimators.Model(steps).fit(rows.filter("env_id < 50"), y)
        want = {r["id"]: r["y_pred"] for r in model.predict(rows).collect()}
        model.save(spark, str(tmp_path / type(last).__name__))
        again = estimators.Model.load(spark.newSession(), str(tmp_path / type(last).__name__))
        assert again.params == model.params and [type(s) for _, s in again.steps] == [type(s) for _, s in steps]
        got = {r["id"]: r["y_pred"] for r in again.predict(rows).collect()}
        assert set(got) == set(range(60)) and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    with pytest.raises(TypeError):
        steps[0][1].predict(rows)


def test_farthest_selection_of_samples_frames_and_features(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 6))
    rows = spark.createDataFrame([(i, i % 8, v.tolist()) for i, v in enumerate(x)], "env_id long, frame_id long, features array<double>")
    thin = estimators.Farthest(n=5)
    kept = {r["env_id"] for r in thin.fit_transform(rows).collect()}
    assert kept == {r["id"] for r in thin.ranked().collect()} and len(kept) == 5 and thin.transform(rows).count() == 40
    everything = estimators.Farthest(n=5).fit(rows, dry_run=True).ranked().orderBy("rank").collect()
    assert len(everything) == 40 and {r["id"] for r in everything[:5]} == kept
    frames_ = estimators.Farthest(n=3, frames=True).fit_transform(rows).groupBy("frame_id").count().collect()
    assert len(frames_) == 3 and {r["count"] for r in frames_} == {5}
    ids = estimators.Farthest(n=4, act_on="feature").fit(rows, dry_run=True)
    assert sorted(ids.ranked()) == list(range(6))
    assert {r["env_id"]: r["features"] for r in ids.transform(rows).collect()} == {i: x[i, ids.ranked()[:4]].tolist() for i in range(40)}
    low = x[:, :3] @ rng.normal(size=(3, 6))
    flat = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(low)], "env_id long, features array<double>")
    mapped = estimators.Farthest(n=3, act_on="feature map").fit_transform(flat).orderBy("env_id").collect()
    assert np.allclose([np.linalg.norm(r["features"]) for r in mapped], np.linalg.norm(low, axis=1))
