"""Command line of experiments with parameters: learning curves, validation over strengths, sweeps of low-rank models, fingerprints, optimisation of weights and of species.

    python -m atomloom.jobs.experiments learning-curve --config lc.json --out DIR
    python -m atomloom.jobs.experiments kernel-cv --features DIR --delta 0.5 1 2 --out DIR
    python -m atomloom.jobs.experiments sparse-sweep --features DIR --active 100 1000 --scale 0.5 2 --delta 1 --out DIR
    python -m atomloom.jobs.experiments fingerprints --frames 'PATH.xyz' --species H C N O --out DIR
    python -m atomloom.jobs.experiments optimise --features DIR --loss frames --angular 6 --active 100 --start 0.5 1 1 1 1 1 1 --out DIR
    python -m atomloom.jobs.experiments optimise --features DIR --loss legs --compressor FILE.json --active 1000 --start 0.5 1 1 --out DIR
    python -m atomloom.jobs.experiments species --features DIR --species 1 6 7 8 --keep 2 --sigma-w 1e-3 --sigma-u 1e-3 --out DIR

Feature tables are Parquet with vec_id, embedding and label (id, features and target), or with
env_id, features and y, and frame_id where frames matter; results are Parquet.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import atomloom
from atomloom.operators import alchemy, compression, descriptors, model_selection, regression, scaled_loss, scores, selection, splits
from atomloom.sources.frames import atoms_of, read_frames

cloudpickle.register_pickle_by_value(atomloom)


def feature_table(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(env_id, features, y); ``first`` keeps the rows of smaller ids."""
    rows = spark.read.parquet(path)
    names = ("env_id", "features", "y") if "env_id" in rows.columns else ("vec_id", "embedding", "label")
    rows = rows.select(*(F.col(n).cast(t).alias(a) for n, a, t in zip(names, ("env_id", "features", "y"), ("long", "array<double>", "double"))))
    return rows if first is None else rows.filter(F.col("env_id") < first)


def learning_curve(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """All of it from one JSON file: features, train_sizes, n_repeats, test_size, zeta, jitter, delta, seed."""
    config = json.loads("\n".join(r["value"] for r in spark.read.text(args.config, wholetext=True).collect()))
    rows = feature_table(spark, config["features"])
    y = rows.select(F.col("env_id").alias("id"), "y")
    return model_selection.learning_curve_rows(rows, y, config["train_sizes"], config["n_repeats"], config["test_size"], config.get("zeta", 2.0), seed=config.get("seed", 10), jitter=config.get("jitter", 1e-8), delta=config.get("delta", 1.0))


def kernel_cv(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Mean scores over folds of exact models, for each strength of the kernel."""
    rows = feature_table(spark, args.features, args.first)
    y = rows.select(F.col("env_id").alias("id"), "y")
    folds = splits.k_fold(y.select("id"), args.folds)

    def score(delta: float) -> DataFrame:
        found = regression.krr_fast_cv_rows(rows, y, folds, args.zeta, jitter=args.jitter, delta=delta).join(y, "id").withColumn("all", F.lit(1))
        return scores.mean_scores(scores.scores(found, ["all", "fold"]), ["all"]).drop("all")

    return model_selection.grid_search({"delta": args.delta}, score)


def sparse_sweep(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Mean scores over folds of low-rank models: sizes of the active set, picked far apart, by strengths of the kernel and noise scales."""
    rows = feature_table(spark, args.features, args.first)
    folds = splits.k_fold(rows.select("env_id"), args.folds, key="env_id")
    ranked = selection.farthest_points(rows.select("env_id", "features"), max(args.active)).select(F.col("id").alias("env_id"), "rank").persist()

    def score(n_active: int, delta: float) -> DataFrame:
        active = rows.join(ranked.orderBy("rank").limit(n_active), "env_id", "left_semi").select("env_id", "features")
        # delta**2 k with noise scale s is k with s / delta: the same predictions.
        found = model_selection.sor_cross_validate(rows, active, folds, zeta=args.zeta, scales=[s / delta for s in args.scale], jitter=args.jitter)
        return scores.mean_scores(found.withColumn("scale", F.col("scale") * delta), ["scale"])

    return model_selection.grid_search({"n_active": args.active, "delta": args.delta}, score)


def fingerprints(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The mean spectrum of each frame of extended-XYZ files, by path and frame number; species are symbols, in the order given. Periodic frames meet their images."""
    at = F.create_map(*(F.lit(x) for k, s in enumerate(args.species) for x in (s, k)))
    frames = read_frames(spark, args.frames)
    atoms = atoms_of(frames).withColumn("species", F.element_at(at, F.col("symbol"))).filter("species IS NOT NULL")
    cells, centres = frames.select("path", "frame_id", "cell", "pbc"), [args.species.index(s) for s in args.centres or args.species]
    size = {"rc": args.rc, "nmax": args.nmax, "lmax": args.lmax, "sigma": args.width}
    return descriptors.describe(atoms, list(range(len(args.species))), **size, mean=True, cells=cells, by=("path", "frame_id"), centres=centres)


def optimise(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(name, start, end): the cross-validated loss, the noise scale and the weights before and after descent by their slopes.

    Losses: ``noise`` has the scale alone; ``legs`` the factors of a stored compressor; ``frames`` one weight
    for each l, on kernels that are averaged over the environments of frames. Active ones are picked far apart.
    """
    rows = spark.read.parquet(args.features)
    rows = rows.select("env_id", "features", "y", *(["frame_id"] if args.loss == "frames" else [])) if "env_id" in rows.columns else rows.selectExpr("vec_id AS env_id", "cast(embedding AS array<double>) AS features", "cast(label AS double) AS y")
    if args.loss == "frames":
        scaling, env = scaled_loss.Scaling(scaled_loss.angular_index(len(rows.first()["features"]), args.angular)), rows.select("frame_id", "features")
        y = rows.groupBy("frame_id").agg(F.avg("y").alias("y"))
        means = descriptors.frame_means(env).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("p")).select(F.col("frame_id").alias("env_id"), F.col("p.v").alias("features"))
    else:
        legs = args.loss == "legs"
        if legs:
            compressor = compression.Compressor.unpack(json.loads("\n".join(r["value"] for r in spark.read.text(args.compressor, wholetext=True).collect())))
            rows = replace(compressor, factors=None).transform(rows, normalise=False)
        scaling = scaled_loss.Scaling(scaled_loss.leg_index(compressor.small, compressor.kind)) if legs else scaled_loss.Scaling(np.zeros((len(rows.first()["features"]), 0), int), normalise=False)
        env, y, means = rows.select(F.col("env_id").alias("frame_id"), "features"), rows.select(F.col("env_id").alias("frame_id"), "y"), rows.select("env_id", "features")
    folds = splits.k_fold(y.select(F.col("frame_id").alias("id")), args.folds).select(F.col("id").alias("frame_id"), "fold")
    active = env.join(selection.farthest_points(means, args.active).select(F.col("id").alias("frame_id")), "frame_id", "left_semi")
    loss = scaled_loss.ScaledLoss(env, y.join(folds, "frame_id"), active, scaling, zeta=args.zeta, jitter=args.jitter)
    start = np.array(args.start, float)
    before = loss.value(start)
    x, after = alchemy.minimise(None, np.array([np.log(start[0]), *start[1:]]), steps=args.steps, gradient=model_selection.by_log_scale(loss), ftol=args.ftol)
    loss.remove()
    names = ["loss", "scale", *(f"weight_{k}" for k in range(len(start) - 1))]
    return spark.createDataFrame(list(zip(names, [before, *start.tolist()], [after, float(np.exp(x[0])), *x[1:].tolist()])), "name string, start double, end double")


def species(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """(round, rmse, u, kappa) of a reduced basis of species, learnt by descent from that of their similarity: u by species, and its products."""
    rows = feature_table(spark, args.features).select(F.col("env_id").alias("id"), "features", "y")
    _, start = alchemy.leading_vectors(alchemy.element_similarity(alchemy.elements(spark).filter(F.col("z").isin(args.species))), args.keep)
    if len(start) != len(args.species):
        raise ValueError("a species has no electronegativity or radius")
    found, _ = alchemy.alchemical_descent(alchemy.centred(rows), start, sigma_w=args.sigma_w, sigma_u=args.sigma_u, rounds=args.rounds, steps=args.steps)
    return spark.createDataFrame([(n, e, u.tolist(), (u @ u.T).tolist()) for n, (u, e) in enumerate(found)], "round long, rmse double, u array<array<double>>, kappa array<array<double>>")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = parser.add_subparsers(required=True)

    def job(name: str, run, *options: tuple[str, dict]) -> None:
        own = jobs.add_parser(name, help=run.__doc__.split("\n")[0])
        own.set_defaults(run=run)
        for option, kind in (*options, ("--out", {"required": True})):
            own.add_argument(option, **kind)

    model = (
        ("--features", {"required": True}), ("--first", {"type": int}), ("--folds", {"type": int, "default": 5}), ("--zeta", {"type": float, "default": 2.0}),
        ("--jitter", {"type": float, "default": 1e-8}), ("--delta", {"type": float, "nargs": "+", "default": [1.0]}),
    )
    job("learning-curve", learning_curve, ("--config", {"required": True}))
    job("kernel-cv", kernel_cv, *model)
    job("sparse-sweep", sparse_sweep, *model, ("--active", {"type": int, "nargs": "+", "required": True}), ("--scale", {"type": float, "nargs": "+", "default": [1.0]}))
    job(
        "fingerprints", fingerprints, ("--frames", {"required": True}), ("--species", {"nargs": "+", "required": True}), ("--rc", {"type": float, "default": 3.5}),
        ("--centres", {"nargs": "+"}), ("--nmax", {"type": int, "default": 6}), ("--lmax", {"type": int, "default": 6}), ("--width", {"type": float, "default": 0.4}),
    )
    descent = (("--features", {"required": True}), ("--steps", {"type": int, "default": 10}))
    job(
        "optimise", optimise, *descent, ("--loss", {"choices": ["noise", "legs", "frames"], "required": True}), ("--start", {"type": float, "nargs": "+", "required": True}),
        ("--active", {"type": int, "required": True}), ("--angular", {"type": int, "default": 1}), ("--compressor", {}), ("--folds", {"type": int, "default": 5}),
        ("--zeta", {"type": float, "default": 1.0}), ("--jitter", {"type": float, "default": 1e-8}), ("--ftol", {"type": float, "default": 1e-6}),
    )
    job(
        "species", species, *descent, ("--species", {"type": int, "nargs": "+", "required": True}), ("--keep", {"type": int, "default": 2}), ("--rounds", {"type": int, "default": 50}),
        ("--sigma-w", {"type": float, "default": 1e-3}), ("--sigma-u", {"type": float, "default": 0.0}),
    )
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("atomloom").getOrCreate()
    args.run(spark, args).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
