"""Every registered query of the analytics part, with the SQL that it is checked against.

Environments are the rows of ``embeddings`` (frame: label); atoms place them at ten times their
first three components (species: label modulo 4); predictions come from ``lineitem`` and ``part``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomloom.functions import geometry, vectors
from atomloom.operators import alchemy, compression, descriptors, kernels, low_rank, matrix_free, model_selection, neighbours, regression, scaled_loss, scores, selection, splits
from atomloom.sources import frames, scf, shielding
from atomloom.tables import environments, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ZETA = 2.0
RC = 2.5
SHAPE = compression.Shape(species=2, radial=2, angular=4)
#: A fixed projection for the checks: one row for each new index.
FIXED_U = np.array([[0.8, 0.6], [-0.6, 0.8]])

ENV = "env AS (SELECT vec_id AS env_id, label::BIGINT AS frame_id, embedding::DOUBLE[] AS f FROM embeddings)"
ATOMS = """atoms AS (SELECT vec_id AS atom_idx, label::BIGINT AS frame_id, (label % 4)::BIGINT AS species,
  10 * embedding[1]::DOUBLE AS x, 10 * embedding[2]::DOUBLE AS y, 10 * embedding[3]::DOUBLE AS z FROM embeddings)"""
PRED = "pred AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_extendedprice AS y, l_quantity * p_retailprice AS y_pred FROM lineitem JOIN part ON l_partkey = p_partkey)"
FLAT = "flat AS (SELECT env_id, frame_id, unnest(f) AS v, generate_subscripts(f, 1) - 1 AS i FROM env)"


def query(name: str, sql: str | None = None):
    """Register a query by ``name``, and the SQL with the same result if there is any."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: (10 * F.col("embedding")[k].cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("frame_id"), F.col("vec_id").alias("atom_idx"), (F.col("label") % 4).cast("long").alias("species"),
        at(0).alias("x"), at(1).alias("y"), at(2).alias("z"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the price its part would give; AQE broadcasts part only while it is small."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("y"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return lines.join(parts, "l_partkey").select("l_orderkey", "l_returnflag", "l_linenumber", "y", (F.col("l_quantity") * F.col("p_retailprice")).alias("y_pred"))


def targets(env: DataFrame) -> DataFrame:
    return env.select(F.col("env_id").alias("id"), F.col("frame_id").cast("double").alias("y"))


def ids(env: DataFrame) -> DataFrame:
    return env.select(F.col("env_id").alias("id"))


def rounded(df: DataFrame, *names: str, places: int = 9) -> DataFrame:
    """``names`` rounded, and -0.0 as 0.0, so equal results have equal values in any engine."""
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n in names})


# Kernels


@query("kernel_power_pairs", f"WITH {ENV} SELECT a.env_id AS i, b.env_id AS j, round(list_dot_product(a.f, b.f) ** 2, 9) + 0.0 AS k FROM env a, env b")
def kernel_power_pairs(spark, sf_dir):
    env = environments(spark, sf_dir)
    return kernels.power_kernel(env, env, ZETA, places=9)


@query("kernel_power_triangle_mirror", ORACLES["kernel_power_pairs"])
def kernel_power_triangle_mirror(spark, sf_dir):
    return kernels.power_kernel_symmetric(environments(spark, sf_dir), ZETA, places=9)


@query("kernel_group_avg", f"WITH {ENV} SELECT a.frame_id AS frame_i, b.frame_id AS frame_j, round(avg(list_dot_product(a.f, b.f) ** 2), 9) + 0.0 AS k FROM env a, env b GROUP BY ALL")
def kernel_group_avg(spark, sf_dir):
    env = environments(spark, sf_dir)
    return rounded(kernels.group_kernel(env, env, ZETA), "k")


FOLDED = "folded AS (SELECT env_id, frame_id, f, ntile(3) OVER (ORDER BY env_id) - 1 AS fold FROM env)"


@query("kernel_rect_train_test", f"WITH {ENV}, {FOLDED} SELECT a.env_id AS i, b.env_id AS j, round(list_dot_product(a.f, b.f) ** 2, 9) + 0.0 AS k FROM folded a, folded b WHERE a.fold = 0 AND b.fold <> 0")
def kernel_rect_train_test(spark, sf_dir):
    env = environments(spark, sf_dir)
    folds = splits.k_fold(env, 3, key="env_id")
    test, train = env.join(folds.filter("fold = 0"), "env_id"), env.join(folds.filter("fold <> 0"), "env_id")
    return kernels.power_kernel(test, train, ZETA, places=9)


@query("kernel_sub", f"WITH {ENV} SELECT a.env_id AS i, b.env_id AS j, round(list_dot_product(a.f, b.f) ** 2, 9) + 0.0 AS k FROM env a, env b WHERE a.frame_id = 0 AND b.frame_id = 1")
def kernel_sub(spark, sf_dir):
    env = environments(spark, sf_dir)
    return rounded(kernels.power_kernel(env.filter("frame_id = 0"), env.filter("frame_id = 1"), ZETA), "k")


@query("kernel_group_gradient", f"""WITH {ENV}, n AS (SELECT frame_id, count(*) AS n FROM env GROUP BY frame_id)
SELECT a.env_id AS i, b.env_id AS j, round((a.frame_id + 2 * b.frame_id) / (na.n * nb.n), 12) + 0.0 AS g
FROM env a JOIN n na ON na.frame_id = a.frame_id, env b JOIN n nb ON nb.frame_id = b.frame_id""")
def kernel_group_gradient(spark, sf_dir):
    env = environments(spark, sf_dir)
    frames = env.select("frame_id").distinct()
    groups = frames.select(F.col("frame_id").alias("frame_i")).crossJoin(frames.select(F.col("frame_id").alias("frame_j"))).withColumn("g", (F.col("frame_i") + 2 * F.col("frame_j")).cast("double"))
    members = env.select("env_id", "frame_id")
    return kernels.spread_entries(rounded(kernels.entry_gradient(groups, members), "g", places=12), members)


# Selection by farthest points, as SQL that picks while ``more`` holds

_FPS_STEPS = """WITH RECURSIVE {source},
step(n, id, d, p) AS (
  SELECT 0, env_id, 'infinity'::DOUBLE, (SELECT min(env_id) FROM {rows}) FROM {rows}
  UNION ALL
  SELECT s.n + 1, s.id, s.e, first_value(s.id) OVER (ORDER BY s.e DESC, s.id)
  FROM (
    SELECT s.n, s.id, least(s.d, list_dot_product(a.f, a.f) ** {zeta} + list_dot_product(b.f, b.f) ** {zeta} - 2 * list_dot_product(a.f, b.f) ** {zeta}) AS e
    FROM step s JOIN {rows} a ON a.env_id = s.id JOIN {rows} b ON b.env_id = s.p) s
  WHERE {more})"""

# Low-rank regression: the active environments are the farthest points, half the square root of the table in number.

_CROSS = "c AS (SELECT m.env_id AS i, e.env_id AS n, e.frame_id::DOUBLE AS y, list_dot_product(m.f, e.f) ** 2 AS k FROM m, env e)"
_SOR = _FPS_STEPS.format(source=ENV, rows="env", zeta=2, more="s.n + 1 < (SELECT ceil(sqrt(count(*)) / 2) FROM env)") + f", m AS (SELECT * FROM env WHERE env_id IN (SELECT p FROM step)), {_CROSS}"
_SOR_2 = f"WITH {ENV}, m AS (SELECT * FROM env WHERE env_id < 2), {_CROSS}"


def active_ids(env: DataFrame) -> list[int]:
    """Farthest points in the order in which they are picked: few, as they are the size of the dense system."""
    n = math.ceil(math.sqrt(env.count()) / 2)
    return [r["id"] for r in selection.farthest_points(env, n, zeta=ZETA).orderBy("rank").collect()]


def with_y(env: DataFrame) -> DataFrame:
    return env.select("env_id", "features", F.col("frame_id").cast("double").alias("y"))


def sor(spark, sf_dir, active: list[int] | None = None):
    env = environments(spark, sf_dir)
    active = active_ids(env) if active is None else active
    return kernels.sor_system(env, env.filter(F.col("env_id").isin(active)), env.select("env_id", F.col("frame_id").cast("double").alias("y")), ZETA, 1.0)


@query("sor_gram", _SOR + """, g AS (SELECT a.i, b.i AS j, sum(a.k * b.k) AS s FROM c a JOIN c b USING (n) GROUP BY a.i, b.i)
SELECT g.i, g.j, round(s + c.k, 7) + 0.0 AS k FROM g JOIN c ON c.i = g.i AND c.n = g.j""")
def sor_gram(spark, sf_dir):
    return rounded(sor(spark, sf_dir)[0], "k", places=7)


@query("sor_rhs", _SOR + " SELECT i, round(sum(k * y), 7) + 0.0 AS b FROM c GROUP BY i")
def sor_rhs(spark, sf_dir):
    return rounded(sor(spark, sf_dir)[1], "b", places=7)


@query("sor_fit_residual", _SOR + " SELECT i, round(sum(k * y), 4) + 0.0 AS b FROM c GROUP BY i")
def sor_fit_residual(spark, sf_dir):
    """(gram + jitter I) alpha of the low-rank fit, which must be its right side again."""
    env = environments(spark, sf_dir)
    active = active_ids(env)
    gram, _, _ = sor(spark, sf_dir, active)
    alpha = low_rank.fit(with_y(env), env.filter(F.col("env_id").isin(active)), ZETA, scale=1.0, jitter=1e-8).persist()
    back = gram.join(alpha.withColumnRenamed("id", "j"), "j").groupBy("i").agg(F.sum(F.col("k") * F.col("alpha")).alias("s"))
    back = back.join(alpha.withColumnRenamed("id", "i"), "i").select("i", (F.col("s") + 1e-8 * F.col("alpha")).alias("b"))
    return rounded(back, "b", places=4)


@query("sor_predict_m2", _SOR_2 + """, g AS (SELECT a.i, b.i AS j, sum(a.k * b.k) AS s FROM c a JOIN c b USING (n) GROUP BY a.i, b.i),
q AS (SELECT g.i, g.j, s + c.k + CASE WHEN g.i = g.j THEN 1e-8 ELSE 0 END AS v FROM g JOIN c ON c.i = g.i AND c.n = g.j),
r AS (SELECT i, sum(k * y) AS b FROM c GROUP BY i),
w AS (SELECT max(v) FILTER (WHERE i = 0 AND j = 0) AS a, max(v) FILTER (WHERE i = 0 AND j = 1) AS b, max(v) FILTER (WHERE i = 1 AND j = 1) AS d FROM q),
t AS (SELECT max(b) FILTER (WHERE i = 0) AS p, max(b) FILTER (WHERE i = 1) AS q FROM r),
s AS (SELECT (p * d - b * q) / (a * d - b * b) AS x0, (a * q - b * p) / (a * d - b * b) AS x1 FROM w, t)
SELECT n AS id, round(sum(k * CASE i WHEN 0 THEN x0 ELSE x1 END), 6) + 0.0 AS y_pred FROM c, s GROUP BY n""")
def sor_predict_m2(spark, sf_dir):
    """Predictions of the fit with two active environments, for which SQL can solve the system."""
    env = environments(spark, sf_dir)
    active = env.filter("env_id < 2")
    alpha = low_rank.fit(with_y(env), active, ZETA, scale=1.0).withColumnRenamed("id", "env_id")
    return rounded(regression.krr_predict_rows(env, active.join(alpha, "env_id"), ZETA), "y_pred", places=6)


# Regression


@query("krr_predict_given_alpha", f"WITH {ENV} SELECT a.env_id AS id, round(4 * sum(list_dot_product(a.f, b.f) ** 2 * ((b.env_id % 7) - 3) / 10.0), 7) + 0.0 AS y_pred FROM env a, env b GROUP BY a.env_id")
def krr_predict_given_alpha(spark, sf_dir):
    env = environments(spark, sf_dir)
    train = env.withColumn("alpha", ((F.col("env_id") % 7) - 3) / 10.0)
    return rounded(regression.krr_predict_rows(env, train, ZETA, delta=2.0), "y_pred", places=7)


@query("krr_fit")
def krr_fit(spark, sf_dir):
    env = environments(spark, sf_dir)
    return rounded(regression.krr_fit_rows(env, targets(env), ZETA, jitter=1e-2), "alpha", places=6)


@query("krr_fast_cv")
def krr_fast_cv(spark, sf_dir):
    env = environments(spark, sf_dir)
    folds = splits.k_fold(ids(env), 3)
    return rounded(regression.krr_fast_cv_rows(env, targets(env), folds, ZETA, jitter=1e-2), "y_pred", places=6)


@query("gaussian_process")
def gaussian_process(spark, sf_dir):
    return _process(environments(spark, sf_dir))


def _process(env: DataFrame) -> DataFrame:
    train, test = env.filter("env_id % 5 <> 0"), env.filter("env_id % 5 = 0")
    found = regression.gaussian_process_rows(train, test, targets(train), ZETA, noise=0.5)
    return rounded(found, "y_pred", "variance", places=6)


@query("conjugate_gradients")
def conjugate_gradients(spark, sf_dir):
    env = environments(spark, sf_dir)
    return rounded(_by_steps(env, 1.0).withColumnRenamed("alpha", "x"), "x", places=4)


def _by_steps(env: DataFrame, jitter: float) -> DataFrame:
    """The fit without a matrix, over four blocks at least."""
    return matrix_free.solve(env, targets(env), ZETA, jitter=jitter, block_rows=min(matrix_free.BLOCK_ROWS, -(-env.count() // 4)))


# Selection

_FPS = _FPS_STEPS.replace("{more}", "s.n < 9") + """
SELECT n::BIGINT AS rank, min(p) AS id FROM step GROUP BY n"""


@query("fps_samples", _FPS.format(source=ENV, rows="env", zeta=2))
def fps_samples(spark, sf_dir):
    return selection.farthest_points(environments(spark, sf_dir), 10, zeta=ZETA).select("rank", "id")


@query("fps_trace", _FPS.format(source=ENV, rows="env", zeta=2).replace("SELECT n::BIGINT AS rank, min(p) AS id FROM step GROUP BY n", "SELECT n::BIGINT AS rank, round(coalesce(lead(max(d)) OVER (ORDER BY n), 0), 9) + 0.0 AS distance FROM step GROUP BY n"))
def fps_trace(spark, sf_dir):
    return rounded(selection.farthest_points(environments(spark, sf_dir), 10, zeta=ZETA).select("rank", "distance"), "distance")


@query("fps_features", _FPS.format(source=f"{ENV}, {FLAT}, cols AS (SELECT i AS env_id, list(v ORDER BY env_id) AS f FROM flat GROUP BY i)", rows="cols", zeta=1))
def fps_features(spark, sf_dir):
    picked = selection.farthest_features(environments(spark, sf_dir), 10)
    return spark.createDataFrame(list(enumerate(picked)), "rank long, id long")


@query("select_features", f"WITH {ENV} SELECT env_id, 0::BIGINT AS k, f[4] AS v FROM env UNION ALL SELECT env_id, 1, f[1] FROM env UNION ALL SELECT env_id, 2, f[11] FROM env")
def select_features(spark, sf_dir):
    picked = environments(spark, sf_dir).select("env_id", F.posexplode(vectors.pick(F.col("features"), [3, 0, 10])).alias("k", "v"))
    return picked.withColumn("k", F.col("k").cast("long"))


@query("select_samples", f"WITH {ENV} SELECT env_id, frame_id, row_number() OVER (ORDER BY env_id DESC) - 1 AS rank FROM env ORDER BY env_id DESC LIMIT 5")
def select_samples(spark, sf_dir):
    env = environments(spark, sf_dir)
    last = env.select(F.col("env_id").alias("id")).orderBy(F.desc("id")).limit(5)
    chosen = last.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("id"))) - 1).cast("long"))
    return selection.select_samples(env, chosen, 5).select("env_id", "frame_id", "rank")


@query("symmetry_filter", f"WITH {ATOMS} SELECT frame_id, atom_idx % 5 AS class_id, min(atom_idx) AS atom_idx FROM atoms GROUP BY ALL")
def symmetry_filter(spark, sf_dir):
    rows = atoms(spark, sf_dir).select("frame_id", (F.col("atom_idx") % 5).alias("class_id"), "atom_idx")
    return selection.symmetry_filter(rows)


@query("symmetry_inverse", f"""WITH {ATOMS}, r AS (SELECT frame_id, atom_idx % 5 AS c, min(atom_idx) AS v FROM atoms GROUP BY ALL)
SELECT frame_id, atom_idx, v AS value FROM atoms JOIN r USING (frame_id) WHERE atom_idx % 5 = c""")
def symmetry_inverse(spark, sf_dir):
    rows = atoms(spark, sf_dir).select("frame_id", (F.col("atom_idx") % 5).alias("class_id"), "atom_idx")
    kept = selection.symmetry_filter(rows).withColumnRenamed("atom_idx", "value")
    return selection.symmetry_inverse(rows, kept)


@query("env_mapping", f"WITH {ATOMS} SELECT frame_id, row_number() OVER (ORDER BY frame_id, atom_idx) - 1 AS env_id FROM atoms WHERE species = 1")
def env_mapping(spark, sf_dir):
    return selection.env_mapping(atoms(spark, sf_dir), 1)


@query("frame_offsets", f"""WITH {ATOMS}, c AS (SELECT frame_id, count(*) AS n FROM atoms WHERE species <> 0 GROUP BY frame_id)
SELECT frame_id, n, coalesce(sum(n) OVER (ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c""")
def frame_offsets(spark, sf_dir):
    return selection.frame_offsets(atoms(spark, sf_dir).filter(~F.col("species").isin(0)))


@query("distinct_species", f"WITH {ATOMS} SELECT DISTINCT species FROM atoms")
def distinct_species(spark, sf_dir):
    return atoms(spark, sf_dir).select("species").distinct()


@query("union_frames", f"WITH {ATOMS} SELECT frame_id, count(*) AS n FROM (SELECT * FROM atoms WHERE frame_id < 6 UNION ALL SELECT * FROM atoms WHERE frame_id >= 4) GROUP BY frame_id")
def union_frames(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return a.filter("frame_id < 6").unionByName(a.filter("frame_id >= 4")).groupBy("frame_id").agg(F.count("*").alias("n"))


@query("holdout_except", f"WITH {ENV}, h AS (SELECT env_id FROM env WHERE env_id % 4 = 1) SELECT env_id FROM env EXCEPT SELECT env_id FROM h")
def holdout_except(spark, sf_dir):
    env = environments(spark, sf_dir).select("env_id")
    return env.join(env.filter("env_id % 4 = 1").select(F.col("env_id").alias("out")), F.col("env_id") == F.col("out"), "left_anti")


# Compression


@query("cov_mean_trace", f"""WITH {ENV}, {FLAT}, p AS (SELECT i, avg(v) * sqrt(2 * (i % 4) + 1) AS p FROM flat GROUP BY i)
SELECT i // 32 AS s, (i // 16) % 2 AS t, round(sum(p) / 8, 9) + 0.0 AS c FROM p WHERE (i // 8) % 2 = (i // 4) % 2 GROUP BY ALL""")
def cov_mean_trace(spark, sf_dir):
    return rounded(compression.species_covariance(environments(spark, sf_dir), SHAPE), "c")


@query("project_fixed_u", f"""WITH {ENV}, {FLAT}, u(a, s, w) AS (VALUES (0, 0, 0.8::DOUBLE), (0, 1, 0.6), (1, 0, -0.6), (1, 1, 0.8))
SELECT env_id, (x.a * 32 + y.a * 16 + i % 16)::BIGINT AS i, round(sum(v * x.w * y.w), 9) + 0.0 AS v
FROM flat JOIN u x ON x.s = i // 32 JOIN u y ON y.s = (i // 16) % 2 GROUP BY ALL""")
def project_fixed_u(spark, sf_dir):
    projected = compression.project(environments(spark, sf_dir), SHAPE, "species", FIXED_U)
    return rounded(projected.select("env_id", F.posexplode("features").alias("i", "v")).withColumn("i", F.col("i").cast("long")), "v")


@query("compress_species", f"""WITH {ENV}, {FLAT}, p AS (SELECT i, avg(v) * sqrt(2 * (i % 4) + 1) AS p FROM flat GROUP BY i),
c AS (SELECT sum(p) FILTER (WHERE i < 16) AS a, sum(p) FILTER (WHERE i >= 16 AND i < 48) / 2 AS b, sum(p) FILTER (WHERE i >= 48) AS d FROM p WHERE (i // 8) % 2 = (i // 4) % 2),
u AS (SELECT cos(atan2(2 * b, a - d) / 2) AS u0, sin(atan2(2 * b, a - d) / 2) AS u1 FROM c),
w AS (SELECT env_id, frame_id, i % 16 AS r, sum(v * CASE WHEN i < 32 THEN u0 ELSE u1 END * CASE WHEN (i // 16) % 2 = 0 THEN u0 ELSE u1 END) AS v FROM flat, u GROUP BY ALL),
g AS (SELECT env_id, frame_id, list(v ORDER BY r) AS g, sqrt(sum(v * v)) AS size FROM w GROUP BY ALL)
SELECT x.frame_id AS frame_i, y.frame_id AS frame_j, round(avg((list_dot_product(x.g, y.g) / x.size / y.size) ** 2), 6) + 0.0 AS k FROM g x, g y GROUP BY ALL""")
def compress_species(spark, sf_dir):
    """The kernel of the compressed spectra with the leading component of themselves: free of the signs of eigenvectors."""
    env = environments(spark, sf_dir)
    u = compression.eigenvectors(compression.covariance(env, SHAPE, "species"), 1)
    small = compression.project(env, SHAPE, "species", u, normalise=True)
    return rounded(kernels.group_kernel(small, small, ZETA), "k", places=6)


@query("pack_symmetric", f"""WITH {ENV}, {FLAT}, u AS (SELECT env_id, i // 8 AS a, i % 8 AS b, v FROM flat WHERE i // 8 <= i % 8)
SELECT env_id, row_number() OVER (PARTITION BY env_id ORDER BY a, b) - 1 AS i, round(CASE WHEN a = b THEN v ELSE v * sqrt(2::DOUBLE) END, 9) + 0.0 AS v FROM u""")
def pack_symmetric(spark, sf_dir):
    packed = environments(spark, sf_dir).select("env_id", F.posexplode(compression.pack_symmetric(F.col("features"), 8)).alias("i", "v"))
    return rounded(packed.withColumn("i", F.col("i").cast("long")), "v")


@query("unlinearise", f"""WITH {ENV}, {FLAT}, g AS (SELECT s, t, n, m, l FROM range(2) a(s), range(2) b(t), range(2) c(n), range(2) d(m), range(6) e(l)),
q AS (SELECT *, 2 * s + n AS i1, 2 * t + m AS j1 FROM g)
SELECT env_id, ((((s * 2 + t) * 2 + n) * 2 + m) * 6 + l)::BIGINT AS k, round(v * CASE WHEN i1 = j1 THEN 1 ELSE sqrt(0.5::DOUBLE) END, 9) + 0.0 AS v
FROM q JOIN flat ON i = (greatest(i1, j1) * (greatest(i1, j1) + 1) // 2 + least(i1, j1)) * 6 + l""")
def unlinearise(spark, sf_dir):
    wide = environments(spark, sf_dir).select("env_id", F.posexplode(compression.unlinearise(F.col("features"), 2, 2, 6)).alias("k", "v"))
    return rounded(wide.withColumn("k", F.col("k").cast("long")), "v")


@query("scale_angular", f"""WITH {ENV}, {FLAT}, s AS (SELECT env_id, i, v * (1 + (i % 4)) / 2 AS v FROM flat)
SELECT env_id, i::BIGINT AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY env_id)), 9) + 0.0 AS v FROM s""")
def scale_angular(spark, sf_dir):
    scaled = compression.scale_angular(F.col("features"), [0.5, 1.0, 1.5, 2.0])
    return rounded(environments(spark, sf_dir).select("env_id", F.posexplode(scaled).alias("i", "v")).withColumn("i", F.col("i").cast("long")), "v")


@query("l2_normalise", f"WITH {ENV}, {FLAT} SELECT env_id, i::BIGINT AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY env_id)), 9) + 0.0 AS v FROM flat")
def l2_normalise(spark, sf_dir):
    flat = environments(spark, sf_dir).select("env_id", F.posexplode(vectors.normalise(F.col("features"))).alias("i", "v"))
    return rounded(flat.withColumn("i", F.col("i").cast("long")), "v")


@query("frame_mean_features", f"WITH {ENV}, {FLAT} SELECT frame_id, i::BIGINT AS i, round(avg(v), 9) + 0.0 AS v FROM flat GROUP BY ALL")
def frame_mean_features(spark, sf_dir):
    return rounded(descriptors.frame_means(environments(spark, sf_dir)).withColumn("i", F.col("i").cast("long")), "v")


@query("sparse_features", f"WITH {ENV}, {FLAT} SELECT env_id, i::BIGINT AS i, v FROM flat WHERE abs(v) >= 0.2")
def sparse_features(spark, sf_dir):
    return environments(spark, sf_dir).select("env_id", F.explode(vectors.drop_small(F.col("features"), 0.2)).alias("p")).select("env_id", "p.i", "p.v")


@query("embed_species", f"""WITH {ENV}, {FLAT}, r AS (SELECT frame_id, frame_id % 2 AS s, (i // 16) % 2 AS t, i % 16 AS i, v FROM flat),
m AS (SELECT frame_id, s, t, i, avg(v) AS v FROM r GROUP BY ALL), k AS (SELECT DISTINCT frame_id FROM r)
SELECT k.frame_id, a.s::BIGINT AS s, b.t::BIGINT AS t, c.i::BIGINT AS i, round(coalesce(m.v, 0), 9) + 0.0 AS v
FROM k, range(2) a(s), range(2) b(t), range(16) c(i) LEFT JOIN m ON m.frame_id = k.frame_id AND m.s = a.s AND m.t = b.t AND m.i = c.i""")
def embed_species(spark, sf_dir):
    i = F.col("i").cast("long")
    flat = environments(spark, sf_dir).select("frame_id", F.posexplode("features").alias("i", "v"))
    rows = flat.select("frame_id", (F.col("frame_id") % 2).alias("s"), (F.floor(i / 16) % 2).alias("t"), (i % 16).alias("i"), "v")
    two = spark.range(2)
    grid = two.select(F.col("id").alias("s")).join(F.broadcast(two.select(F.col("id").alias("t"))))
    return rounded(descriptors.embed_species(rows, grid), "v")


# Geometry

_NEAR = f"""WITH {ATOMS} SELECT a.frame_id, a.atom_idx AS i, b.atom_idx AS j,
  round(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2), 9) + 0.0 AS r
FROM atoms a JOIN atoms b ON a.frame_id = b.frame_id AND a.atom_idx <> b.atom_idx AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 < {RC * RC}"""


@query("neighbours_cutoff", _NEAR)
def neighbours_cutoff(spark, sf_dir):
    return neighbours.distances_scan(atoms(spark, sf_dir), RC, places=9)


@query("neighbours_binned", _NEAR)
def neighbours_binned(spark, sf_dir):
    return neighbours.distances_binned(atoms(spark, sf_dir), RC, places=9)


_IMAGE = "((b.{a} - a.{a}) - 8 * round_even((b.{a} - a.{a}) / 8, 0))"


@query("neighbours_image", f"""WITH {ATOMS}, p AS (SELECT a.frame_id, a.atom_idx AS i, b.atom_idx AS j, {" + ".join(_IMAGE.format(a=a) + " ** 2" for a in "xyz")} AS r2
  FROM atoms a JOIN atoms b ON a.frame_id = b.frame_id AND a.atom_idx <> b.atom_idx)
SELECT frame_id, i, j, round(sqrt(r2), 9) + 0.0 AS r FROM p WHERE r2 < {RC * RC}""")
def neighbours_image(spark, sf_dir):
    return neighbours.distances_wrapped(atoms(spark, sf_dir), RC, (8.0, 8.0, 8.0), places=9)


@query("cutoff_weight", f"""WITH {ATOMS}, d AS (SELECT atom_idx, sqrt(x * x + y * y + z * z) AS r FROM atoms)
SELECT atom_idx, round(CASE WHEN r <= 2.0 THEN 1 WHEN r >= 2.5 THEN 0 ELSE (1 + cos(pi() * (r - 2.0) / 0.5)) / 2 END, 9) + 0.0 AS w FROM d""")
def cutoff_weight(spark, sf_dir):
    p = geometry.polar(F.col("x"), F.col("y"), F.col("z"))
    return rounded(atoms(spark, sf_dir).select("atom_idx", geometry.cutoff_weight(p["r"], RC).alias("w")), "w")


@query("polar_coords", f"""WITH {ATOMS}, d AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM atoms)
SELECT atom_idx, round(r, 9) + 0.0 AS r, round(CASE WHEN r = 0 THEN 0 ELSE z / r END, 9) + 0.0 AS cos_theta, round(atan2(y, x), 9) + 0.0 AS phi FROM d""")
def polar_coords(spark, sf_dir):
    rows = atoms(spark, sf_dir).select("atom_idx", geometry.polar(F.col("x"), F.col("y"), F.col("z")).alias("p")).select("atom_idx", "p.*")
    return rounded(rows, "r", "cos_theta", "phi")


@query("soap_power_spectrum")
def soap_power_spectrum(spark, sf_dir):
    spectra = descriptors.describe(atoms(spark, sf_dir), [0, 1, 2, 3], rc=RC, nmax=3, lmax=3, sigma=0.4)
    return rounded(spectra.select("frame_id", "atom_idx", F.posexplode("features").alias("i", "v")).filter("v <> 0"), "v", places=6)


# Splits


@query("kfold", "SELECT vec_id AS id, (ntile(3) OVER (ORDER BY vec_id) - 1)::BIGINT AS fold FROM embeddings")
def kfold(spark, sf_dir):
    return splits.k_fold(ids(environments(spark, sf_dir)), 3)


@query("kfold_shuffled", "SELECT vec_id AS id, (ntile(5) OVER (ORDER BY md5('7:' || vec_id), vec_id) - 1)::BIGINT AS fold FROM embeddings")
def kfold_shuffled(spark, sf_dir):
    return splits.k_fold(ids(environments(spark, sf_dir)), 5, seed=7)


@query("group_kfold", """WITH f AS (SELECT frame, ntile(3) OVER (ORDER BY frame) - 1 AS fold FROM (SELECT DISTINCT label AS frame FROM embeddings))
SELECT s.split::BIGINT AS split, vec_id AS env_id, CASE WHEN fold = s.split THEN 'test' ELSE 'train' END AS role FROM embeddings JOIN f ON frame = label, range(3) s(split)""")
def group_kfold(spark, sf_dir):
    return splits.group_k_fold(environments(spark, sf_dir).select("frame_id", "env_id"), 3)


@query("shuffle_split", """WITH r AS (SELECT s.split, vec_id, row_number() OVER (PARTITION BY split ORDER BY md5((split + 11) || ':' || vec_id), vec_id) AS pos FROM embeddings, range(4) s(split))
SELECT split::BIGINT AS split, vec_id AS id, CASE WHEN pos <= 40 THEN 'test' ELSE 'train' END AS role FROM r WHERE pos <= 140""")
def shuffle_split(spark, sf_dir):
    return splits.shuffle_split(ids(environments(spark, sf_dir)), 4, 100, 40, 11)


@query("group_shuffle_split", """WITH f AS (SELECT DISTINCT label AS frame FROM embeddings),
r AS (SELECT s.split, frame, row_number() OVER (PARTITION BY split ORDER BY md5((split + 3) || ':' || frame), frame) AS pos FROM f, range(3) s(split))
SELECT split::BIGINT AS split, vec_id AS env_id, CASE WHEN pos <= 2 THEN 'test' ELSE 'train' END AS role FROM r JOIN embeddings ON frame = label WHERE pos <= 7""")
def group_shuffle_split(spark, sf_dir):
    return splits.group_shuffle_split(environments(spark, sf_dir).select("frame_id", "env_id"), 3, 5, 2, 3)


@query("lc_split", """WITH p(n_train, repeat) AS (VALUES (20, 0), (20, 1), (50, 0)),
r AS (SELECT n_train, repeat, vec_id, row_number() OVER (PARTITION BY n_train, repeat ORDER BY md5('5:' || n_train || ':' || repeat || ':' || vec_id), vec_id) AS pos FROM embeddings, p)
SELECT n_train::BIGINT AS n_train, repeat::BIGINT AS repeat, vec_id AS id, CASE WHEN pos <= 30 THEN 'test' ELSE 'train' END AS role FROM r WHERE pos <= 30 + n_train""")
def lc_split(spark, sf_dir):
    return splits.learning_curve_split(ids(environments(spark, sf_dir)), [20, 50], [2, 1], 30, 5)


# Scores

_SCORES = "avg(abs(y_pred - y)) AS mae, sqrt(avg((y_pred - y) ** 2)) AS rmse, max(abs(y_pred - y)) AS sup, 1 - avg((y_pred - y) ** 2) / var_pop(y) AS r2"
_ROUNDED = "round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(sup, 4) AS sup, round(r2, 6) AS r2"


def _rounded_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4), "sup": F.round("sup", 4), "r2": F.round("r2", 6)})


@query("scores_all", f"WITH {PRED} SELECT {_ROUNDED} FROM (SELECT {_SCORES} FROM pred)")
def scores_all(spark, sf_dir):
    return _rounded_scores(scores.scores(predictions(spark, sf_dir)))


@query("scores_by_fold", f"WITH {PRED} SELECT l_returnflag, {_ROUNDED} FROM (SELECT l_returnflag, {_SCORES} FROM pred GROUP BY l_returnflag)")
def scores_by_fold(spark, sf_dir):
    return _rounded_scores(scores.scores(predictions(spark, sf_dir), ["l_returnflag"]))


@query("spearman", f"""WITH {PRED}, r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS a, rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2 AS b FROM pred)
SELECT round(corr(a, b), 8) AS spearman FROM r""")
def spearman(spark, sf_dir):
    return scores.spearman(predictions(spark, sf_dir)).select(F.round("spearman", 8).alias("spearman"))


@query("learning_curve", f"""WITH {PRED}, f AS (SELECT l_linenumber::BIGINT AS n_train, l_returnflag, {_SCORES} FROM pred GROUP BY ALL)
SELECT n_train, {_ROUNDED} FROM (SELECT n_train, avg(mae) AS mae, avg(rmse) AS rmse, avg(sup) AS sup, avg(r2) AS r2 FROM f GROUP BY n_train)""")
def learning_curve(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("n_train", F.col("l_linenumber").cast("long"))
    return _rounded_scores(scores.mean_scores(scores.scores(rows, ["n_train", "l_returnflag"]), ["n_train"]))


@query("outlier_3sigma", f"""WITH {PRED}, s AS (SELECT l_orderkey % 100 AS frame_id, l_orderkey AS env_id, stddev_pop(y_pred) AS s FROM pred GROUP BY ALL)
SELECT DISTINCT frame_id FROM s WHERE s > (SELECT 1.6 * avg(s) FROM s)""")
def outlier_3sigma(spark, sf_dir):
    rows = predictions(spark, sf_dir).select((F.col("l_orderkey") % 100).alias("frame_id"), F.col("l_orderkey").alias("env_id"), "y_pred")
    return scores.outlier_frames(rows, factor=1.6)


@query("cv_scores")
def cv_scores(spark, sf_dir):
    """Scores by fold of a fast cross-validation, over several strengths of the kernel."""
    return _cv_scores(environments(spark, sf_dir), 1e-2)


def _cv_scores(env: DataFrame, jitter: float) -> DataFrame:
    folds = splits.k_fold(ids(env), 3)
    rows = regression.krr_fast_cv_deltas(env, targets(env), folds, ZETA, jitter=jitter, deltas=[0.5, 1.0, 2.0]).join(targets(env), "id")
    return _rounded_scores(scores.mean_scores(scores.scores(rows, ["delta", "fold"]), ["delta"]))


# Elements


@query("element_lookup", "WITH " + ATOMS + ", e(z, symbol) AS (VALUES " + ", ".join(f"({z}, '{s}')" for z, s, *_ in alchemy.ELEMENTS) + ") SELECT symbol, count(*) AS n FROM atoms JOIN e ON e.z = 5 + species GROUP BY symbol")
def element_lookup(spark, sf_dir):
    named = atoms(spark, sf_dir).withColumn("z", (F.col("species") + 5).cast("int")).join(F.broadcast(alchemy.elements(spark)), "z")
    return named.groupBy("symbol").agg(F.count("*").alias("n"))


@query("kappa_matrix", "WITH " + ATOMS + ", e(z, c, r) AS (VALUES " + ", ".join(f"({z}, {c}::DOUBLE, {r}::DOUBLE)" for z, _, c, r in alchemy.ELEMENTS) + """), p AS (SELECT * FROM e WHERE z IN (SELECT 5 + species FROM atoms))
SELECT a.z AS z1, b.z AS z2, round(exp(-((a.c - b.c) ** 2) / 0.5) * exp(-((a.r - b.r) ** 2) / 0.5), 9) AS kappa FROM p a, p b""")
def kappa_matrix(spark, sf_dir):
    present = atoms(spark, sf_dir).select((F.col("species") + 5).cast("int").alias("z")).distinct()
    return rounded(alchemy.element_similarity(alchemy.elements(spark).join(present, "z", "left_semi")), "kappa")


@query("alchemical_loss")
def alchemical_loss(spark, sf_dir):
    """The two-halves loss of a fit in the basis that element similarity starts from, before and after descent on it."""
    rows = environments(spark, sf_dir).select(F.col("env_id").alias("id"), F.col("frame_id").cast("double").alias("y"), "features")
    _, u = alchemy.leading_vectors(alchemy.element_similarity(alchemy.elements(spark).filter("z IN (6, 8)")), 1)
    (_, before), *_, (_, after) = alchemy.alchemical_descent(rows, u, sigma_w=1e-3, rounds=1)[0]
    return spark.createDataFrame([("start", round(before**2, 6)), ("end", round(after**2, 6))], "step string, loss double")


@query("centred_targets", f"WITH {ENV}, t AS (SELECT env_id AS id, frame_id::DOUBLE AS y FROM env) SELECT id, round(y - avg(y) OVER (), 9) + 0.0 AS y FROM t")
def centred_targets(spark, sf_dir):
    return rounded(alchemy.centred(targets(environments(spark, sf_dir))), "y")


# Model selection


# Systems of any size, for each number ``a`` of active environments (the first picked), scale and fold, solved by elimination.
_SOR_CV = f"""{_SOR}, folds AS (SELECT vec_id AS n, ntile(4) OVER (ORDER BY md5('1:' || vec_id), vec_id) - 1 AS fold FROM embeddings),
picked AS (SELECT n + 1 AS r, min(p) AS env_id FROM step GROUP BY n), size AS (SELECT count(*) AS m FROM picked),
x AS (SELECT r AS i, c.n, y, k, fold FROM c JOIN picked ON env_id = c.i JOIN folds USING (n)),
g AS (SELECT a.fold, a.i, b.i AS j, sum(a.k * b.k) AS s FROM x a JOIN x b ON b.n = a.n GROUP BY ALL UNION ALL SELECT fold, i, 0, sum(k * y) FROM x GROUP BY ALL),
rest AS (SELECT i, j, fold, sum(s) OVER (PARTITION BY i, j) - s AS s FROM g),
own AS (SELECT a.r AS i, b.r AS j, c.k + CASE WHEN a.r = b.r THEN 1e-8 ELSE 0 END AS k FROM c JOIN picked a ON a.env_id = c.i JOIN picked b ON b.env_id = c.n),
try(a, scale) AS ({{tries}}),
q(t, a, scale, fold, i, j, v) AS (
  SELECT 0, a, scale, fold, i, j, s / scale ** 2 + coalesce(own.k, 0) FROM try, rest LEFT JOIN own USING (i, j) WHERE i <= a AND j <= a
  UNION ALL
  SELECT t + 1, a, scale, fold, i, j, CASE WHEN i = t + 1 THEN v / d ELSE v - left_v * top_v / d END
  FROM (SELECT *, max(v) FILTER (WHERE i = t + 1 AND j = t + 1) OVER (PARTITION BY a, scale, fold) AS d, max(v) FILTER (WHERE j = t + 1) OVER (PARTITION BY a, scale, fold, i) AS left_v,
    max(v) FILTER (WHERE i = t + 1) OVER (PARTITION BY a, scale, fold, j) AS top_v FROM q WHERE t < a)),
pred AS (SELECT a, scale, x.fold, n, any_value(y) AS y, sum(k * v) AS y_pred FROM q JOIN x ON x.i = q.i AND x.fold = q.fold WHERE t = a AND j = 0 GROUP BY ALL),
f AS (SELECT a, scale, fold, {_SCORES} FROM pred GROUP BY ALL)"""


@query("sor_cv_scores", _SOR_CV.format(tries="SELECT m, scale FROM size, (VALUES (0.5::DOUBLE), (1), (2)) s(scale)") + f" SELECT scale, fold::BIGINT AS fold, {_ROUNDED} FROM f")
def sor_cv_scores(spark, sf_dir):
    env = environments(spark, sf_dir)
    folds = splits.k_fold(env.select("env_id"), 4, key="env_id", seed=1)
    return _rounded_scores(model_selection.sor_cross_validate(with_y(env), env.filter(F.col("env_id").isin(active_ids(env))), folds, zeta=ZETA, scales=[0.5, 1.0, 2.0]))


@query("sor_sweep", _SOR_CV.format(tries="SELECT DISTINCT a, scale FROM size, (VALUES (0.5::DOUBLE), (2)) s(scale), unnest([(m + 3) // 4, (m + 1) // 2, m]) u(a)") + f"""
SELECT a::INT AS n_active, scale, {_ROUNDED} FROM (SELECT a, scale, avg(mae) AS mae, avg(rmse) AS rmse, avg(sup) AS sup, avg(r2) AS r2 FROM f GROUP BY ALL)""")
def sor_sweep(spark, sf_dir):
    """Mean scores over folds for sizes of the active set, the first points of one selection, and scales."""
    env = environments(spark, sf_dir)
    folds = splits.k_fold(env.select("env_id"), 4, key="env_id", seed=1)

    active = active_ids(env)

    def score(n_active: int) -> DataFrame:
        found = model_selection.sor_cross_validate(with_y(env), env.filter(F.col("env_id").isin(active[:n_active])), folds, zeta=ZETA, scales=[0.5, 2.0])
        return scores.mean_scores(found, ["scale"])

    return _rounded_scores(model_selection.grid_search({"n_active": sorted({-(-len(active) // 4), -(-len(active) // 2), len(active)})}, score))


@query("learning_curve_krr", f"""WITH RECURSIVE {ENV}, p(n_train, repeat) AS (VALUES (50, 0), (50, 1), (50, 2), (100, 0), (100, 1), (200, 0)),
r AS (SELECT n_train, repeat, f, frame_id::DOUBLE AS y, env_id, row_number() OVER (PARTITION BY n_train, repeat ORDER BY md5('5:' || n_train || ':' || repeat || ':' || env_id), env_id) - 100 AS i FROM env, p),
x AS (SELECT * FROM r WHERE i BETWEEN 1 AND n_train),
start AS (SELECT a.n_train, a.repeat, a.i, b.i AS j, list_dot_product(a.f, b.f) ** 2 + CASE WHEN a.i = b.i THEN 1e-2 ELSE 0 END AS v FROM x a JOIN x b ON a.n_train = b.n_train AND a.repeat = b.repeat
  UNION ALL SELECT n_train, repeat, i, 0, y FROM x),
q(t, n_train, repeat, i, j, v) AS (
  SELECT 0, n_train, repeat, i, j, v FROM start
  UNION ALL
  SELECT t + 1, n_train, repeat, i, j, CASE WHEN i = t + 1 THEN v / d ELSE v - left_v * top_v / d END
  FROM (SELECT *, max(v) FILTER (WHERE i = t + 1 AND j = t + 1) OVER (PARTITION BY n_train, repeat) AS d, max(v) FILTER (WHERE j = t + 1) OVER (PARTITION BY n_train, repeat, i) AS left_v,
    max(v) FILTER (WHERE i = t + 1) OVER (PARTITION BY n_train, repeat, j) AS top_v FROM q WHERE t < n_train) WHERE j = 0 OR j > t + 1),
alpha AS (SELECT x.n_train, x.repeat, x.f, v AS alpha FROM q JOIN x ON x.n_train = q.n_train AND x.repeat = q.repeat AND x.i = q.i WHERE t = q.n_train AND j = 0),
pred AS (SELECT r.n_train, r.repeat, r.env_id, any_value(r.y) AS y, sum(alpha * list_dot_product(r.f, a.f) ** 2) AS y_pred FROM r JOIN alpha a ON a.n_train = r.n_train AND a.repeat = r.repeat WHERE r.i <= 0 GROUP BY ALL),
f AS (SELECT n_train, repeat, {_SCORES} FROM pred GROUP BY ALL)
SELECT n_train::BIGINT AS n_train, {_ROUNDED} FROM (SELECT n_train, avg(mae) AS mae, avg(rmse) AS rmse, avg(sup) AS sup, avg(r2) AS r2 FROM f GROUP BY n_train)""")
def learning_curve_krr(spark, sf_dir):
    env = environments(spark, sf_dir)
    return _rounded_scores(model_selection.learning_curve_rows(env, targets(env), [50, 100, 200], [3, 2, 1], 100, ZETA, seed=5, jitter=1e-2))


@query("fps_back_map")
def fps_back_map(spark, sf_dir):
    """The map back from ten features picked far apart, as a table."""
    env = environments(spark, sf_dir)
    a = compression.back_map(env, selection.farthest_features(env, 10))
    rows = [(i, j, round(float(a[i, j]), 6) + 0.0) for i in range(len(a)) for j in range(len(a))]
    return spark.createDataFrame(rows, "i long, j long, a double")


# Closed forms of fits, scaling of compressed spectra, losses

_Y = f"WITH {ENV} SELECT env_id AS id, round(frame_id::DOUBLE, 6) + 0.0 AS y FROM env"


@query("krr_fit_residual", _Y)
def krr_fit_residual(spark, sf_dir):
    """(K + jitter I) alpha of the fit, which must be y again."""
    env = environments(spark, sf_dir)
    alpha = regression.krr_fit_rows(env, targets(env), ZETA, jitter=1e-2)
    back = regression.krr_predict_rows(env, env.join(alpha.withColumnRenamed("id", "env_id"), "env_id"), ZETA).join(alpha, "id")
    return rounded(back.select("id", (F.col("y_pred") + 1e-2 * F.col("alpha")).alias("y")), "y", places=6)


@query("krr_matrix_free_residual", _Y)
def krr_matrix_free_residual(spark, sf_dir):
    """(K + jitter I) alpha of the fit by steps, over several blocks, which must be y again."""
    env = environments(spark, sf_dir)
    alpha = _by_steps(env, 1e-2)
    back = regression.krr_predict_rows(env, env.join(alpha.withColumnRenamed("id", "env_id"), "env_id"), ZETA).join(alpha, "id")
    return rounded(back.select("id", (F.col("y_pred") + 1e-2 * F.col("alpha")).alias("y")), "y", places=6)


@query("cg_features_residual", _Y)
def cg_features_residual(spark, sf_dir):
    """(X X^T + ridge I) x of the conjugate gradients on features, which must be y again."""
    env = environments(spark, sf_dir)
    x = regression.conjugate_gradients_features(env.join(targets(env).withColumnRenamed("id", "env_id"), "env_id").withColumnRenamed("env_id", "id"), ridge=0.5)
    rows = env.join(x.withColumnRenamed("id", "env_id"), "env_id")
    q = [r["q"] for r in rows.select(F.posexplode("features").alias("i", "v"), "x").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("q")).orderBy("i").collect()]
    back = vectors.dot(F.col("features"), F.array(*map(F.lit, q))) + 0.5 * F.col("x")
    return rounded(rows.select(F.col("env_id").alias("id"), back.alias("y")), "y", places=6)


_SCALED = f"WITH {ENV}, {FLAT}, x AS (SELECT env_id, i, v, i // 32 AS s, (i // 16) % 2 AS t, (i // 8) % 2 AS n, (i // 4) % 2 AS m, i % 4 AS l FROM flat)"
_W2 = "CASE {0} WHEN 0 THEN 0.5::DOUBLE ELSE 2 END"


def _long(rows: DataFrame) -> DataFrame:
    return rounded(rows.select("env_id", F.posexplode("features").alias("i", "v")).withColumn("i", F.col("i").cast("long")), "v")


@query("scale_diagonal", f"{_SCALED} SELECT env_id, i::BIGINT AS i, round(v * {_W2.format('s')} * {_W2.format('t')}, 9) + 0.0 AS v FROM x")
def scale_diagonal(spark, sf_dir):
    return _long(compression.scale_features(environments(spark, sf_dir), SHAPE, "species", [0.5, 2.0]))


@query("scale_full", f"""{_SCALED}, u(a, s, w) AS (VALUES (0, 0, 1::DOUBLE), (0, 1, 0.5), (1, 0, 0.25), (1, 1, 2))
SELECT env_id, (p.a * 32 + q.a * 16 + i % 16)::BIGINT AS i, round(sum(v * p.w * q.w), 9) + 0.0 AS v FROM x JOIN u p ON p.s = x.s JOIN u q ON q.s = x.t GROUP BY ALL""")
def scale_full(spark, sf_dir):
    return _long(compression.scale_features(environments(spark, sf_dir), SHAPE, "species", [1.0, 0.5, 0.25, 2.0], full=True))


@query("scale_relative_angular", f"{_SCALED} SELECT env_id, i::BIGINT AS i, round(v * (l + 1) / 2 * {_W2.format('s')} * {_W2.format('t')}, 9) + 0.0 AS v FROM x")
def scale_relative_angular(spark, sf_dir):
    return _long(compression.scale_features(environments(spark, sf_dir), SHAPE, "angular+species", [0.5, 1.0, 1.5, 2.0, 0.5, 2.0]))


@query("scale_relative_species", f"{_SCALED} SELECT env_id, i::BIGINT AS i, round(v * (s + 1) * (t + 1) * {_W2.format('n')} * {_W2.format('m')}, 9) + 0.0 AS v FROM x")
def scale_relative_species(spark, sf_dir):
    return _long(compression.scale_features(environments(spark, sf_dir), SHAPE, "species+radial", [1.0, 2.0, 0.5, 2.0]))


def _one_active(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    env = environments(spark, sf_dir)
    return env.select("env_id", "features", F.col("frame_id").cast("double").alias("y")), env.filter("env_id = 0").select("env_id", "features")


_ONE = f"WITH {ENV}, a AS (SELECT f FROM env WHERE env_id = 0), k AS (SELECT env_id, frame_id::DOUBLE AS y, list_dot_product(env.f, a.f) ** 2 AS k FROM env, a), o AS (SELECT list_dot_product(f, f) ** 2 AS own FROM a)"


@query("sor_log_likelihood_m1", f"""{_ONE}, t AS (SELECT sum(k * k) AS g, sum(k * y) AS b, sum(y * y) AS yy, count(*) AS n FROM k), s(scale) AS (VALUES (0.5::DOUBLE), (2)),
z AS (SELECT scale, n, own + 1e-8 AS own, own + 1e-8 + g / scale ** 2 AS system, b / scale ** 2 AS b, yy / scale ** 2 AS yy FROM t, s, o)
SELECT scale, round(-0.5 * (yy - b * b / system + ln(system) - ln(own) + 2 * n * ln(scale) + n * ln(2 * pi())), 5) + 0.0 AS log_likelihood FROM z""")
def sor_log_likelihood_m1(spark, sf_dir):
    """The log-likelihood of all rows, with one active environment so that SQL can follow."""
    rows, active = _one_active(spark, sf_dir)
    return rounded(model_selection.log_likelihood(rows, active, zeta=ZETA, scales=[0.5, 2.0]), "log_likelihood", places=5)


@query("sor_loss_m1", f"""{_ONE}, f AS (SELECT k.*, ntile(3) OVER (ORDER BY env_id) - 1 AS fold FROM k), s(scale) AS (VALUES (0.5::DOUBLE), (2)),
t AS (SELECT g.fold, sum(f.k * f.k) AS g, sum(f.k * f.y) AS b FROM f JOIN (SELECT DISTINCT fold FROM f) g ON f.fold <> g.fold GROUP BY g.fold),
w AS (SELECT scale, fold, b / scale ** 2 / (own + 1e-8 + g / scale ** 2) AS alpha FROM t, s, o)
SELECT scale, round(avg((alpha * k - y) ** 2), 7) + 0.0 AS mse FROM f JOIN w USING (fold) GROUP BY scale""")
def sor_loss_m1(spark, sf_dir):
    """The loss that hyper-parameters are chosen by, with one active environment so that SQL can follow."""
    rows, active = _one_active(spark, sf_dir)
    return rounded(model_selection.sor_loss(rows, active, splits.k_fold(rows.select("env_id"), 3, key="env_id"), zeta=ZETA, scales=[0.5, 2.0]), "mse", places=7)


@query("describe_norms", f"WITH {ATOMS} SELECT frame_id, atom_idx, 1.0::DOUBLE AS norm, 0.0::DOUBLE AS asymmetry FROM atoms")
def describe_norms(spark, sf_dir):
    """Of each spectrum: its norm, and how far it is from p[s, t, n, m, l] = p[t, s, m, n, l]."""
    found = descriptors.describe(atoms(spark, sf_dir), [0, 1, 2, 3], rc=RC, nmax=3, lmax=3, sigma=0.4)
    order = np.arange(4 * 4 * 3 * 3 * 4).reshape(4, 4, 3, 3, 4).transpose(1, 0, 3, 2, 4).ravel().tolist()
    other = F.zip_with("features", vectors.pick(F.col("features"), order), lambda a, b: F.abs(a - b))
    rows = found.select("frame_id", "atom_idx", vectors.norm(F.col("features")).alias("norm"), F.array_max(other).alias("asymmetry"))
    return rounded(rows, "norm", "asymmetry")


# Fits to one feature x: the kernel of rows i and j is z[i] z[j] with z = x * x, whose systems SQL can solve.

_Z = f"""WITH {ENV}, z AS (SELECT env_id AS id, frame_id::DOUBLE AS y, (10 * f[1]) ** 2 AS z, ntile(3) OVER (ORDER BY env_id) - 1 AS fold FROM env)"""


def one_feature(spark, sf_dir) -> DataFrame:
    return environments(spark, sf_dir).withColumn("features", F.array(10 * F.col("features")[0]))


_REST = "t AS (SELECT g.fold, sum(z * y) AS zy, sum(z * z) AS zz FROM z JOIN (SELECT DISTINCT fold FROM z) g ON g.fold <> z.fold GROUP BY g.fold)"


@query("krr_fast_cv_one_feature", f"{_Z}, {_REST} SELECT id, fold, round(4 * z * zy / (1 + 4 * zz), 6) + 0.0 AS y_pred FROM z JOIN t USING (fold)")
def krr_fast_cv_one_feature(spark, sf_dir):
    env = one_feature(spark, sf_dir)
    found = regression.krr_fast_cv_rows(env, targets(env), splits.k_fold(ids(env), 3), ZETA, jitter=1.0, delta=2.0)
    return rounded(found, "y_pred", places=6)


@query("gaussian_process_one_feature", f"""{_Z}, t AS (SELECT sum(z * y) AS zy, sum(z * z) AS zz, 0.25 * avg(z * z) / var_pop(y) AS noise FROM z WHERE id % 5 <> 0)
SELECT id, round(z * zy / (noise + zz), 6) + 0.0 AS y_pred, round(z * z * noise / (noise + zz), 6) + 0.0 AS variance FROM z, t WHERE id % 5 = 0""")
def gaussian_process_one_feature(spark, sf_dir):
    return _process(one_feature(spark, sf_dir))


@query("conjugate_gradients_one_feature", f"{_Z}, t AS (SELECT sum(z * y) AS zy, sum(z * z) AS zz FROM z) SELECT id, round(y - z * zy / (1 + zz), 5) + 0.0 AS x FROM z, t")
def conjugate_gradients_one_feature(spark, sf_dir):
    env = one_feature(spark, sf_dir)
    return rounded(_by_steps(env, 1.0).withColumnRenamed("alpha", "x"), "x", places=5)


_MEANS = "avg(mae) AS mae, avg(rmse) AS rmse, avg(sup) AS sup, avg(r2) AS r2"


@query("cv_scores_one_feature", f"""{_Z}, {_REST}, d(delta) AS (VALUES (0.5::DOUBLE), (1), (2)),
p AS (SELECT delta, fold, y, delta ** 2 * z * zy / (1 + delta ** 2 * zz) AS y_pred FROM z JOIN t USING (fold), d),
f AS (SELECT delta, fold, {_SCORES} FROM p GROUP BY ALL) SELECT delta, {_ROUNDED} FROM (SELECT delta, {_MEANS} FROM f GROUP BY delta)""")
def cv_scores_one_feature(spark, sf_dir):
    return _cv_scores(one_feature(spark, sf_dir), 1.0)


@query("learning_curve_one_feature", f"""{_Z}, s(n_train, repeat) AS (VALUES (20, 0), (20, 1), (50, 0)),
r AS (SELECT n_train, repeat, z, y, row_number() OVER (PARTITION BY n_train, repeat ORDER BY md5('5:' || n_train || ':' || repeat || ':' || id), id) AS pos FROM z, s),
t AS (SELECT n_train, repeat, sum(z * y) AS zy, sum(z * z) AS zz FROM r WHERE pos > 30 AND pos <= 30 + n_train GROUP BY ALL),
p AS (SELECT n_train, repeat, y, z * zy / (1 + zz) AS y_pred FROM r JOIN t USING (n_train, repeat) WHERE pos <= 30),
f AS (SELECT n_train, repeat, {_SCORES} FROM p GROUP BY ALL) SELECT n_train::BIGINT AS n_train, {_ROUNDED} FROM (SELECT n_train, {_MEANS} FROM f GROUP BY n_train)""")
def learning_curve_one_feature(spark, sf_dir):
    env = one_feature(spark, sf_dir)
    return _rounded_scores(model_selection.learning_curve_rows(env, targets(env), [20, 50], [2, 1], 30, ZETA, seed=5, jitter=1.0))


@query("grid_search_m1", f"""{_ONE}, f AS (SELECT k.*, ntile(3) OVER (ORDER BY env_id) - 1 AS fold FROM k), s(delta, scale) AS (VALUES (0.5::DOUBLE, 0.5::DOUBLE), (0.5, 2), (2, 0.5), (2, 2)),
t AS (SELECT g.fold, sum(f.k * f.k) AS g, sum(f.k * f.y) AS b FROM f JOIN (SELECT DISTINCT fold FROM f) g ON f.fold <> g.fold GROUP BY g.fold),
w AS (SELECT delta, scale, fold, delta ** 2 * b / scale ** 2 / (delta ** 2 * own + 1e-8 + delta ** 4 * g / scale ** 2) AS alpha FROM t, s, o),
p AS (SELECT delta, scale, fold, y, alpha * delta ** 2 * k AS y_pred FROM f JOIN w USING (fold)),
q AS (SELECT delta, scale, fold, {_SCORES} FROM p GROUP BY ALL) SELECT delta, scale, {_ROUNDED} FROM (SELECT delta, scale, {_MEANS} FROM q GROUP BY ALL)""")
def grid_search_m1(spark, sf_dir):
    """Mean scores over folds by strength of the kernel and scale, with one active environment so that SQL can follow."""
    rows, active = _one_active(spark, sf_dir)
    folds = splits.k_fold(rows.select("env_id"), 3, key="env_id")

    def score(delta: float) -> DataFrame:
        return scores.mean_scores(model_selection.sor_cross_validate(rows, active, folds, zeta=ZETA, scales=[0.5, 2.0], delta=delta), ["scale"])

    return _rounded_scores(model_selection.grid_search({"delta": [0.5, 2.0]}, score))


@query("alchemical_loss_d1", f"""WITH {ENV}, x AS (SELECT env_id % 2 AS half, frame_id::DOUBLE AS y, 0.64 * f[1] + 0.48 * f[2] + 0.48 * f[3] + 0.36 * f[4] AS x FROM env),
w AS (SELECT 1 - half AS half, sum(x * y) / (sum(x * x) + 1e-3) AS w FROM x GROUP BY half) SELECT round(avg((w * x - y) ** 2), 6) + 0.0 AS loss FROM x JOIN w USING (half)""")
def alchemical_loss_d1(spark, sf_dir):
    """The two-halves loss with features that a vector of two species reduces to one."""
    rows = environments(spark, sf_dir).select(F.col("env_id").alias("id"), F.col("frame_id").cast("double").alias("y"), F.slice("features", 1, 4).alias("features"))
    loss = alchemy.cross_loss(rows, np.array([[0.8], [0.6]]), 1e-3)
    return spark.createDataFrame([(round(loss, 6),)], "loss double")


@query("alchemical_gradient_d1", f"""WITH {ENV}, p AS (SELECT env_id % 2 AS half, frame_id::DOUBLE AS y, f[1] AS a, f[2] + f[3] AS b, f[4] AS c FROM env),
x AS (SELECT half, y, 0.64 * a + 0.48 * b + 0.36 * c AS x, 1.6 * a + 0.6 * b AS d0, 0.8 * b + 1.2 * c AS d1 FROM p),
t AS (SELECT 1 - half AS half, sum(x * y) / (sum(x * x) + 0.5) AS w, sum(x * x) + 0.5 AS s, sum(y * d0) AS y0, sum(y * d1) AS y1, 2 * sum(x * d0) AS s0, 2 * sum(x * d1) AS s1 FROM x GROUP BY half),
w AS (SELECT half, w, (y0 - w * s0) / s AS w0, (y1 - w * s1) / s AS w1 FROM t)
SELECT round(sum((w * x - y) ** 2) / 2 + 0.05, 5) + 0.0 AS loss, round(sum((w * x - y) * (w * d0 + x * w0)) + 0.08, 5) + 0.0 AS slope_0, round(sum((w * x - y) * (w * d1 + x * w1)) + 0.06, 5) + 0.0 AS slope_1
FROM x JOIN w USING (half)""")
def alchemical_gradient_d1(spark, sf_dir):
    """The regularised two-halves loss and its whole slope by a vector of two species, which reduces the features to one."""
    rows = environments(spark, sf_dir).select(F.col("env_id").alias("id"), F.col("frame_id").cast("double").alias("y"), F.slice("features", 1, 4).alias("features"))
    loss, slope = alchemy.AlchemicalLoss(rows, sigma_w=0.5, sigma_u=0.1).value_and_slope(np.array([[0.8], [0.6]]))
    return spark.createDataFrame([tuple(round(float(v), 5) + 0.0 for v in (loss, *slope.ravel()))], "loss double, slope_0 double, slope_1 double")


@query("group_loss_m1", f"""WITH {ENV}, {FLAT}, z AS (SELECT env_id, frame_id, list(v * (1 + i % 4) / 2 ORDER BY i) AS g FROM flat GROUP BY ALL),
k AS (SELECT a.frame_id, a.frame_id::DOUBLE AS y, avg((list_dot_product(a.g, b.g) / sqrt(list_dot_product(a.g, a.g) * list_dot_product(b.g, b.g))) ** 2) AS k FROM z a JOIN z b ON b.frame_id = 0 GROUP BY a.frame_id),
f AS (SELECT *, ntile(3) OVER (ORDER BY frame_id) - 1 AS fold FROM k), o AS (SELECT k + 1e-3 AS own FROM k WHERE frame_id = 0), s(scale) AS (VALUES (0.5::DOUBLE), (2)),
t AS (SELECT g.fold, sum(f.k * f.k) AS g, sum(f.k * f.y) AS b FROM f JOIN (SELECT DISTINCT fold FROM f) g ON f.fold <> g.fold GROUP BY g.fold),
w AS (SELECT scale, fold, b / (own * scale ** 2 + g) AS alpha, -2 * scale * own * b / (own * scale ** 2 + g) ** 2 AS by_scale FROM t, s, o)
SELECT scale, round(avg((alpha * k - y) ** 2), 7) + 0.0 AS mse, round(avg(2 * (alpha * k - y) * k * by_scale), 7) + 0.0 AS slope FROM f JOIN w USING (fold) GROUP BY scale""")
def group_loss_m1(spark, sf_dir):
    """The loss of group-averaged kernels of angularly weighted spectra and its slope by the scale, over all frames, with one of them active."""
    env = environments(spark, sf_dir).select("frame_id", "features")
    frames = env.select("frame_id").distinct().select(F.col("frame_id").alias("id"))
    targets = splits.k_fold(frames, 3).select(F.col("id").alias("frame_id"), F.col("id").cast("double").alias("y"), "fold")
    loss = scaled_loss.ScaledLoss(env, targets, env.filter("frame_id = 0"), scaled_loss.Scaling(scaled_loss.angular_index(64, 4)), zeta=ZETA, jitter=1e-3)
    found = [(scale, *loss.value_and_slope(np.array([scale, 0.5, 1.0, 1.5, 2.0]))) for scale in (0.5, 2.0)]
    loss.remove()
    return spark.createDataFrame([(s, round(v, 7) + 0.0, round(float(g[0]), 7) + 0.0) for s, v, g in found], "scale double, mse double, slope double")


@query("back_map_two", f"""WITH {ENV}, {FLAT}, g AS (SELECT b.i, sum(p.f[1] * b.v) AS g1, sum(p.f[6] * b.v) AS g2 FROM flat b JOIN env p USING (env_id) GROUP BY b.i),
k AS (SELECT max(g1) FILTER (WHERE i = 0) AS a, max(g2) FILTER (WHERE i = 0) AS b, max(g2) FILTER (WHERE i = 5) AS d FROM g),
c AS (SELECT (d * g1 - b * g2) / (a * d - b * b) AS c1, (a * g2 - b * g1) / (a * d - b * b) AS c2 FROM g, k),
m AS (SELECT sum(c1 * c1) AS a, sum(c1 * c2) AS b, sum(c2 * c2) AS d FROM c), r AS (SELECT *, sqrt(a * d - b * b) AS s FROM m),
e(i, j) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1))
SELECT i::BIGINT AS i, j::BIGINT AS j, round((CASE WHEN i <> j THEN b WHEN i = 0 THEN a + s ELSE d + s END) / sqrt(a + d + 2 * s), 6) + 0.0 AS a FROM r, e""")
def back_map_two(spark, sf_dir):
    """The map back from two features, whose symmetric root has a closed form."""
    a = compression.back_map(environments(spark, sf_dir), [0, 5])
    return spark.createDataFrame([(i, j, round(float(a[i, j]), 6) + 0.0) for i in range(2) for j in range(2)], "i long, j long, a double")


# With one radial point and l up to 1, a spectrum follows from a sum and a vector sum over the neighbours of each species.

_POINT = (RC + 3 * 0.4) / 2
_RATIO = f"{_POINT} * r / 0.16"


@query("soap_spectrum_one_point", f"""WITH {ATOMS}, n AS (
  SELECT a.frame_id, a.atom_idx, b.species, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2) AS r
  FROM atoms a JOIN atoms b ON a.frame_id = b.frame_id AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 < {RC * RC}),
w AS (SELECT *, CASE WHEN r <= 2.0 THEN 1 ELSE (1 + cos(pi() * (r - 2.0) / 0.5)) / 2 END AS w FROM n),
g AS (SELECT *, CASE WHEN abs({_POINT} - r) >= 2.0 THEN 0 WHEN r <= 1e-5 THEN w * exp(-({_POINT} ** 2) / 0.32)
  ELSE w * exp(-(({_POINT} - r) ** 2) / 0.32) * (1 - exp(-2 * {_RATIO})) / (2 * {_RATIO}) END AS g FROM w),
h AS (SELECT *, CASE WHEN r <= 1e-5 THEN 0 ELSE g * ((1 + exp(-2 * {_RATIO})) / (1 - exp(-2 * {_RATIO})) - 1 / ({_RATIO})) / r END AS h FROM g),
s AS (SELECT frame_id, atom_idx, species, sum(g) AS g, sum(h * dx) AS x, sum(h * dy) AS y, sum(h * dz) AS z FROM h GROUP BY ALL),
p AS (SELECT frame_id, atom_idx, (a.species * 4 + b.species) * 2 + l AS i, CASE l WHEN 0 THEN a.g * b.g ELSE sqrt(3::DOUBLE) * (a.x * b.x + a.y * b.y + a.z * b.z) END AS v
  FROM s a JOIN s b USING (frame_id, atom_idx), range(2) k(l)),
q AS (SELECT frame_id, atom_idx, i::BIGINT AS i, round(v / sqrt(sum(v * v) OVER (PARTITION BY frame_id, atom_idx)), 6) + 0.0 AS v FROM p)
SELECT * FROM q WHERE v <> 0""")
def soap_spectrum_one_point(spark, sf_dir):
    found = descriptors.describe(atoms(spark, sf_dir), [0, 1, 2, 3], rc=RC, nmax=1, lmax=1, sigma=0.4)
    rows = found.select("frame_id", "atom_idx", F.posexplode("features").alias("i", "v")).withColumn("i", F.col("i").cast("long"))
    return rounded(rows, "v", places=6).filter("v <> 0")


# Frames of two files, two in three of them periodic in a skewed cell and with atoms off by lattice vectors; two radial points and l up to 2.

_CELL = ((8.0, 0.0, 0.0), (2.0, 7.0, 0.0), (1.0, 1.0, 9.0))
_AT = [f"(({_POINT}::DOUBLE) * (1 {sign} 1 / sqrt(3::DOUBLE)))" for sign in "-+"]


@query("soap_periodic_two_points", f"""WITH {ATOMS}, own AS (SELECT 'f' || (atom_idx % 2) AS path, * FROM atoms),
k AS (SELECT unnest(range(-4, 5)) AS k), shift AS (SELECT a.k AS p, b.k AS q, c.k AS r, 8 * a.k + 2 * b.k + c.k AS sx, 7 * b.k + c.k AS sy, 9 * c.k AS sz FROM k a, k b, k c),
d AS (SELECT a.path, a.frame_id, a.atom_idx, b.species, b.x + sx - a.x AS dx, b.y + sy - a.y AS dy, b.z + sz - a.z AS dz
  FROM own a JOIN own b ON a.path = b.path AND a.frame_id = b.frame_id JOIN shift ON a.frame_id % 3 > 0 OR (p = 0 AND q = 0 AND r = 0)),
n AS (SELECT *, row_number() OVER () AS id, sqrt(dx ** 2 + dy ** 2 + dz ** 2) AS r FROM d WHERE dx ** 2 + dy ** 2 + dz ** 2 < {RC * RC}),
w AS (SELECT *, n AS point, CASE n WHEN 0 THEN {_AT[0]} ELSE {_AT[1]} END AS pt, CASE WHEN r <= 2.0 THEN 1 ELSE (1 + cos(pi() * (r - 2.0) / 0.5)) / 2 END AS w FROM n, range(2) s(n)),
z AS (SELECT *, pt * r / 0.16 AS z, CASE WHEN abs(pt - r) >= 2.0 THEN 0 WHEN r <= 1e-5 THEN w * pt * exp(-(pt ** 2) / 0.32) ELSE w * pt * exp(-((pt - r) ** 2) / 0.32) * (1 - exp(-2 * pt * r / 0.16)) / (2 * pt * r / 0.16) END AS g0 FROM w),
y AS (SELECT *, CASE WHEN r <= 1e-5 THEN 0 ELSE g0 * ((1 + exp(-2 * z)) / (1 - exp(-2 * z)) - 1 / z) END AS g1 FROM z),
g AS (SELECT *, CASE WHEN r <= 1e-5 THEN 0 ELSE g0 - 3 * g1 / z END AS g2 FROM y),
b AS (SELECT a.path, a.frame_id, a.atom_idx, ((a.species * 4 + b.species) * 2 + a.point) * 2 + b.point AS i, a.g0 * b.g0 AS v0, a.g1 * b.g1 AS v1, a.g2 * b.g2 AS v2,
  CASE WHEN a.r <= 1e-5 OR b.r <= 1e-5 THEN 0 ELSE (a.dx * b.dx + a.dy * b.dy + a.dz * b.dz) / (a.r * b.r) END AS c FROM g a JOIN g b ON a.path = b.path AND a.frame_id = b.frame_id AND a.atom_idx = b.atom_idx),
p AS (SELECT path, frame_id, atom_idx, (i * 3 + l)::BIGINT AS i, sum(CASE l WHEN 0 THEN v0 WHEN 1 THEN sqrt(3::DOUBLE) * v1 * c ELSE sqrt(5::DOUBLE) * v2 * (3 * c * c - 1) / 2 END) AS v FROM b, range(3) k(l) GROUP BY ALL),
q AS (SELECT path, frame_id, atom_idx, i, round(v / sqrt(sum(v * v) OVER (PARTITION BY path, frame_id, atom_idx)), 6) + 0.0 AS v FROM p)
SELECT * FROM q WHERE v <> 0""")
def soap_periodic_two_points(spark, sf_dir):
    """Spectra of every frame of two files; where a frame is periodic, its atoms are off by up to two lattice vectors along an axis."""
    own = atoms(spark, sf_dir).withColumn("path", F.concat(F.lit("f"), F.col("atom_idx") % 2))
    periodic = F.col("frame_id") % 3 > 0
    off = [F.when(periodic, n).otherwise(0) for n in (F.col("atom_idx") % 5 - 2, F.col("atom_idx") % 3 - 1, F.col("atom_idx") % 4 - 2)]
    moved = own.withColumns({a: F.col(a) + sum((off[k] * _CELL[k][i] for k in (1, 2)), off[0] * _CELL[0][i]) for i, a in enumerate("xyz")})
    cell = F.array(*(F.array(*map(F.lit, v)) for v in _CELL))
    cells = own.select("path", "frame_id").distinct().select("path", "frame_id", F.when(periodic, cell).alias("cell"), F.array(*[periodic] * 3).alias("pbc"))
    found = descriptors.describe(moved, [0, 1, 2, 3], rc=RC, nmax=2, lmax=2, sigma=0.4, cells=cells, by=("path", "frame_id"))
    rows = found.select("path", "frame_id", "atom_idx", F.posexplode("features").alias("i", "v")).withColumn("i", F.col("i").cast("long"))
    return rounded(rows, "v", places=6).filter("v <> 0")


# Parsers, over logs and frames that are written from the rows of embeddings, and parameter grids


def _whole(k: int):
    return F.floor(100 * F.col("embedding")[k].cast("double")).cast("string")


def _tensor_text(first: int):
    return F.concat(*(F.concat(*(F.concat(F.lit(" "), _whole(first + 3 * i + j)) for j in range(3)), F.lit("\n")) for i in range(3)))


_TRACE = "round((floor(100 * embedding[{}]::DOUBLE) + floor(100 * embedding[{}]::DOUBLE) + floor(100 * embedding[{}]::DOUBLE)) / 3{}, 2) + 0.0"


@query("shielding_isotropic", f"""SELECT vec_id AS env_id, {_TRACE.format(1, 5, 9, " + floor(100 * embedding[31]::DOUBLE)")} AS local,
{_TRACE.format(10, 14, 18, "")} AS total, {_TRACE.format(19, 23, 27, "")} AS macroscopic FROM embeddings""")
def shielding_isotropic(spark, sf_dir):
    head = lambda name, value: F.concat(F.lit(f"  Atom 1 C pos: (0.0 0.0 0.0) {name} sigma: "), value, F.lit("\n"))
    text = F.concat(
        head("core", _whole(30)), head("bare", F.lit("0.0")), _tensor_text(0), head("Total", F.lit("0.0")), _tensor_text(9),
        F.lit("  Macroscopic shape contribution in ppm:\n"), _tensor_text(18),
    )
    logs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), text.alias("text"))
    records = shielding.contributions(logs)
    found = None
    for name, own in (("local", shielding.local_shielding(records)), ("total", shielding.total_shielding(records)), ("macroscopic", shielding.macroscopic(logs))):
        own = own.select(F.col("path").alias("env_id"), (shielding.isotropic(F.col("tensor")) + F.lit(0.0)).alias(name))
        found = own if found is None else found.join(own, "env_id")
    return found


@query("scf_sites", """SELECT vec_id AS env_id, k AS atom_idx, CASE k WHEN 0 THEN 'Si' ELSE 'O' END AS symbol,
round(floor(100 * embedding[3 * k + 1]::DOUBLE) * 10 * 0.529177210903, 9) + 0.0 AS x, round(floor(100 * embedding[3 * k + 2]::DOUBLE) * 10 * 0.529177210903, 9) + 0.0 AS y,
round(floor(100 * embedding[3 * k + 3]::DOUBLE) * 10 * 0.529177210903, 9) + 0.0 AS z, round(20 * 0.529177210903, 9) AS edge FROM embeddings, range(2) s(k)""")
def scf_sites(spark, sf_dir):
    site = lambda k, s: F.concat(F.lit(f"   {k + 1}   {s}  tau(   {k + 1}) = ( "), F.concat_ws(" ", *(_whole(3 * k + i) for i in range(3))), F.lit(" )\n"))
    text = F.concat(F.lit("lattice parameter (alat) = 10.0 a.u.\n a(1) = ( 2.0 0.0 0.0 )\n a(2) = ( 0.0 2.0 0.0 )\n a(3) = ( 0.0 0.0 2.0 )\n"), site(0, "Si"), site(1, "O"))
    logs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), text.alias("text"))
    edges = scf.cells(logs).select("path", F.col("cell")[2][2].alias("edge"))
    return rounded(scf.sites(logs).join(edges, "path").withColumnRenamed("path", "env_id"), "x", "y", "z", "edge")


@query("frames_round_trip", f"WITH {ATOMS} SELECT atom_idx // 16 AS block, atom_idx, ['C', 'H', 'N', 'O'][species + 1] AS symbol, round(x, 10) + 0.0 AS x, round(y, 10) + 0.0 AS y, round(z, 10) + 0.0 AS z, frame_id FROM atoms")
def frames_round_trip(spark, sf_dir):
    """Atoms in frames of at most 16, written as extended-XYZ text with further columns and read back."""
    symbol = F.element_at(F.array(*map(F.lit, "CHNO")), F.col("species").cast("int") + 1)
    extra = F.create_map(F.lit("frame"), F.col("frame_id").cast("string"), F.lit("id"), F.col("atom_idx").cast("string"))
    own = F.struct(F.col("atom_idx"), symbol.alias("symbol"), "x", "y", "z", extra.alias("extra"))
    cell = F.array(*(F.array(*(F.lit(8.0 if i == j else 0.0) for j in range(3))) for i in range(3)))
    blocks = atoms(spark, sf_dir).groupBy(F.floor(F.col("atom_idx") / 16).alias("block")).agg(F.collect_list(own).alias("atoms"))
    written = frames.format_frames(blocks.select("atoms", cell.alias("cell"), F.array(*[F.lit(True)] * 3).alias("pbc"), F.create_map(F.lit("block"), F.col("block").cast("string")).alias("info")))
    back = frames.parse_texts(written.select(F.lit("").alias("path"), F.col("value").alias("text")))
    rows = back.select(F.col("info")["block"].cast("long").alias("block"), F.explode("atoms").alias("a"))
    return rounded(rows.select("block", F.col("a.extra")["id"].cast("long").alias("atom_idx"), "a.symbol", "a.x", "a.y", "a.z", F.col("a.extra")["frame"].cast("long").alias("frame_id")), "x", "y", "z", places=10)


@query("param_grid_counts", """WITH g(point, scale_by, filter_above, filter_first) AS (VALUES (0, '1.0', '5.0', '0'), (1, '2.0', '5.0', '0'), (2, '1.0', '5.0', '3'), (3, '2.0', '5.0', '3'),
  (4, '1.0', '20.0', '0'), (5, '2.0', '20.0', '0'), (6, '1.0', '20.0', '3'), (7, '2.0', '20.0', '3'))
SELECT point::BIGINT AS point, scale_by, filter_above, filter_first, count(*) FILTER (WHERE l_quantity * scale_by::DOUBLE > filter_above::DOUBLE AND l_linenumber > filter_first::INT) AS n FROM lineitem, g GROUP BY ALL""")
def param_grid_counts(spark, sf_dir):
    """The points of a grid of two steps, each with the number of rows that pass it."""
    grid = splits.param_grid(spark, [("scale", {"by": [1.0, 2.0]}), ("filter", {"above": [5.0, 20.0], "first": [0, 3]})])
    passes = (F.col("l_quantity") * F.col("scale_by").cast("double") > F.col("filter_above").cast("double")) & (F.col("l_linenumber") > F.col("filter_first").cast("int"))
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", "l_linenumber").join(F.broadcast(grid))
    return rows.groupBy("point", "scale_by", "filter_above", "filter_first").agg(F.count(F.when(passes, 1)).alias("n"))
