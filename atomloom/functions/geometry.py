"""Column functions on distances and displacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width of the shell below the cutoff radius in which the weight falls from 1 to 0.
TAPER = 0.5


def cutoff_weight(r: Column, rc: float) -> Column:
    """1 up to ``rc`` less the taper, 0 from ``rc``, half a cosine between."""
    fall = (F.cos(F.lit(3.141592653589793) * (r - (rc - TAPER)) / TAPER) + 1) / 2
    return F.when(r <= rc - TAPER, 1.0).when(r >= rc, 0.0).otherwise(fall)


def polar(x: Column, y: Column, z: Column) -> Column:
    """(r, cos_theta, phi) of a displacement; cos_theta of the origin is 0."""
    r = F.sqrt(x * x + y * y + z * z)
    return F.struct(r.alias("r"), F.when(r == 0, 0.0).otherwise(z / r).alias("cos_theta"), F.atan2(y, x).alias("phi"))


def coth(x: Column) -> Column:
    return 1 / F.tanh(x)


def nearest_image(d: Column, length: Column) -> Column:
    """A component of a displacement in an orthogonal cell of that edge, taken to the nearest image; no edge, no images."""
    return F.when(length.isNull() | (length <= 0), d).otherwise(d - length * F.rint(d / length))
