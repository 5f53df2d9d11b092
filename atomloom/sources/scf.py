"""Frames out of the text logs of plane-wave calculations: lattice and sites, with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The length unit of the logs in angstrom (a fixed value).
BOHR = 0.529177210903
_N = r"([-+]?\d+\.?\d*(?:[eE][-+]?\d+)?)"


def cells(logs: DataFrame) -> DataFrame:
    """(path, cell) in angstrom of ``logs`` (path, text): the lattice parameter times the crystal axes."""
    alat = F.regexp_extract("text", rf"lattice parameter \(alat\)\s*=\s*{_N}", 1).cast("double") * BOHR
    axis = lambda k: F.array(*(F.regexp_extract("text", rf"a\({k}\)\s*=\s*\(\s*{_N}\s+{_N}\s+{_N}\s*\)", i).cast("double") * alat for i in (1, 2, 3)))
    return logs.select("path", F.array(axis(1), axis(2), axis(3)).alias("cell"))


def sites(logs: DataFrame) -> DataFrame:
    """(path, atom_idx, symbol, x, y, z) in angstrom, in the order of the log."""
    alat = F.regexp_extract("text", rf"lattice parameter \(alat\)\s*=\s*{_N}", 1).cast("double") * BOHR
    line = rf"(\d+)\s+([A-Za-z]+)\d*\s+tau\(\s*\d+\)\s*=\s*\(\s*{_N}\s+{_N}\s+{_N}\s*\)"
    rows = logs.select("path", alat.alias("alat"), F.explode(F.regexp_extract_all("text", F.lit(line), F.lit(0))).alias("s"))
    return rows.select(
        "path",
        (F.regexp_extract("s", line, 1).cast("long") - 1).alias("atom_idx"),
        F.regexp_extract("s", line, 2).alias("symbol"),
        *((F.regexp_extract("s", line, k).cast("double") * F.col("alat")).alias(n) for k, n in ((3, "x"), (4, "y"), (5, "z"))),
    )
