"""Shielding tensors out of the text logs of magnetic-response calculations, with DataFrame functions.

A record is a header line ``Atom n S pos: (x y z) <name> sigma: v``, and for all contributions
but core the three rows of its tensor below. The macroscopic contribution has a block of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL = ("core", "bare", "para", "dia", "para_oo", "para_lq")
_NUMBER = r"[-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?"
_ROW = rf"[ \t]*{_NUMBER}[ \t]+{_NUMBER}[ \t]+{_NUMBER}[ \t]*"
_RECORD = rf"(?m)^[ \t]*Atom[ \t]+\d+[ \t]+\w+[ \t]+pos:[^\n]*sigma:[^\n]*(?:\n{_ROW}){{0,3}}"
_HEADER = r"Atom[ \t]+(\d+)[ \t]+(\w+)[ \t]+pos:[ \t]*\([^)]*\)[ \t]*(\S*)[ \t]*sigma:[ \t]*(" + _NUMBER + ")"


def _tensor(text):
    """The numbers behind the first line of a record, or three times the unit matrix of its single value."""
    below = F.regexp_replace(text, r"^[^\n]*\n?", "")
    numbers = F.transform(F.regexp_extract_all(below, F.lit(_NUMBER), F.lit(0)), lambda v: v.cast("double"))
    single = F.regexp_extract(text, _HEADER, 4).cast("double")
    unit = F.array(*(single if i % 4 == 0 else F.lit(0.0) for i in range(9)))
    return F.when(F.size(numbers) == 9, numbers).otherwise(unit)


def contributions(logs: DataFrame) -> DataFrame:
    """(path, atom, symbol, name, value, tensor) of ``logs`` (path, text), one row a record; tensor by rows, 9 numbers."""
    records = logs.select("path", F.explode(F.regexp_extract_all("text", F.lit(_RECORD), F.lit(0))).alias("r"))
    return records.select(
        "path",
        F.regexp_extract("r", _HEADER, 1).cast("long").alias("atom"),
        F.regexp_extract("r", _HEADER, 2).alias("symbol"),
        F.regexp_extract("r", _HEADER, 3).alias("name"),
        F.regexp_extract("r", _HEADER, 4).cast("double").alias("value"),
        _tensor(F.col("r")).alias("tensor"),
    )


def macroscopic(logs: DataFrame) -> DataFrame:
    """(path, tensor): the rows below the line that names the macroscopic shape."""
    block = F.regexp_extract("text", rf"(?m)^[^\n]*Macroscopic shape[^\n]*((?:\n{_ROW}){{3}})", 1)
    numbers = F.transform(F.regexp_extract_all(block, F.lit(_NUMBER), F.lit(0)), lambda v: v.cast("double"))
    return logs.select("path", numbers.alias("tensor")).filter(F.size("tensor") == 9)


def isotropic(tensor, *, places: int = 2):
    """A third of the trace, rounded half to even."""
    return F.bround((tensor[0] + tensor[4] + tensor[8]) / 3, places)


def local_shielding(records: DataFrame) -> DataFrame:
    """(path, atom, tensor): the sum of an atom's local contributions, in one aggregation."""
    local = records.filter(F.col("name").isin(*LOCAL))
    sums = local.groupBy("path", "atom").agg(*(F.sum(F.col("tensor")[i]).alias(f"t{i}") for i in range(9)))
    return sums.select("path", "atom", F.array(*(f"t{i}" for i in range(9))).alias("tensor"))


def total_shielding(records: DataFrame) -> DataFrame:
    """(path, atom, tensor) of the contribution that the log calls Total."""
    return records.filter("name = 'Total'").select("path", "atom", "tensor")
