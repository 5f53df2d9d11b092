"""Pipelines of named steps whose results are kept by content: what was computed before is read back.

A step is a function of a DataFrame and parameters. A result's key is a digest of the input's
fingerprint, the targets' if there are any, and the names and parameters of all steps up to it,
so a change anywhere makes new keys from there on and a restart begins at the longest prefix held.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> str:
    """A digest of the rows of ``df``, whatever their order: their number and sums of two row hashes, with the schema."""
    names = sorted(df.columns)
    row = [F.xxhash64(*names).cast("decimal(38,0)"), F.xxhash64(F.lit(1), *names).cast("decimal(38,0)")]
    sums = df.agg(F.count("*"), *(F.sum(r) for r in row)).first()
    return hashlib.sha256(json.dumps([sorted(map(list, df.dtypes)), list(map(str, sums))]).encode()).hexdigest()


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)


class Pipeline:
    """Steps applied in turn; with ``folder``, each result is written there as Parquet with a JSON record of what it is."""

    def __init__(self, steps: list[Step], folder: str | None = None):
        self.steps, self.folder = steps, folder

    def keys(self, start: str) -> list[str]:
        out = []
        for step in self.steps:
            start = hashlib.sha256(json.dumps([start, step.name, step.params], sort_keys=True, default=str).encode()).hexdigest()
            out.append(start)
        return out

    def run(self, df: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        if self.folder is None:
            for step in self.steps:
                df = step.run(df, **step.params)
            return df
        spark = df.sparkSession
        start = fingerprint(df) + (fingerprint(targets) if targets is not None else "")
        keys, first = self.keys(start), 0
        for n in range(len(keys), 0, -1):
            try:  # a result is complete once its record is
                spark.read.json(f"{self.folder}/{keys[n - 1]}/record").first()
            except AnalysisException:
                continue
            df, first = spark.read.parquet(f"{self.folder}/{keys[n - 1]}/data"), n
            break
        for step, key in list(zip(self.steps, keys))[first:]:
            where = f"{self.folder}/{key}"
            step.run(df, **step.params).write.mode("overwrite").parquet(f"{where}/data")
            record = {"step": step.name, "params": json.dumps(step.params, sort_keys=True, default=str), "input": start, "key": key, "written": time.ctime()}
            spark.createDataFrame([record]).coalesce(1).write.mode("overwrite").json(f"{where}/record")
            df = spark.read.parquet(f"{where}/data")
        return df
