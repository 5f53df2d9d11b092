"""Runs a query beside its SQL on the same tables."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    gone = frame.columns[frame.isna().any()]
    frame = frame.assign(**{c: frame[c].astype(object).where(frame[c].notna(), None) for c in gone})  # a null of any kind
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


def agrees(spark, sf_dir: str, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
