"""Command line: run registered queries over a folder of tables and write each result as Parquet.

    python -m atomloom.jobs.run --tables DIR --out DIR kernel_group_avg scores_all
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from atomloom.jobs import catalog


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--tables", required=True, help="folder of the input tables, on any file system that Spark reads")
    parser.add_argument("--out", required=True, help="folder for the results, one subfolder a query")
    parser.add_argument("queries", nargs="+", choices=sorted(catalog.QUERIES), metavar="QUERY")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("atomloom").getOrCreate()
    for name in args.queries:
        catalog.QUERIES[name](spark, args.tables).write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")


if __name__ == "__main__":
    main()
