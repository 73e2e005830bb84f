"""``python -m resultlake QUERY FOLDER [--out DIR]``: runs a named query over stored tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import catalog
from .session import reachable


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="resultlake", description=main.__doc__)
    parser.add_argument("query", choices=sorted(catalog.QUERIES))
    parser.add_argument("folder", help="folder of the tables as Parquet")
    parser.add_argument("--out", help="write the result here as Parquet instead of showing rows")
    parser.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    spark = reachable(SparkSession.builder.appName("resultlake").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    result = catalog.QUERIES[args.query](spark, args.folder)
    if args.out:
        result.write.mode("overwrite").parquet(args.out)
    else:
        result.show(args.rows, truncate=80)


if __name__ == "__main__":
    main()
