"""Command line: compare two snapshots, write the results, exit with the run status.

    python -m catadrift PREVIOUS CURRENT OUTPUT [--format parquet|csv|json|orc|table|sheets|xlsx]
        [--connection NAME] [--option KEY=VALUE ...] [--checkpoint FOLDER] [--documents]

With --documents, workbooks and web pages are written too, to OUTPUT/documents.

The session gets settings that suit the size of the input; spark.checkpoint.dir or --checkpoint names the folder for the
changed keys, which Spark removes once they are no longer needed.

Exit status: 0 no drift, 1 drift, 2 error, 3 some connections failed.
"""

from __future__ import annotations

import argparse
import logging
import sys
from datetime import datetime

from pyspark.sql import SparkSession

from catadrift.config import RUN_FAILED
from catadrift.plans.compare import compare_locations, compare_sheets
from catadrift.plans.session import cuts_removed, input_bytes, tune
from catadrift.sources.inventory import FORMATS

log = logging.getLogger("catadrift")


def run(arguments: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="catadrift", description="Compare two catalog snapshots.")
    parser.add_argument("previous")
    parser.add_argument("current")
    parser.add_argument("output")
    parser.add_argument("--format", choices=(*FORMATS, "sheets", "xlsx"), default="parquet")
    parser.add_argument("--connection", help="name of the connection, for sources without such a column")
    parser.add_argument("--option", action="append", default=[], metavar="KEY=VALUE", help="an option of Spark's reader")
    parser.add_argument("--documents", action="store_true", help="write workbooks and web pages too")
    parser.add_argument("--checkpoint", help="folder that all executors can reach")
    args = parser.parse_args(arguments)
    builder = SparkSession.builder.appName("catadrift").config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    spark = spark or builder.getOrCreate()
    stamp = f"{datetime.now():%Y-%m-%d %H:%M:%S}"
    try:
        if args.checkpoint:
            spark.sparkContext.setCheckpointDir(args.checkpoint)
        if args.format != "table":
            tune(spark, input_bytes(spark, args.previous, args.current))
        with cuts_removed(spark):
            if args.format in ("sheets", "xlsx"):
                fmt = "xlsx" if args.format == "xlsx" else "csv"
                found = compare_sheets(spark, args.previous, args.current, comparison_ts=stamp, fmt=fmt)
            else:
                options = dict(x.split("=", 1) for x in args.option)
                found = compare_locations(
                    spark, args.previous, args.current, args.format, comparison_ts=stamp,
                    connection=args.connection, **options,
                )
            status = found.write(args.output)
            if args.documents:
                found.write_documents(f"{args.output}/documents")
            return status
    except Exception:
        # Whatever went wrong, a pipeline is to see a failed run and not a drift.
        log.exception("comparison failed")
        return RUN_FAILED


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
