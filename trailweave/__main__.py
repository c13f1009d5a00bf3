"""Run a program on an event-log CSV, or score a folder of cluster files.

    python -m trailweave frequent-components --log LOG.csv --out OUT
    python -m trailweave score --log LOG.csv --results FOLDER --out OUT
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from trailweave.plans.programs import PROGRAMS, score
from trailweave.sources.logs import CSV_TIMESTAMP_FORMAT, read_log


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="trailweave", description=__doc__, formatter_class=argparse.RawTextHelpFormatter)
    parser.add_argument("program", choices=[*PROGRAMS, "score"])
    parser.add_argument("--log", required=True, help="event-log CSV with a header")
    parser.add_argument("--out", required=True, help="folder to write")
    parser.add_argument("--results", help="folder of cluster files to score")
    parser.add_argument("--timestamp-format", default=CSV_TIMESTAMP_FORMAT, help="'' for the default pattern")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("trailweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    log = read_log(spark, args.log, args.timestamp_format or None)
    if args.program == "score":
        if not args.results:
            parser.error("score needs --results")
        score(log, args.results, args.out)
    else:
        PROGRAMS[args.program](log, args.out)


if __name__ == "__main__":
    main()
