"""``python -m rowmill.cli [--data DIR] [--swap DIR] [--db DIR] [--load] FILE.sql ...``"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from rowmill.plans.script import run_script
from rowmill.session import get_session
from rowmill.sources.catalog import Catalog
from rowmill.sources.sinks import print_lines


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rowmill", description="Run SQL files over pipe-delimited or loaded tables.")
    parser.add_argument("--data", help="directory of NAME.dat files")
    parser.add_argument("--swap", help="directory for spill files; results don't depend on it")
    parser.add_argument("--db", help="directory of loaded Parquet tables")
    parser.add_argument("--load", action="store_true", help="load the tables of the files (CREATE TABLE only) into --db")
    parser.add_argument("files", nargs="+", metavar="FILE.sql")
    args = parser.parse_args(argv)
    if args.load and not (args.data and args.db):
        parser.error("--load needs --data and --db")
    spark = get_session(**({"spark.local.dir": args.swap} if args.swap else {}))
    spark.sparkContext.setLogLevel("ERROR")
    catalog, failed = Catalog(spark, args.data, args.db), 0
    for name in args.files:
        try:
            for result in run_script(spark, catalog, Path(name).read_text(), load=args.load):
                for line in print_lines(result):
                    print(line)
        except Exception as error:  # the next file still runs, the exit code tells
            print(f"{name}: {type(error).__name__}: {str(error).splitlines()[0]}", file=sys.stderr)
            failed = 1
    return failed


if __name__ == "__main__":
    sys.exit(main())
