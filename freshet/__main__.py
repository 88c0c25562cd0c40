"""Run the whole study: ``python -m freshet DATA OUT [--basin] [--daily] [--layout FILE]``.

Use ``spark-submit`` with this module's file to run it on a cluster; set
``spark.checkpoint.dir`` to a folder all executors share.
"""

from __future__ import annotations

import argparse
import json

from freshet.plans import study as plans
from freshet.session import build_session, release


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="freshet")
    parser.add_argument("data", help="folder with the input files")
    parser.add_argument("out", help="folder for the result tables")
    parser.add_argument("--basin", action="store_true", help="run the single basin as well")
    parser.add_argument("--daily", action="store_true", help="take the window demand from the daily file")
    parser.add_argument("--layout", help="JSON file: input name -> path under the data folder")
    args = parser.parse_args(argv)

    layout = None
    if args.layout:
        with open(args.layout) as f:
            layout = json.load(f)
    spark = build_session("freshet-study")
    basin = plans.load_basin(spark, args.data, layout) if args.basin else None
    plans.write_results(plans.load(spark, args.data, layout, daily=args.daily), args.out, basin)
    release(spark)


if __name__ == "__main__":
    main()
