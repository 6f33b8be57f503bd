"""python -m kinfold.cli --csv FILE --resume FILE --config FILE --output DIR"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from kinfold.errors import KinfoldError
from kinfold.operators.projection import load_config
from kinfold.plans.pipeline import export


def main(argv: list[str] | None = None) -> int:
    """0: done, 1: no sources, 2: an error of the data or config, 3: any other."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--csv", action="append", default=[])
    parser.add_argument("--resume", action="append", default=[])
    parser.add_argument("--config", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--array", action="store_true", help="lines of one JSON array instead of objects")
    args = parser.parse_args(argv)
    if not args.csv and not args.resume:
        print("no sources given", file=sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    try:
        config = load_config(spark, args.config)
        export(spark, [*args.csv, *args.resume], config, args.output, args.array)
        return 0
    except KinfoldError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(f"unexpected: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
