"""Command line: run the whole analysis on a CSV (or Parquet) input.

    python -m saleslens SOURCE OUT_DIR [--core APAC EU US LATAM] [--years 2013 2014]
                        [--exclude-segment "Home Office"] [--csv-marts] [--processed-csv]
                        [--partition-report-by-year] [--market-rule WRONG COUNTRY CORRECT]...
                        [--product-rule NAME SUBCATEGORY CATEGORY]... [--multi-market-countries ...]
                        [--no-quoted-line-breaks]

SOURCE ending in .csv (or a folder of CSV files with --csv) is loaded with the
declared schema; anything else is read as Parquet. Defaults are the original
analysis's business literals. Prints one line per written output.
"""

from __future__ import annotations

import argparse

from saleslens.constants import (
    REFERENCE_CORE_MARKETS,
    REFERENCE_EXCLUDED_SEGMENT,
    REFERENCE_MARKET_RULES,
    REFERENCE_MULTI_MARKET_COUNTRIES,
    REFERENCE_PRODUCT_RULE,
    REFERENCE_SEGMENT_YEARS,
)
from saleslens.plans.pipeline import run_pipeline
from saleslens.session import get_spark, input_bytes, size_for_input


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="saleslens", description=__doc__.splitlines()[0])
    ap.add_argument("source")
    ap.add_argument("out_dir")
    ap.add_argument("--csv", action="store_true", help="treat SOURCE as CSV even without a .csv suffix")
    ap.add_argument(
        "--no-quoted-line-breaks", action="store_true", help="every line is a row: spares the pass that finds records"
    )
    ap.add_argument("--core", nargs="+", default=list(REFERENCE_CORE_MARKETS))
    ap.add_argument("--years", nargs="+", type=int, default=list(REFERENCE_SEGMENT_YEARS))
    ap.add_argument("--exclude-segment", default=REFERENCE_EXCLUDED_SEGMENT)
    ap.add_argument("--csv-marts", action="store_true")
    ap.add_argument("--processed-csv", action="store_true")
    ap.add_argument("--partition-report-by-year", action="store_true")
    ap.add_argument(
        "--market-rule", nargs=3, action="append", metavar=("WRONG", "COUNTRY", "CORRECT"),
        help="a market correction, instead of the default ones; may be repeated",
    )
    ap.add_argument(
        "--product-rule", nargs=3, action="append", metavar=("NAME", "SUBCATEGORY", "CATEGORY"),
        help="a product correction, instead of the default one; may be repeated",
    )
    ap.add_argument("--multi-market-countries", nargs="+", default=list(REFERENCE_MULTI_MARKET_COUNTRIES))
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    spark = get_spark(args.master)
    size_for_input(spark, input_bytes(spark, args.source))
    source = args.source if (args.csv or args.source.lower().endswith(".csv")) else spark.read.parquet(args.source)
    written = run_pipeline(
        spark,
        source,
        args.out_dir,
        core=args.core,
        years=args.years,
        excluded_segment=args.exclude_segment,
        market_rules=[tuple(r) for r in args.market_rule] if args.market_rule else REFERENCE_MARKET_RULES,
        product_rule=[tuple(r) for r in args.product_rule] if args.product_rule else REFERENCE_PRODUCT_RULE,
        multi_market_countries=args.multi_market_countries,
        csv_marts=args.csv_marts,
        processed_csv=args.processed_csv,
        partition_reporting_by_year=args.partition_report_by_year,
        quoted_line_breaks=not args.no_quoted_line_breaks,
    )
    for name, path in sorted(written.items()):
        print(f"{name}\t{path}")


if __name__ == "__main__":
    main()
