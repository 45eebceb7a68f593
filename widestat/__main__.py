"""Command line for the three flows.

    python -m widestat process BIRTHS_TSV BIRTHS_DSD EDUCATION_TSV EDUCATION_DSD OUT [--parquet DIR]
    python -m widestat analyze OUT [--fmt csv|parquet]        # row counts of N1-N13
    python -m widestat stream FEED [--files-per-trigger N]   # windowed maxima, then SELECT * FROM counts
"""

from __future__ import annotations

import argparse
import json

from widestat.plans import etl
from widestat.session import get_spark


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="widestat")
    sub = parser.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("process")
    for name in ("births_tsv", "births_dsd", "education_tsv", "education_dsd", "out"):
        p.add_argument(name)
    p.add_argument("--parquet", default=None)
    p.add_argument("--missing", choices=("zero", "null"), default="zero")
    a = sub.add_parser("analyze")
    a.add_argument("out")
    a.add_argument("--fmt", choices=("csv", "parquet"), default="csv")
    s = sub.add_parser("stream")
    s.add_argument("feed")
    s.add_argument("--files-per-trigger", type=int, default=1)
    s.add_argument("--name", default="counts")
    args = parser.parse_args(argv)

    spark = get_spark()
    if args.cmd == "process":
        out = etl.from_files(spark, args.births_tsv, args.births_dsd, args.education_tsv,
                             args.education_dsd, missing=args.missing)
        result = etl.publish_all(out, args.out, parquet_base=args.parquet)
    elif args.cmd == "analyze":
        result = {k: v.count() for k, v in etl.analysis(spark, args.out, fmt=args.fmt).items()}
    else:
        result = {"rows": etl.stream_maxima(spark, args.feed, args.name, files_per_trigger=args.files_per_trigger).count()}
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    main()
