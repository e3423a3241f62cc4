"""Command line: link the given sources and print or write configured JSON."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from kinfold.plans.linkage import run
from kinfold.plans.project import PRESETS, OutputConfig
from kinfold.sources.writers import pretty_json, write_json_lines


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    for flag in ("csv", "json", "text"):
        parser.add_argument(f"--{flag}")
    parser.add_argument("--config", help=f"a JSON file, or one of {', '.join(PRESETS)}", default="default")
    parser.add_argument("--output", help="folder for JSON lines; without it, a JSON array goes to standard output")
    parser.add_argument("--verbose", action="store_true")
    args = parser.parse_args(argv)
    if not (args.csv or args.json or args.text):
        parser.error("at least one of --csv, --json and --text is needed")
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    try:
        config = OutputConfig.parse(PRESETS[args.config]) if args.config in PRESETS else OutputConfig.load(args.config)
        spark = SparkSession.builder.appName("kinfold").getOrCreate()
        found = run(spark, config, csv=args.csv, ats_json=args.json, recruiter_notes=args.text)
        if args.output and found is not None:
            write_json_lines(found, args.output)
        else:
            print("[]" if found is None else pretty_json(found))
        return 0
    except Exception:
        logging.getLogger(__name__).exception("the run failed")
        return 1


if __name__ == "__main__":
    sys.exit(main())
