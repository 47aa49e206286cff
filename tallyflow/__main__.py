"""python -m tallyflow --out DIR [--seed N] MAIL_FILE ...: every experiment over the corpora, results as CSV tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tallyflow.plans import experiments
from tallyflow.sources import corpus
from tallyflow.sources.shared import importable


def main() -> None:
    args = argparse.ArgumentParser(prog="tallyflow", description=__doc__)
    args.add_argument("paths", nargs="+", help="mail files in the marked text format; those that don't exist are left out")
    args.add_argument("--out", required=True, help="folder of the result tables")
    args.add_argument("--seed", type=int, default=12, help="of the stream's order")
    given = args.parse_args()
    spark = SparkSession.builder.appName("tallyflow").getOrCreate()
    importable(spark)
    emails = corpus.load(spark, given.paths, given.seed)
    corpus.profile(emails).show()
    experiments.run(emails, given.out).show(truncate=False)


if __name__ == "__main__":
    main()
