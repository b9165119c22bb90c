"""What the jobs share: command line, session, settings, logs."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def settings(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, changed by a JSON file that Spark reads; a name that isn't among them raises an error."""
    given = json.loads(spark.read.text(path, wholetext=True).first()["value"]) if path else {}
    unknown = sorted(set(given) - set(defaults))
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return defaults | given


def main(name: str, paths: dict[str, str], defaults: dict, run: Callable, argv: list[str] | None = None) -> None:
    """Command line of a job: a path for each argument of run, and --config. Only this creates and stops a session."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    for arg, about in paths.items():
        parser.add_argument(f"--{arg}", required=True, help=about)
    parser.add_argument("--config", help="JSON file of settings: " + ", ".join(f"{k} ({v!r})" for k, v in defaults.items()))
    options = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = options.pop("config")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, **options, config=settings(spark, config, defaults))
    finally:
        spark.stop()
