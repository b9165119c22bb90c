"""Settings from a JSON file over a frozen dataclass's defaults."""

from __future__ import annotations

import dataclasses
import json
import warnings

from pyspark.sql import SparkSession

from .functions.genotype import Quality


def load(text: str, base=Quality()):
    """base with the values of a JSON object; keys that base doesn't have are warned of and left out."""
    given = json.loads(text)
    if not isinstance(given, dict):
        raise ValueError("settings must be a JSON object")
    known = {f.name for f in dataclasses.fields(base)}
    for k in sorted(set(given) - known):
        warnings.warn(f"unknown setting {k} is left out", stacklevel=2)
    return dataclasses.replace(base, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known})


def read(spark: SparkSession | None, path: str | None, base=Quality()):
    """As load(), from a file of any file system that Spark reads; base itself without a path."""
    if path is None:
        return base
    return load(spark.read.text(path, wholetext=True).first()["value"], base)
