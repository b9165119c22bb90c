"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialise, shared_dir, work_dir  # noqa: F401  (for the operators)

#: A word is a maximal run of anything but a space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small: by default they have up to 10,000 rows or 64 MB, twice for each task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def past_filters(df: DataFrame, *extra: tuple[str, Column]) -> DataFrame:
    """df with further columns that are computed once, where they stand.

    A filter on computed columns would be pushed down with their expressions written out; it can't pass a generator.
    """
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.inline(F.array(F.struct(*[v.alias(k) for k, v in extra]))))


def with_outputs(df: DataFrame, given: list[str], outputs: dict[str, Column]) -> DataFrame:
    """The given input columns, and the outputs; an input column that has an output's name gives way to it."""
    lower = {o.lower() for o in outputs}
    return df.select(*[F.col(f"`{c}`") for c in given if c.lower() not in lower], *[v.alias(k) for k, v in outputs.items()])
