"""Batch job: a cohort's marker matrix and the samples' callability, as partitioned tables.

Variant records of all samples are judged by the quality ladder, the last record of each place wins, and every sample
and marker of the panel gets its state, value and label. `<out>/matrix` is partitioned by contig: a run replaces the partitions of the
contigs that it covers (dynamic partition overwrite) and leaves the others. `<out>/samples` follows from the whole matrix as it then stands: recovery, callable share, verdict
and numbers of labels, partitioned by verdict. A rerun over the same tables gives the same rows; after a run that broke off, a rerun mends both.

    python -m jobs.cohort_release --tables DIR --out DIR [--config jobs/cohort_release.json]

Settings: contigs (all, unless listed), absent_is_reference, min_recovery, min_callable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmark.functions.genotype import ABSENT
from helixmark.operators import cohort, lookup
from helixmark.plans import adapters
from helixmark.storage import Scope

from .common import log, main

DEFAULTS = {"contigs": None, "absent_is_reference": True, "min_recovery": 0.5, "min_callable": 0.5}
MATRIX = "sample bigint, feature string, state string, assumed boolean, value double, label string, chrom string"
SAMPLES = "sample bigint, n_features bigint, recovery double, callable double, n_active bigint, n_baseline bigint, n_not_callable bigint, verdict string"


def matrix(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MATRIX).parquet(f"{out}/matrix")


def samples(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(SAMPLES).parquet(f"{out}/samples")


def run(spark: SparkSession, tables: str, out: str, config: dict | None = None) -> dict:
    """Write the matrix of a cohort and the verdicts of its samples; returns the numbers of rows read and written."""
    c = DEFAULTS | (config or {})
    with Scope() as made:
        calls = adapters.latest(spark, tables)
        panel = adapters.manifest(spark, tables)
        if c["contigs"] is not None:
            panel = panel.where(F.col("chrom").isin(*c["contigs"]))
        cells = lookup.resolve_features(calls, None, panel, absent_is_reference=c["absent_is_reference"])
        cells = cells.select("sample", "feature", "state", "assumed", "value", "label", F.substring_index("feature", ":", 1).alias("chrom"))
        cells.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chrom").parquet(f"{out}/matrix")
        whole = matrix(spark, out)
        states = whole.withColumn("state", F.when(F.col("assumed"), F.lit(ABSENT)).otherwise(F.col("state")))
        counts = whole.groupBy("sample").agg(F.count_if(F.col("value") == 1).alias("n_active"), F.count_if(F.col("value") == 0).alias("n_baseline"), F.count_if(F.col("value").isNull()).alias("n_not_callable"))
        judged = cohort.gates(states, c["min_recovery"], c["min_callable"]).join(counts, "sample")
        judged.select("sample", "n_features", "recovery", "callable", "n_active", "n_baseline", "n_not_callable", "verdict").write.mode("overwrite").partitionBy("verdict").parquet(f"{out}/samples")
        numbers = {"records": adapters.table(spark, tables, "lineitem").count(), "markers": panel.count(), "cells": whole.count(), "samples": samples(spark, out).count()}
        made.release()
    log.info("read %d records and %d markers from %s; %d cells and %d samples stand in %s", numbers["records"], numbers["markers"], tables, numbers["cells"], numbers["samples"], out)
    return numbers


if __name__ == "__main__":
    main("cohort_release", {"tables": "folder of lineitem.parquet (records) and part.parquet (panel)", "out": "folder of the output"}, DEFAULTS, run)
