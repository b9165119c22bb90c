"""The jobs as queries over the whole tables: each runs twice into one new folder and gives what stands there after the second run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmark.plans import adapters as a
from helixmark.plans.wider import PASSAGES
from helixmark.storage import shared_dir

from . import cohort_release, marker_screen


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


GATE = {"min_recovery": 0.1, "min_callable": 0.02}


def job1_cohort_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of the cohort with its samples' verdicts; the second run covers one contig."""
    out = _folder(spark, "cohort-release")
    cohort_release.run(spark, sf_dir, out, GATE)
    cohort_release.run(spark, sf_dir, out, GATE | {"contigs": ["F"]})
    judged = cohort_release.samples(spark, out).select("sample", F.round("recovery", 6).alias("recovery"), F.round("callable", 6).alias("callable"), "n_active", "verdict")
    return cohort_release.matrix(spark, out).join(judged, "sample")


def job2_marker_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all documents; the second run finds nothing new."""
    out = _folder(spark, "marker-screen")
    for _ in range(2):
        marker_screen.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{out}/output", f"{out}/checkpoint")
    return marker_screen.calls(spark, f"{out}/output").drop("batch")


QUERIES = {f.__name__: f for f in (job1_cohort_release, job2_marker_screen)}

ORACLE = {
    "job1_cohort_release": f"""WITH {a.RESOLVED}, g AS (SELECT sample, count(*) AS n, count(*) FILTER (NOT assumed) AS found, count(*) FILTER (NOT assumed AND state IN ('CALLED_REFERENCE', 'CALLED_ALTERNATE')) AS c, count(*) FILTER (value = 1) AS n_active FROM resolved GROUP BY sample)
SELECT sample, feature, state, assumed, value, label, chrom, round(found / n, 6) AS recovery, round(c / n, 6) AS callable, n_active, CASE WHEN found / n >= 0.1 AND c / n >= 0.02 AND c > 0 THEN 'predict' ELSE 'abstain' END AS verdict FROM resolved JOIN g USING (sample)""",
    "job2_marker_screen": f"""WITH {PASSAGES}, called AS (SELECT subject_id AS doc_id, context_id AS marker, at_, strand, CASE WHEN strand = 'minus' THEN translate(letter, 'ACGTN', 'TGCAN') ELSE letter END AS observed, m, aligned FROM hits WHERE m <= 2),
ranked AS (SELECT *, rank() OVER (PARTITION BY doc_id, marker ORDER BY aligned - m - 3 * m DESC, 1 - m / aligned DESC, aligned DESC, m) AS r FROM called),
best AS (SELECT doc_id, marker, min({{'b': at_, 'c': strand, 'd': observed, 'e': m, 'f': aligned}}) AS b, count(*) AS n FROM ranked WHERE r = 1 GROUP BY ALL)
SELECT doc_id, marker, b.b::INT AS "at", b.c AS strand, b.d AS observed, b.e::INT AS mismatches, b.f::INT AS aligned, CASE WHEN n = 1 THEN 'mapped_unique_context' ELSE 'multi_hit_context' END AS status, CASE WHEN n = 1 THEN CASE WHEN b.d = substr(c.context, 21, 1) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END AS value, d.lang
FROM best JOIN ctx0 c ON c.context_id = best.marker JOIN (SELECT doc_id, min(lang) AS lang FROM documents GROUP BY doc_id) d USING (doc_id)""",
}
