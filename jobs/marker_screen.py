"""Streaming job: new sequences are screened against a panel of marker contexts as their files arrive.

The input is a stream of Parquet files of documents; a run takes what is new since the last one (availableNow, with the stream's checkpoint)
and ends. Each item of the panel table is a marker: a context of 2 * flank + 1 letters of its text, its centre in the middle. For each new document
and marker that is found in it, on either strand, with at most `mismatches` letters replaced, the best place is reported: its letter, whether that is the
context's own (value 0) or another (1), or that several places are as good (no value). Calls are written below `<out>`, partitioned by batch and language; a batch that is
run again after a failure replaces its own folder, so nothing is written twice. A document that comes again in a later file is screened
again: `calls` gives the last batch's rows of each document.

    python -m jobs.marker_screen --documents DIR --panel FILE --out DIR --checkpoint DIR [--config jobs/marker_screen.json]

Settings: flank, skip (letters of an item before its context), mismatches, min_coverage, files_per_batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmark.functions.sequence import capitals
from helixmark.operators import lookup
from helixmark.storage import Scope, materialise

from .common import log, main

DEFAULTS = {"flank": 20, "skip": 10, "mismatches": 2, "min_coverage": 0.8, "files_per_batch": 100}
SEQUENCES = "doc_id bigint, text string, lang string"
CALLS = "doc_id bigint, marker bigint, at int, strand string, observed string, mismatches int, aligned int, status string, value double, batch bigint, lang string"
SCREENED = "doc_id bigint, batch bigint"


def contexts(panel: DataFrame, flank: int, skip: int) -> DataFrame:
    """(context_id, context, centre) of items long enough."""
    size = 2 * flank + 1
    return panel.where(F.length("text") >= skip + size).select(F.col("item_id").alias("context_id"), F.substring("text", skip + 1, size).alias("context"), F.lit(flank).alias("centre"))


def screened(documents: DataFrame, markers: DataFrame, mismatches: int, min_coverage: float) -> DataFrame:
    """The best place of each marker in each document that has any."""
    subjects = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("subject_id"), F.col("text").alias("seq"))
    best = lookup.best_context_hits(lookup.context_hits(subjects, markers, mismatches, min_coverage).withColumn("doc_id", F.col("subject_id")), ["doc_id", "context_id"])
    own = markers.select("context_id", capitals(F.expr("substring(context, centre + 1, 1)")).alias("own"))
    value = F.when(F.col("n_equivalent_best_hits") == 1, F.when(F.col("observed") == F.col("own"), 0.0).otherwise(1.0))
    return best.join(own, "context_id").select("doc_id", F.col("context_id").alias("marker"), "at", "strand", "observed", "mismatches", "aligned", "status", value.alias("value"))


def calls(spark: SparkSession, out: str) -> DataFrame:
    """The calls as they stand: of each document those of the last batch that held it."""
    last = spark.read.schema(SCREENED).parquet(f"{out}/screened").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.schema(CALLS).parquet(f"{out}/calls").join(last, ["doc_id", "batch"])


def run(spark: SparkSession, documents: str, panel: str, out: str, checkpoint: str, config: dict | None = None) -> dict:
    """Screen all documents that have come since the last run; returns the numbers of documents read and calls written."""
    c = DEFAULTS | (config or {})
    numbers = {"documents": 0, "calls": 0, "batches": 0}

    def one(batch: DataFrame, number: int) -> None:
        with Scope() as made:
            markers = contexts(spark.read.parquet(panel), c["flank"], c["skip"])
            # read several times, and by the job's session: that of a stream plans without adaptive execution
            docs = materialise(batch.select("doc_id", "text", "lang").dropDuplicates(["doc_id", "text", "lang"]), "screen-documents", reader=spark)
            found = screened(docs, markers, c["mismatches"], c["min_coverage"])
            languages = docs.groupBy("doc_id").agg(F.min("lang").alias("lang"))
            found.join(languages, "doc_id").write.mode("overwrite").partitionBy("lang").parquet(f"{out}/calls/batch={number}")
            docs.select("doc_id").distinct().write.mode("overwrite").parquet(f"{out}/screened/batch={number}")
            numbers["calls"] += spark.read.schema(CALLS).parquet(f"{out}/calls/batch={number}").count()
            numbers["documents"] += docs.count()
            numbers["batches"] += 1
            made.release()

    path = documents.rstrip("/")
    if not any(x in path for x in "*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"  # as a pattern it may name a file as well as a folder
    stream = spark.readStream.schema(SEQUENCES).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(path)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new documents from %s in %d batches; wrote %d calls below %s", numbers["documents"], documents, numbers["batches"], numbers["calls"], out)
    return numbers


if __name__ == "__main__":
    main("marker_screen", {"documents": "folder or file of documents", "panel": "table of items", "out": "folder of the output", "checkpoint": "folder of the stream's checkpoint"}, DEFAULTS, run)
