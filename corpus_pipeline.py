"""The corpus pipeline: documents to token digests, in five stages that each call one operator.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame;
all but the last return the columns of documents. Stages are written as Parquet in between; they, and what
a stage has written for itself, go once the next one is written. An empty table stays empty through all stages; columns of any other name are
carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmark.llm import mixing, quality_rules, secrets, simhash
from helixmark.llm.common import discard, materialise
from helixmark.llm.queries import encoded_digests
from helixmark.storage import Scope


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; thresholds come from all of docs. Null and empty texts go, as texts of fewer than 50 words do; repeated rows share one verdict; null language or source is a group."""
    return quality_rules.apply_rules(docs).where(F.col("kept")).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id (null last), of equal ones that with the least digest of its text, then of its row. All texts without words are one group; null text is empty."""
    return simhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret. Null text stays null; repeated rows are treated alike."""
    return secrets.redact(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without words never. Repeated rows are documents of their own; where the budget ends among rows that are alike, that many are taken."""
    return mixing.mix_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to; null text has no ids, as empty text."""
    return encoded_digests(docs)


STAGES = [("quality rules", keep_good), ("near-duplicates", keep_one), ("secrets", redact_secrets), ("mixing", mix_sources), ("BPE", encode_texts)]

#: SQL can't express the stages with fitted models and merges; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with Scope() as made:
            out = materialise(stage(spark, docs, sf_dir), "pipeline")
            made.release(out)
        discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
