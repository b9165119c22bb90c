"""Queries of the corpus operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, lexical_search, mixing, pii, quality_classifier, quality_rules, secrets, simhash, tiff, warc

HELD_OUT_FOLDS = 5
KEEP_FROM = 0.3
PII_KEY = b"demonstration"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of the held-out fold are never read."""
    docs = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % HELD_OUT_FOLDS == 0
    labels = _read(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = quality_classifier.score(docs, quality_classifier.fit(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data. The key is a parameter; in production it's a secret."""
    out = pii.pseudonymise(_read(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "text", *[f"n_{k}" for k in pii.KINDS], "entities")


def _stored(media: bytes, payload: bytes) -> dict:
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": tiff.feature(np.frombuffer(payload, np.uint8)),
    }


_stored.columns = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def op3_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF file, and what is read back from it."""
    return tiff.read_back(tiff.encode(_read(spark, sf_dir, "documents")), _stored)


#: How the transcripts of op4 mark speakers; a transcript has one style. The last three have names that no list of the parser has.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### System\n", "### Human\n", "### Assistant\n"),
    ("[sys] ", "[q] ", "[a] "),
    ("<|system|>", "<|user|>", "<|assistant|>"),
    ("**Instructions**: ", "**Customer**: ", "**Agent**: "),
    ("Narrator: ", "Visitor: ", "Guide: "),
    ("Rules: ", "Alice: ", "Bob: "),
    ("Chair: ", "Delegate: ", "Clerk: "),
)


def transcripts(conversations: DataFrame) -> DataFrame:
    """Conversations as raw transcripts: each row's text behind a speaker marker of its transcript's style; every third row has none. `known` tells whether the style's names are the parser's."""
    style = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % len(STYLES)
    bare = F.crc32(F.concat_ws(":", F.col("conv_id"), F.col("turn"))) % 3 == 0
    mark = F.lit("")
    for k, names in enumerate(STYLES):
        for role, name in zip(("system", "user", "assistant"), names):
            mark = F.when((style == k) & (F.col("role") == role) & ~bare, F.lit(name)).otherwise(mark)
    return conversations.withColumns({"raw": F.concat(mark, F.coalesce("text", F.lit(""))), "known": style < 5, "marked": mark != ""})


#: Turns of a transcript that op4 has in one text, at most.
TURNS = 8


def joined(raw: DataFrame) -> DataFrame:
    """Transcripts with TURNS turns to a text, one after another: (conv_id, place, text), and of each line its role and turn."""
    given = F.sort_array(F.collect_list(F.struct("turn", "raw", "role")))
    each = lambda f: F.flatten(F.transform("given", lambda x: F.array_repeat(x[f], F.size(F.split(x["raw"], "\n")))))
    texts = raw.groupBy("conv_id", F.floor(F.col("turn") / TURNS).alias("place")).agg(given.alias("given"))
    return texts.select("conv_id", "place", F.array_join(F.transform("given", lambda x: x["raw"]), "\n").alias("text"), each("role").alias("roles"), each("turn").alias("turns"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and their roles recovered from raw transcripts, many turns to a text; roles of the held-out fold are never learned from. `turn` and `given_role` are those of a turn's first line."""
    raw = joined(transcripts(_read(spark, sf_dir, "conversations")))
    held_out = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % HELD_OUT_FOLDS == 0
    rows = chat.arranged(raw, "conv_id", "place", "text", F.when(~held_out, F.col("roles")).alias("learned"), F.col("roles"), F.col("turns"), held_out.alias("held_out"))
    found = chat.parse(rows.drop("learned"), chat.fit(rows.select("ident", "place", "text", "learned"), by_line=True), by_line=True)
    first = lambda c: F.get(c, F.col("line"))
    return found.select(F.col("ident").alias("conv_id"), first("turns").alias("turn"), "block", "role", "continues", "turn_text", first("roles").alias("given_role"), "held_out")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, normalised, and read back."""
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Digests of each text's ids and of what they decode to."""
    both = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(_read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_rules.quality_report(_read(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents within occurrences of windows of the benchmark, and the items that occur. Null and empty texts have no words."""
    found = decontamination.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_items, digest = F.size("items").cast("long"), F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item. Null and empty texts are never found, items without terms have no rows."""
    return lexical_search.search(lexical_search.index(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_classifier, op2_pii, op3_tiff, op4_chat, op5_warc, op6_bpe, op7_simhash, op8_quality_rules, op9_secrets, op10_mixing, op11_decontamination, op12_lexical_search)}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {"op5_warc": sql.WARC, "op8_quality_rules": sql.QUALITY_RULES, "op10_mixing": sql.MIXING, "op11_decontamination": sql.DECONTAMINATION, "op12_lexical_search": sql.LEXICAL_SEARCH}
