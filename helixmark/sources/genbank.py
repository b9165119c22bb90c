"""GenBank flat files: sequences, and the parts of their coding features."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import readers

_SPAN = re.compile(r"<?(\d+)(?:\.\.>?(\d+))?")


def location_parts(text: str) -> list[tuple[int, int, int]]:
    """(start, end, strand) of a location, in reading order of the forward strand; complements turn the strand."""
    text = re.sub(r"\s+", "", text)
    strand = -1 if text.startswith("complement(") else 1
    out = []
    for m in _SPAN.finditer(text):
        inside = text.rfind("complement(", 0, m.start())
        own = -1 if inside >= 0 and text.count("(", inside, m.start()) > text.count(")", inside, m.start()) else strand if strand < 0 else 1
        out.append((int(m[1]), int(m[2] or m[1]), own))
    return sorted(out)


def _lines(spark: SparkSession, path) -> DataFrame:
    """Lines of GenBank files with their record, from 1 and 0 before the first, the part of it they stand in (head, sequence or none), and the number of CDS features and of feature lines so far."""
    line = F.col("line")
    part = F.when(line.startswith("LOCUS "), "head").when(line.startswith("ORIGIN"), "sequence").when(line.rlike(r"^//\s*$"), "none")
    lines = readers.sections(
        readers.text_lines(spark, path),
        {"record_no": line.startswith("LOCUS ").cast("long"), "feature_no": line.rlike(r"^( {5})?\S").cast("long"), "coding_no": line.rlike(r"^ {5}CDS\s").cast("long"), "at": F.length(_letters())},
        {"part": part},
    )
    return lines.where("record_no > 0").withColumn("record_no", F.col("record_no").cast("int"))


def _letters() -> Column:
    """A sequence line's letters, without its number."""
    return F.when(F.col("line").rlike(r"^\s*\d"), F.regexp_replace("line", "[^A-Za-z]", "")).otherwise("")


def _named(lines: DataFrame) -> DataFrame:
    """(file, record_no, id, description, base): the version, else the locus; the definition with its further lines."""
    line = F.col("line")
    first = lambda p: F.min(F.when(line.rlike(p), F.struct("n", F.regexp_extract("line", p, 1).alias("v"))))["v"]
    head = lines.where("part = 'head'")
    top = head.where(line.rlike(r"^(LOCUS|VERSION)\s+\S")).groupBy("file", "record_no").agg(F.coalesce(first(r"^VERSION\s+(\S+)"), first(r"^LOCUS\s+(\S+)")).alias("id"), F.min("at").alias("base"))
    about = head.where(~line.rlike(r"^( {5}\S| {21})")).groupBy("file", "record_no", "feature_no").agg(_joined("line").alias("text")).where(F.col("text").startswith("DEFINITION"))
    about = about.groupBy("file", "record_no").agg(F.min_by(F.trim(F.regexp_replace(F.regexp_replace("text", "^DEFINITION", ""), r"\s+", " ")), "feature_no").alias("description"))
    return top.join(about, ["file", "record_no"], "left").select("file", "record_no", "id", F.coalesce("description", F.lit("")).alias("description"), "base")


def _joined(column: str, by: str = "\n") -> Column:
    """A group's lines in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", column))), lambda r: r[column]), by)


def pieces(spark: SparkSession, path, letters: int = readers.PIECE) -> tuple[DataFrame, DataFrame]:
    """As readers.fasta_pieces: records (file, record_no, id, description, base) and pieces of their sequences (file, record_no, start, seq)."""
    lines = _lines(spark, path)
    named = _named(lines)
    rows = lines.where("part = 'sequence'").withColumn("letters", F.upper(_letters())).where("letters <> ''").withColumn("at", F.col("at") - F.length("letters"))
    out = rows.groupBy("file", "record_no", F.floor(F.col("at") / letters).alias("piece")).agg(F.min("at").alias("at"), _joined("letters", "").alias("seq"))
    start = F.col("at") - F.min("at").over(Window.partitionBy("file", "record_no"))  # a row per piece
    return named, out.select("file", "record_no", start.alias("start"), "seq")


def records(spark: SparkSession, path) -> DataFrame:
    """(file, record_no, id, description, seq), numbered in order."""
    return readers.whole_sequences(*pieces(spark, path)).select("file", "record_no", "id", "description", "seq")


def sequences(spark: SparkSession, path) -> DataFrame:
    return records(spark, path).select("file", F.col("id").alias("contig"), "description", "seq")


def coding_parts(spark: SparkSession, path) -> DataFrame:
    """(contig, feature_order, part_order, start, end, strand, gene), positions from 1; a feature's lines are gathered, never a record's.

    feature_order numbers a file's coding features from 0. The gene is the first of /gene and /locus_tag that a feature has.
    """
    lines = _lines(spark, path)
    cds = lines.where("part = 'head'").groupBy("file", "record_no", "feature_no").agg(_joined("line").alias("text"), F.min("coding_no").alias("coding_no")).where(F.col("text").rlike(r"^ {5}CDS\s"))
    fields = F.split(F.regexp_replace("text", r"^ {5}CDS\s+", ""), r"\n {21}(?=/)")
    gene = F.get(F.filter("fields", lambda x: x.rlike("^/(gene|locus_tag)=")), F.lit(0))

    @F.pandas_udf("array<struct<start long, end long, strand int>>")
    def parts(where: pd.Series) -> pd.Series:
        return where.map(lambda t: [{"start": a, "end": b, "strand": s} for a, b, s in location_parts(t)])

    out = cds.withColumn("fields", fields).select("file", "record_no", (F.col("coding_no") - 1).cast("int").alias("feature_order"), parts(F.get("fields", F.lit(0))).alias("parts"), F.coalesce(F.trim(F.regexp_replace(gene, "^/[a-z_]+=", ""), F.lit('"')), F.lit("")).alias("gene"))
    out = out.join(_named(lines).select("file", "record_no", F.col("id").alias("contig")), ["file", "record_no"])
    return out.select("contig", "feature_order", F.posexplode("parts").alias("part_order", "p"), "gene").select("contig", "feature_order", "part_order", "p.*", "gene")
