"""Sinks: texts of matrices, VCF, BED, FASTA and reports as DataFrames of lines, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wrapped(seq: Column, width: int = 60) -> Column:
    """A sequence with a line break after every `width` letters."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def fasta_lines(records: DataFrame, width: int = 60) -> DataFrame:
    return records.select(F.concat(F.lit(">"), F.col("id"), F.lit("\n"), wrapped(F.col("seq"), width)).alias("value"))


def bed_lines(sites: DataFrame) -> DataFrame:
    """Unique positions, from 0."""
    return sites.select("chrom", "pos").distinct().select(F.concat_ws("\t", "chrom", F.col("pos") - 1, "pos").alias("value"))


def vcf_body(calls: DataFrame) -> DataFrame:
    """calls (chrom, pos, ref, allele, depth, fraction, state, ...) with `value`, their VCF lines; sites without a call are missing, not reference."""
    gt = F.when(F.col("state") != "called", "./.").when(F.col("allele") == F.col("ref"), "0/0").otherwise("1/1")
    alt = F.when((F.col("state") == "called") & (F.col("allele") != F.col("ref")), F.col("allele")).otherwise(".")
    return calls.withColumn("value", F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", alt, F.lit("."), F.lit("PASS"), F.concat(F.lit("DP="), "depth", F.lit(";AF="), F.format_string("%.3f", "fraction")), F.lit("GT:DP"), F.concat_ws(":", gt, "depth")))


def vcf_lines(calls: DataFrame, sample: str) -> DataFrame:
    """Lines (ord, value) of a VCF of one sample's calls, with its header."""
    head = calls.sparkSession.createDataFrame([(0, "", 0, "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + sample)], "k int, chrom string, pos long, value string")
    body = vcf_body(calls).select(F.lit(1).alias("k"), "chrom", F.col("pos").cast("long").alias("pos"), "value")
    return head.unionByName(body).select(F.struct("k", "chrom", "pos").alias("ord"), "value")


def matrix_lines(matrix: DataFrame) -> DataFrame:
    """One line per sample of a long matrix: values in order of feature, NULL empty."""
    each = F.array_sort(F.collect_list(F.struct("feature", F.coalesce(F.col("value").cast("int").cast("string"), F.lit("")).alias("v"))))
    return matrix.groupBy("sample").agg(F.concat_ws("\t", F.col("sample"), F.array_join(F.transform(each, lambda x: x["v"]), "\t")).alias("value"))


def audit(steps: DataFrame) -> DataFrame:
    """(sample, route): each sample's steps as JSON, in order."""
    each = F.array_sort(F.collect_list(F.struct("depth", "node", "child", "score")))
    return steps.groupBy("sample").agg(F.to_json(each).alias("route"))


def _cut(rows: DataFrame, limit: int) -> tuple[list, str]:
    """At most `limit` rows, and a note of how many there are, where there are more."""
    first = rows.limit(limit + 1).collect()
    return first[:limit], f"{limit} of {rows.count()} rows" if len(first) > limit else ""


def html_report(rows: DataFrame, title: str, limit: int = 10_000) -> str:
    """An HTML table of at most `limit` rows, which says so where there are more (html_lines has all)."""
    from html import escape

    shown, note = _cut(rows, limit)
    head = "".join(f"<th>{escape(c)}</th>" for c in rows.columns)
    body = "\n".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in shown)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1>{f'<p>{note}</p>' if note else ''}<table><tr>{head}</tr>\n{body}</table></body></html>"


def text_report(rows: DataFrame, limit: int = 10_000) -> str:
    """A line for each of at most `limit` rows, and a last one that says so where there are more (text_lines has all)."""
    shown, note = _cut(rows, limit)
    return "\n".join(["; ".join(f"{c}: {v}" for c, v in zip(rows.columns, r)) for r in shown] + ([note] if note else []))


def _text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def html_lines(rows: DataFrame, title: str, order: list[str]) -> DataFrame:
    """Lines (ord, value) of an HTML table of all rows, for write_lines; made by the tasks."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = rows.select(F.struct(F.lit(1).alias("k"), *order).alias("ord"), F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *[safe(_text(c)) for c in rows.columns]), F.lit("</td></tr>")).alias("value"))
    kind = body.schema["ord"].dataType
    head = "<!DOCTYPE html><html><head><meta charset='utf-8'></head><body><h1>" + title.replace("&", "&amp;").replace("<", "&lt;") + "</h1><table><tr>" + "".join(f"<th>{c}</th>" for c in rows.columns) + "</tr>"
    nulls = {f.name: None for f in kind.fields}
    ends = rows.sparkSession.createDataFrame([(nulls | {"k": 0}, head), (nulls | {"k": 2}, "</table></body></html>")], T.StructType([T.StructField("ord", _nullable(kind)), T.StructField("value", T.StringType())]))
    return ends.unionByName(body)


def _nullable(kind: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in kind.fields])


def text_lines(rows: DataFrame) -> DataFrame:
    """A line (value) for each of all rows, with their own columns."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))) for c in rows.columns]
    return rows.withColumn("value", F.concat_ws("; ", *parts))


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Text files of a DataFrame of lines; with an order, range-sorted over the files."""
    df = lines.orderBy(*order) if order else lines
    df.select("value").write.mode("overwrite").text(path)


def write_tsv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The given columns that rows has, as TSV with a header."""
    rows.select(*[c for c in columns if c in rows.columns]).write.mode("overwrite").csv(path, sep="\t", header=True)
