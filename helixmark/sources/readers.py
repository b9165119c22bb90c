"""File sources as DataFrames: VCF, FASTA, matrices, metadata, marker lists, manifests, BED, pileups, FASTQ names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import genotype
from . import bgzf

FASTQ, VCF, FASTA, MATRIX = "fastq", "vcf", "fasta", "matrix"
#: Suffixes by input type, in the order a folder is searched.
SUFFIXES = {
    FASTQ: (".fastq", ".fq", ".fastq.gz", ".fq.gz"),
    VCF: (".vcf", ".vcf.gz", ".g.vcf", ".g.vcf.gz"),
    FASTA: (".fasta", ".fa", ".fna", ".fasta.gz", ".fa.gz", ".fna.gz"),
    MATRIX: (".csv", ".tsv", ".txt"),
}


def input_type(names: list[str], requested: str = "auto") -> str:
    """Of one file or a folder's names: an explicit type wins; else the first type, in order, that a name has; else matrix."""
    if requested != "auto":
        kind = FASTA if requested.startswith("raw_") else requested
        if kind not in SUFFIXES:
            raise ValueError(f"input type {requested} isn't known")
        return kind
    low = [n.lower() for n in names]
    return next((k for k, ends in SUFFIXES.items() if any(n.endswith(ends) for n in low)), MATRIX)


#: Suffixes of GenBank files.
GENBANK = (".gbk", ".gb", ".gbff", ".gbk.gz", ".gb.gz", ".gbff.gz")


def discover(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Files of a type below a path, sorted; any file system that Spark reads."""
    return [x for x in _listed(spark, path) if x.lower().endswith(SUFFIXES[kind])]


def _listed(spark: SparkSession, path: str) -> list[str]:
    return [p for p, _ in _sized(spark, path)]


def _sized(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files that a path names, or that lie in folders it names, with their sizes, sorted."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    out = []
    for s in found or []:
        if s.isDirectory():
            fs = s.getPath().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            out += [(x.getPath().toString(), x.getLen()) for x in fs.listStatus(s.getPath()) if not x.isDirectory()]
        else:
            out.append((s.getPath().toString(), s.getLen()))
    return sorted(out)


def text_lines(spark: SparkSession, path) -> DataFrame:
    """(file, n, line): lines of each file, as many tasks as Spark cuts a file into; n orders a file's lines."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return rows.select("file", F.struct("block", F.monotonically_increasing_id().alias("row")).alias("n"), "line").where("line <> ''")


def sections(lines: DataFrame, sums: dict[str, Column], last: dict[str, Column] | None = None) -> DataFrame:
    """lines (file, n, ...) with running values over each file, the line itself included: sums, and of `last` the latest that isn't NULL.

    A file's lines meet by the ranges that Spark cut it into; what a range needs of those before it is one row.
    """
    last = last or {}
    df = lines.withColumn("__block", F.col("n.block"))
    values = {**{k: v.cast("long") for k, v in sums.items()}, **{k: F.when(v.isNotNull(), F.struct("n", v.alias("v"))) for k, v in last.items()}}
    total = lambda k, c: F.sum(c) if k in sums else F.max(c)
    per = df.groupBy("file", "__block").agg(*[total(k, v).alias(f"__all_{k}") for k, v in values.items()])
    earlier = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    per = per.select("file", "__block", *[total(k, F.col(f"__all_{k}")).over(earlier).alias(f"__from_{k}") for k in values])
    own = Window.partitionBy("file", "__block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(per, ["file", "__block"])
    out = [(F.coalesce(F.col(f"__from_{k}"), F.lit(0)) + F.sum(values[k]).over(own)).alias(k) for k in sums]
    out += [F.coalesce(F.max(values[k]).over(own), F.col(f"__from_{k}"))["v"].alias(k) for k in last]
    return df.select(*lines.columns, *out)


def packed_lines(spark: SparkSession, path, split: int = bgzf.SPLIT) -> DataFrame:
    """As text_lines, but block-gzipped files (.gz) larger than `split` compressed bytes are read by several tasks."""
    found = [f for p in ([path] if isinstance(path, str) else path) for f in _sized(spark, p) if not f[0].rsplit("/", 1)[1].startswith((".", "_"))]
    packed = [f for f in found if f[0].endswith(".gz")]
    if not packed:
        return text_lines(spark, path)
    out, plain = bgzf.text_lines(spark, packed, split), [p for p, _ in found if not p.endswith(".gz")]
    return out.unionByName(text_lines(spark, plain)) if plain else out


def bam(spark: SparkSession, path, split: int = bgzf.SPLIT) -> DataFrame:
    """Alignments of BAM files, with the sample that a file's name tells: (sample, file, n, name, flag, contig, pos, mapq, cigar, seq, qual)."""
    found = [f for p in ([path] if isinstance(path, str) else path) for f in _sized(spark, p) if f[0].lower().endswith(".bam")]
    if not found:
        raise ValueError(f"no BAM files in {path}")
    sample = genotype.sample_id(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?i)\.bam$", ""))
    df = bgzf.reads(spark, found, split)
    return df.select(sample.alias("sample"), *df.columns)


def vcf(spark: SparkSession, path, split: int = bgzf.SPLIT) -> DataFrame:
    """Records of single-sample VCF files: (sample, line_no, chrom, pos, ref, alt, qual, filter, info, sample_fields).

    line_no orders a file's lines. The header's tenth column names the sample, else the file. Block-gzipped files are cut at `split` compressed bytes. Lines with fewer than 8 fields are dropped.
    """
    lines = packed_lines(spark, path, split)
    head = lines.where(F.col("line").startswith("#CHROM")).groupBy("file").agg(F.max(F.get(F.split("line", "\t"), F.lit(9))).alias("named"))
    body = lines.where(~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t")).where(F.size("f") >= 8)
    get = lambda i: F.get("f", F.lit(i))
    name = genotype.sample_id(genotype.sample_of_path(F.col("file")))
    return body.join(head, "file", "left").select(
        F.coalesce(F.when(F.trim("named") != "", genotype.sample_id(F.col("named"))), name).alias("sample"),
        F.col("n").alias("line_no"),
        get(0).alias("chrom"),
        get(1).try_cast("long").alias("pos"),
        F.upper(get(3)).alias("ref"),
        F.upper(get(4)).alias("alt"),
        genotype.number(get(5)).alias("qual"),
        get(6).alias("filter"),
        genotype.info_map(get(7)).alias("info"),
        F.when(F.size("f") >= 10, genotype.sample_map(get(8), get(9))).alias("fields"),
    )


def classified(records: DataFrame, q: genotype.Quality = genotype.Quality()) -> DataFrame:
    """VCF records with their state, allele and reasons: (sample, line_no, chrom, pos, end, ref, alt, state, allele, reasons, block)."""
    info = lambda k: F.try_element_at("info", F.lit(k))
    field = lambda k: F.try_element_at("fields", F.lit(k))
    gt = field("GT")
    dp = F.coalesce(genotype.number(field("DP")), genotype.number(info("DP")))
    gq = F.coalesce(genotype.number(field("GQ")), genotype.number(info("GQ")))
    df = records.withColumn("reasons", genotype.qc_reasons(F.col("qual"), F.col("filter"), dp, gq, genotype.number(info("MQ")), genotype.number(info("MQ0F")), q))
    df = df.withColumn("state", genotype.record_state(F.col("ref"), F.col("alt"), gt, F.size("reasons") > 0, None, q))
    end = genotype.number(info("END")).cast("long")
    return df.select("sample", "line_no", "chrom", "pos", F.greatest(F.coalesce(end, F.col("pos")), F.col("pos")).alias("end"), "ref", "alt", "state", genotype.called_allele(F.col("ref"), F.col("alt"), gt, F.col("state")).alias("allele"), "reasons", genotype.is_reference_block(F.col("alt"), F.col("state"), F.col("pos"), end).alias("block"))


def callset(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of classified records the calls by place (of several records the last), and the reference blocks: (sample, chrom, pos, state, allele) and (sample, chrom, start, end, ord, ref)."""
    by = ["sample", "chrom", "pos"]
    last = calls.groupBy(*by).agg(F.max_by(F.struct("state", "allele"), "line_no").alias("c")).select(*by, "c.state", "c.allele")
    blocks = calls.where("block").select("sample", "chrom", F.col("pos").alias("start"), "end", F.col("line_no").alias("ord"), F.when(F.length("ref") == 1, F.col("ref")).otherwise(F.col("allele")).alias("ref"))
    return last, blocks


def genomes(spark: SparkSession, folder: str) -> DataFrame:
    """(file, name, record_no, id, description, seq) of all FASTA and GenBank files of a folder, packed or not; name is the file's without suffix."""
    from . import genbank

    def listed(ends: tuple[str, ...]) -> list[str]:
        return [x for x in _listed(spark, folder) if x.lower().endswith(ends)]

    parts = []
    if found := listed(SUFFIXES[FASTA]):
        parts.append(fasta(spark, found))
    if found := listed(GENBANK):
        parts.append(genbank.records(spark, found).select("file", "record_no", "id", "description", "seq"))
    if not parts:
        raise ValueError(f"no genome files in {folder}")
    df = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?i)\.(fasta|fa|fna|gbk|gb|gbff)(\.gz)?$", "")
    return df.select("file", name.alias("name"), "record_no", "id", "description", "seq")


def rows(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, cells): a CSV, TSV or TXT table's rows as arrays of trimmed cells; rows of blank cells only are left out."""
    low = path.lower()
    if not low.endswith((".csv", ".tsv", ".txt")):
        raise ValueError(f"the format of {path} isn't known")
    return _cells(spark, path, "," if low.endswith(".csv") else "\t", ("utf-8",)).where(F.exists("cells", lambda c: c != ""))


#: Encodings of annotation tables, in the order they're tried.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1251", "cp1252", "latin-1")


def annotation(spark: SparkSession, path: str) -> DataFrame:
    """An annotation TSV with its header's columns, in the first of ENCODINGS that fits the whole file; short rows are filled with NULL."""
    cells = _cells(spark, path, "\t", ENCODINGS, trim=False)
    head = cells.orderBy("row_no").select("cells").first()
    if head is None:
        raise ValueError(f"{path} is empty")
    names = [n.lstrip("\ufeff") for n in head["cells"]]
    return cells.where("row_no > 0").select("row_no", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def _cells(spark: SparkSession, path: str, delimiter: str, encodings: tuple[str, ...], trim: bool = True) -> DataFrame:
    """(row_no, cells) of one delimited file; quotes and encodings are read in Python, the file by one task."""
    import csv
    import io
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data, text = content.as_py(), None
                for e in encodings:
                    try:
                        text = data.decode(e)
                        break
                    except UnicodeDecodeError:
                        continue
                if text is None:
                    raise ValueError(f"the file is in none of {', '.join(encodings)}")
                kept: list[list[str]] = []
                n = 0
                for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
                    if row:
                        kept.append([c.strip() for c in row] if trim else row)
                    if len(kept) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(kept)), pa.int64()), pa.array(kept, pa.list_(pa.string()))], ["row_no", "cells"])
                        n, kept = n + len(kept), []
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(kept)), pa.int64()), pa.array(kept, pa.list_(pa.string()))], ["row_no", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row_no long, cells array<string>")


def gff(spark: SparkSession, path) -> DataFrame:
    """Features of GFF files: (contig, source, type, start, end, score, strand, phase, attributes); strand is 1, -1 or 0. What follows ##FASTA has fewer columns and is left out."""
    f = F.split("line", "\t")
    lines = text_lines(spark, path).where(~F.col("line").startswith("#") & (F.size(f) == 9)).withColumn("f", f)
    get = lambda i: F.get("f", F.lit(i))
    known = lambda i: F.nullif(get(i), F.lit("."))
    strand = F.when(get(6) == "+", 1).when(get(6) == "-", -1).otherwise(0)
    return lines.select(get(0).alias("contig"), get(1).alias("source"), get(2).alias("type"), get(3).try_cast("long").alias("start"), get(4).try_cast("long").alias("end"), genotype.number(known(5)).alias("score"), strand.alias("strand"), known(7).try_cast("int").alias("phase"), genotype.info_map(get(8)).alias("attributes"))


#: Letters of a piece of a sequence; a line is never cut.
PIECE = 65536


def fasta_pieces(spark: SparkSession, path, letters: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Records of FASTA files, (file, record_no, id, description, base), and their sequences as pieces of about `letters` letters: (file, record_no, start, seq).

    start is a piece's first letter in its record, from 0. A file is read by as many tasks as Spark cuts it
    into, and a row is never longer than a piece and a line. Lines before the first header are left out.
    """
    header = F.col("line").startswith(">")
    clean = F.when(header, "").otherwise(F.upper(F.regexp_replace("line", r"\s+", "")))
    lines = text_lines(spark, path).withColumn("line", F.when(header, F.col("line")).otherwise(clean))
    lines = sections(lines, {"record_no": header.cast("long"), "at": F.when(header, 0).otherwise(F.length("line"))}).where("record_no > 0")
    lines = lines.withColumns({"record_no": F.col("record_no").cast("int"), "at": F.when(header, F.col("at")).otherwise(F.col("at") - F.length("line"))})
    about = F.substring("line", 2, 2**31 - 1)
    heads = lines.where(header).select("file", "record_no", F.regexp_extract(about, r"^(\S*)", 1).alias("id"), about.alias("description"), F.col("at").alias("base"))
    pieces = lines.where(~header & (F.length("line") > 0)).groupBy("file", "record_no", F.floor(F.col("at") / letters).alias("piece"))
    each = F.array_sort(F.collect_list(F.struct("at", "line")))
    pieces = pieces.agg(F.min("at").alias("at"), F.array_join(F.transform(each, lambda r: r["line"]), "").alias("seq"))
    return heads, pieces.join(heads, ["file", "record_no"]).select("file", "record_no", (F.col("at") - F.col("base")).alias("start"), "seq")


def whole_sequences(records: DataFrame, pieces: DataFrame) -> DataFrame:
    """records (file, record_no, ...) with `seq`, their pieces in one value: for records that a row can hold."""
    each = F.array_sort(F.collect_list(F.struct("start", "seq")))
    seqs = pieces.groupBy("file", "record_no").agg(F.array_join(F.transform(each, lambda r: r["seq"]), "").alias("seq"))
    return records.join(seqs, ["file", "record_no"], "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def fasta(spark: SparkSession, path) -> DataFrame:
    """(file, record_no, id, description, seq), numbered in order; the id is the header's first word."""
    return whole_sequences(*fasta_pieces(spark, path)).select("file", "record_no", "id", "description", "seq")


def joined_sequence(records: DataFrame, spacer: int = 100, longest: bool = False) -> DataFrame:
    """(file, seq): records joined by `spacer` N, or the longest (the first of equal ones)."""
    if longest:
        return records.groupBy("file").agg(F.min_by("seq", F.struct((-F.length("seq")).alias("l"), "record_no")).alias("seq"))
    each = F.array_sort(F.collect_list(F.struct("record_no", "seq")))
    return records.groupBy("file").agg(F.array_join(F.transform(each, lambda r: r["seq"]), "N" * spacer).alias("seq"))


def matrix(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A wide matrix as long rows (sample, feature, value); what isn't 0 or 1 is NULL."""
    t = spark.read.csv(path, header=True, sep=sep)
    first, rest = t.columns[0], t.columns[1:]
    long = t.unpivot([first], rest, "feature", "v").withColumnRenamed(first, "sample")
    x = F.col("v").try_cast("double")
    return long.select("sample", "feature", F.when(x.isin(0.0, 1.0), x).alias("value"))


def metadata(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Labels by sample: column Sample, else the first, becomes `sample`; at least one label column."""
    t = spark.read.csv(path, header=True, sep=sep)
    name = "Sample" if "Sample" in t.columns else t.columns[0]
    if len(t.columns) < 2:
        raise ValueError("metadata needs a sample and a label column")
    return t.withColumnRenamed(name, "sample")


def markers(spark: SparkSession, path: str) -> DataFrame:
    """(ord, marker) of a list with # comments, distinct, in order of first occurrence."""
    lines = text_lines(spark, path).select("n", F.trim(F.regexp_replace("line", "#.*", "")).alias("marker")).where("marker <> ''")
    return lines.groupBy("marker").agg(F.min("n").alias("ord")).select("ord", "marker")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Feature manifest with normalised columns; alias columns of the context, and a default centre of half its length."""
    t = spark.read.csv(path, header=True, sep="\t")
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in t.columns], F.lit(None).cast("string"))
    context = pick("Context_±40", "Context", "Context_sequence")
    ident = genotype.feature_parts(pick("Feature_ID"))
    return t.select(
        pick("Feature_ID").alias("feature"),
        F.coalesce(pick("Position").try_cast("long"), ident["pos"].try_cast("long")).alias("pos"),
        ident["contig"].alias("chrom"),
        F.coalesce(pick("Ref_allele"), ident["ref"]).alias("ref"),
        F.coalesce(pick("Alt_allele"), ident["alt"]).alias("alt"),
        F.coalesce(pick("Baseline_allele"), pick("Ref_allele"), ident["ref"]).alias("baseline"),
        context.alias("context"),
        F.coalesce(pick("Context_center_offset").try_cast("int"), F.floor(F.length(context) / 2).cast("int")).alias("centre"),
    )


def hierarchical(table: DataFrame, delimiter: str = "|") -> DataFrame:
    """A table whose first column is L1|L2|...|sample, as (labels, sample, feature, state); label arrays have equal length, padded with ''."""
    first, rest = table.columns[0], table.columns[1:]
    parts = F.split(F.col(f"`{first}`"), "\\" + delimiter)
    df = table.withColumns({"sample": F.trim(F.element_at(parts, -1)), "labels": F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.trim(x))})
    depth = df.agg(F.max(F.size("labels"))).first()[0] or 0
    df = df.withColumn("labels", F.concat("labels", F.array_repeat(F.lit(""), F.lit(depth) - F.size("labels"))))
    return df.unpivot(["labels", "sample"], rest, "feature", "state")


def hierarchical_binary(table: DataFrame, levels: list[int], delimiter: str = "|") -> DataFrame:
    """A hierarchical matrix for distance tests, as (sample, label, feature, value): strictly 0 or 1, and of one depth.

    levels: 1 is the last label, n the first; the label joins the given ones in that order. Rows with a blank
    part of it are dropped, repeated samples get suffixes. Ragged paths, empty samples, missing values and any
    other value than 0 and 1 raise an error when read.
    """
    from ..operators import tables

    first, rest = table.columns[0], table.columns[1:]
    parts = F.split(F.trim(F.col(f"`{first}`")), "\\" + delimiter)
    depths = table.agg(F.min(F.size(parts)), F.max(F.size(parts))).first()
    if depths[0] is None or depths[0] != depths[1] or depths[0] < 2:
        raise ValueError("all rows need the same number of labels, at least one, before the sample")
    if not levels or min(levels) < 1 or max(levels) >= depths[0]:
        raise ValueError(f"levels go from 1 to {depths[0] - 1}")
    df = table.withColumns({"__sample": F.trim(F.element_at(parts, -1)), "__labels": F.array(*[F.trim(F.get(parts, F.lit(depths[0] - 1 - k))) for k in levels])})
    df = df.withColumn("__sample", F.when(F.col("__sample") == "", F.raise_error(F.lit("an empty sample")).cast("string")).otherwise(F.col("__sample")))
    order = [f"`{c}`" for c in table.columns]
    df = tables.suffixed(df, "__sample", order).where(F.forall("__labels", lambda x: x != ""))
    long = df.select(F.col("name").alias("sample"), F.array_join("__labels", delimiter).alias("label"), *[F.col(f"`{c}`").cast("string").alias(c) for c in rest]).unpivot(["sample", "label"], rest, "feature", "v")
    x = F.trim("v").try_cast("double")
    bad = F.raise_error(F.concat(F.lit("not 0 or 1: "), F.coalesce("v", F.lit("NULL")), F.lit(" in "), F.col("feature"))).cast("double")
    return long.select("sample", "label", "feature", F.when(x.isin(0.0, 1.0), x).otherwise(bad).alias("value"))


def data_type(states: DataFrame, missing: str = "nd") -> str:
    """binary if all states of rows (state) but missing ones are 0 or 1, else character; no more than 33 distinct states are looked at, as more can't be binary."""
    found = states.select(F.lower(F.trim(F.col("state").cast("string"))).alias("s")).where((F.col("s") != missing) & F.col("s").isNotNull()).distinct().limit(33).collect()
    return "binary" if found and {r["s"] for r in found} <= {"0", "1"} else "character"


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, name) of a BED file; starts count from 0, positions from 1."""
    f = F.split("line", "\t")
    return text_lines(spark, path).where(~F.col("line").rlike("^(#|track|browser)")).select(F.get(f, F.lit(0)).alias("chrom"), (F.get(f, F.lit(1)).try_cast("long") + 1).alias("pos"), F.get(f, F.lit(3)).alias("name"))


def pileup(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("line", "\t")
    return text_lines(spark, path).where(F.size(f) >= 5).select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.upper(F.get(f, F.lit(2))).alias("ref"), F.get(f, F.lit(3)).try_cast("int").alias("depth"), F.get(f, F.lit(4)).alias("bases"))


def fastq_names(names: DataFrame) -> DataFrame:
    """(name, sample, lane, mate) by Casava names, then _R1/_R2, then _1/_2 or .1/.2."""
    stem = F.regexp_replace("name", r"(?i)\.(fastq|fq)(\.gz)?$", "")
    casava = r"^(.+)_S[0-9]+_(L[0-9]{3})_R([12])_[0-9]{3}$"
    mate = r"^(.+?)(?:_(L[0-9]{3}))?_R([12])(?:_[0-9]{3})?$"
    plain = r"^(.+)()[_.]([12])$"
    got = None
    for p in (plain, mate, casava):
        here = F.struct(*[F.regexp_extract(stem, p, i).alias(a) for i, a in ((1, "sample"), (2, "lane"), (3, "mate"))])
        got = F.when(stem.rlike(p), here) if got is None else F.when(stem.rlike(p), here).otherwise(got)
    return names.select("name", got.alias("g")).where("g IS NOT NULL").select("name", "g.sample", "g.lane", "g.mate")


def fastq_pairs(parsed: DataFrame) -> DataFrame:
    """(sample, lane, r1, r2, duplicates) of parsed names."""
    one = lambda m: F.max(F.when(F.col("mate") == m, F.col("name")))
    n = lambda m: F.count_if(F.col("mate") == m)
    return parsed.groupBy("sample", "lane").agg(one("1").alias("r1"), one("2").alias("r2"), ((n("1") > 1) | (n("2") > 1)).alias("duplicates"))
