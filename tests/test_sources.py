import gzip

import pytest
from pyspark.sql import functions as F

from helixmark.functions.genotype import ALTERNATE, FILTERED, REFERENCE, UNRESOLVED
from helixmark.sources import readers, writers
from helixmark.streaming import calls as streams

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tERR7.vcf
c\t5\t.\tA\tC\t50\tPASS\tDP=20;MQ=60\tGT:DP\t1/1:20
c\t6\t.\tA\tC\t10\tPASS\tDP=20;MQ=60\tGT\t1/1
c\t7\t.\tA\t<NON_REF>\t50\t.\tDP=20;MQ=60;END=90\tGT\t0/0
c\t8\t.\tAT\tC\t50\tPASS\tDP=20;MQ=60\tGT\t1/1
broken\tline
"""


def test_vcf(spark, tmp_path):
    with gzip.open(tmp_path / "x.vcf.gz", "wt") as f:
        f.write(VCF)
    rows = readers.classified(readers.vcf(spark, str(tmp_path))).orderBy("pos").collect()
    assert [r["state"] for r in rows] == [ALTERNATE, FILTERED, REFERENCE, UNRESOLVED]
    assert {r["sample"] for r in rows} == {"ERR7"} and rows[2]["end"] == 90 and rows[2]["block"] and rows[0]["allele"] == "C"
    assert rows[1]["reasons"] == ["QUAL_low"]


def test_fasta(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a one\nacg\nT\n>b\n\n>c two\nGGGG\n")
    f = readers.fasta(spark, str(tmp_path / "g.fa"))
    assert [(r["id"], r["seq"]) for r in f.orderBy("record_no").collect()] == [("a", "ACGT"), ("b", ""), ("c", "GGGG")]
    assert readers.joined_sequence(f, 2).first()["seq"] == "ACGTNNNNGGGG"
    assert readers.joined_sequence(f, longest=True).first()["seq"] == "ACGT"
    lines = "\n".join(r["value"] for r in writers.fasta_lines(f.where("id = 'a'"), 3).collect())
    assert lines == ">a\nACG\nT"


def test_matrix_and_lists(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Sample\tf1\tf2\ns1\t0\t1.0\ns2\t\t2\n")
    m = readers.matrix(spark, str(tmp_path / "m.tsv"))
    assert {tuple(r) for r in m.collect()} == {("s1", "f1", 0.0), ("s1", "f2", 1.0), ("s2", "f1", None), ("s2", "f2", None)}
    assert {r["value"] for r in writers.matrix_lines(m).collect()} == {"s1\t0\t1", "s2\t\t"}
    assert readers.metadata(spark, str(tmp_path / "m.tsv")).columns == ["sample", "f1", "f2"]
    (tmp_path / "k.txt").write_text("# list\nb\na # x\nb\n")
    assert [r["marker"] for r in readers.markers(spark, str(tmp_path / "k.txt")).orderBy("ord").collect()] == ["b", "a"]
    (tmp_path / "f.tsv").write_text("Feature_ID\tContext_±40\tBaseline_allele\nc:7:A:G\tACGTA\t\n")
    r = readers.manifest(spark, str(tmp_path / "f.tsv")).first()
    assert (r["pos"], r["ref"], r["alt"], r["baseline"], r["centre"]) == (7, "A", "G", "A", 2)
    (tmp_path / "p.bed").write_text("track x\nc\t4\t5\tn\n")
    assert tuple(readers.bed(spark, str(tmp_path / "p.bed")).first()) == ("c", 5, "n")


def test_hierarchical_labels(spark):
    t = spark.createDataFrame([("A| A1|s1", "0"), ("B|s2", "1")], "id string, f string")
    got = {r["sample"]: (r["labels"], r["state"]) for r in readers.hierarchical(t).collect()}
    assert got == {"s1": (["A", "A1"], "0"), "s2": (["B", ""], "1")}


def test_input_types():
    assert readers.input_type(["x"], "raw_sequence") == "fasta" and readers.input_type(["x.vcf.gz"]) == "vcf"
    assert readers.input_type(["s_R1.fastq.gz", "other.vcf"]) == "fastq" and readers.input_type(["x.bin"]) == "matrix"
    with pytest.raises(ValueError):
        readers.input_type(["x"], "bam")


def test_discovery(spark, tmp_path):
    for n in ("b.vcf", "a.vcf.gz", "c.txt"):
        (tmp_path / n).write_text("")
    assert [x.rsplit("/", 1)[1] for x in readers.discover(spark, str(tmp_path), "vcf")] == ["a.vcf.gz", "b.vcf"]


def test_fastq_pairs(spark):
    names = spark.createDataFrame([("S_S1_L001_R1_001.fastq.gz",), ("S_S1_L001_R2_001.fastq.gz",), ("T_1.fq",), ("T_2.fq",), ("notes.txt",)], "name string")
    got = {(r["sample"], r["lane"]): (r["r1"] is not None and r["r2"] is not None, r["duplicates"]) for r in readers.fastq_pairs(readers.fastq_names(names)).collect()}
    assert got == {("S", "L001"): (True, False), ("T", ""): (True, False)}


def test_vcf_text(spark):
    calls = spark.createDataFrame([("c", 1, "A", "A", 10, 1.0, "called"), ("c", 2, "A", "G", 10, 0.9, "called"), ("c", 3, "A", None, 2, 0.5, "low_depth")], "chrom string, pos long, ref string, allele string, depth int, fraction double, state string")
    lines = [r["value"].split("\t")[-1].split(":")[0] for r in writers.vcf_lines(calls, "s").orderBy("ord").collect()]
    assert lines[1:] == ["0/0", "1/1", "./."]


def test_sessions_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10).parquet(str(tmp_path / "in"))
    q = streams.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.table("w").collect()}
    assert got == {(r["start"], r["event_type"], r["n"]) for r in streams.windowed_counts(events).collect()}


def test_reports(spark):
    rows = spark.createDataFrame([("a<b", 1)], "x string, y int")
    assert "a&lt;b" in writers.html_report(rows, "t") and writers.text_report(rows) == "x: a<b; y: 1"


def test_audit_and_distribution(spark):
    from helixmark.operators import selection

    steps = spark.createDataFrame([("s", 2, "A", "A|1", 0.5), ("s", 1, "", "A", 0.9)], "sample string, depth int, node string, child string, score double")
    assert writers.audit(steps).first()["route"].index('"child":"A"') < writers.audit(steps).first()["route"].index('"child":"A|1"')
    assert [r["f"] for r in selection.distribution(3.0, iter([1.0, 2.0]), spark, "f").orderBy("replicate").collect()] == [3.0, 1.0, 2.0]


def test_matrix_files_are_written(spark, tmp_path):
    m = spark.createDataFrame([("b", "f", 1.0), ("a", "f", 0.0)], "sample string, feature string, value double")
    writers.write_lines(writers.matrix_lines(m), str(tmp_path / "m"), ["sample"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["a\t0", "b\t1"]
    writers.write_tsv(m, str(tmp_path / "t"), ["sample", "absent", "value"])
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).columns == ["sample", "value"]


def test_tables_of_rows(spark, tmp_path):
    (tmp_path / "t.tsv").write_text(' a \t b\n\n \t \n"x\ty"\t 2 \n')
    got = [r["cells"] for r in readers.rows(spark, str(tmp_path / "t.tsv")).orderBy("row_no").collect()]
    assert got == [["a", "b"], ["x\ty", "2"]]
    with pytest.raises(ValueError):
        readers.rows(spark, "t.bin")
    for text, encoding in (("Имя\tГен\nа\tб\n", "utf-8"), ("\ufeffName\tGene\nx\ty\n", "utf-8"), ("Имя\tГен\nа\tб\n", "cp1251")):
        (tmp_path / "a.tsv").write_bytes(text.encode(encoding))
        df = readers.annotation(spark, str(tmp_path / "a.tsv"))
        names, row = text.lstrip("\ufeff").split("\n")[:2]
        assert df.columns[1:] == names.split("\t") and list(df.first())[1:] == row.split("\t")


def test_gff_and_genomes(spark, tmp_path):
    (tmp_path / "x.gff").write_text("##gff-version 3\nc\tsrc\tCDS\t5\t9\t.\t-\t0\tID=g1;Name=a=b\n##FASTA\n>c\nACGT\n")
    r = readers.gff(spark, str(tmp_path / "x.gff")).collect()
    assert len(r) == 1 and (r[0]["contig"], r[0]["start"], r[0]["end"], r[0]["strand"], r[0]["score"], r[0]["phase"]) == ("c", 5, 9, -1, None, 0)
    assert r[0]["attributes"] == {"ID": "g1", "Name": "a=b"}
    with gzip.open(tmp_path / "g.fna.gz", "wt") as f:
        f.write(">one\nAC\nGT\n>two\nTT\n")
    (tmp_path / "h.gbk").write_text("LOCUS       L1 4 bp\nDEFINITION  about it\nVERSION     V1\nFEATURES             x\nORIGIN\n        1 acgt\n//\n")
    got = {(r["name"], r["id"]): r["seq"] for r in readers.genomes(spark, str(tmp_path)).collect()}
    assert got == {("g", "one"): "ACGT", ("g", "two"): "TT", ("h", "V1"): "ACGT"}
    with pytest.raises(ValueError):
        readers.genomes(spark, str(tmp_path / "x.gff"))


def test_strict_hierarchies(spark):
    t = lambda rows: spark.createDataFrame(rows, "id string, f string, g string")
    ok = readers.hierarchical_binary(t([("A|x|s", "0", "1.0"), ("A|y|s", "1", "0"), ("B| |u", "1", "1")]), [1])
    assert {(r["sample"], r["label"], r["feature"]): r["value"] for r in ok.collect()} == {("s", "x", "f"): 0, ("s", "x", "g"): 1, ("s__dup2", "y", "f"): 1, ("s__dup2", "y", "g"): 0}
    assert {r["label"] for r in readers.hierarchical_binary(t([("A|x|s", "0", "1")]), [2, 1]).collect()} == {"A|x"}
    for rows, levels in (([("A|s", "0", "1"), ("A|B|t", "0", "1")], [1]), ([("s", "0", "1")], [1]), ([("A|s", "0", "1")], [2])):
        with pytest.raises(ValueError):
            readers.hierarchical_binary(t(rows), levels)
    for rows in ([("A|s", "0", None)], [("A|s", "0", "nd")], [("A|s", "0", "2")], [("A|", "0", "1")]):
        with pytest.raises(Exception, match="not 0 or 1|empty sample"):
            readers.hierarchical_binary(t(rows), [1]).collect()


def test_data_types(spark):
    kind = lambda *x: readers.data_type(spark.createDataFrame([(v,) for v in x], "state string"))
    assert kind("0", "1", "ND", None) == "binary" and kind("0", "A") == "character" and kind("nd") == "character" and kind(*map(str, range(99))) == "character"


def test_settings():
    from helixmark import settings
    from helixmark.functions.genotype import Quality

    with pytest.warns(UserWarning, match="colour"):
        q = settings.load('{"min_qual": 20, "ploidies": [1], "colour": 3}')
    assert (q.min_qual, q.ploidies, q.min_depth) == (20, (1,), Quality().min_depth)
    with pytest.raises(ValueError):
        settings.load("[]")
    assert settings.read(None, None) == Quality()


def test_lines_keep_their_order(spark, tmp_path):
    """A file that Spark cuts into several ranges: of several records of a place the last one counts."""
    body = "".join(f"c\t{i % 50}\t.\tA\tC\t50\tPASS\tDP=20;MQ=60\tGT\t{'1/1' if i >= 950 else '0/0'}\n" for i in range(1000))
    (tmp_path / "x.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n" + body)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = readers.classified(readers.vcf(spark, str(tmp_path)))
        assert rows.rdd.getNumPartitions() > 3
        calls, blocks = readers.callset(rows)
        assert calls.count() == 50 and {r["state"] for r in calls.collect()} == {ALTERNATE} and blocks.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_reports_tell_what_they_leave_out(spark, tmp_path):
    from helixmark.sources import writers

    rows = spark.range(25).selectExpr("id", "concat('<', id, '&') AS t", "cast(null AS int) AS n")
    assert "<p>10 of 25 rows</p>" in writers.html_report(rows, "t", 10) and "<p>" not in writers.html_report(rows, "t", 25)
    assert writers.text_report(rows, 3).split("\n")[-1] == "3 of 25 rows" and len(writers.text_report(rows, 25).split("\n")) == 25
    writers.write_lines(writers.html_lines(rows, "a<b", ["id"]), f"file://{tmp_path}/html", ["ord"])
    lines = [r["value"] for r in spark.read.text(f"file://{tmp_path}/html").collect()]
    assert len(lines) == 27 and "<tr><td>7</td><td>&lt;7&amp;</td><td></td></tr>" in lines and sum("a&lt;b" in x for x in lines) == 1
    assert sorted(r["value"] for r in writers.text_lines(rows).collect()) == sorted(writers.text_report(rows).split("\n"))


def test_positions(spark):
    import pytest
    from pyspark.sql import functions as F

    from helixmark.operators import tables

    one = lambda t, n=None: spark.createDataFrame([(t,)], "t string").select(tables.positions(F.col("t"), n).alias("p")).first()["p"]
    assert one("7, 3;3\n12  7,") == [3, 7, 12] and one(None) == [] and one(" ") == []
    for bad, n in (("0", None), ("4,x", None), ("11", 10), ("-2", None), ("1.5", None)):
        with pytest.raises(Exception, match="positions must be"):
            one(bad, n)


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fasta_over_several_splits(spark, tmp_path, small_splits):
    """Records that start, end or lie as a whole in any of a file's ranges; two files; text before the first header."""
    import random

    rng = random.Random(3)
    want = {}
    for f in ("a.fa", "b.fa"):
        text = "no header yet\n"
        for k in range(1, 9):
            seq = "".join(rng.choice("acgtN") for _ in range(rng.choice([0, 3, 61, 900, 4000])))
            text += f">{f}{k} about > it\r\n" + "".join(seq[i : i + 60] + rng.choice(["\n", " \n", "\n\n"]) for i in range(0, len(seq), 60))
            want[f, k] = (f"{f}{k}", f"{f}{k} about > it", seq.upper())
        (tmp_path / f).write_text(text)
    assert readers.text_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    rows = readers.fasta(spark, str(tmp_path)).collect()
    assert {(r["file"].rsplit("/", 1)[1], r["record_no"]): (r["id"], r["description"], r["seq"]) for r in rows} == want and len(rows) == len(want)
    heads, pieces = readers.fasta_pieces(spark, str(tmp_path), 500)
    for r in pieces.collect():
        seq = want[r["file"].rsplit("/", 1)[1], r["record_no"]][2]
        assert len(r["seq"]) <= 560 and seq[r["start"] : r["start"] + len(r["seq"])] == r["seq"]
    assert pieces.agg(F.sum(F.length("seq"))).first()[0] == sum(len(v[2]) for v in want.values())


def test_genbank_over_several_splits(spark, tmp_path, small_splits):
    import random

    from helixmark.sources import genbank

    rng = random.Random(4)
    text, want, parts = "", {}, set()
    k = 0
    for no in range(1, 7):
        seq = "".join(rng.choice("acgt") for _ in range(rng.choice([0, 59, 1300])))
        text += f"LOCUS       L{no} {len(seq)} bp\nDEFINITION  about\n            it, number {no}\n" + (f"VERSION     V{no}.1\n" if no % 2 else "") + "FEATURES             Location/Qualifiers\n     source          1..9\n                     /gene=\"not coding\"\n"
        for g in range(rng.randrange(4)):
            text += f"     CDS             complement(join(5..9,\n                     {20 + g}..30))\n                     /note=\"LOCUS x\n                     ORIGIN\"\n" + f'                     /locus_tag="t{g}"\n                     /gene="g{g}"\n'
            name = f"V{no}.1" if no % 2 else f"L{no}"
            parts |= {(name, k, 0, 5, 9, -1, f"t{g}"), (name, k, 1, 20 + g, 30, -1, f"t{g}")}
            k += 1
        text += "ORIGIN      \n" + "".join(f"{i + 1:>9} " + " ".join(seq[j : j + 10] for j in range(i, min(i + 60, len(seq)), 10)) + "\n" for i in range(0, len(seq), 60)) + "//\n"
        want[no] = (f"V{no}.1" if no % 2 else f"L{no}", f"about it, number {no}", seq.upper())
    (tmp_path / "x.gbk").write_text(text)
    assert readers.text_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 2
    assert {r["record_no"]: (r["id"], r["description"], r["seq"]) for r in genbank.records(spark, str(tmp_path)).collect()} == want
    assert {tuple(r) for r in genbank.coding_parts(spark, str(tmp_path)).collect()} == parts
