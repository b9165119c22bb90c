from math import log2

import pytest
from pyspark.sql import functions as F

from helixmark.functions import encode, genotype, sequence
from helixmark.functions.genotype import ABSENT, ALTERNATE, FILTERED, MISSING, REFERENCE, UNRESOLVED


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("alt", "gt", "state"),
    [
        ("C", "0", REFERENCE),
        ("C", "1", ALTERNATE),
        ("C", "0/0", REFERENCE),
        ("C", "1/1", ALTERNATE),
        ("C", "1|1", ALTERNATE),
        ("C", "0/1", UNRESOLVED),
        ("C,G", "1/2", UNRESOLVED),
        ("C,G", "2/2", ALTERNATE),
        ("C", "./.", MISSING),
        ("C", "0/.", UNRESOLVED),
        ("C", "3", UNRESOLVED),
        ("C", "x", MISSING),
        ("C", None, MISSING),
        ("C", "0/0/0", UNRESOLVED),
        ("<NON_REF>", "1", UNRESOLVED),
        ("<NON_REF>", "0/0", REFERENCE),
    ],
)
def test_genotype_ladder(spark, alt, gt, state):
    gt = F.lit(gt).cast("string")
    assert one(spark, genotype.genotype_state(F.lit("A"), F.lit(alt), gt)) == state


@pytest.mark.parametrize(
    ("ref", "alt", "failed", "genome", "state"),
    [("AT", "A", False, "A", UNRESOLVED), ("A", "C,G", False, "A", UNRESOLVED), ("A", "C", True, "A", FILTERED), ("A", "C", False, "G", UNRESOLVED), ("A", "C", False, "a", ALTERNATE), ("A", "C", False, None, ALTERNATE)],
)
def test_record_ladder(spark, ref, alt, failed, genome, state):
    assert one(spark, genotype.record_state(F.lit(ref), F.lit(alt), F.lit("1/1"), F.lit(failed), F.lit(genome).cast("string"))) == state


@pytest.mark.parametrize(
    ("ref", "alt", "gt", "state", "allele"),
    [
        ("A", "G,<NON_REF>", "1/1", ALTERNATE, "G"),
        ("A", "G,<NON_REF>", "2/2", UNRESOLVED, None),
        ("A", "<NON_REF>", "0/0", REFERENCE, "A"),
        ("AT", "<NON_REF>", "0/0", REFERENCE, "AT"),
        ("A", "<*>", "1/1", UNRESOLVED, None),
        ("A", ".", "0/0", REFERENCE, "A"),
        ("A", ".", "1/1", UNRESOLVED, None),
        ("A", "C,G", "1/1", UNRESOLVED, None),
        ("A", "C,G,<NON_REF>", "1/1", UNRESOLVED, None),
        ("A", "g", "1|1", ALTERNATE, "G"),
        ("AT", "G", "1/1", UNRESOLVED, None),
        ("A", "GT", "1/1", UNRESOLVED, None),
        ("A", "G,<NON_REF>", "0/1", UNRESOLVED, None),
        ("A", "G,<NON_REF>", "./.", MISSING, None),
    ],
)
def test_gvcf_records(spark, ref, alt, gt, state, allele):
    r, a, g = F.lit(ref), F.lit(alt), F.lit(gt)
    found = genotype.record_state(r, a, g, F.lit(False))
    got = one(spark, F.struct(found.alias("s"), genotype.called_allele(r, a, g, found).alias("a")))
    assert (got["s"], got["a"]) == (state, allele)


def test_quality_reasons(spark):
    n = F.lit(None).cast("double")
    q = lambda *x, **k: one(spark, genotype.qc_reasons(*[F.lit(v) if not isinstance(v, type(n)) else v for v in x], genotype.Quality(**k)))
    assert q(30.0, "PASS", 10.0, n, 40.0, n) == []
    assert q(29.9, "q10;PASS", 9.0, n, 39.0, 0.2) == ["FILTER", "QUAL_low", "DP_low", "MQ_low", "MQ0F_high"]
    assert q(n, ".", n, n, n, n) == ["QUAL_missing", "DP_missing", "MQ_missing"]
    assert q(n, ".", n, n, n, n, min_gq=5, min_mq=0) == ["QUAL_missing", "DP_missing", "GQ_missing"]


ENCODE = [
    (REFERENCE, "A", "A", True, False, 0, "assumed_reference"),
    (REFERENCE, "A", "C", True, False, 1, "assumed_reference_non_baseline"),
    (REFERENCE, "", "C", True, False, 0, "assumed_reference"),
    (REFERENCE, "A", "A", False, False, 0, "baseline_match"),
    (REFERENCE, "C", "A", False, False, 1, "alt_match"),
    (REFERENCE, "G", "A", False, False, 1, "non_baseline_callable"),
    (REFERENCE, "", "A", False, False, None, "callable_non_training_allele"),
    (REFERENCE, "G", "A", False, True, 0, "baseline_match"),
    (ALTERNATE, "C", "C", False, False, 1, "alt_match"),
    (ALTERNATE, "A", "C", False, False, 0, "baseline_match"),
    (ALTERNATE, "G", "G", False, False, 0, "baseline_match"),
    (ALTERNATE, "T", "A", False, False, None, "non_training_allele"),
    (MISSING, None, "A", False, False, None, "missing_or_no_call"),
    (FILTERED, None, "A", False, False, None, "filtered_or_low_quality"),
    (ABSENT, None, "A", False, False, None, "locus_not_present"),
    (UNRESOLVED, None, "A", False, False, None, "unresolved_or_ambiguous"),
]


@pytest.mark.parametrize(("state", "allele", "baseline", "assumed", "block", "value", "label"), ENCODE)
def test_encode_table(spark, state, allele, baseline, assumed, block, value, label):
    got = one(spark, encode.encode(F.lit(state), F.lit(allele).cast("string"), F.lit("A"), F.lit("C"), F.lit(baseline), F.lit(assumed), F.lit(block)))
    assert (got["value"], got["label"]) == (value, label)


def test_parsing(spark):
    assert one(spark, genotype.info_map(F.lit("A=1;FLAG;B=x=y;A=2;;"))) == {"FLAG": "1", "B": "x=y", "A": "2"}
    assert one(spark, genotype.sample_map(F.lit("GT:DP:GQ"), F.lit("0/1:7"))) == {"GT": "0/1", "DP": "7", "GQ": ""}
    assert one(spark, genotype.gt_indices(F.lit("0/1|1"))) == [0, None]
    assert one(spark, genotype.is_phased(F.lit("0|1"))) is True
    for text, want in ((" x.g.vcf.gz", "x.g"), ("x.gz", "x"), ("err12_SRR3", "err12_SRR3"), ("XERR12", "XERR12"), ("run_LIBRARY3", "run"), ("SRR5/SRR5.sorted.bam", "SRR5"), ("a/SRR7.vcf", "SRR7"), ("N/A", ""), ("s_library12", "s")):
        assert one(spark, genotype.sample_id(F.lit(text))) == want
    for text, want in (("/a/b.g.vcf.gz", "b"), ("b.G.VCF", "b"), ("b.g.bcf", "b.g"), ("x.y.txt", "x.y"), ("plain", "plain")):
        assert one(spark, genotype.sample_of_path(F.lit(text))) == want
    assert one(spark, genotype.sample_id(F.lit("s_library2 SRR1"), strip_library=False)) == "s_library2 SRR1"
    assert one(spark, genotype.number(F.lit("nan"))) is None and one(spark, genotype.number(F.lit("1e400"))) is None


def test_scores(spark):
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, encode.normalised(arr(1, -1, 3))) == [0.25, 0.0, 0.75]
    assert one(spark, encode.normalised(arr(0, 0))) == [0.5, 0.5]
    assert one(spark, encode.entropy(arr(0.25, 0.75))) == pytest.approx(-(0.25 * log2(0.25) + 0.75 * log2(0.75)))
    assert one(spark, encode.entropy(arr(1))) == 0 == one(spark, encode.entropy_strict(arr(0, 1)))
    for text, want in (("1.0", "1"), ("nd", ""), ("x", "x"), ("-2.5", "-2.5")):
        assert one(spark, encode.marker_symbol(F.lit(text))) == want
    got = [one(spark, encode.report_path(F.lit("2|Food chain|Chicken"), k)) for k in (1, 2, 3)]
    assert [tuple(g) for g in got] == [("Chicken", "Root.2.Food chain"), ("Food chain|Chicken", "Root.2"), ("2|Food chain|Chicken", "Root.0")]


def test_sequences(spark):
    assert one(spark, sequence.reverse_complement(F.lit("ACGTN"))) == "NACGT"
    assert one(spark, sequence.reverse_complement(F.lit("RYK"), True)) == "MRY"
    assert one(spark, sequence.circular_context(F.lit("ABC"), F.lit(1), 4)) == "".join("ABC"[(k) % 3] for k in range(-4, 5))
    assert one(spark, sequence.amino_acid(F.lit("atg"))) == "M" and one(spark, sequence.amino_acid(F.lit("TAA"))) == "*" and one(spark, sequence.amino_acid(F.lit("ANG"))) == "X"
