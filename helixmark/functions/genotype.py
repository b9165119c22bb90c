"""Column expressions over variant records: parsing, quality ladder, genotype and record classification.

All return Columns; nothing here reads a table. Not-callable is NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Call states, reason codes (in qc_reasons), null-like words and symbolic alternates are part of the formats.
REFERENCE, ALTERNATE, MISSING, FILTERED, ABSENT, UNRESOLVED = (
    "CALLED_REFERENCE",
    "CALLED_ALTERNATE",
    "MISSING_OR_NO_CALL",
    "FILTERED_OR_LOW_QUALITY",
    "LOCUS_NOT_PRESENT",
    "UNRESOLVED_OR_AMBIGUOUS",
)
STATES = (REFERENCE, ALTERNATE, MISSING, FILTERED, ABSENT, UNRESOLVED)
NULL_LIKE = ("", "nan", "none", "null", "na", "n/a")
SYMBOLIC = ("<*>", "<NON_REF>")


@dataclass(frozen=True)
class Quality:
    """Thresholds of the quality ladder; the defaults are those of the configuration."""

    min_qual: float = 30.0
    min_depth: float = 10.0
    min_gq: float = 0.0
    min_mq: float = 40.0
    max_mq0f: float = 0.1
    biallelic_only: bool = True
    ploidies: tuple[int, ...] = (1, 2)
    filters: tuple[str, ...] = ("PASS", ".")
    absent_is_reference: bool = True
    min_recovery: float = 0.5
    min_callable: float = 0.5


def number(c: Column) -> Column:
    """A double; text that isn't a finite number is NULL."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def info_map(info: Column) -> Column:
    """`k=v;flag` as a map: flags are "1", the last of equal keys wins, only the first `=` splits."""
    parts = F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda p: (p != "") & (p != "."))
    entries = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit("1")).alias("v")))
    last = F.filter(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))), lambda e: e["k"].isNotNull())
    kept = F.filter(last, lambda e: ~F.exists(last, lambda o: (o["k"] == e["k"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"])))


def sample_map(fmt: Column, value: Column) -> Column:
    """FORMAT keys with the sample's values; missing trailing values are empty."""
    keys = F.split(fmt, ":")
    values = F.split(F.coalesce(value, F.lit("")), ":")
    return F.map_from_entries(F.array_distinct(F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.coalesce(F.get(values, i), F.lit("")).alias("v")))))


def gt_indices(gt: Column) -> Column:
    """Allele indices of a genotype; a token that is no number is NULL. `/` is the separator wherever it occurs, else `|`."""
    tokens = F.when(gt.contains("/"), F.split(gt, "/")).otherwise(F.split(gt, "\\|"))
    return F.transform(tokens, lambda t: t.try_cast("int"))


def is_phased(gt: Column) -> Column:
    return gt.contains("|") & ~gt.contains("/")


def alternates(alt: Column) -> Column:
    """Listed alternates in upper case, without empty ones and `.`."""
    return F.filter(F.transform(F.split(F.upper(F.coalesce(alt, F.lit(""))), ","), F.trim), lambda x: ~x.isin("", "."))


def concrete(alt: Column) -> Column:
    """Alternates that aren't symbolic."""
    return F.filter(alternates(alt), lambda x: ~x.isin(*SYMBOLIC))


def called_from(alt: Column) -> Column:
    """The alternates that a genotype's indices count: the concrete ones, or the symbolic ones where there are no others."""
    every = lambda all_: once(F.filter(all_, lambda x: ~x.isin(*SYMBOLIC)), lambda c: F.when(F.size(c) > 0, c).otherwise(all_))
    return once(alternates(alt), every)


def is_symbolic(alt: Column) -> Column:
    """Whether a record is of a gVCF: it lists a symbolic alternate, or only `.`."""
    return (F.trim(alt) == ".") | F.exists(alternates(alt), lambda x: x.isin(*SYMBOLIC))


def is_snp(ref: Column, alt: Column, biallelic_only: bool = True) -> Column:
    """Single-letter reference and alternates; records with a symbolic alternate count whatever their reference."""
    alts = alternates(alt)
    plain = (F.length(ref) == 1) & (ref != ".") & (F.size(alts) > 0) & F.forall(alts, lambda a: F.length(a) == 1)
    ok = F.exists(alts, lambda a: a.isin(*SYMBOLIC)) | plain
    return ok & (F.size(concrete(alt)) <= 1) if biallelic_only else ok


def qc_reasons(qual: Column, flt: Column, dp: Column, gq: Column, mq: Column, mq0f: Column, q: Quality = Quality()) -> Column:
    """All reasons why a site fails, in order; empty if it passes. A missing field fails by its own reason, but MQ0F passes."""
    tokens = F.split(F.coalesce(flt, F.lit(".")), ";")
    arms = [
        F.when(~F.forall(tokens, lambda t: t.isin(*q.filters)), F.lit("FILTER")),
        F.when(qual.isNull(), F.lit("QUAL_missing")).when(qual < q.min_qual, F.lit("QUAL_low")),
        F.when(dp.isNull(), F.lit("DP_missing")).when(dp < q.min_depth, F.lit("DP_low")),
    ]
    if q.min_gq > 0:
        arms.append(F.when(gq.isNull(), F.lit("GQ_missing")).when(gq < q.min_gq, F.lit("GQ_low")))
    if q.min_mq > 0:
        arms.append(F.when(mq.isNull(), F.lit("MQ_missing")).when(mq < q.min_mq, F.lit("MQ_low")))
    arms.append(F.when(mq0f > q.max_mq0f, F.lit("MQ0F_high")))
    return F.filter(F.array(*arms), lambda r: r.isNotNull())


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often it is used: Spark computes an expression again at each place where a higher-order function holds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def genotype_state(ref: Column, alt: Column, gt: Column, q: Quality = Quality()) -> Column:
    """The genotype ladder; its order is part of the meaning."""
    return once(F.struct(gt_indices(gt).alias("idx"), called_from(alt).alias("alts")), lambda s: _ladder(gt, s["idx"], s["alts"], q))


def _ladder(gt: Column, idx: Column, alts: Column, q: Quality) -> Column:
    distinct = F.array_distinct(idx)
    called = F.get(alts, F.get(distinct, F.lit(0)) - 1)
    return (
        F.when(gt.isNull() | (gt == ""), F.lit(MISSING))
        .when(F.forall(idx, lambda i: i.isNull()), F.lit(MISSING))
        .when(~F.size(idx).isin(*q.ploidies), F.lit(UNRESOLVED))
        .when(F.exists(idx, lambda i: i.isNull()), F.lit(UNRESOLVED))
        .when(F.exists(idx, lambda i: (i < 0) | (i > F.size(alts))), F.lit(UNRESOLVED))
        .when((F.size(distinct) == 1) & (F.get(distinct, F.lit(0)) == 0), F.lit(REFERENCE))
        .when((F.size(distinct) == 1) & ~called.isin(*SYMBOLIC), F.lit(ALTERNATE))
        .otherwise(F.lit(UNRESOLVED))
    )


def called_allele(ref: Column, alt: Column, gt: Column, state: Column) -> Column:
    first = F.get(gt_indices(gt), F.lit(0))
    return F.when(state == REFERENCE, F.upper(ref)).when(state == ALTERNATE, F.get(called_from(alt), first - 1))


def record_state(ref: Column, alt: Column, gt: Column, failed: Column, genome_ref: Column | None = None, q: Quality = Quality()) -> Column:
    """The record ladder: not a SNP (records of a gVCF pass), several concrete alternates, failed quality, other reference base, then the genotype's."""
    out = F.when(~is_symbolic(alt) & ~is_snp(ref, alt, False), F.lit(UNRESOLVED))
    if q.biallelic_only:
        out = out.when(F.size(concrete(alt)) > 1, F.lit(UNRESOLVED))
    out = out.when(failed, F.lit(FILTERED))
    if genome_ref is not None:
        out = out.when(genome_ref.isNotNull() & (F.upper(genome_ref) != F.upper(F.substring(ref, 1, 1))), F.lit(UNRESOLVED))
    return out.otherwise(genotype_state(ref, alt, gt, q))


def is_reference_block(alt: Column, state: Column, pos: Column, end: Column) -> Column:
    """Whether a record stands for all places from pos to end: a called reference that goes on."""
    return F.coalesce((state == REFERENCE) & (end > pos), F.lit(False))


def sample_id(value: Column, strip_library: bool = True) -> Column:
    """Null-like is empty; exactly one distinct ERR or SRR accession stands for itself; else one file suffix goes, and a library's."""
    runs = F.array_distinct(F.transform(F.regexp_extract_all(value, F.lit("(?i)(?<![A-Z0-9])([ES]RR[0-9]+)"), F.lit(1)), F.upper))
    bare = F.regexp_replace(F.trim(value), r"(?i)(\.vcf\.gz|\.vcf|\.bcf\.gz|\.bcf|\.gz)$", "")
    out = F.when(value.isNull() | F.lower(F.trim(value)).isin(*NULL_LIKE), F.lit(""))
    if strip_library:
        return out.when(F.size(runs) == 1, F.get(runs, F.lit(0))).otherwise(F.regexp_replace(bare, r"(?i)_library[0-9]+$", ""))
    return out.otherwise(bare)


def sample_of_path(path: Column) -> Column:
    """The sample that a variant file's name tells: its last part without suffix (the longest that fits)."""
    name = F.element_at(F.split(path, "/"), -1)
    known = r"(?i)(\.g\.vcf\.gz|\.g\.vcf|\.vcf\.gz|\.vcf|\.bcf\.gz|\.bcf)$"
    return F.when(name.rlike(known), F.regexp_replace(name, known, "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def feature_parts(feature: Column) -> Column:
    """contig:pos:ref:alt as a struct; fewer parts give empty ones, more are ignored."""
    p = F.split(feature, ":")
    part = lambda i: F.when(F.size(p) >= 4, F.get(p, F.lit(i))).otherwise(F.lit(""))
    return F.struct(part(0).alias("contig"), part(1).alias("pos"), part(2).alias("ref"), part(3).alias("alt"))
