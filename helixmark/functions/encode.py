"""Column expressions over resolved calls: encoding against a baseline, roles, statuses, scores, label paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .genotype import ABSENT, ALTERNATE, FILTERED, MISSING, REFERENCE, UNRESOLVED


# All call labels, roles, statuses and confidence names in this module are part of the output format.
LOW_CONFIDENCE = ("low_confidence", "low_to_moderate_confidence")
BASES = ("A", "C", "G", "T")


def encode(state: Column, allele: Column, ref: Column, alt: Column, baseline: Column, assumed: Column, from_block: Column) -> Column:
    """Struct (value, label): 0 baseline, 1 not, NULL not callable."""
    base = F.coalesce(F.when(baseline != "", baseline), ref)
    shown = F.when(from_block, ref).otherwise(allele)
    has = shown.isNotNull() & (shown != "")
    out = lambda v, s: F.struct(F.lit(v).cast("double").alias("value"), F.lit(s).alias("label"))
    return (
        F.when((state == REFERENCE) & assumed & has & (shown != base), out(1, "assumed_reference_non_baseline"))
        .when((state == REFERENCE) & assumed, out(0, "assumed_reference"))
        .when((state == REFERENCE) & has & (shown == base), out(0, "baseline_match"))
        .when((state == REFERENCE) & has & (shown == alt), out(1, "alt_match"))
        .when((state == REFERENCE) & has & (base != ""), out(1, "non_baseline_callable"))
        .when(state == REFERENCE, out(None, "callable_non_training_allele"))
        .when((state == ALTERNATE) & (allele == alt), out(1, "alt_match"))
        .when((state == ALTERNATE) & ((allele == base) | (allele == ref)), out(0, "baseline_match"))
        .when(state == ALTERNATE, out(None, "non_training_allele"))
        .otherwise(F.struct(F.lit(None).cast("double").alias("value"), F.lower(state).alias("label")))
    )


def context_encode(status: Column, observed: Column, ref: Column, alt: Column, baseline: Column, has_context: Column) -> Column:
    """Struct (value, mapping_status, allele_call, call_state) of a marker mapped by its context; status is NULL where it wasn't found.

    Several equally good places, other letters and alleles that no model was trained on aren't callable (NULL).
    """
    base = F.upper(F.coalesce(F.nullif(baseline, F.lit("")), ref))
    seen = F.upper(F.coalesce(observed, F.lit("")))
    alleles = F.filter(F.array(F.upper(ref), F.upper(alt), base), lambda x: x.isNotNull() & (x != ""))
    out = lambda v, m, c, s: F.struct(F.lit(v).cast("double").alias("value"), m.alias("mapping_status"), F.lit(c).alias("allele_call"), F.lit(s).alias("call_state"))
    not_zero = lambda x: F.concat(x, F.lit("_not_encoded_as_zero"))
    return (
        F.when(status.isNull(), out(None, not_zero(F.when(has_context, "unresolved_context").otherwise("missing_context")), "not_called", UNRESOLVED))
        .when(status.startswith("multi_hit"), out(None, not_zero(status), "not_called_multi_hit_context", UNRESOLVED))
        .when(~seen.isin(*BASES), out(None, not_zero(F.lit("mapped_ambiguous_base")), "ambiguous_base", UNRESOLVED))
        .when((F.size(alleles) > 0) & ~F.array_contains(alleles, seen), out(None, not_zero(F.lit("mapped_non_training_allele")), "non_training_allele", UNRESOLVED))
        .when(seen == base, out(0, status, "baseline_match", REFERENCE))
        .when(seen == F.upper(alt), out(1, status, "alt_match", ALTERNATE))
        .otherwise(out(1, status, "known_nonbaseline_match", ALTERNATE))
    )


def evidence_role(call: Column, mapping_status: Column, available: Column, value: Column | None = None) -> Column:
    """What a feature's state is worth as evidence: resolved by its call, filled in, or given by a matrix."""
    given = mapping_status.isNotNull() & (mapping_status != "")
    return (
        F.when(call.isin("alt_match", "known_nonbaseline_match"), F.lit("resolved_nonbaseline_state"))
        .when(call == "baseline_match", F.lit("resolved_baseline_state"))
        .when(call.isin("not_called", "ambiguous_base", "not_called_multi_hit_context", "non_training_allele") | given, F.lit("unresolved_zero_fill"))
        .when(available, F.lit("aligned_matrix_state"))
        .otherwise(F.lit("unresolved_zero_fill"))
    )


def recovery_status(fraction: Column, has_mapping: Column) -> Column:
    return (
        F.when(~has_mapping, F.lit("feature_space_alignment_only"))
        .when(fraction.isNull(), F.lit("unknown_marker_recovery"))
        .when(fraction >= 0.8, F.lit("adequate_marker_recovery"))
        .when(fraction >= 0.5, F.lit("partial_marker_recovery"))
        .otherwise(F.lit("low_marker_recovery"))
    )


def active_status(fraction: Column, count: Column) -> Column:
    return F.when((count >= 10) | (fraction >= 0.01), F.lit("active_marker_evidence_present")).when(count > 0, F.lit("very_low_active_marker_evidence")).otherwise(F.lit("no_active_marker_evidence"))


def resolved_status(fraction: Column, count: Column, has_mapping: Column) -> Column:
    return (
        F.when(~has_mapping & (count > 0), F.lit("aligned_matrix_evidence_present"))
        .when(~has_mapping, F.lit("feature_space_alignment_only"))
        .when(fraction >= 0.8, F.lit("resolved_marker_evidence_present"))
        .when(fraction >= 0.5, F.lit("partial_resolved_marker_evidence"))
        .when(count > 0, F.lit("low_resolved_marker_evidence"))
        .otherwise(F.lit("no_resolved_marker_evidence"))
    )


def confidence(support: Column, n_supporting: Column, resolved: Column, n_resolved: Column, n_active: Column, status: Column) -> Column:
    """What a level's support and evidence are worth together; the first arm that holds decides."""
    strong = (support >= 0.7) & (n_supporting > 0) & (resolved >= 0.5)
    return (
        F.when(n_resolved == 0, F.lit("low_confidence"))
        .when(support.isNull(), F.lit("evidence_available_support_unavailable"))
        .when(strong & (n_active == 0), F.lit("high_confidence_baseline_pattern"))
        .when(strong, F.lit("high_confidence"))
        .when(support >= 0.5, F.lit("moderate_confidence"))
        .when(status.isin("resolved_marker_evidence_present", "partial_resolved_marker_evidence", "aligned_matrix_evidence_present"), F.lit("low_to_moderate_confidence"))
        .otherwise(F.lit("low_confidence"))
    )


def is_supporting(role: Column) -> Column:
    return role == "resolved_nonbaseline_state"


def is_resolved(role: Column) -> Column:
    return role.isin("resolved_nonbaseline_state", "resolved_baseline_state", "resolved_trained_zero_state", "aligned_matrix_state")


def weak_evidence(resolved: Column, n_resolved: Column, status: Column, least: float = 0.05) -> Column:
    """Whether a branch has too few resolved markers for a confident susceptible call."""
    return (n_resolved <= 0) | (status == "low_resolved_marker_evidence") | (resolved < least)


def alignment_status(missing: Column, noncallable: Column) -> Column:
    return F.when((missing == 0) & (noncallable == 0), F.lit("complete")).when((missing < 0.5) & (noncallable < 0.5), F.lit("partial")).otherwise(F.lit("low_feature_coverage"))


def lineage_fallback(status: Column, branch_confidence: Column, branch: Column, support: Column, other: Column, other_support: Column, low: tuple[str, ...] = LOW_CONFIDENCE, delta: float = 0.0) -> Column:
    """Why the global model's label replaces the branch's; NULL where it doesn't."""
    differs = (branch != "") & (other != "") & (branch != other)
    return (
        F.when(status != "success", F.lit("branch_node_unavailable"))
        .when(branch_confidence.isin(*low), F.lit("low_branch_confidence"))
        .when(differs & other_support.isNotNull() & (support.isNull() | (other_support >= support + delta)), F.lit("global_lineage_disagreement_recovery"))
    )


def normalised(scores: Column) -> Column:
    """Scores over their sum; negative or not finite counts as 0; a sum of 0 gives equal shares."""
    clean = F.transform(scores, lambda x: F.when(x.isNull() | F.isnan(x) | (x < 0) | (x == F.lit(float("inf"))), F.lit(0.0)).otherwise(x))
    total = F.aggregate(clean, F.lit(0.0), lambda a, x: a + x)
    return F.transform(clean, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(scores)))


def entropy(shares: Column) -> Column:
    """Shannon entropy over that of equal shares; 0 for one share."""
    h = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))
    return F.when(F.size(shares) <= 1, F.lit(0.0)).otherwise(h / F.log2(F.size(shares).cast("double")))


def entropy_strict(shares: Column) -> Column:
    """As entropy in bits, but 0 if any share is exactly 0 or 1."""
    h = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(F.exists(shares, lambda p: p.isin(0.0, 1.0)), F.lit(0.0)).otherwise(h)


def level_label(labels: Column, level: Column | int, delimiter: str = "|") -> Column:
    """The first `level` labels, joined; NULL if one of them is blank or there are fewer."""
    level = F.lit(level) if isinstance(level, int) else level
    head = F.slice(labels, 1, F.greatest(level, F.lit(0)))
    return F.when((F.size(labels) >= level) & F.forall(head, lambda x: x.isNotNull() & (F.trim(x) != "")), F.array_join(head, delimiter))


def report_path(path: Column, visible: int, delimiter: str = "|") -> Column:
    """Struct (shown, omitted): the lowest `visible` labels, and the path above them from Root on."""
    p = F.filter(F.transform(F.split(path, "\\" + delimiter), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(p)
    above = F.slice(p, 1, F.greatest(n - visible, F.lit(0)))
    return F.struct(
        F.array_join(F.slice(p, F.greatest(n - visible, F.lit(0)) + 1, visible), delimiter).alias("shown"),
        F.when(n > visible, F.concat(F.lit("Root."), F.array_join(above, "."))).otherwise(F.lit("Root.0")).alias("omitted"),
    )


def marker_symbol(value: Column) -> Column:
    """Text of a marker's value: whole numbers without fraction, null-like empty."""
    v = F.trim(value)
    x = v.try_cast("double")
    return F.when(value.isNull() | F.lower(v).isin("", "nan", "none", "nd"), F.lit("")).when(x.isNotNull() & (x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("long").cast("string")).otherwise(v)


def plain_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]", "")


def clipped(value: Column, limit: float = 2.0) -> Column:
    """A number within the limit on either side; what is no finite number is 0."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.greatest(F.least(x, F.lit(limit)), F.lit(-limit)))


def vcf_mapping_status(state: Column) -> Column:
    """Callable states count as uniquely mapped."""
    return F.when(state.isin(REFERENCE, ALTERNATE), F.lit("mapped_unique_context")).when(state == ABSENT, F.lit("not_mapped")).when(state.isin(MISSING, FILTERED, UNRESOLVED), F.lower(state))
