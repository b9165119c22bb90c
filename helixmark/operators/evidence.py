"""Summaries of marker evidence: per sample over all calls, and per sample and model over the model's features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encode
from ..functions.genotype import ALTERNATE, REFERENCE
from ..storage import materialise

# Call and status names, and what the counts are called, are part of the output format.
BASELINE_CALLS = ("baseline_match",)
NONBASELINE_CALLS = ("alt_match", "known_nonbaseline_match")
ASSUMED = "assumed_reference"


def histograms(combined: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """by, with a map value to count (in order of the values) for each of columns (name: column); NULL is left out. combined: rows with `n`, how often each occurs."""
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.col(c).cast("string").alias("value")) for k, c in columns.items()])
    n = combined.select(*by, F.explode(each).alias("x"), "n").where("x.value IS NOT NULL").groupBy(*by, "x.name", "x.value").agg(F.sum("n").alias("n"))
    of = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("name") == k, F.struct("value", "n")))))
    return n.groupBy(*by).agg(*[of(k).alias(k) for k in columns])


def _counted(condition: Column) -> Column:
    """Over combined rows, how many rows meet a condition."""
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def histogram_text(c: Column | str) -> Column:
    """A histogram as value=count, comma-joined in order of the values; empty for none."""
    entries = F.array_sort(F.map_entries(F.col(c) if isinstance(c, str) else c))
    return F.coalesce(F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ","), F.lit(""))


def mapping_summary(calls: DataFrame) -> DataFrame:
    """Per sample of (sample, value, mapping_status, allele_call, call_state): 13 counts and three histograms."""
    every = ["sample", "value", "mapping_status", "allele_call", "call_state"]
    combined = materialise(calls.groupBy(*every).agg(F.count("*").alias("n")), "evidence-calls", few=True)  # a few rows per sample
    n, status, call, state = _counted, F.coalesce("mapping_status", F.lit("")), F.coalesce("allele_call", F.lit("")), F.coalesce("call_state", F.lit(""))
    per = combined.groupBy("sample").agg(
        F.sum("n").alias("n_feature_calls"),
        n(F.col("value") == 1).alias("n_encoded_active_features"),
        n(call.isin(*BASELINE_CALLS, *NONBASELINE_CALLS, ASSUMED)).alias("n_resolved_features"),
        n(call.isin(*BASELINE_CALLS, ASSUMED)).alias("n_resolved_baseline_features"),
        n(call.isin(*NONBASELINE_CALLS)).alias("n_resolved_nonbaseline_features"),
        n(state.isin(REFERENCE, ALTERNATE)).alias("n_callable_features"),
        n(F.col("value").isNull()).alias("n_noncallable_nan"),
        n(status.isin("mapped_unique_context", REFERENCE, ALTERNATE)).alias("n_unique_mapped_calls"),
        n(status.rlike("unresolved|missing|locus_not_present|filtered")).alias("n_unresolved_or_missing_context_calls"),
        n(status.contains("multi_hit")).alias("n_multi_hit_calls"),
        n(status.contains("ambiguous_base")).alias("n_ambiguous_base_calls"),
        n(status.contains("non_training_allele")).alias("n_non_training_allele_calls"),
        n(call == ASSUMED).alias("n_assumed_reference"),
    )
    return per.join(histograms(combined, ["sample"], {"status_counts": "mapping_status", "allele_call_counts": "allele_call", "call_state_counts": "call_state"}), "sample", "left")


def model_evidence(cells: DataFrame) -> DataFrame:
    """Per sample and node of (sample, node, feature, value, mapping_status, allele_call, available): what of a model's features a query resolves.

    A cell without mapping_status and allele_call has no mapping data. Where a sample and node have none at all
    (a matrix was given), states that the matrix has count as resolved.
    """
    call, status = F.coalesce("allele_call", F.lit("")), F.coalesce("mapping_status", F.lit(""))
    mapped = F.col("mapping_status").isNotNull() | F.col("allele_call").isNotNull()
    role = encode.evidence_role(F.col("allele_call"), F.col("mapping_status"), F.col("available"), F.col("value"))
    df = cells.withColumns({"__mapped": mapped, "__role": role, "__active": F.coalesce(F.col("value") != 0, F.lit(False))})
    by, n = ["sample", "node"], _counted
    cells = materialise(df.select(*by, "feature", "mapping_status", "allele_call", "__mapped", "__role", "__active"), "evidence-cells")  # read twice
    active_ids = cells.where("__active").groupBy(*by).agg(F.array_sort(F.collect_list("feature")).alias("active_feature_ids"))
    df = cells.groupBy(*by, "mapping_status", "allele_call", "__mapped", "__role", "__active").agg(F.count("*").alias("n"))
    df = materialise(df, "evidence-counts", few=True)  # a few rows per sample and node
    is_ = lambda *r: F.col("__role").isin(*r)
    resolved = is_("resolved_baseline_state", "resolved_nonbaseline_state", "resolved_trained_zero_state")
    per = df.groupBy(*by).agg(
        F.sum("n").alias("n_selected_features"),
        n(F.col("__active")).alias("n_active_features"),
        n(F.col("__mapped")).alias("n_features_with_mapping_metadata"),
        n(F.col("mapping_status") == "mapped_unique_context").alias("n_unique_mapped_features"),
        n(resolved).alias("__resolved"),
        n(is_("aligned_matrix_state")).alias("__aligned"),
        n(is_("resolved_baseline_state", "resolved_trained_zero_state")).alias("n_resolved_baseline_features"),
        n(is_("resolved_nonbaseline_state")).alias("n_resolved_nonbaseline_features"),
        n(is_("unresolved_zero_fill")).alias("n_zero_fill_caution_features"),
        n(call == "baseline_match").alias("n_baseline_match_calls"),
        n(call == "alt_match").alias("n_alt_match_calls"),
        n(call == "known_nonbaseline_match").alias("n_known_nonbaseline_match_calls"),
        (n(call == "not_called") + n(status.rlike("missing_context|unresolved_context"))).alias("n_unresolved_or_missing_calls"),
        (n(call == "not_called_multi_hit_context") + n(status.contains("multi_hit"))).alias("n_multi_hit_calls"),
        (n(call == "ambiguous_base") + n(status.contains("ambiguous_base"))).alias("n_ambiguous_base_calls"),
        (n(call == "non_training_allele") + n(status.contains("non_training_allele"))).alias("n_non_training_allele_calls"),
    )
    per = per.join(active_ids, by, "left").withColumn("active_feature_ids", F.coalesce("active_feature_ids", F.array().cast(active_ids.schema["active_feature_ids"].dataType)))
    has = F.col("n_features_with_mapping_metadata") > 0
    per = per.withColumns({"has_mapping_metadata": has, "n_resolved_features": F.col("__resolved") + F.when(has, F.lit(0)).otherwise(F.col("__aligned"))}).drop("__resolved", "__aligned")
    share = lambda c: F.col(c) / F.greatest("n_selected_features", F.lit(1))
    per = per.withColumns(
        {
            "active_feature_fraction": share("n_active_features"),
            "unique_mapped_fraction": F.when(has, F.col("n_unique_mapped_features") / F.greatest("n_features_with_mapping_metadata", F.lit(1))),
            "resolved_feature_fraction": share("n_resolved_features"),
            "resolved_baseline_feature_fraction": share("n_resolved_baseline_features"),
            "resolved_nonbaseline_feature_fraction": share("n_resolved_nonbaseline_features"),
            "n_unresolved_or_missing_features": F.col("n_selected_features") - F.col("n_resolved_features"),
        }
    )
    active = encode.active_status(F.col("active_feature_fraction"), F.col("n_active_features"))
    per = per.withColumns(
        {
            "nonbaseline_evidence_status": active,
            "active_marker_evidence_status": active,
            "marker_recovery_status": encode.recovery_status(F.col("unique_mapped_fraction"), has),
            "resolved_marker_evidence_status": encode.resolved_status(F.col("resolved_feature_fraction"), F.col("n_resolved_features"), has),
        }
    )
    percent = lambda c: F.format_string("%.1f %% of the features", 100 * F.col(c))
    per = per.withColumns(
        {
            "nonbaseline_evidence_reason": F.format_string("%d features aren't baseline", "n_active_features"),
            "active_marker_evidence_reason": F.format_string("%d features aren't baseline", "n_active_features"),
            "marker_recovery_reason": F.when(has, F.format_string("%.1f %% of the mapped features are unique", 100 * F.col("unique_mapped_fraction"))).otherwise(F.lit("a matrix without mapping data")),
            "resolved_marker_evidence_reason": F.concat(percent("resolved_feature_fraction"), F.lit(" resolved")),
        }
    )
    counts = histograms(df, by, {"evidence_role_counts": "__role", "mapping_status_counts": "mapping_status", "allele_call_counts": "allele_call"})
    return per.join(counts, by, "left")


def flattened(evidence: DataFrame, prefix: str, keys: tuple[str, ...] = ("sample", "node")) -> DataFrame:
    """Columns but the keys under `<prefix>_<name>`; lists and histograms as text."""
    out = [F.col(k) for k in keys if k in evidence.columns]
    for name, kind in evidence.dtypes:
        if name not in keys:
            c = F.array_join(F.col(name).cast("array<string>"), ",") if kind.startswith("array") else histogram_text(name) if kind.startswith("map") else F.col(name)
            out.append(c.alias(f"{prefix}_{name}"))
    return evidence.select(*out)


def supporting_markers(cells: DataFrame, importance: DataFrame, k: int = 10) -> DataFrame:
    """Per sample and node the k most important features that support the call: (sample, node, feature, value, role, importance, place).

    cells: as for model_evidence; importance: (node, feature, importance). A supporting feature is resolved and not baseline.
    """
    from pyspark.sql import Window

    role = encode.evidence_role(F.col("allele_call"), F.col("mapping_status"), F.col("available"), F.col("value"))
    rows = cells.withColumn("role", role).where(encode.is_supporting(F.col("role"))).join(importance, ["node", "feature"], "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("sample", "node").orderBy(F.col("importance").desc(), "feature"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select("sample", "node", "feature", "value", "role", "importance", "place")
