"""All queries of the library over the driver's tables, with their SQL.

Each query has the operator's columns under the names of its SQL; doubles are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import encode, genotype, sequence
from ..operators import cohort, evidence, hierarchy, joins, models, pileup, selection, stats, tables
from ..sources import readers, writers
from ..streaming import calls as streams
from . import adapters as a
from .registry import ORACLE, QUERIES, query  # noqa: F401

def r6(c):
    return F.round(c, 6)


# calls ----------------------------------------------------------------------------------------------


@query(f"WITH {a.CALLS} SELECT sample, chrom, pos, l_orderkey, l_linenumber, l_partkey, l_extendedprice, state, allele, array_to_string(reasons, ',') AS reasons FROM called")
def record_classification(s, d):
    return a.classified(s, d).select("sample", "chrom", "pos", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "state", "allele", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {a.CALLS} SELECT r AS reason, count(*) AS n FROM (SELECT unnest(reasons) AS r FROM judged) GROUP BY r")
def site_quality_reasons(s, d):
    return a.classified(s, d).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"WITH {a.CALLS} SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, qual >= 25 AND mq >= 40 AND dp >= 4 AS passed FROM calls")
def info_quality_legacy(s, d):
    """The older ladder: no filter, no genotype quality."""
    q = genotype.Quality(min_qual=25, min_depth=4, filters=("PASS", ".", "q10"))
    df, null = a.raw_calls(s, d), F.lit(None).cast("double")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.size(genotype.qc_reasons(F.col("qual"), F.col("filter"), F.col("dp"), null, F.col("mq"), null, q)) == 0).alias("passed"))


@query(f"WITH {a.CALLS} SELECT sample, chrom, pos, ref, alt, state, allele FROM latest")
def last_record_wins(s, d):
    return a.latest(s, d).select("sample", "chrom", "pos", "ref", "alt", "state", "allele")


@query(f"WITH {a.CALLS} SELECT sample, count(*) FILTER (state = 'CALLED_REFERENCE') AS ref, count(*) FILTER (state = 'CALLED_ALTERNATE') AS alt, count(*) FILTER (state = 'MISSING_OR_NO_CALL') AS missing, count(*) FILTER (state = 'FILTERED_OR_LOW_QUALITY') AS filtered, count(*) FILTER (state = 'UNRESOLVED_OR_AMBIGUOUS') AS unresolved FROM latest GROUP BY sample")
def call_state_counts(s, d):
    n = lambda x: F.count_if(F.col("state") == x)
    return a.latest(s, d).groupBy("sample").agg(n(genotype.REFERENCE).alias("ref"), n(genotype.ALTERNATE).alias("alt"), n(genotype.MISSING).alias("missing"), n(genotype.FILTERED).alias("filtered"), n(genotype.UNRESOLVED).alias("unresolved"))


@query(f"WITH {a.CALLS} SELECT chrom, pos, ref, allele AS alt, count(DISTINCT sample) AS n_carriers FROM latest WHERE state = 'CALLED_ALTERNATE' AND ref <> allele GROUP BY ALL HAVING count(DISTINCT sample) >= 2")
def cohort_sites(s, d):
    return cohort.sites(a.latest(s, d), 2)


@query(f"WITH {a.CALLS}, n AS (SELECT chrom, pos, allele, count(*) AS n, min(sample) AS f FROM latest WHERE allele IS NOT NULL GROUP BY ALL) SELECT chrom, pos, allele AS base, n FROM n QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY n DESC, f) = 1")
def modal_baseline(s, d):
    return cohort.modal_baseline(a.latest(s, d))


@query(f"WITH {a.CALLS} SELECT sample, count(*) AS n FROM (SELECT sample, chrom, pos FROM calls GROUP BY ALL HAVING count(*) > 1) GROUP BY sample")
def duplicate_records(s, d):
    place = F.concat_ws(":", "sample", "chrom", "pos")
    again = tables.duplicates(a.raw_calls(s, d).select(place.alias("place")), "place")
    return again.groupBy(F.substring_index("place", ":", 1).cast("long").alias("sample")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_ids(s, d):
    return tables.duplicates(a.table(s, d, "lineitem"), "l_orderkey")


# resolution and gate --------------------------------------------------------------------------------


@query(f"WITH {a.RESOLVED} SELECT sample, feature, state, assumed, value, label FROM resolved")
def feature_resolution(s, d):
    return a.resolved(s, d).select("sample", "feature", "state", "assumed", "value", "label")


@query(f"WITH {a.RESOLVED} SELECT label, value, count(*) AS n FROM resolved GROUP BY ALL")
def encoding_counts(s, d):
    return a.resolved(s, d).groupBy("label", "value").agg(F.count("*").alias("n"))


@query(f"""WITH {a.RESOLVED}, g AS (SELECT sample, count(*) AS n, count(*) FILTER (NOT assumed) AS found, count(*) FILTER (NOT assumed AND state IN ('CALLED_REFERENCE', 'CALLED_ALTERNATE')) AS c FROM resolved GROUP BY sample)
SELECT sample, n AS n_features, round(found / n, 6) AS recovery, round(c / n, 6) AS callable, CASE WHEN found / n >= 0.1 AND c / n >= 0.02 AND c > 0 THEN 'predict' ELSE 'abstain' END AS verdict FROM g""")
def callability_gate(s, d):
    g = cohort.gates(a.resolved(s, d, absent_is_reference=False), 0.1, 0.02)
    return g.select("sample", "n_features", r6("recovery").alias("recovery"), r6("callable").alias("callable"), "verdict")


_MAPPED = """mapped AS (SELECT sample, feature, value, CASE WHEN assumed THEN 'assumed_reference_not_in_vcf' WHEN state = 'FILTERED_OR_LOW_QUALITY' THEN 'filtered_or_low_quality' WHEN regexp_matches(feature, '^[^:]*:1[0-9][0-9]:') THEN 'multi_hit_context_not_encoded_as_zero' ELSE 'mapped_unique_context' END AS mapping_status,
  CASE WHEN label = 'assumed_reference_non_baseline' THEN 'known_nonbaseline_match' WHEN regexp_matches(feature, '^[^:]*:1[0-9][0-9]:') AND NOT assumed THEN 'not_called_multi_hit_context' ELSE label END AS allele_call, state AS call_state FROM resolved)"""


def _mapped(s, d):
    """Calls with mapping data, some of them at several places."""
    several = F.col("feature").rlike("^[^:]*:1[0-9]{2}:")
    status = F.when(F.col("assumed"), "assumed_reference_not_in_vcf").when(F.col("state") == genotype.FILTERED, "filtered_or_low_quality").when(several, "multi_hit_context_not_encoded_as_zero").otherwise("mapped_unique_context")
    call = F.when(F.col("label") == "assumed_reference_non_baseline", "known_nonbaseline_match").when(several & ~F.col("assumed"), "not_called_multi_hit_context").otherwise(F.col("label"))
    return a.resolved(s, d).select("sample", "feature", "value", status.alias("mapping_status"), call.alias("allele_call"), F.col("state").alias("call_state"))


_HIST = lambda c, keys="sample": f"(SELECT {keys}, string_agg(v || '=' || n, ',' ORDER BY v) AS h FROM (SELECT {keys}, {c} AS v, count(*) AS n FROM mapped WHERE {c} IS NOT NULL GROUP BY ALL) GROUP BY ALL)"


@query(f"""WITH {a.RESOLVED}, {_MAPPED}, n AS (SELECT sample, count(*) AS n_feature_calls, count(*) FILTER (value = 1) AS n_encoded_active_features, count(*) FILTER (allele_call IN ('baseline_match', 'alt_match', 'known_nonbaseline_match', 'assumed_reference')) AS n_resolved_features,
  count(*) FILTER (allele_call IN ('baseline_match', 'assumed_reference')) AS n_resolved_baseline_features, count(*) FILTER (allele_call IN ('alt_match', 'known_nonbaseline_match')) AS n_resolved_nonbaseline_features, count(*) FILTER (call_state LIKE 'CALLED%') AS n_callable_features, count(*) FILTER (value IS NULL) AS n_noncallable_nan,
  count(*) FILTER (mapping_status = 'mapped_unique_context') AS n_unique_mapped_calls, count(*) FILTER (regexp_matches(mapping_status, 'unresolved|missing|locus_not_present|filtered')) AS n_unresolved_or_missing_context_calls, count(*) FILTER (mapping_status LIKE '%multi_hit%') AS n_multi_hit_calls,
  count(*) FILTER (mapping_status LIKE '%ambiguous_base%') AS n_ambiguous_base_calls, count(*) FILTER (mapping_status LIKE '%non_training_allele%') AS n_non_training_allele_calls, count(*) FILTER (allele_call = 'assumed_reference') AS n_assumed_reference FROM mapped GROUP BY sample)
SELECT n.*, a.h AS status_counts, b.h AS allele_call_counts, c.h AS call_state_counts FROM n JOIN {_HIST("mapping_status")} a USING (sample) JOIN {_HIST("allele_call")} b USING (sample) JOIN {_HIST("call_state")} c USING (sample)""")
def mapping_summary(s, d):
    """13 counts and three histograms of each sample's calls."""
    out = evidence.mapping_summary(_mapped(s, d))
    return out.select(*[evidence.histogram_text(c).alias(c) if t.startswith("map") else F.col(c) for c, t in out.dtypes])


_CELLS = f"""{_MAPPED.replace("mapped AS", "mapped0 AS")}, mapped AS (SELECT *, CASE WHEN sample % 7 = 0 THEN 'matrix' ELSE 'root' END AS node FROM (SELECT sample, feature, value, CASE WHEN sample % 7 <> 0 THEN mapping_status END AS mapping_status, CASE WHEN sample % 7 <> 0 THEN allele_call END AS allele_call FROM mapped0)),
roles AS (SELECT *, CASE WHEN allele_call IN ('alt_match', 'known_nonbaseline_match') THEN 'resolved_nonbaseline_state' WHEN allele_call = 'baseline_match' THEN 'resolved_baseline_state' WHEN mapping_status IS NOT NULL THEN 'unresolved_zero_fill' WHEN value IS NOT NULL THEN 'aligned_matrix_state' ELSE 'unresolved_zero_fill' END AS role FROM mapped)"""


def _cells(s, d):
    """Cells of a model's features; samples divisible by 7 come as a matrix, without mapping data."""
    given = F.col("sample") % 7 != 0
    return _mapped(s, d).select("sample", F.when(given, "root").otherwise("matrix").alias("node"), "feature", "value", F.when(given, F.col("mapping_status")).alias("mapping_status"), F.when(given, F.col("allele_call")).alias("allele_call"), F.col("value").isNotNull().alias("available"))


_EVIDENCE = f"""{_CELLS}, e0 AS (SELECT sample, node, count(*) AS n, count(*) FILTER (value <> 0) AS act, count(*) FILTER (mapping_status IS NOT NULL) AS mp, count(*) FILTER (mapping_status = 'mapped_unique_context') AS uniq, count(*) FILTER (role IN ('resolved_baseline_state', 'resolved_nonbaseline_state')) AS res0, count(*) FILTER (role = 'aligned_matrix_state') AS ali,
  count(*) FILTER (role = 'resolved_baseline_state') AS rb, count(*) FILTER (role = 'resolved_nonbaseline_state') AS rn, count(*) FILTER (role = 'unresolved_zero_fill') AS unres, count(*) FILTER (allele_call = 'baseline_match') AS bm, count(*) FILTER (allele_call = 'alt_match') AS am, count(*) FILTER (allele_call = 'known_nonbaseline_match') AS kn,
  count(*) FILTER (allele_call = 'not_called_multi_hit_context') + count(*) FILTER (mapping_status LIKE '%multi_hit%') AS mh, count(*) FILTER (allele_call = 'non_training_allele') AS nt, string_agg(feature, ',' ORDER BY feature) FILTER (value <> 0) AS ids FROM roles GROUP BY ALL),
ev AS (SELECT *, res0 + CASE WHEN mp > 0 THEN 0 ELSE ali END AS res, act / n AS af, CASE WHEN mp > 0 THEN uniq / mp END AS uf, (res0 + CASE WHEN mp > 0 THEN 0 ELSE ali END) / n AS rf FROM e0),
st AS (SELECT *, CASE WHEN mp = 0 THEN 'feature_space_alignment_only' WHEN uf >= .8 THEN 'adequate_marker_recovery' WHEN uf >= .5 THEN 'partial_marker_recovery' ELSE 'low_marker_recovery' END AS recovery, CASE WHEN act >= 10 OR af >= .01 THEN 'active_marker_evidence_present' WHEN act > 0 THEN 'very_low_active_marker_evidence' ELSE 'no_active_marker_evidence' END AS active,
  CASE WHEN mp = 0 AND res > 0 THEN 'aligned_matrix_evidence_present' WHEN mp = 0 THEN 'feature_space_alignment_only' WHEN rf >= .8 THEN 'resolved_marker_evidence_present' WHEN rf >= .5 THEN 'partial_resolved_marker_evidence' WHEN res > 0 THEN 'low_resolved_marker_evidence' ELSE 'no_resolved_marker_evidence' END AS resolved FROM ev)"""


@query(f"""WITH {a.RESOLVED}, {_EVIDENCE} SELECT sample, node, n AS e_n_selected_features, act AS e_n_active_features, coalesce(ids, '') AS e_active_feature_ids, mp AS e_n_features_with_mapping_metadata, uniq AS e_n_unique_mapped_features, rb AS e_n_resolved_baseline_features, rn AS e_n_resolved_nonbaseline_features, unres AS e_n_zero_fill_caution_features,
  bm AS e_n_baseline_match_calls, am AS e_n_alt_match_calls, kn AS e_n_known_nonbaseline_match_calls, 0::BIGINT AS e_n_unresolved_or_missing_calls, mh AS e_n_multi_hit_calls, 0::BIGINT AS e_n_ambiguous_base_calls, nt AS e_n_non_training_allele_calls, mp > 0 AS e_has_mapping_metadata, res AS e_n_resolved_features,
  round(af, 6) AS e_active_feature_fraction, round(uf, 6) AS e_unique_mapped_fraction, round(rf, 6) AS e_resolved_feature_fraction, round(rb / n, 6) AS e_resolved_baseline_feature_fraction, round(rn / n, 6) AS e_resolved_nonbaseline_feature_fraction, n - res AS e_n_unresolved_or_missing_features,
  active AS e_nonbaseline_evidence_status, active AS e_active_marker_evidence_status, recovery AS e_marker_recovery_status, resolved AS e_resolved_marker_evidence_status, x.h AS e_evidence_role_counts, coalesce(y.h, '') AS e_mapping_status_counts, coalesce(z.h, '') AS e_allele_call_counts
FROM st JOIN {_HIST("role", "sample, node").replace("mapped", "roles")} x USING (sample, node) LEFT JOIN {_HIST("mapping_status", "sample, node")} y USING (sample, node) LEFT JOIN {_HIST("allele_call", "sample, node")} z USING (sample, node)""")
def evidence_summary(s, d):
    """All outputs of a model's evidence but the reasons' texts, under a prefix."""
    flat = evidence.flattened(evidence.model_evidence(_cells(s, d)), "e")
    return flat.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in flat.dtypes if not c.endswith("_reason")])


@query(f"""WITH {a.RESOLVED}, {_CELLS} SELECT sample, node, feature, value, role, round(imp, 6) AS importance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY sample, node ORDER BY imp DESC, feature) AS place FROM (SELECT *, length(feature) % 3 + ascii(feature[-1]) % 5 / 10.0::DOUBLE AS imp FROM roles WHERE role = 'resolved_nonbaseline_state')) WHERE place <= 5""")
def supporting_markers(s, d):
    """The five most important features that support a sample's call."""
    c = _cells(s, d)
    imp = c.select("node", "feature").distinct().withColumn("importance", F.length("feature") % 3 + F.ascii(F.substring("feature", -1, 1)) % 5 / 10.0)
    return evidence.supporting_markers(c, imp, 5).withColumn("importance", r6("importance"))


@query(f"""WITH {a.RESOLVED}, {_EVIDENCE}, x AS (SELECT *, round(0.3 + (sample % 8) / 10.0, 2)::DOUBLE AS support FROM st)
SELECT sample, CASE WHEN res = 0 THEN 'low_confidence' WHEN support >= 0.7::DOUBLE AND rf >= .5 AND act = 0 THEN 'high_confidence_baseline_pattern' WHEN support >= 0.7::DOUBLE AND rf >= .5 THEN 'high_confidence' WHEN support >= 0.5::DOUBLE THEN 'moderate_confidence'
  WHEN resolved IN ('resolved_marker_evidence_present', 'partial_resolved_marker_evidence', 'aligned_matrix_evidence_present') THEN 'low_to_moderate_confidence' ELSE 'low_confidence' END AS confidence,
  res <= 0 OR resolved = 'low_resolved_marker_evidence' OR rf < 0.05 AS weak FROM x""")
def confidence_and_guard(s, d):
    e = evidence.model_evidence(_cells(s, d)).withColumn("support", F.round(F.lit(0.3) + (F.col("sample") % 8) / 10.0, 2))
    n, share, status = F.col("n_resolved_features"), F.col("resolved_feature_fraction"), F.col("resolved_marker_evidence_status")
    conf = encode.confidence(F.col("support"), F.col("n_selected_features"), share, n, F.col("n_active_features"), status)
    return e.select("sample", conf.alias("confidence"), encode.weak_evidence(share, n, status).alias("weak"))


_GUARD = """g AS (SELECT sample, 'Drug_status' AS label_column, CASE WHEN sample % 3 = 0 THEN 'resistant' ELSE 'Susceptible' END AS label, rf, res, resolved, CASE sample % 4 WHEN 0 THEN 'resistant' WHEN 1 THEN 'resistant' ELSE 'susceptible' END AS other, (sample % 10) / 10.0::DOUBLE AS p FROM st),
gw AS (SELECT *, label = 'Susceptible' AND (res <= 0 OR resolved = 'low_resolved_marker_evidence' OR rf < 0.3) AS weak, other = 'resistant' AND p >= 0.5 AS over_ FROM g)"""


@query(f"""WITH {a.RESOLVED}, {_EVIDENCE}, {_GUARD} SELECT sample, label, CASE WHEN weak AND over_ THEN 'resistant' WHEN weak AND sample % 2 = 1 THEN 'amr_evidence_review_required' ELSE label END AS reported, CASE WHEN weak AND over_ THEN 'resistant' ELSE label END AS routing,
  CASE WHEN weak AND over_ THEN 'amr_terminal_fallback_escalation' WHEN weak AND sample % 2 = 1 THEN 'amr_evidence_review_required' WHEN weak THEN 'amr_weak_evidence_warning' ELSE 'none' END AS guard, CASE WHEN weak AND over_ THEN 'global' END AS source FROM gw""")
def evidence_guard(s, d):
    """Susceptible calls on weak evidence: the terminal model's answer, else a warning (even samples) or a review (odd ones)."""
    e = evidence.model_evidence(_cells(s, d))
    k = F.col("sample")
    steps = e.select("sample", F.lit("Drug_status").alias("label_column"), F.when(k % 3 == 0, "resistant").otherwise("Susceptible").alias("label"), F.col("resolved_feature_fraction").alias("resolved"), F.col("n_resolved_features").alias("n_resolved"), F.col("resolved_marker_evidence_status").alias("status"))
    terminal = e.select("sample", F.when(k % 4 <= 1, "resistant").otherwise("susceptible").alias("prediction"), ((k % 10) / F.lit(10.0)).alias("resistant_probability"), F.lit("global").alias("source"))
    each = [hierarchy.guarded(steps.where(k % 2 == r), ("drug_status",), terminal, mode, 0.3) for r, mode in ((0, "warn"), (1, "block"))]
    return each[0].unionByName(each[1]).select("sample", "label", "reported", "routing", "guard", "source")


# expressions ----------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT event_id, 'type=' || event_type || ';FLAG;v=' || (event_id % 7) || ';v=' || (event_id % 5) || '=x' AS info FROM events)
SELECT event_id, regexp_extract(info, 'type=([^;]*)', 1) AS type, '1' AS flag, (event_id % 5) || '=x' AS v, 3::INT AS n FROM t""")
def info_parsing(s, d):
    t = a.table(s, d, "events").select("event_id", F.concat(F.lit("type="), "event_type", F.lit(";FLAG;v="), F.col("event_id") % 7, F.lit(";v="), F.col("event_id") % 5, F.lit("=x")).alias("info"))
    m = genotype.info_map(F.col("info"))
    return t.select("event_id", m["type"].alias("type"), m["FLAG"].alias("flag"), m["v"].alias("v"), F.size(m).alias("n"))


@query("SELECT event_id, event_type AS gt, CASE WHEN event_id % 3 = 0 THEN '' ELSE (event_id % 9)::VARCHAR END AS dp FROM events")
def format_zip(s, d):
    t = a.table(s, d, "events").select("event_id", F.lit("GT:DP").alias("f"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.concat_ws(":", "event_type", F.col("event_id") % 9)).alias("v"))
    m = genotype.sample_map(F.col("f"), F.col("v"))
    return t.select("event_id", m["GT"].alias("gt"), m["DP"].alias("dp"))


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN ' /data/SRR' || c_custkey || '.vcf.gz' WHEN 1 THEN 'nan' WHEN 2 THEN 's' || c_custkey || '.g.vcf.gz' WHEN 3 THEN 's' || c_custkey || '_LIBRARY2' WHEN 4 THEN 'ERR1 and err1' ELSE 'ERR1,ERR' || c_custkey END AS x FROM customer)
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'SRR' || c_custkey WHEN 1 THEN '' WHEN 2 THEN 's' || c_custkey || '.g' WHEN 3 THEN 's' || c_custkey WHEN 4 THEN 'ERR1' ELSE CASE WHEN c_custkey = 1 THEN 'ERR1' ELSE x END END AS sample FROM t""")
def sample_id_normalisation(s, d):
    k = F.col("c_custkey")
    x = F.element_at(F.array(F.concat(F.lit(" /data/SRR"), k, F.lit(".vcf.gz")), F.lit("nan"), F.concat(F.lit("s"), k, F.lit(".g.vcf.gz")), F.concat(F.lit("s"), k, F.lit("_LIBRARY2")), F.lit("ERR1 and err1"), F.concat(F.lit("ERR1,ERR"), k)), (k % 6 + 1).cast("int"))
    return a.table(s, d, "customer").select("c_custkey", genotype.sample_id(x).alias("sample"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'S' || c_custkey WHEN 1 THEN 'S' || c_custkey WHEN 2 THEN 'S' || c_custkey || '.g' WHEN 3 THEN 'S' || c_custkey || '.x' ELSE 'S' || c_custkey END AS sample FROM customer""")
def sample_of_path(s, d):
    k = F.col("c_custkey")
    end = F.element_at(F.array(*[F.lit(x) for x in (".g.vcf.gz", ".VCF", ".g.bcf", ".x.txt", "")]), (k % 5 + 1).cast("int"))
    return a.table(s, d, "customer").select("c_custkey", genotype.sample_of_path(F.concat(F.lit("/data/run/S"), k, end)).alias("sample"))


@query("WITH t AS (SELECT page_id, string_split(replace(url, ':', ''), '/') AS p FROM pages) SELECT page_id, " + ", ".join(f"CASE WHEN len(p) >= 4 THEN p[{i}] ELSE '' END AS {c}" for i, c in enumerate(("contig", "pos", "ref", "alt"), 1)) + " FROM t")
def feature_id_parsing(s, d):
    f = genotype.feature_parts(F.regexp_replace(F.regexp_replace("url", ":", ""), "/", ":"))
    return a.table(s, d, "pages").select("page_id", *[f[c].alias(c) for c in ("contig", "pos", "ref", "alt")])


@query("SELECT p_partkey, reverse(translate(upper(p_brand), 'ACGTN', 'TGCAN')) AS rc, reverse(translate(upper(p_type), 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS rc_iupac FROM part")
def reverse_complements(s, d):
    return a.table(s, d, "part").select("p_partkey", sequence.reverse_complement(F.col("p_brand")).alias("rc"), sequence.reverse_complement(F.col("p_type"), True).alias("rc_iupac"))


@query("SELECT p_partkey, array_to_string(list_transform(range(-40, 41), lambda k: substr(p_name, ((p_size - 1 + k) % length(p_name) + length(p_name)) % length(p_name) + 1, 1)), '') AS context FROM part")
def circular_contexts(s, d):
    return a.table(s, d, "part").select("p_partkey", sequence.circular_context(F.col("p_name"), F.col("p_size"), 40).alias("context"))


_CODON = "".join(f" WHEN '{x}{y}{z}' THEN '{sequence.AMINO[16 * i + 4 * j + k]}'" for i, x in enumerate("TCAG") for j, y in enumerate("TCAG") for k, z in enumerate("TCAG"))


@query(f"WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, substr('ACGTN', (l_partkey % 5)::INT + 1, 1) || substr('ACGT', (l_suppkey % 4)::INT + 1, 1) || substr('ACGT', (l_orderkey % 4)::INT + 1, 1) AS codon FROM lineitem) SELECT *, CASE codon{_CODON} ELSE 'X' END AS amino FROM t")
def codon_translation(s, d):
    letter = lambda alphabet, c: F.substring(F.lit(alphabet), (F.col(c) % len(alphabet) + 1).cast("int"), F.lit(1))
    t = a.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.concat(letter("ACGTN", "l_partkey"), letter("ACGT", "l_suppkey"), letter("ACGT", "l_orderkey")).alias("codon"))
    return t.withColumn("amino", sequence.amino_acid(F.col("codon")))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN '' WHEN 2 THEN '1.5' ELSE c_mktsegment END AS symbol FROM customer")
def marker_symbols(s, d):
    k = F.col("c_custkey")
    x = F.when(k % 4 == 0, F.concat(k, F.lit(".0"))).when(k % 4 == 1, F.lit(" NaN ")).when(k % 4 == 2, F.lit("1.5")).otherwise(F.col("c_mktsegment"))
    return a.table(s, d, "customer").select("c_custkey", encode.marker_symbol(x).alias("symbol"))


@query("SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^\\p{L}\\p{N}]', '', 'g') AS name FROM part")
def plain_names(s, d):
    return a.table(s, d, "part").select("p_partkey", encode.plain_name(F.col("p_name")).alias("name"))


@query("SELECT event_id, greatest(least(coalesce(value, 0), 2.0::DOUBLE), -2.0::DOUBLE) AS v FROM events")
def clipped_markers(s, d):
    return a.table(s, d, "events").select("event_id", encode.clipped(F.col("value")).alias("v"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x < 0 THEN 0 ELSE x::DOUBLE END) AS s FROM embeddings), p AS (SELECT vec_id, list_transform(s, lambda x: CASE WHEN list_sum(s) > 0 THEN x / list_sum(s) ELSE 1 / len(s) END) AS p FROM v)
SELECT vec_id, round(list_max(p), 6) AS top, round((0 - list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * log2(x) ELSE 0 END))) / log2(len(p)), 6) AS entropy, CASE WHEN list_contains(p, 0) OR list_contains(p, 1) THEN 0 ELSE round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * log2(x) ELSE 0 END)), 6) END::DOUBLE AS strict FROM p""")
def scores_and_entropy(s, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    t = a.table(s, d, "embeddings").select("vec_id", encode.normalised(x).alias("p"))
    return t.select("vec_id", r6(F.array_max("p")).alias("top"), r6(encode.entropy(F.col("p"))).alias("entropy"), r6(encode.entropy_strict(F.col("p"))).alias("strict"))


_PATHS = "paths AS (SELECT c_custkey AS id, r_name, n_name, c_mktsegment AS seg FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _paths(s, d):
    c, n, r = (a.table(s, d, t) for t in ("customer", "nation", "region"))
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("id"), F.array("r_name", "n_name", "c_mktsegment").alias("labels"))  # 25 and 5 rows


@query(f"WITH {_PATHS} SELECT id, r_name || '|' || n_name AS level2, CASE WHEN seg = 'BUILDING' THEN NULL ELSE r_name || '|' || n_name || '|' || seg END AS level3 FROM paths")
def hierarchy_levels(s, d):
    p = _paths(s, d).withColumn("labels", F.transform("labels", lambda x: F.when(x == "BUILDING", " ").otherwise(x)))
    return p.select("id", encode.level_label(F.col("labels"), 2).alias("level2"), encode.level_label(F.col("labels"), 3).alias("level3"))


@query(f"WITH {_PATHS} SELECT id, n_name || '|' || seg AS shown, 'Root.' || r_name AS omitted FROM paths")
def report_paths(s, d):
    p = encode.report_path(F.array_join("labels", "|"), 2)
    return _paths(s, d).select("id", p["shown"].alias("shown"), p["omitted"].alias("omitted"))


@query("""WITH lists AS (SELECT p_brand, string_agg(CAST(p_size AS VARCHAR), ', ' ORDER BY p_partkey) AS t FROM part WHERE p_size % 3 = 0 GROUP BY p_brand), named AS (SELECT DISTINCT p_brand, CAST(unnest(string_split(t, ', ')) AS BIGINT) AS p FROM lists)
SELECT part.p_partkey, part.p_brand, part.p_size, named.p IS NOT NULL AS kept FROM part LEFT JOIN named ON part.p_brand = named.p_brand AND part.p_size = named.p""")
def position_list(s, d):
    """Force-kept positions of each brand, from its text of 1-based numbers with repeats."""
    part = a.table(s, d, "part").select("p_partkey", "p_brand", "p_size")
    texts = part.where("p_size % 3 = 0").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))), lambda x: x["p_size"].cast("string")), ", ").alias("t"))
    listed = texts.select("p_brand", F.explode(tables.positions(F.col("t"), 50)).alias("p_size"))
    return tables.kept_positions(part, listed, ["p_brand"], "p_size")


@query("SELECT p_partkey AS sample, p_brand AS feature, upper(trim(p_type)) AS state, dense_rank() OVER (PARTITION BY p_brand ORDER BY upper(trim(p_type)))::INT - 1 AS code FROM part")
def categorical_codes(s, d):
    """Each part's type, numbered among the types of its brand."""
    return tables.encoded(a.table(s, d, "part").select(F.col("p_partkey").alias("sample"), F.col("p_brand").alias("feature"), F.col("p_type").alias("state")))


@query("SELECT p_brand AS marker, array_to_string(list_sort(list_distinct(list(p_size))), ',') AS known FROM part GROUP BY p_brand")
def known_values(s, d):
    return tables.known_values(a.table(s, d, "part").withColumnRenamed("p_brand", "marker"), ["marker"], "p_size").withColumn("known", F.array_join("known", ","))


# matrices -------------------------------------------------------------------------------------------


@query(f"WITH {a.MATRIX} SELECT feature FROM matrix GROUP BY feature HAVING count(DISTINCT coalesce(value, -1)) > 1")
def variant_features(s, d):
    return cohort.variant_features(a.matrix(s, d))


@query(f"WITH {a.MATRIX}, n AS (SELECT feature, count(*) FILTER (value = 0) AS n0, count(*) FILTER (value = 1) AS n1 FROM matrix GROUP BY feature) SELECT *, least(n0, n1) AS minor FROM n WHERE least(n0, n1) >= 5")
def minor_count_filter(s, d):
    return cohort.minor_counts(a.matrix(s, d)).where("minor >= 5")


@query(f"WITH {a.MATRIX}, p AS (SELECT feature, count(*) AS n, count(*) FILTER (value = 1) AS o, count(*) FILTER (value IS NULL) AS m FROM matrix GROUP BY feature) SELECT count(*) AS n_features, sum(n)::BIGINT AS n_cells, sum(o)::BIGINT AS n_ones, sum(m)::BIGINT AS n_missing, round(sum(o) / sum(n), 6) AS density, count(*) FILTER (o = 1) AS singletons, count(*) FILTER (o = 2) AS doubletons, round(avg(o), 6) AS mean_carriers FROM p")
def matrix_statistics(s, d):
    t = cohort.statistics(a.matrix(s, d))
    return t.withColumns({"density": r6("density"), "mean_carriers": r6("mean_carriers")})


@query(f"WITH {a.MATRIX} SELECT 'sample' AS axis, sample AS id, round(avg((value IS NULL)::INT), 6) AS missing FROM matrix GROUP BY sample UNION ALL SELECT 'feature', feature, round(avg((value IS NULL)::INT), 6) FROM matrix GROUP BY feature")
def missing_fractions(s, d):
    m = a.matrix(s, d)
    each = lambda by: cohort.missing_fractions(m, by).select(F.lit(by).alias("axis"), F.col(by).alias("id"), r6("missing").alias("missing"))
    return each("sample").unionByName(each("feature"))


@query(f"""WITH {a.MATRIX}, f AS (SELECT feature FROM matrix GROUP BY feature HAVING avg((value IS NULL)::INT) <= 0.3), k AS (SELECT * FROM matrix WHERE feature IN (SELECT feature FROM f)), s AS (SELECT sample FROM k GROUP BY sample HAVING avg((value IS NULL)::INT) <= 0.3)
SELECT sample, feature, value FROM k WHERE sample IN (SELECT sample FROM s)""")
def missingness_retained(s, d):
    return cohort.retained(a.matrix(s, d), 0.3, 0.3).select("sample", "feature", "value")


@query(f"WITH {a.MATRIX}, c AS (SELECT feature, value, count(*) AS n FROM matrix WHERE value IS NOT NULL GROUP BY ALL), m AS (SELECT feature, value FROM c QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) = 1) SELECT x.sample, x.feature, coalesce(x.value, m.value, 0) AS value FROM matrix x LEFT JOIN m USING (feature)")
def mode_imputation(s, d):
    m = a.matrix(s, d)
    return cohort.imputed(m, cohort.fills(m, "mode"))


@query(f"""WITH {a.MATRIX}, p AS (SELECT feature, string_agg(sample || ':' || coalesce(value::INT::VARCHAR, '?'), ',' ORDER BY sample) AS pat FROM matrix GROUP BY feature), q AS (SELECT feature, row_number() OVER (PARTITION BY pat ORDER BY feature) - 1 AS place, count(*) OVER (PARTITION BY pat) AS pattern_size FROM p)
SELECT feature, pattern_size, place FROM q WHERE pattern_size <= 2 OR place IN (0, pattern_size - 1)""")
def pattern_dedupe(s, d):
    m = a.matrix(s, d).withColumn("ord", F.col("feature"))
    return cohort.pattern_representatives(m, "ord", 2).select("feature", "pattern_size", F.col("place").cast("long").alias("place"))


@query("WITH t AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_partkey FROM t WHERE n <= 4 OR list_contains(list_transform(range(4), lambda k: round_even(k * (n - 1) / 3.0::DOUBLE, 0)), i)")
def even_pick(s, d):
    w = Window.partitionBy("p_brand")
    t = a.table(s, d, "part").select("p_partkey", (F.row_number().over(w.orderBy("p_partkey")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return t.where(cohort.even_picks(F.col("i"), F.col("n"), 4)).select("p_partkey")


@query(f"WITH {a.MATRIX}, f AS (SELECT DISTINCT l_partkey % 150 + 100 AS feature, l_partkey % 150 AS ord FROM lineitem ) SELECT g.sample, f.feature, f.ord, m.value, m.sample IS NOT NULL AS present FROM (SELECT DISTINCT sample FROM matrix) g CROSS JOIN f LEFT JOIN matrix m ON m.sample = g.sample AND m.feature = f.feature")
def feature_alignment(s, d):
    k = F.col("l_partkey") % 150
    f = a.table(s, d, "lineitem").select((k + 100).alias("feature"), k.alias("ord")).distinct()
    return cohort.aligned(a.matrix(s, d), f).select("sample", "feature", "ord", "value", "present")


@query(f"WITH {a.MATRIX} SELECT sample, " + ", ".join(f"max(value) FILTER (feature = {k}) AS f{k}" for k in range(1, 201)) + " FROM matrix GROUP BY sample")
def matrix_pivot(s, d):
    m = a.matrix(s, d).withColumn("feature", F.concat(F.lit("f"), "feature"))
    return cohort.wide(m, [f"f{k}" for k in range(1, 201)])


@query("SELECT s_suppkey AS sample, 's_nationkey' AS feature, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 's_acctbal', s_acctbal FROM supplier")
def matrix_unpivot(s, d):
    t = a.table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("s_nationkey"), "s_acctbal")
    return cohort.long(t, "s_suppkey")


@query(f"WITH {a.MATRIX} SELECT sample, string_agg(coalesce(value::INT::VARCHAR, ''), chr(9) ORDER BY feature) AS line FROM matrix GROUP BY sample")
def matrix_text(s, d):
    return writers.matrix_lines(a.matrix(s, d)).select("sample", F.regexp_replace("value", "^[^\t]*\t", "").alias("line"))


@query("SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) = 1 THEN lang ELSE lang || '__dup' || row_number() OVER (PARTITION BY lang ORDER BY doc_id) END AS name FROM documents")
def duplicate_suffixes(s, d):
    return tables.suffixed(a.table(s, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"]).withColumnRenamed("number", "n")


@query(f"WITH {a.MATRIX}, k AS (SELECT 'matrix' AS source, CASE WHEN bool_and(value IN (0, 1)) THEN 'binary' ELSE 'character' END AS kind FROM matrix WHERE value IS NOT NULL UNION ALL SELECT 'brands', CASE WHEN bool_and(p_brand IN ('0', '1')) THEN 'binary' ELSE 'character' END FROM part) SELECT * FROM k")
def data_type_inference(s, d):
    found = [("matrix", readers.data_type(a.matrix(s, d).select(F.col("value").cast("int").alias("state")))), ("brands", readers.data_type(a.table(s, d, "part").select(F.col("p_brand").alias("state"))))]
    return s.createDataFrame(found, "source string, kind string")


@query(f"WITH {a.MATRIX}, a AS (SELECT DISTINCT feature FROM matrix WHERE sample = 1), b AS (SELECT DISTINCT feature FROM matrix WHERE sample = 2) SELECT feature, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT feature, 'extra' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def feature_differences(s, d):
    m = a.matrix(s, d)
    x, y = (m.where(F.col("sample") == k).select("feature").distinct() for k in (1, 2))
    return x.join(y, "feature", "left_anti").withColumn("side", F.lit("missing")).unionByName(y.join(x, "feature", "left_anti").withColumn("side", F.lit("extra")))


@query("WITH u AS (SELECT l_partkey AS feature, 0 AS list, l_orderkey AS ord FROM lineitem UNION ALL SELECT p_partkey, 1, p_partkey FROM part) SELECT feature, list, ord FROM u QUALIFY row_number() OVER (PARTITION BY feature ORDER BY list, ord) = 1")
def ordered_union(s, d):
    x = a.table(s, d, "lineitem").select(F.col("l_partkey").alias("feature"), F.col("l_orderkey").alias("ord"))
    return tables.ordered_union([x, a.table(s, d, "part").select(F.col("p_partkey").alias("feature"), F.col("p_partkey").alias("ord"))])


# joins ----------------------------------------------------------------------------------------------


@query(f"WITH {a.BLOCKS} SELECT id, k, pos, ord FROM (SELECT p.id, p.k, p.pos, b.ord FROM probes p LEFT JOIN blocks b ON b.k = p.k AND p.pos BETWEEN b.start AND b.end_) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1")
def first_covering_block(s, d):
    return joins.first_covering(a.probes(s, d), a.blocks(s, d), ["k"], "pos", "start", "end", "ord", 3600).select("id", "k", "pos", "ord")


@query(f"WITH {a.BLOCKS} SELECT p.id, b.ord FROM probes p JOIN blocks b ON b.k = p.k AND p.pos BETWEEN b.start AND b.end_")
def overlapping_blocks(s, d):
    return joins.range_join(a.probes(s, d), a.blocks(s, d), ["k"], "pos", "start", "end", 3600).select("id", "ord")


@query(f"""WITH {a.BLOCKS}, c AS (SELECT p.id, p.pos, b.ord, b.start, b.end_, CASE WHEN p.pos > b.end_ THEN p.pos - b.end_ WHEN p.pos < b.start THEN b.start - p.pos ELSE 0 END AS distance FROM probes p JOIN blocks b ON b.k = p.k)
SELECT id, arg_min(ord, {{'a': distance, 'b': ord}}) AS ord, min(distance) AS distance FROM c GROUP BY id""")
def nearest_block(s, d):
    return joins.nearest(a.probes(s, d), a.blocks(s, d), ["k"], "pos", "start", "end", "ord", 3600).select("id", "ord", "distance")


@query("""WITH q AS (SELECT c_custkey, c_nationkey FROM customer), one AS (SELECT o_custkey AS c_custkey, count(DISTINCT o_orderstatus) AS n, min(o_orderstatus) AS v FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY ALL), two AS (SELECT o_custkey AS c_custkey, min(o_orderstatus) AS v FROM orders GROUP BY ALL)
SELECT c_custkey, CASE WHEN one.n > 1 THEN NULL ELSE coalesce(one.v, two.v) END AS v, CASE WHEN one.n > 1 THEN 'ambiguous_urgent' WHEN one.n = 1 THEN 'urgent' WHEN two.v IS NOT NULL THEN 'any' ELSE 'absent' END AS match FROM q LEFT JOIN one USING (c_custkey) LEFT JOIN two USING (c_custkey)""")
def tiered_lookup(s, d):
    o = a.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("v"), "o_orderpriority")
    return joins.tiered_lookup(a.table(s, d, "customer").select("c_custkey"), [("urgent", o.where("o_orderpriority LIKE '1%'"), True), ("any", o, False)], ["c_custkey"], ["v"])


_SUBJECTS = "subj AS (SELECT page_id AS subject_id, upper(url) AS seq FROM pages)"


def _subjects(s, d):
    return a.table(s, d, "pages").select(F.col("page_id").alias("subject_id"), F.upper("url").alias("seq"))


@query(f"WITH {_SUBJECTS}, pat AS (SELECT DISTINCT substr(seq, 9, 8) AS pattern FROM subj WHERE subject_id % 100 = 0 AND length(seq) >= 20), places AS (SELECT subject_id, seq, unnest(range(0, length(seq) - 7)) AS p FROM subj) SELECT pattern AS pattern_id, subject_id, p::INT AS \"at\", hamming(substr(seq, p + 1, 8), pattern)::INT AS mismatches FROM places JOIN pat ON hamming(substr(seq, p + 1, 8), pattern) <= 1")
def mismatch_search(s, d):
    x = _subjects(s, d)
    pat = x.where("subject_id % 100 = 0 AND length(seq) >= 20")  # the search's queries
    pat = pat.select(F.substring("seq", 9, 8).alias("pattern")).distinct()
    return joins.seeded_search(x, pat.select(F.col("pattern").alias("pattern_id"), "pattern"), 1)


@query(f"""WITH {_SUBJECTS}, ctx AS (SELECT subject_id AS context_id, substr(seq, 10, 4) AS l, substr(seq, 15, 4) AS r FROM subj WHERE subject_id % 100 = 0 AND length(seq) >= 30),
both_ AS (SELECT context_id, l, r, '+' AS strand FROM ctx UNION ALL SELECT context_id, reverse(translate(r, 'ACGTN', 'TGCAN')), reverse(translate(l, 'ACGTN', 'TGCAN')), '-' FROM ctx), places AS (SELECT subject_id, seq, unnest(range(4, length(seq) - 4)) AS p FROM subj)
SELECT context_id, subject_id, p::INT AS "at", strand, CASE WHEN strand = '-' THEN translate(substr(seq, p + 1, 1), 'ACGTN', 'TGCAN') ELSE substr(seq, p + 1, 1) END AS centre FROM places JOIN both_ ON substr(seq, p - 3, 4) = l AND substr(seq, p + 2, 4) = r""")
def flank_context_search(s, d):
    x = _subjects(s, d)
    ctx = x.where("subject_id % 100 = 0 AND length(seq) >= 30").select(F.col("subject_id").alias("context_id"), F.substring("seq", 10, 4).alias("left"), F.substring("seq", 15, 4).alias("right"))
    return joins.flank_search(x, ctx)


# selection ------------------------------------------------------------------------------------------


@query(f"WITH {a.PREDICTIONS} SELECT snp, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, p, fdr, gfdr FROM preds WHERE p <= 0.05 AND fdr <= 0.05 AND gfdr <= 0.2")
def significant_features(s, d):
    return selection.significant(a.predictions(s, d), 0.05, 0.05, 0.2).select("snp", "ord.*", "p", "fdr", "gfdr")


_BEST = "best AS (SELECT snp, p, fdr, gfdr FROM preds QUALIFY row_number() OVER (PARTITION BY snp ORDER BY gfdr, fdr, p, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = 1)"


@query(f"WITH {a.PREDICTIONS}, {_BEST} SELECT * FROM best")
def best_predictions(s, d):
    return selection.best_prediction(a.predictions(s, d)).select("snp", "p", "fdr", "gfdr")


@query(f"WITH {a.PREDICTIONS}, {_BEST} SELECT snp, row_number() OVER (ORDER BY gfdr, fdr, p, snp) AS rank FROM best QUALIFY rank <= 100")
def top_ranked(s, d):
    """A top-k report: the k least by the full order."""
    best = selection.best_prediction(a.predictions(s, d)).orderBy("gfdr", "fdr", "p", "snp").limit(100)
    return selection.ranked(best).select("snp", F.col("rank").cast("long").alias("rank"))


_ISLANDS = "c AS (SELECT user_id, event_id AS id, floor(epoch(ts))::BIGINT AS pos FROM events), g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos, id) <= 3600 THEN 0 ELSE 1 END AS n FROM c), h AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY pos, id)::BIGINT AS grp FROM g), i AS (SELECT *, count(*) OVER (PARTITION BY user_id, grp) AS m FROM h), isl AS (SELECT user_id, id, pos, CASE WHEN m >= 2 THEN grp END AS \"group\" FROM i)"


@query(f"WITH {_ISLANDS} SELECT * FROM isl")
def neighbourhoods(s, d):
    return selection.neighbourhoods(a.coords(s, d), 3600, ["user_id"]).select("user_id", "id", "pos", "group")


@query(f'WITH {_ISLANDS} SELECT user_id, id FROM isl QUALIFY row_number() OVER (PARTITION BY user_id, coalesce(\'g\' || "group", \'i\' || id) ORDER BY id % 7, id) = 1')
def best_of_neighbourhood(s, d):
    n = selection.neighbourhoods(a.coords(s, d), 3600, ["user_id"]).withColumns({"g": F.when(F.col("group").isNotNull(), F.concat_ws(":", "user_id", "group")), "o": F.col("id") % 7})
    return selection.best_of_group(n, "g", "id", ["o", "id"]).select("user_id", "id")


@query("SELECT user_id, event_id, max(floor(epoch(ts))::BIGINT + event_id % 11 * 1800) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prefix_max FROM events")
def prefix_maximum(s, d):
    return tables.prefix_max(a.table(s, d, "events"), ["user_id"], ["ts", "event_id"], F.unix_timestamp("ts") + F.col("event_id") % 11 * 1800).select("user_id", "event_id", "prefix_max")


@query("SELECT DISTINCT p_partkey AS feature FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def synchronised_selection(s, d):
    li = a.table(s, d, "lineitem").withColumnRenamed("l_partkey", "feature")
    return selection.synchronised(a.table(s, d, "part").select(F.col("p_partkey").alias("feature")).distinct(), li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), li.where("l_discount > 0.09"))


@query(None)
def redundancy_clusters(s, d):
    """Complete linkage over the whole list of features."""
    m = a.matrix(s, d)
    m = cohort.aligned(m, m.select("feature", F.col("feature").alias("ord")).distinct())
    v = F.coalesce(F.col("value").cast("int").cast("string"), F.lit("?"))
    each = F.array_sort(F.collect_list(F.struct("sample", v.alias("v"))))
    states = m.groupBy("feature").agg(F.array_join(F.transform(each, lambda x: x["v"]), "").alias("states"))
    states = states.select(F.lit(0).cast("long").alias("group"), "feature", F.col("feature").cast("long").alias("rank"), "states")
    return selection.redundancy(states, 0.4, 2)


@query(f"WITH {a.MATRIX}, e AS (SELECT sample, feature, row_number() OVER (PARTITION BY sample ORDER BY value DESC, feature) AS n FROM matrix WHERE value IS NOT NULL) SELECT sample, feature, n FROM e WHERE n <= 10")
def top_supporting_markers(s, d):
    return tables.top(a.matrix(s, d).where("value IS NOT NULL"), ["sample"], [F.col("value").desc(), F.col("feature")], 10).select("sample", "feature", "n")


# statistics -----------------------------------------------------------------------------------------


@query(f"WITH {a.VECTORS} SELECT i, j, round(d, 6) AS d FROM dist WHERE d <= 0.5")
def jaccard_neighbours(s, d):
    return stats.jaccard(stats.ones(a.vectors(s, d)), 0.5).select("i", "j", r6("d").alias("d"))


@query(f"WITH {a.VECTORS} SELECT i, j, round(h, 6) AS d FROM dist WHERE h <= 0.3")
def hamming_neighbours(s, d):
    return stats.hamming(a.vectors(s, d), 0.3).select("i", "j", r6("d").alias("d"))


@query(f"WITH {a.VECTORS}, z AS (SELECT label, count(*) AS n FROM bits GROUP BY label), w AS (SELECT li AS label, sum(d * d) AS s FROM dist WHERE li = lj GROUP BY li), t AS (SELECT sum(n) AS n, count(*) AS k, sum(coalesce(s, 0) / n) AS wi FROM z LEFT JOIN w USING (label)), u AS (SELECT sum(d * d) AS s FROM dist) SELECT n::BIGINT AS n, k, round(s / n, 6) AS ss_total, round(wi, 6) AS ss_within, round(((s / n - wi) / (k - 1)) / (wi / (n - k)), 6) AS f FROM t, u")
def permanova(s, d):
    v = a.vectors(s, d)
    p = stats.group_tests(stats.member_sets(stats.ones(v)), v.select("id", "label"))
    return p.select("n", "k", r6("ss_total").alias("ss_total"), r6("ss_within").alias("ss_within"), r6("f").alias("f"))


@query(f"WITH {a.VECTORS} SELECT round(corr(d, (li <> lj)::INT::DOUBLE), 6) AS r FROM dist")
def mantel(s, d):
    v = a.vectors(s, d)
    return stats.group_tests(stats.member_sets(stats.ones(v)), v.select("id", "label")).select(r6("r").alias("r"))


@query(None)
def permutation_test(s, d):
    """P value of the pseudo-F under 19 label permutations."""
    v = a.vectors(s, d)
    return stats.permutation_p(stats.permuted_tests(stats.member_sets(stats.ones(v)), v.select("id", "label"), 19, 1, of=("f",)), "f")


@query(f"""WITH {a.VECTORS}, b AS (SELECT i AS id, j AS other, lj AS label, h FROM dist UNION ALL SELECT j, i, li, h FROM dist), n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY h, other) <= 5), v AS (SELECT id, label, round(sum(1 / (h + 1e-9)), 6) AS w FROM n GROUP BY ALL)
SELECT id, label AS predicted, round(w, 3) AS weight FROM v QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, label) = 1""")
def nearest_neighbours(s, d):
    v = a.vectors(s, d)
    return stats.votes(stats.nearest(stats.vector_sets(v.select("id", "bits")), 5), v.select("id", "label")).select("id", "predicted", F.round("weight", 3).alias("weight"))


@query(f"""WITH {a.MATRIX}, {a.LABELS}, m AS (SELECT matrix.*, r_name AS label FROM matrix JOIN slabels USING (sample) WHERE value IS NOT NULL), p AS (SELECT label, feature, (sum(value) + 1) / (count(*) + 2) AS p FROM m GROUP BY ALL), pr AS (SELECT r_name AS label, count(*) AS n FROM slabels GROUP BY ALL),
sc AS (SELECT sample, p.label, round(sum(CASE WHEN value = 1 THEN ln(p) ELSE ln(1 - p) END) + any_value(ln(n / (SELECT count(*) FROM slabels))), 6) AS s FROM matrix JOIN p USING (feature) JOIN pr ON pr.label = p.label WHERE value IS NOT NULL GROUP BY ALL)
SELECT sample, label AS predicted, round(s, 4) AS log_score FROM sc QUALIFY row_number() OVER (PARTITION BY sample ORDER BY s DESC, label) = 1""")
def naive_bayes(s, d):
    labels = a.sample_labels(s, d).select(F.col("sample").alias("id"), F.col("labels")[0].alias("label"))
    return stats.naive_bayes(a.matrix(s, d), labels).withColumn("log_score", F.round("log_score", 4))


@query(f"""WITH {a.MATRIX}, {a.LABELS}, n AS (SELECT r_name AS label, count(*) AS n FROM slabels GROUP BY ALL) SELECT (SELECT sum(n)::BIGINT FROM n) AS n_samples, (SELECT count(*) FROM n) AS n_classes, (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM n) AS class_counts, (SELECT round(max(n) / min(n), 6) FROM n) AS imbalance,
count(DISTINCT feature) AS n_features, round(avg((value IS NULL)::INT), 6) AS missing FROM matrix""")
def class_context(s, d):
    labels = a.sample_labels(s, d).select("sample", F.col("labels")[0].alias("label"))
    t = tables.class_context(labels, a.matrix(s, d))
    return t.withColumns({"class_counts": evidence.histogram_text("class_counts"), "imbalance": r6("imbalance"), "missing": r6("missing")})


@query(f"WITH {a.LABELS} SELECT sample, r_name AS label, ((row_number() OVER (PARTITION BY r_name ORDER BY md5(sample::VARCHAR)) - 1) % 5)::INT AS fold FROM slabels")
def stratified_folds(s, d):
    return models.folds(a.sample_labels(s, d).select("sample", F.col("labels")[0].alias("label")), 5)


@query("SELECT source AS candidate, mean, coverage, row_number() OVER (ORDER BY mean DESC, coverage DESC, source)::INT AS place FROM (SELECT source, round(avg(m), 6) AS mean, count(m) AS coverage FROM (SELECT source, lang, avg(n_chars) AS m FROM documents GROUP BY source, lang) GROUP BY source) QUALIFY place <= 3")
def hierarchy_ranking(s, d):
    """The three best candidates by their mean over levels."""
    g = a.table(s, d, "documents").groupBy(F.col("source").alias("candidate"), F.col("lang").alias("level")).agg(F.avg("n_chars").alias("score"))
    return models.rank_candidates(g, 3).withColumn("mean", r6("mean"))


# hierarchies ----------------------------------------------------------------------------------------


@query(f"WITH {_PATHS} SELECT 'toxic' AS label_column, seg AS class, count(*) AS n, count(*) < 60 AS excluded, count(*) < 300 AS review FROM paths GROUP BY seg UNION ALL SELECT 'nation', n_name, count(*), count(*) < 60, count(*) < 300 FROM paths GROUP BY n_name")
def support_policy(s, d):
    p = _paths(s, d)
    rows = p.select(F.lit("toxic").alias("label_column"), F.col("labels")[2].alias("label")).unionByName(p.select(F.lit("nation").alias("label_column"), F.concat(F.lit(" "), F.col("labels")[1]).alias("label")))
    return hierarchy.support_policy(rows, 60, 300)


@query(f"WITH {_PATHS}, p AS (SELECT n_name AS class, count(*) AS n FROM paths GROUP BY n_name) SELECT 'nation' AS label_column, coalesce(string_agg(class, ',' ORDER BY class) FILTER (n < 55), '') AS excluded, coalesce(string_agg(class, ',' ORDER BY class) FILTER (n < 60), '') AS review FROM p")
def support_lists(s, d):
    rows = _paths(s, d).select(F.lit("nation").alias("label_column"), F.col("labels")[1].alias("label"))
    return hierarchy.policy_lists(hierarchy.support_policy(rows, 55, 60))


@query(f"WITH {_PATHS}, p AS (SELECT n_name, count(*) AS n FROM paths GROUP BY n_name) SELECT id, n_name AS routing, CASE WHEN n < 60 THEN 'review_required' ELSE n_name END AS reported FROM paths JOIN p USING (n_name)")
def low_support_review(s, d):
    rows = _paths(s, d).select("id", F.col("labels")[1].alias("label"))
    policy = hierarchy.support_policy(rows.select(F.lit("nation").alias("label_column"), "label"), 55, 60)
    return hierarchy.reported(rows, policy, "nation").select("id", "routing", "reported")


@query(f"WITH {_PATHS} SELECT DISTINCT '' AS node, r_name AS child, r_name AS label, 1 AS depth FROM paths UNION SELECT DISTINCT r_name, r_name || '|' || n_name, n_name, 2 FROM paths UNION SELECT DISTINCT r_name || '|' || n_name, r_name || '|' || n_name || '|' || seg, seg, 3 FROM paths")
def hierarchy_edges(s, d):
    return hierarchy.prefixes(_paths(s, d))


@query(f"WITH {_PATHS} SELECT r_name, n_name, seg, count(*) AS n FROM paths GROUP BY ROLLUP (r_name, n_name, seg)")
def hierarchy_rollup(s, d):
    """Extension: counts of all label prefixes."""
    p = _paths(s, d).select(F.col("labels")[0].alias("r_name"), F.col("labels")[1].alias("n_name"), F.col("labels")[2].alias("seg"))
    return p.rollup("r_name", "n_name", "seg").agg(F.count("*").alias("n"))


@query(f"WITH {a.PROFILES} SELECT node, child, feature, round(mean, 6) AS mean FROM profiles")
def child_profiles(s, d):
    return a.trained(s, d)[2].select("node", "child", "feature", r6("mean").alias("mean"))


_SCORES = "sc AS (SELECT x.sample, p.node, p.child, round(avg(1 - abs(x.value - p.mean)), 9) AS score FROM matrix x JOIN profiles p USING (feature) WHERE x.value IS NOT NULL GROUP BY ALL)"


@query(f"WITH {a.PROFILES}, {_SCORES} SELECT sample, child, round(score, 6) AS score FROM sc WHERE node = ''")
def profile_scores(s, d):
    m, _, prof = a.trained(s, d)
    out = hierarchy.profile_scores(m.select("sample", F.lit("").alias("node")).distinct(), m, prof)
    return out.where("n > 0").select("sample", "child", r6("score").alias("score"))


_WALK = f"{a.PROFILES}, {_SCORES}, one AS (SELECT sample, child, score FROM sc WHERE node = '' QUALIFY row_number() OVER (PARTITION BY sample ORDER BY score DESC, child) = 1), two AS (SELECT sc.sample, sc.node, sc.child, sc.score FROM sc JOIN one ON one.sample = sc.sample AND one.child = sc.node QUALIFY row_number() OVER (PARTITION BY sc.sample ORDER BY sc.score DESC, sc.child) = 1)"


def _scorer(s, d):
    m, _, prof = a.trained(s, d)
    return m, lambda frontier: hierarchy.profile_scores(frontier, m, prof).where("n > 0").withColumn("score", F.round("score", 9))


@query(f"WITH {_WALK} SELECT one.sample, 'region=' || one.child || ' / nation=' || string_split(two.child, '|')[2] AS path FROM one JOIN two ON one.sample = two.sample")
def hierarchy_path(s, d):
    """Flagship: from line items to matrix, profiles, one branch down the tree, and the path's text."""
    m, scorer = _scorer(s, d)
    steps = hierarchy.descend(m.select("sample").distinct(), scorer, 2)
    steps = steps.select("sample", "depth", F.when(F.col("depth") == 1, "region").otherwise("nation").alias("label_column"), F.element_at(F.split("child", "\\|"), -1).alias("label"))
    return hierarchy.path_text(steps)


@query(f"WITH {_WALK} SELECT sample, '' AS node, child, round(score, 6) AS score, 1 AS depth FROM one UNION ALL SELECT sample, node, child, round(score, 6), 2 FROM two")
def hierarchy_descent(s, d):
    m, scorer = _scorer(s, d)
    return hierarchy.descend(m.select("sample").distinct(), scorer, 2).select("sample", "node", "child", r6("score").alias("score"), "depth")


@query(f"""WITH {a.PROFILES}, {_SCORES}, k1 AS (SELECT sample, child, score FROM sc WHERE node = '' AND score > 0.5), k2 AS (SELECT sc.sample, sc.child, least(k1.score, sc.score) AS score FROM sc JOIN k1 ON k1.sample = sc.sample AND k1.child = sc.node WHERE sc.score > 0.5),
t AS (SELECT *, 2 AS depth, true AS terminal FROM k2 WHERE score > 0.6), o AS (SELECT *, 1 AS depth, false AS terminal FROM k1 WHERE score > 0.6 AND sample NOT IN (SELECT sample FROM t))
SELECT sample, child AS path, round(score, 6) AS score, depth, terminal FROM t UNION ALL SELECT sample, child, round(score, 6), depth, terminal FROM o""")
def multi_branch(s, d):
    m, scorer = _scorer(s, d)
    out = hierarchy.branch(m.select("sample").distinct(), scorer, 2, 0.5, 0.6)
    return out.select("sample", "path", r6("score").alias("score"), "depth", "terminal")


_TREE = f"{_PATHS}, cnt AS (SELECT '' AS node, r_name AS child, count(*) AS n FROM paths GROUP BY ALL UNION ALL SELECT r_name, r_name || '|' || n_name, count(*) FROM paths GROUP BY ALL UNION ALL SELECT r_name || '|' || n_name, r_name || '|' || n_name || '|' || seg, count(*) FROM paths GROUP BY ALL), tot AS (SELECT node, sum(n) AS t FROM cnt GROUP BY node), edge AS (SELECT node, child, round(n / t, 9) AS score FROM cnt JOIN tot USING (node))"


def _edges(s, d):
    p = _paths(s, d)
    each = p.select(F.explode(F.expr("transform(sequence(1, size(labels)), k -> struct(array_join(slice(labels, 1, k - 1), '|') AS node, array_join(slice(labels, 1, k), '|') AS child))")).alias("e")).select("e.*")
    n = each.groupBy("node", "child").agg(F.count("*").alias("n"))
    return n.select("node", "child", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("node")), 9).alias("score"))


@query(f"WITH RECURSIVE {_TREE}, p(path, score, depth) AS (SELECT child, score, 1 FROM edge WHERE node = '' UNION ALL SELECT e.child, least(p.score, e.score), p.depth + 1 FROM p JOIN edge e ON e.node = p.path) SELECT path, round(score, 6) AS score, depth FROM p")
def recursive_paths(s, d):
    return hierarchy.recursive_paths(_edges(s, d)).select("path", r6("score").alias("score"), "depth")


@query(f"WITH {_TREE}, x AS (SELECT node, child FROM edge WHERE node NOT LIKE 'ASIA%' AND node NOT LIKE '%|%') SELECT node, child FROM x WHERE node <> 'AFRICA' UNION ALL SELECT CASE node WHEN '' THEN 'AFRICA' ELSE 'AFRICA|' || node END, 'AFRICA|' || child FROM x WHERE node = ''")
def grafted_tree(s, d):
    e = _edges(s, d).select("node", "child").where("node NOT LIKE 'ASIA%' AND node NOT LIKE '%|%'")
    return hierarchy.graft(e, e.where("node = ''"), "AFRICA")


@query("""WITH st AS (SELECT c_custkey AS sample, c_mktsegment AS label, c_nationkey % 3 AS depth FROM customer), m AS (SELECT 'BUILDING' AS label, 'm1' AS model UNION ALL SELECT 'MACHINERY', 'm2' UNION ALL SELECT '', 'g')
SELECT sample, coalesce(m.model, 'g') AS model, CASE WHEN m.model IS NULL THEN 'global' ELSE 'parent' END AS source FROM st LEFT JOIN m USING (label)""")
def terminal_fallback(s, d):
    steps = a.table(s, d, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_mktsegment").alias("label"), (F.col("c_nationkey") % 3).alias("depth"))
    models = s.createDataFrame([("BUILDING", "m1"), ("MACHINERY", "m2"), ("", "g")], "label string, model string")
    return hierarchy.fallback_model(steps, models)


@query("""WITH b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'abstained' ELSE 'success' END AS status, CASE WHEN c_custkey % 7 = 0 THEN 'low_confidence' ELSE 'high_confidence' END AS conf, c_mktsegment AS label, (c_custkey % 10) / 10.0 AS sup, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS g, (c_custkey % 8) / 8.0 AS gs FROM customer)
SELECT id, CASE WHEN status <> 'success' THEN 'branch_node_unavailable' WHEN conf = 'low_confidence' THEN 'low_branch_confidence' WHEN label <> g AND gs >= sup THEN 'global_lineage_disagreement_recovery' END AS reason FROM b""")
def lineage_fallback(s, d):
    k = F.col("c_custkey")
    out = encode.lineage_fallback(F.when(k % 11 == 0, "abstained").otherwise("success"), F.when(k % 7 == 0, "low_confidence").otherwise("high_confidence"), F.col("c_mktsegment"), (k % 10) / F.lit(10.0), F.when(k % 3 == 0, "BUILDING").otherwise(F.col("c_mktsegment")), (k % 8) / F.lit(8.0))
    return a.table(s, d, "customer").select(k.alias("id"), out.alias("reason"))


@query(f"WITH {a.MATRIX}, x AS (SELECT feature, avg((value IS NULL)::INT) AS m FROM matrix GROUP BY feature) SELECT feature, CASE WHEN m = 0 THEN 'complete' WHEN m < 0.5 THEN 'partial' ELSE 'low_feature_coverage' END AS status FROM x")
def alignment_statuses(s, d):
    return cohort.missing_fractions(a.matrix(s, d), "feature").select("feature", encode.alignment_status(F.col("missing"), F.lit(0.0)).alias("status"))


# sources and sinks over text ------------------------------------------------------------------------


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'S' || user_id ELSE 'T' || user_id END AS sample, CASE event_id % 3 WHEN 0 THEN 'L001' ELSE '' END AS lane, (1 + event_id % 2)::VARCHAR AS mate FROM events")
def fastq_name_grammar(s, d):
    e = a.table(s, d, "events")
    m = 1 + F.col("event_id") % 2
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("S"), "user_id", F.lit("_S1_L001_R"), m, F.lit("_001.fastq.gz"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("T"), "user_id", F.lit("_R"), m, F.lit(".fq"))).otherwise(F.concat(F.lit("T"), "user_id", F.lit("_"), m, F.lit(".fastq.gz")))
    rows = e.select(F.concat("event_id", F.lit("/"), name).alias("k")).select(F.substring_index("k", "/", 1).cast("long").alias("event_id"), F.substring_index("k", "/", -1).alias("name"))
    parsed = readers.fastq_names(rows.select("name").distinct())
    return rows.join(parsed, "name").select("event_id", "sample", "lane", "mate")


@query("""WITH t AS (SELECT event_id AS pos, repeat('.', 6 + (event_id % 5)::INT) || repeat('t', (event_id % 4)::INT) || '^I.$+2ac' AS b FROM events), c AS (SELECT pos, 7 + pos % 5 AS nr, pos % 4 AS nt FROM t)
SELECT pos, CASE WHEN nr >= nt THEN 'A' ELSE 'T' END AS allele, (nr + nt)::INT AS depth, round(greatest(nr, nt) / (nr + nt), 6) AS fraction, CASE WHEN nr + nt < 9 THEN 'low_depth' WHEN greatest(nr, nt) / (nr + nt) < 0.75 THEN 'ambiguous' ELSE 'called' END AS state FROM c""")
def pileup_majority(s, d):
    k = F.col("event_id")
    t = a.table(s, d, "events").select(k.alias("pos"), F.lit("A").alias("ref"), F.concat(F.expr("repeat('.', cast(6 + event_id % 5 AS int))"), F.expr("repeat('t', cast(event_id % 4 AS int))"), F.lit("^I.$+2ac")).alias("bases"))
    return pileup.majority(pileup.expanded(t), ["pos"], 9, 0.75).withColumn("fraction", r6("fraction"))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\s+', '', 'g'), '(.{60})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS value FROM documents")
def fasta_wrapping(s, d):
    return a.table(s, d, "documents").select("doc_id", writers.wrapped(F.regexp_replace("text", r"[\t\n\f\r ]+", "")).alias("value"))


@query("SELECT DISTINCT l_returnflag || chr(9) || (l_partkey - 1) || chr(9) || l_partkey AS value FROM lineitem")
def bed_text(s, d):
    return writers.bed_lines(a.table(s, d, "lineitem").select(F.col("l_returnflag").alias("chrom"), F.col("l_partkey").alias("pos")))


# streams (extensions) -------------------------------------------------------------------------------


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)))::BIGINT + 3600 AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def event_sessions(s, d):
    out = streams.sessions(a.table(s, d, "events"))
    return out.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n")


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(s, d):
    return streams.windowed_counts(a.table(s, d, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


from . import extended, files, wider  # noqa: E402, F401  (they register their queries)
